"""Exposures against loops over rows, and implied distributions against the lognormal that priced the chain."""

import datetime
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest

from quantloom.operators import exposures as E
from quantloom.operators import implied as I
from quantloom.operators import options as O

CONFIG = E.ExposureConfig(draws=60)
LEGS = ["a", "b", "c"]


def months(n, first=(2010, 1)):
    return [datetime.date(first[0] + (first[1] - 1 + i) // 12, (first[1] - 1 + i) % 12 + 1, 1) for i in range(n)]


def ridge(x, y, w, lam):
    w = w / w.sum()
    mean = w @ x
    sd = np.sqrt(w @ (x - mean) ** 2)
    sd = np.where(sd > 1e-12, sd, 1.0)
    z = (x - mean) / sd
    b = np.linalg.solve((z * w[:, None]).T @ z + lam * np.eye(x.shape[1]), (z * w[:, None]).T @ (y - w @ y)) / sd
    return b, w @ y - b @ mean


def table(n=90, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.04, (n, 3))
    y = {s: x @ rng.normal(1, 0.5, 3) + rng.normal(0, 0.02, n) for s in "AB"}
    return months(n), x, y


def frames(spark, when, x, y):
    basket = [(m, leg, float(v)) for m, row in zip(when, x) for leg, v in zip(LEGS, row) if np.isfinite(v)]
    own = [(s, m, float(v)) for s, ys in y.items() for m, v in zip(when, ys)] + [("Z", when[0], 0.1), ("A", None, None)]
    return spark.createDataFrame(own, "symbol string, month date, y double").where("month is not null"), spark.createDataFrame(basket, "month date, leg string, x double")


def test_exposures_equal_loops(spark):
    when, x, y = table()
    got = {r.symbol: r for r in E.exposures(*frames(spark, when, x, y), LEGS, CONFIG).collect()}
    assert set(got) == {"A", "B"}  # one month is too few
    years = np.array([m.year for m in when])
    for s, own in y.items():
        error = {}
        for lam in CONFIG.penalties:
            error[lam] = 0.0
            for year in sorted(set(years)):
                held = years == year
                b, c = ridge(x[~held], own[~held], np.ones((~held).sum()), lam)
                error[lam] += ((own[held] - x[held] @ b - c) ** 2).sum()
        lam = min(error, key=error.get)
        w = 0.5 ** (np.arange(89, -1, -1) / 24)
        b, c = ridge(x, own, w, lam)
        r, rest = got[s], own - x @ b - c
        assert (r.penalty, r.alpha, r.r2, r.residual) == pytest.approx((lam, c, 1 - (rest**2).sum() / ((own - own.mean()) ** 2).sum(), rest.std(ddof=1) * math.sqrt(12)), rel=1e-9)
        rng, drawn = np.random.default_rng(CONFIG.seed), []
        for _ in range(CONFIG.draws):
            i = rng.integers(0, 90, size=90)
            drawn.append(ridge(x[i], own[i], w[i], lam)[0])
        assert [v.beta for v in r.betas] == pytest.approx(b, rel=1e-9) and [v.se for v in r.betas] == pytest.approx(np.std(drawn, axis=0, ddof=1), rel=1e-7)
        path = {(p.leg, p.month): p.beta for p in r.path}
        assert len(path) == 3 * 25
        at = {}
        for end in range(66, 91):
            lo = max(0, end - 60)
            at[end] = ridge(x[lo:end], own[lo:end], 0.5 ** (np.arange(end - lo - 1, -1, -1) / 24), lam)[0]
            assert [path[leg, when[end - 1]] for leg in LEGS] == pytest.approx(at[end], rel=1e-8)
        assert [v.change_6 for v in r.betas] == pytest.approx(at[90] - at[84], rel=1e-6, abs=1e-12) and [v.change_12 for v in r.betas] == pytest.approx(at[90] - at[78], rel=1e-6, abs=1e-12)


def test_short_legs_are_pruned(spark):
    when, x, y = table()
    x[:70, 2] = np.nan
    (a, _) = sorted(E.exposures(*frames(spark, when, x, y), LEGS, CONFIG).collect())
    assert a.pruned == ["c"] and a.months == 90 and [v.leg for v in a.betas] == ["a", "b"]
    m, basket = frames(spark, when, x, y)
    assert E.exposures(m.limit(0), basket, LEGS, CONFIG).count() == 0 and E.exposures(m, basket.limit(0), LEGS, CONFIG).count() == 0


AS_OF, SPOT, VOL, RATE = "2024-01-02", 100.0, 0.3, 0.04


def lognormal(days=182, spot=SPOT, name="A", step=2.0):
    expiry = datetime.date(2024, 1, 2) + datetime.timedelta(days=days)
    rows = [(name, spot, expiry, k, kind, O.price(spot, k, days / 365.25, RATE, VOL, kind == "call")) for k in np.arange(30.0, 260.0, step).tolist() for kind in ("call", "put")]
    return rows


SCHEMA = "underlying string, spot double, expiry date, strike double, type string, mid double"


def test_lognormal_chain_gives_back_its_quantiles(spark):
    rows = lognormal() + [("A", SPOT, datetime.date(2024, 7, 2), None, "call", 1.0), ("A", SPOT, datetime.date(2024, 7, 2), 100.0, "call", None), ("B", None, datetime.date(2024, 7, 2), 100.0, "call", 2.0)]
    rows += [("C", 100.0, datetime.date(2024, 7, 2), k, "call", 5.0) for k in (90.0, 100.0)]
    got = I.implied(spark.createDataFrame(rows, SCHEMA), AS_OF, RATE).collect()
    assert {r.underlying for r in got} == {"A"} and sorted(r.months for r in got) == [1, 2, 3, 6, 12, 18]  # one expiry serves all
    r, t = got[0], 182 / 365.25
    sd, mean = VOL * math.sqrt(t), (RATE - VOL * VOL / 2) * t
    for level, q in zip(I.LEVELS, (r.q05, r.q25, r.q50, r.q75, r.q95)):
        assert q == pytest.approx(math.expm1(mean + sd * NormalDist().inv_cdf(level)), abs=0.01)
    for p, k, up in ((r.p_up10, 1.1, True), (r.p_dn10, 0.9, False), (r.p_up20, 1.2, True), (r.p_dn20, 0.8, False)):
        below = NormalDist(mean, sd).cdf(math.log(k))
        assert p == pytest.approx(1 - below if up else below, abs=0.01)
    assert r.iv_atm == pytest.approx(VOL, abs=1e-4) and r.skew_25d == pytest.approx(0, abs=1e-4) and r.rn_mean == pytest.approx(math.expm1(RATE * t)) and r.quality == "ok" and r.monotone
    pdf = [x.pdf for x in r.density]
    k = [x.k for x in r.density]
    assert np.trapezoid(pdf, k) == pytest.approx(1) and min(pdf) >= 0 and len(k) == 61


def test_shift_to_base_rates(spark):
    rows = I.implied(spark.createDataFrame(lognormal(), SCHEMA), AS_OF, RATE)
    rates = spark.createDataFrame([("A", 6, 0.2, 0.05), ("A", 1, 0.0, 0.01)], "symbol string, months int, iqr double, median double")
    got = {r.months: r for r in I.to_base_rates(rows, rates).collect()}
    six = got[6]
    assert six.mean_shift == pytest.approx(0.05 - six.rn_mean) and six.rw_q50 == pytest.approx(six.q50 + six.mean_shift) and six.width_ratio == pytest.approx((six.q75 - six.q25) / 0.2)
    assert got[1].width_ratio is None and got[1].mean_shift is not None and got[12].mean_shift is None and got[12].rw_q05 is None
    assert I.implied(spark.createDataFrame([], SCHEMA), AS_OF).count() == 0


def test_arrays_equal_the_scalar_model():
    k = np.array([80.0, 100.0, 130.0])
    for call in (True, False):
        v = I.value(100.0, k, 0.5, 0.03, np.full(3, 0.25), call, 0.01)
        assert v == pytest.approx([O.price(100.0, x, 0.5, 0.03, 0.25, call, 0.01) for x in k])
        up, down = (I.value(100.0 + e, k, 0.5, 0.03, np.full(3, 0.25), call, 0.01) for e in (1e-3, -1e-3))
        assert I.delta(100.0, k, 0.5, 0.03, np.full(3, 0.25), call, 0.01) == pytest.approx((up - down) / 2e-3, abs=1e-6)


def test_price_as_columns(spark):
    from pyspark.sql import functions as F

    x = spark.createDataFrame([(100.0, 90.0, 0.5, 0.3, True), (100.0, 90.0, 0.5, 0.3, False)], "s double, k double, t double, v double, c boolean")
    got = [r[0] for r in x.select(I.priced(F.col("s"), F.col("k"), F.col("t"), F.col("v"), F.col("c"))).collect()]
    assert got == pytest.approx([O.price(100.0, 90.0, 0.5, 0.04, 0.3, c) for c in (True, False)])
