"""Pools, families, quantile bins, model states and search: values against plain NumPy, and awkward rows."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from quantloom.operators import pools as P
from quantloom.operators.models import Hmm
from quantloom.queries import catalog
from quantloom.sources import securities as D
from quantloom.sources import tables

CATALOG = catalog()
NAMES = ("pooled_base_rates", "distribution_closed_forms", "entropy_quantile_bins", "security_search")


@pytest.mark.parametrize("name", NAMES)
def test_equal_to_sql(spark, sf_dir, duck, name):
    got = CATALOG.queries[name](spark, sf_dir).toPandas()
    want = duck.execute(CATALOG.sql[name]).df()[list(got.columns)]
    key = list(got.columns)
    a, b = (x.astype(object).where(x.notna(), None).sort_values(key, key=lambda c: c.map(repr)).values.tolist() for x in (got, want))
    assert len(a) == len(b) and len(a) > 0
    for x, y in zip(a, b):
        assert all(u == v or (isinstance(u, float) and math.isclose(u, v, abs_tol=2e-6)) for u, v in zip(x, y)), (x, y)


def families(x):
    """Distances of the five families, written plainly."""
    x, n = np.sort(np.asarray(x, float)), len(x)
    phi = np.vectorize(lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2))))
    mid = np.median(x)
    out = {"normal": phi((x - x.mean()) / x.std(ddof=1)), "laplace": np.array([0.5 * math.exp((v - mid) / np.abs(x - mid).mean()) if v < mid else 1 - 0.5 * math.exp((mid - v) / np.abs(x - mid).mean()) for v in x])}
    if x[0] > 0:
        out["lognormal"] = phi((np.log(x) - np.log(x).mean()) / np.log(x).std(ddof=1))
        out["exponential"] = 1 - np.exp(-x / x.mean())
        out["pareto"] = 1 - (x[0] / x) ** (n / np.log(x / x[0]).sum())
    return {k: max(max((i + 1) / n - c, c - i / n) for i, c in enumerate(v)) for k, v in out.items()}


def test_families(spark):
    rng = np.random.default_rng(5)
    drawn = {"n": rng.normal(3, 2, 400), "l": rng.laplace(-1, 1, 400), "g": rng.lognormal(0, 1.2, 400), "e": rng.exponential(2, 400), "p": 1 + rng.pareto(3, 400)}
    rows = [(s, float(v)) for s, x in drawn.items() for v in x] + [("few", 1.0)] * 7 + [("flat", 2.0)] * 9 + [("n", None), ("n", math.nan), ("n", math.inf)]
    got = P.fitted_families(spark.createDataFrame(rows, "symbol string, value double")).toPandas()
    for s, x in drawn.items():
        own, want = got[got.symbol == s].set_index("family"), families(x)
        assert set(own.index) == set(want)
        assert all(math.isclose(own.ks[k], v, abs_tol=1e-6) for k, v in want.items())
        assert own["rank"].idxmin() == min(want, key=want.get)
    assert [got[(got.symbol == s) & (got["rank"] == 1)].family.item() for s in "nlgep"] == ["normal", "laplace", "lognormal", "exponential", "pareto"]
    assert list(got[got.symbol == "flat"].family) == ["exponential"] and not len(got[got.symbol == "few"])


def test_quantile_entropy(spark):
    rng = np.random.default_rng(2)
    days = pd.bdate_range("2020-01-01", periods=120).date
    closes = {"a": 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 120))), "tied": 100 * 2.0 ** np.cumsum(rng.integers(-1, 2, 120)), "flat": np.full(120, 5.0), "short": np.full(8, 5.0)}
    rows = [(s, d, float(v)) for s, x in closes.items() for d, v in zip(days, x)]
    got = {(r.symbol, r.days): (r.entropy, r.n) for r in P.quantile_entropy(spark.createDataFrame(rows, "symbol string, date date, close double"), (21, 252)).collect()}
    for s in ("a", "tied"):
        ret = closes[s][1:] / closes[s][:-1] - 1
        edges = np.quantile(ret, np.linspace(0, 1, 11))
        for i in range(1, 11):
            edges[i] = np.nextafter(edges[i - 1], np.inf) if edges[i] <= edges[i - 1] else edges[i]
        for n in (21, 252):
            c = np.bincount(np.digitize(ret[-n:], edges[1:-1]))
            p = c[c > 0] / c.sum()
            assert got[s, n][1] == min(n, 119)
            assert math.isclose(got[s, n][0], -(p * np.log2(p)).sum() / math.log2(10), abs_tol=1e-9)
    assert got["flat", 21] == (0.0, 21) and ("short", 21) not in got


def test_states(spark):
    rng = np.random.default_rng(4)
    ret = np.r_[rng.normal(0.002, 0.004, 300), rng.normal(-0.004, 0.03, 200), rng.normal(0.002, 0.004, 200)]
    days = pd.bdate_range("2018-01-01", periods=701).date
    close = 100 * np.exp(np.r_[0, np.cumsum(ret)])
    rows = [("x", d, float(v)) for d, v in zip(days, close)] + [("young", d, 1.0 + i) for i, d in enumerate(days[:100])]
    got = P.state_opinion(spark.createDataFrame(rows, "symbol string, date date, close double")).toPandas()
    assert list(got.symbol.unique()) == ["x"] and sorted(got.state) == ["bear", "bull", "neutral"]
    assert math.isclose(got.p.sum(), 1) and math.isclose(got["share"].sum(), 1) and math.isclose(got.path_share.sum(), 1)
    assert got.path_now.sum() == 1 and (got.days >= 1).all() and set(got.n_days) == {691}
    assert set(got.label) == {got.loc[got.p.idxmax(), "state"]} and got.label.iloc[0] != "bear"


def test_likeliest_path_and_long_run():
    """Viterbi against all paths of a short series; the long-run shares against the powers of the transition matrix."""
    x = np.random.default_rng(1).normal(size=(200, 2)) * np.tile(np.repeat([1.0, 4.0], 20), 5)[:, None]  # states that come back, so that none lasts for ever
    m = Hmm(rounds=30, starts=1).fit(x)
    part = x[95:102].copy()
    log, move = m._log_density(part), np.log(np.maximum(m.move, 1e-300))
    score = lambda p: math.log(max(m.start[p[0]], 1e-300)) + sum(log[t, s] for t, s in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:]))
    assert math.isclose(score(tuple(m.viterbi(part))), max(map(score, itertools.product(range(3), repeat=len(part)))))
    assert np.allclose(m.stationary(), m.stationary() @ m.move, atol=1e-6)
    assert np.allclose(m.durations(), 1 / (1 - np.diag(m.move)))


def test_pools_of_awkward_members(spark):
    days = [d.date() for d in pd.date_range("2018-01-01", periods=900)]
    rng = np.random.default_rng(3)
    rows = [(s, d, float(v)) for s in ("i", "x") for d, v in zip(days, 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 900))))]
    bars = spark.createDataFrame(rows, "symbol string, date date, close double")
    members = spark.createDataFrame([("x", "i"), ("new", "i"), ("y", "gone"), ("z", None)], "symbol string, pool string")
    got = {(r.symbol, r.h): r for r in P.pooled_base_rates(bars, members, (1, 3)).collect()}
    assert set(got) == {("x", 1), ("x", 3), ("new", 1), ("new", 3)}
    new, x = got["new", 3], got["x", 3]
    assert new.cell is None and new.w == 0 and new.shrunk_q50 == new.q50 and new.n == x.n
    assert math.isclose(x.w, (x.cond_n / 3) / (x.cond_n / 3 + 24)) and x.cond_n > 0
    assert math.isclose(x.shrunk_q50, x.w * x.cond_q50 + (1 - x.w) * x.q50)


def test_search(spark):
    schema = "ticker string, name string, primary_exchange string, type string, market string, active boolean"
    listed = spark.createDataFrame([
        (" ab ", "Alpha  Beta Corp", "N", "CS", "stocks", True), ("abc", "Gamma", None, "etf", "stocks", True), ("AB", "Other", "X", "INDEX", "indices", True), ("X1", "Beta coin", None, None, "crypto", True),
        ("", "none", "N", "CS", "stocks", True), (None, None, None, None, None, None), ("ABX", "abandoned", "N", "CS", "stocks", False), ("Z", None, None, "CS", "stocks", True), ("ZZ", "x", None, "CS", "bonds", True),
    ], schema)
    d = D.securities(listed)
    assert sorted(map(tuple, d.select("symbol", "exchange", "asset_type").collect())) == [("AB", "N", "equity"), ("ABC", "", "etf"), ("X1", "", "crypto"), ("Z", "", "equity")]
    asked = spark.createDataFrame([("ab",), (" ab ",), ("BETA c",), ("beta",), ("",), (None,), ("q" * 101,), ("mma",)], "query string")
    got = {}
    for r in D.search(d, asked).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.symbol)
    assert got == {"ab": ["AB", "ABC"], "BETA c": ["AB", "X1"], "beta": ["AB", "X1"]}
    assert D.search(d.limit(0), asked).count() == 0
    with pytest.raises(ValueError):
        D.search(d, asked, 11)


def test_queries_without_sql(spark, sf_dir):
    volumes = tables.bars_smooth(spark, sf_dir).select("symbol", "volume").toPandas().groupby("symbol")["volume"]
    got = CATALOG.queries["distribution_families"](spark, sf_dir).toPandas().set_index(["symbol", "family"]).ks
    checked = 0
    for s, x in volumes:
        if len(x) >= 8:
            for k, v in families(x).items():
                assert math.isclose(got[s, k], v, abs_tol=2e-6)
                checked += 1
    assert checked == len(got) > 0
