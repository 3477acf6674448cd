"""Cycles, components and mixtures against plain NumPy and closed forms."""

import math

import numpy as np
import pandas as pd
import pytest
from statistics import NormalDist

from quantloom.operators import components as C
from quantloom.operators import cycles, stack
from quantloom.operators import models as M
from quantloom.queries import catalog
from quantloom.sources import tables

QUERIES = catalog().queries
SF = "/root/testdata/sf0.01"
N = NormalDist()


@pytest.fixture(scope="module")
def closes(spark):
    return tables.bars_smooth(spark, SF).select("symbol", "date", "close").toPandas().sort_values(["symbol", "date"])


def test_planted_cycle(spark):
    t = np.arange(1000)
    log = 0.0004 * t + 0.05 * np.sin(2 * math.pi * t / 50) + 0.002 * np.random.default_rng(3).normal(size=1000)
    days = pd.date_range("2015-01-01", periods=1000).date
    bars = spark.createDataFrame([("A", d, float(math.exp(x))) for d, x in zip(days, log)] + [("B", days[0], 1.0), ("B", days[1], -1.0)], "symbol string, date date, close double")
    got = cycles.sections(bars).collect()
    assert [r.symbol for r in got] == ["A"]
    r = got[0]
    assert r.dominant == pytest.approx(50) and r.r2 > 0.95 and r.check.label == "consistent" and r.limit == pytest.approx(12.5)
    assert r.modes[0].amplitude == pytest.approx(0.05, abs=0.003)
    one = next(x for x in r.ahead if x.h == 1)
    assert one.truncated and one.confidence < 0.3
    assert cycles.sections(bars.limit(0)).count() == 0


def plain_modes(rest):
    n = len(rest)
    f = np.fft.rfft(rest)
    own = sorted((k for k in range(1, len(f)) if 5 <= n / k <= n / 2), key=lambda k: -abs(f[k]))[:5]
    return [(k, 2 * abs(f[k]) / n, float(np.angle(f[k]))) for k in own]


def test_consistency_and_projection(spark, closes):
    check = {r.symbol: r for r in QUERIES["cycle_consistency"](spark, SF).collect()}
    ahead = {(r.symbol, r.h): r for r in QUERIES["cycle_projection"](spark, SF).collect()}
    modes = {(r.symbol, r["rank"]): r for r in QUERIES["cycle_modes"](spark, SF).collect()}
    for symbol, own in list(closes.groupby("symbol"))[:4]:
        log = np.log(own["close"].to_numpy())
        n, t = len(log), np.arange(len(log))
        rest = log - np.polyval(np.polyfit(t, log, 1), t)
        at = lambda found, m, x: sum(a * math.cos(2 * math.pi * k * x / m + p) for k, a, p in found)

        def miss(end):
            found = plain_modes(rest[:end])
            return math.sqrt(np.mean([(rest[end + i] - at(found, end, end + i)) ** 2 for i in range(60)]))

        earlier = [miss(end) for end in range(240, n - 59, 30)]
        z = (miss(n - 60) - np.mean(earlier)) / np.std(earlier, ddof=1)
        r = check[symbol]
        assert (r.error, r.usual, r.spread, r.z, r.blocks) == pytest.approx((miss(n - 60), np.mean(earlier), np.std(earlier, ddof=1), z, len(earlier)), abs=2e-6)
        assert r.label == ("consistent" if z <= 1 else "drifting" if z <= 2.5 else "broken")
        found = plain_modes(rest)
        fitted = np.array([at(found, n, i) for i in range(n)])
        r2 = 1 - ((rest - fitted) ** 2).sum() / ((rest - rest.mean()) ** 2).sum()
        period = n / found[0][0]
        slope = np.median(np.diff(log)[-504:]) / 2
        assert modes[symbol, 1].k == found[0][0] and modes[symbol, 1].amplitude == pytest.approx(found[0][1], abs=2e-6)
        for h, days in cycles.HORIZONS.items():
            limit = max(period / 4, 1)
            swing = r2 * (at(found, n, n - 1 + min(days, limit)) - fitted[-1])
            sure = r2 / (1 + days / period) * min(max(1 - abs(z) / 4, 0.1), 1)
            if days > limit:
                sure = min(sure, 0.29) * limit / days
            x = ahead[symbol, h]
            assert (x.expected, x.confidence, x.truncated) == pytest.approx((math.expm1(slope * days + swing), sure, days > limit), abs=2e-6)


def test_regime_model(spark, closes):
    row = C.regime_model(tables.bars_smooth(spark, SF).where("symbol = 'Brand#11'")).collect()[0]
    move = np.array([s.moves for s in row.states])
    p = np.array([s.posterior for s in row.states])
    assert sorted(s.label for s in row.states) == ["bear", "bull", "neutral"] and p.sum() == pytest.approx(1) and move.sum(axis=1) == pytest.approx(1)
    by = {s.label: s.mean_return for s in row.states}
    assert by["bear"] <= by["neutral"] <= by["bull"]
    still = np.array([s.stationary for s in row.states])
    assert still @ move == pytest.approx(still, abs=1e-9)
    for k, s in enumerate(row.states):
        assert s.duration == pytest.approx(1 / (1 - move[k, k])) and s.n == sum(d.state == s.label for d in row.days)
        for a in s.ahead:
            q, total = p.copy(), 0.0
            for _ in range(a.h):
                total, q = total + q[k], q @ move
            assert a.days == pytest.approx(total)
    # the component, from the same model
    got = {(r.symbol, r.months): r for r in QUERIES["component_regime"](spark, SF).collect()}
    label = {d.date: d.filtered for d in row.days}
    for symbol, own in list(closes.groupby("symbol"))[:5]:
        own = own.assign(next=own["close"].shift(-1) / own["close"] - 1, label=own["date"].map(label)).dropna()
        g = own.groupby("label")["next"].agg(["mean", "std", "count"])
        for months in (1, 12):
            days = {s.label: next(a.days for a in s.ahead if a.months == months) for s in row.states}
            use = g[g["count"] >= 10]
            mean, var = sum(days[k] * use["mean"][k] for k in use.index), sum(days[k] * use["std"][k] ** 2 for k in use.index)
            assert (got[symbol, months].value, got[symbol, months].sigma) == pytest.approx((math.expm1(mean), math.sqrt(var)), abs=2e-6)


def test_viterbi_is_the_best_path():
    m = M.Hmm(states=2)
    m.mean, m.cov, m.start = np.array([[0.0], [1.0]]), np.array([[[1.0]], [[0.5]]]), np.array([0.6, 0.4])
    m.move = np.array([[0.8, 0.2], [0.3, 0.7]])
    x = np.random.default_rng(1).normal(size=(8, 1))
    log = m._log_density(x)
    score = lambda path: math.log(m.start[path[0]]) + log[0, path[0]] + sum(math.log(m.move[a, b]) + log[t + 1, b] for t, (a, b) in enumerate(zip(path, path[1:])))
    best = max((tuple((i >> t) & 1 for t in range(8)) for i in range(256)), key=score)
    assert tuple(m.viterbi(x)) == best


def test_factor_component(spark, closes):
    ret = closes.assign(ret=closes.groupby("symbol")["close"].pct_change()).dropna()
    names = ["Brand#11", "Brand#12", "Brand#13"]
    premia = ret[ret.symbol.isin(names)].groupby("symbol")["ret"].mean()[names].to_numpy()
    wide = ret[ret.symbol.isin(names)].pivot(index="date", columns="symbol", values="ret")[names].dropna()
    got = {(r.symbol, r.months): r for r in QUERIES["component_factors"](spark, SF).collect()}
    for symbol, own in list(ret[~ret.symbol.isin(names)].groupby("symbol"))[:5]:
        both = own.set_index("date")[["ret"]].join(wide, how="inner").sort_index().tail(1260)
        a, y = np.c_[np.ones(len(both)), both[names]], both["ret"].to_numpy()
        b = np.linalg.lstsq(a, y, rcond=None)[0]
        rest = y - a @ b
        r2, sd = 1 - rest @ rest / ((y - y.mean()) ** 2).sum(), math.sqrt(rest @ rest / (len(y) - 4))
        r = got[symbol, 6]
        assert (r.value, r.sigma) == pytest.approx((math.expm1(math.log1p(b[1:] @ premia) * 126), sd / math.sqrt(max(1 - r2, 0.02)) * math.sqrt(126)), abs=2e-6)


def integral(parts, lo, hi, f):
    x = np.linspace(lo, hi, 400_001)
    y = sum(w * np.exp(-(((x - m) / s) ** 2) / 2) / (s * math.sqrt(2 * math.pi)) for w, m, s in parts)
    return np.trapezoid(y * f(x), x)


def test_mixture_figures(spark):
    groups = {"A": [(0.5, 0.05, 0.2), (0.3, -0.1, 0.1), (0.2, 0.3, 0.4)], "B": [(1.0, 0.02, 0.15)]}
    rows = [(k, 6, 126, [("c", *map(float, p)) for p in v]) for k, v in groups.items()] + [("C", 6, 126, []), ("D", 6, 126, None)]
    schema = "symbol string, months int, h int, parts array<struct<component: string, weight: double, mean: double, sd: double>>"
    got = {r.symbol: r for r in C.mix(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"A", "B"}
    for k, parts in groups.items():
        r = got[k]
        mean = sum(w * m for w, m, _ in parts)
        sd = math.sqrt(sum(w * (s * s + m * m) for w, m, s in parts) - mean**2)
        lo, hi = mean - sd / 2, mean + sd / 2
        whole = (mean - 12 * sd, mean + 12 * sd)
        first = integral(parts, *whole, np.exp)
        assert r.mean == pytest.approx(first - 1, abs=1e-7)
        central = [integral(parts, *whole, lambda x, o=o: (np.exp(x) - first) ** o) for o in (2, 3, 4)]
        assert (r.std, r.skew, r.kurtosis) == pytest.approx((math.sqrt(central[0]), central[1] / central[0] ** 1.5, central[2] / central[0] ** 2), rel=1e-5)
        want = M.cases(parts)
        assert (r.p_bear, r.p_neutral, r.p_bull) == pytest.approx((want["p_bear"], want["p_neutral"], want["p_bull"]), abs=1e-9)
        assert (r.bear_p50, r.neutral_p50, r.bull_p50) == pytest.approx((want["bear"], want["neutral"], want["bull"]), abs=1e-8)
        for name, a, b in (("bear", whole[0], lo), ("neutral", lo, hi), ("bull", hi, whole[1])):
            inside = integral(parts, a, b, lambda x: x) / integral(parts, a, b, np.ones_like)
            assert r[f"{name}_expected"] == pytest.approx(math.expm1(inside), abs=1e-6)
        assert (r.q25, r.q50, r.q75) == pytest.approx([math.expm1(M.mixture_quantile(p, parts)) for p in (0.25, 0.5, 0.75)], abs=1e-8)


def test_parts_match_two_moments(spark):
    x = spark.createDataFrame([("A", "u", 1, 21, 0.1, 0.3), ("A", "v", 1, 21, -1.2, 0.3), ("A", "w", 1, 21, 0.0, 0.2), ("A", "z", 1, 21, 0.0, None)], "symbol string, component string, months int, h int, calibrated double, sigma double")
    w = spark.createDataFrame([("A", "u", 0.2), ("A", "v", 0.5), ("A", "w", 0.2), ("A", "z", 0.1)], "symbol string, component string, weight double")
    (row,) = C.parts(x, w).collect()
    assert [(p.component, p.weight) for p in row.parts] == [("u", 0.5), ("w", 0.5)]
    m, s = row.parts[0].mean, row.parts[0].sd
    assert math.exp(m + s * s / 2) - 1 == pytest.approx(0.1) and math.exp(m + s * s / 2) * math.sqrt(math.expm1(s * s)) == pytest.approx(0.3)


def test_recommendation_zone_and_goals(spark):
    figures = {f: 0.0 for f in C.FIGURES} | {"p_bull": 0.5, "p_bear": 0.2, "q25": -0.1, "q50": 0.1, "q75": 0.3, "bull_p50": 0.4, "bear_p50": -0.3}
    mixed = spark.createDataFrame([{"symbol": "A", "months": m, "h": 1, **figures} for m in (3, 6, 12)] + [{"symbol": "B", "months": 3, "h": 1, **figures, "p_bull": 0.2, "p_bear": 0.6}])
    prices = spark.createDataFrame([("A", 50.0), ("B", 0.0)], "symbol string, price double")
    zone = C.zones(mixed, prices)
    (z,) = zone.collect()
    assert tuple(z) == ("A", 50.0, pytest.approx(45), pytest.approx(55), pytest.approx(65), pytest.approx(1 / 1.1 - 1))
    labels = spark.createDataFrame([("A", "noise"), ("B", "structure")], "symbol string, label string")
    share = spark.createDataFrame([("A", 1.0), ("B", 0.5)], "symbol string, share double")
    got = {r.symbol: tuple(r)[1:] for r in C.recommendations(mixed, zone, labels, share).collect()}
    assert got == {"A": (0.3, 0.1, 0.4, "strong_buy", round(0.4 / 0.6 * 0.7, 3), "normal"), "B": (-0.4, None, -0.4, "strong_sell", round(0.4 / 0.6 * 1.15 * 0.75, 3), "normal")}
    goals = {(r.months, r.kind): r.target for r in C.targets(mixed, prices).collect()}
    assert goals == {(3, "exit"): pytest.approx(70), (6, "exit"): pytest.approx(70), (12, "exit"): pytest.approx(70), (3, "reassess"): pytest.approx(35)}


def test_whole_forecast_hangs_together(spark):
    rows = QUERIES["forecast_mixture"](spark, SF).collect()
    assert len(rows) == 25 * 6
    for r in rows:
        assert r.p_bear + r.p_neutral + r.p_bull == pytest.approx(1, abs=3e-6)
        assert -1 < r.bear_p10 < r.bear_p50 < r.bear_p90 <= r.cut_low + 1e-6 and r.cut_high - 1e-6 <= r.bull_p10 < r.bull_p50 < r.bull_p90
    parts = QUERIES["forecast_parts"](spark, SF).toPandas()
    assert parts.groupby(["symbol", "months"]).weight.sum().to_numpy() == pytest.approx(1, abs=1e-5) and set(parts.component) == {"seasonality", "regime", "factors", "spectral", "fundamentals", "macro"}


def test_empty_bars(spark):
    none = tables.bars_smooth(spark, SF).limit(0)
    for x in (C.seasonality(none), C.regime(none, "A"), C.factors(none, ["A", "B"]), C.spectral(none), C.regime_model(none), stack.feature_panel(none, none.selectExpr("symbol", "symbol AS etf"))):
        assert x.count() == 0
    assert {r.source for r in C.market_prior(none, "A").collect()} == {"assumed"}
