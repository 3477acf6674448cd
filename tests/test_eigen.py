"""The eigen section: values against plain NumPy and pandas, and awkward rows."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import eigen as E
from quantloom.plans import eigen

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def panel():
    """Two symbols of days by signals: gaps, a constant, a signal that one of them lacks, values far from zero."""
    rng = np.random.default_rng(11)
    out = {}
    for symbol in ("P", "Q"):
        n = 200
        f = rng.normal(size=n)
        x = pd.DataFrame({"a": 1e6 + f, "b": f + rng.normal(size=n), "c": rng.normal(size=n), "d": 3.0}, index=pd.date_range("2023-01-01", periods=n))
        x.loc[x.index[rng.integers(0, n, 15)], "b"] = np.nan
        x["ret"] = 0.01 * (f + x["c"] * np.where(np.arange(n) < 100, 1, -1) + 0.3 * rng.normal(size=n))
        x["label"] = np.where(np.arange(n) < 100, "up", "down")
        out[symbol] = x
    out["Q"] = out["Q"].drop(columns="c").assign(c=np.nan)
    return out


@pytest.fixture(scope="module")
def tables(spark, panel):
    rows = [(s, d.date(), n, float(v)) for s, x in panel.items() for n in NAMES for d, v in x[n].items()]
    rows += [("P", panel["P"].index[0].date(), "other", 1.0), ("R", panel["P"].index[0].date(), "a", math.inf), ("R", panel["P"].index[0].date(), "b", None)]
    signals = spark.createDataFrame(rows, "symbol string, date date, signal string, x double")
    target = spark.createDataFrame([(s, d.date(), float(v)) for s, x in panel.items() for d, v in x["ret"].items()] + [("R", panel["P"].index[0].date(), 0.1)], "symbol string, date date, ret double")
    labels = spark.createDataFrame([(s, d.date(), v) for s, x in panel.items() for d, v in x["label"].items()], "symbol string, date date, label string")
    return signals, target, labels


def test_axes(tables, panel):
    got = {r.symbol: r for r in E.axes(tables[0], NAMES).collect()}
    assert set(got) == {"P", "Q"}  # R has no usable value
    for symbol, own in (("P", ["a", "b", "c"]), ("Q", ["a", "b"])):
        x = panel[symbol][own].dropna()
        z = ((x - x.mean()) / x.std(ddof=0)).to_numpy()
        _, single, axes = np.linalg.svd(z, full_matrices=False)
        r = got[symbol]
        assert (r.features, r.constant, r.n) == (own, ["d"], len(x))
        np.testing.assert_allclose(r.eigenvalues, single**2 / (len(x) - 1), rtol=1e-6)
        np.testing.assert_allclose(r.shares, single**2 / (single**2).sum(), rtol=1e-6)
        for c, axis in enumerate(axes):
            mine = np.array([e.loading for e in r.loadings if e.component == c + 1])
            np.testing.assert_allclose(mine, axis * np.sign(axis[np.abs(axis).round(9).argmax()]), atol=1e-5)


def test_ranking(tables, panel):
    got = {(r.symbol, r.signal): r for r in E.ranking(tables[0], tables[1], NAMES, (100, 40)).collect()}
    for symbol, x in panel.items():
        ahead = np.expm1(np.log1p(x["ret"]).rolling(21).sum().shift(-21))
        for n in NAMES:
            r = got[symbol, n]
            flat = x[n].dropna().nunique() < 2
            for k in (100, 40):
                both = x[[n, "ret"]].iloc[-k:].dropna()
                assert r[f"n_{k}"] == len(both)
                assert r[f"corr_{k}"] is None if flat else math.isclose(r[f"corr_{k}"], both[n].corr(both["ret"]), abs_tol=1e-6)
            assert r.forward_corr is None if flat else math.isclose(r.forward_corr, x[n].corr(ahead), abs_tol=1e-6)
        order = sorted(NAMES, key=lambda n: (-abs(got[symbol, n].corr_100 or 0), n))
        assert [got[symbol, n].rank for n in order] == [1, 2, 3, 4] and got[symbol, "a"].ranked_by == "corr_100"
    assert got["R", "a"].rank is None and got["R", "a"].ranked_by is None


def test_symmetry(spark, tables, panel):
    signals, target, labels = tables
    both = signals.unionByName(target.where("symbol != 'R'").selectExpr("symbol", "date", "'y' AS signal", "ret AS x"))
    got = {(r.symbol, r.a, r.b): r for r in E.symmetry(both, labels, [*NAMES, "y"]).collect()}
    x = panel["P"][["a", "b", "c", "ret", "label"]].dropna()
    per = [g for _, g in x.groupby("label")]
    for pair, state in ((("a", "b"), "invariant"), (("c", "y"), "broken")):
        want = sorted(g[pair[0]].corr(g["ret" if pair[1] == "y" else pair[1]]) for g in per)
        r = got["P", *pair]
        np.testing.assert_allclose([r.lo, r.hi], want, atol=1e-6)
        assert r.state == state and r.regimes == 2
    odd = [k for k in got if "d" in k or k[0] == "R" or k == ("Q", "b", "c")]
    assert not odd, [got[k] for k in odd]
    assert E.symmetry(both, labels.where("label = 'up'"), [*NAMES, "y"]).count() == 0  # one regime


def plain_load(x, names, weigh):
    """Weights by each set of names, compared as written in the contract."""
    base, out = weigh(x, names), {}
    for gone in names:
        alt = weigh(x, [n for n in names if n != gone])
        mass = sum(base[n] for n in alt)
        out[gone] = (base[gone], sum(abs(alt.get(n, 0) - base[n]) for n in names), sum(abs(alt[n] - base[n] / mass) for n in alt) if len(alt) > 1 else None)
    return out


def plain_ridge(x, names):
    if not names:
        return {}
    c = x[[*names, "ret"]].corr().to_numpy()
    b = np.abs(np.linalg.solve(c[:-1, :-1] + 0.1 * np.eye(len(names)), c[:-1, -1]))
    return dict(zip(names, b / b.sum()))


def test_load_bearing(tables, panel):
    sets = E.candidates(tables[0], tables[1], NAMES)
    got = {(r.symbol, r.signal): r for r in E.load_bearing(sets, E.by_ridge()).collect()}
    assert {k for k in got} == {("P", "a"), ("P", "b"), ("P", "c"), ("Q", "a"), ("Q", "b")}
    for symbol, own in (("P", ["a", "b", "c"]), ("Q", ["a", "b"])):
        x = panel[symbol][[*own, "ret"]].dropna()
        for n, (base, delta, moved) in plain_load(x, own, plain_ridge).items():
            r = got[symbol, n]
            assert math.isclose(r.baseline, base, abs_tol=1e-6) and math.isclose(r.delta, delta, abs_tol=1e-6)
            assert r.survivor_delta is None if moved is None else math.isclose(r.survivor_delta, moved, abs_tol=1e-6)
            assert r.load_bearing == ((delta if moved is None else moved) >= 0.05)
    even = E.load_bearing(sets, E.by_strength).where("symbol = 'P'").collect()
    assert all(abs(r.survivor_delta) < 1e-9 and not r.load_bearing and math.isclose(r.delta, 2 * r.baseline, abs_tol=1e-9) for r in even)


def test_weighing_that_gives_nothing(tables):
    sets = E.candidates(tables[0], tables[1], NAMES)
    some = lambda s: E.by_strength(s).where("dropped IS NULL OR dropped != 'a'")
    got = {(r.symbol, r.signal): r for r in E.load_bearing(sets, some).collect()}
    assert got["P", "a"].delta is None and got["P", "a"].load_bearing is None and got["P", "b"].delta is not None
    none = E.load_bearing(sets, lambda s: E.by_strength(s).where("false")).collect()
    assert len(none) == 5 and all(r.baseline is None and r.load_bearing is None for r in none)


def test_section(tables):
    signals, target, labels = tables
    got = {r.symbol: r for r in eigen.section(signals, target, NAMES, labels, E.by_ridge()).collect()}
    assert got["P"].pca.constant == ["d"] and len(got["P"].ranking) == 4 and len(got["P"].load_bearing) == 3 and got["P"].symmetry
    assert got["R"].pca is None and got["R"].load_bearing is None
    bare = eigen.section(signals, target, NAMES).where("symbol = 'P'").first()
    assert bare.symmetry is None and bare.load_bearing is None
    assert eigen.section(signals.limit(0), target.limit(0), NAMES, labels, E.by_strength).count() == 0
    more = signals.withColumn("n", F.lit(7)).withColumn("s", F.lit("x")).unionByName(signals, allowMissingColumns=True)  # repeated rows, clashing columns
    assert E.axes(more, NAMES).where("symbol = 'P'").first().eigenvalues == pytest.approx(E.axes(signals, NAMES).where("symbol = 'P'").first().eigenvalues)


def test_constant_symbol_has_no_correlation(spark):
    from quantloom.operators import cross as X

    r = spark.createDataFrame([(s, pd.Timestamp("2024-01-01").date() + pd.Timedelta(days=i), v) for s, f in (("A", lambda i: 0.01 * (i % 3)), ("B", lambda i: 0.5)) for i in range(9) for v in [f(i)]], "symbol string, date date, ret double")
    assert [x.c for x in X.gram(r).select(X.correlation().alias("c")).collect()] == [None]
