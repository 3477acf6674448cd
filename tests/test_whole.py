"""Queries and operators that do the whole job: no rows, days or groups are left out."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from quantloom.operators import cross as X
from quantloom.operators import models as M
from quantloom.operators import texts as T
from quantloom.queries import catalog
from quantloom.sources.tables import bars_smooth
from tests import test_queries

QUERIES = catalog().queries


@pytest.mark.parametrize("name", ["claims_verified_all", "verified_share_all"])
def test_every_order_is_a_claim(spark, duck, sf_dir, name):
    orders, priced = duck.execute("SELECT count(*), count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderpriority <> '5-LOW') FROM orders").fetchone()
    assert sum(r.n for r in QUERIES[name](spark, sf_dir).collect()) == (orders if name == "claims_verified_all" else priced)
    test_queries.test_matches_sql(spark, duck, sf_dir, name)


def greedy(rows, days=3, least=0.5):
    """The clusters by one plain pass over the distinct (symbol, date, title)."""
    first, by, out = {}, {}, {}
    for i, s, d, t in rows:
        first[s, d, t] = min(first.get((s, d, t), i), i)
    for (s, d, t), i in sorted(first.items(), key=lambda x: (x[0][1], x[1])):
        words = set(t.lower().split())
        for c in by.setdefault(s, []):
            if (d - c[1]).days <= days and len(words & c[0]) / len(words | c[0]) >= least:
                c[0] |= words
                c[1] = d
                break
        else:
            by[s].append(c := [words, d, i])
        out[s, d, t] = c[2]
    return {i: out[s, d, t] for i, s, d, t in rows}


def test_clusters_cross_the_end_of_a_month(spark):
    schema = "item_id long, symbol string, date date, title string"
    rows = [(1, "a", dt.date(2024, 1, 31), "fed raises rates"), (2, "a", dt.date(2024, 2, 1), "fed raises rates"), (3, "a", dt.date(2024, 2, 5), "fed raises rates")]
    got = {r.item_id: r.cluster for r in T.clusters(spark.createDataFrame([*rows, (4, "a", dt.date(2024, 2, 5), " "), (5, "a", None, "fed"), (6, "a", dt.date(2024, 2, 5), None)], schema)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}
    r = random.Random(2)
    some = [(i, r.choice("ab"), dt.date(2024, 1, 1) + dt.timedelta(days=r.choice([*range(50), *range(55, 80)])), " ".join(r.choice("uvwxyz") + r.choice("12") for _ in range(r.randint(1, 6)))) for i in range(900)]
    assert {r.item_id: r.cluster for r in T.clusters(spark.createDataFrame(some, schema)).collect()} == greedy(some)


def test_regimes_are_fitted_to_the_end(spark, sf_dir):
    """On this symbol 25 rounds from 2 starts end at a lower likelihood, with other labels."""
    bars = bars_smooth(spark, sf_dir).where("symbol = 'Brand#14'")
    x = bars.select("date", "close").toPandas().sort_values("date")
    r, v = x["close"].pct_change(), (x["close"] / x["close"].rolling(10).mean() - 1).pow(2).rolling(10).mean()
    ok = (r.notna() & v.notna()).to_numpy()
    z = np.c_[r[ok], np.log(v[ok] + 1e-12)]
    z = (z - z.mean(axis=0)) / z.std(axis=0)
    labels = {}
    for rounds, starts in ((25, 2), (200, 4)):
        m = M.Hmm(rounds=rounds, starts=starts).fit(z)
        name = dict(zip(np.argsort(m.mean[:, 0]), ["bear", "neutral", "bull"]))
        labels[rounds] = [name[k] for k in m.smoothed(z).argmax(axis=1)]
    got = [r.state for r in sorted(M.regimes(bars).collect(), key=lambda r: r.date)]
    assert got == labels[200] != labels[25]


def ridge(x, y, lam):
    sd = x.std(axis=0)
    xs = (x - x.mean(axis=0)) / sd
    b = np.linalg.solve(xs.T @ xs + lam * np.eye(x.shape[1]), xs.T @ (y - y.mean())) / sd
    return lambda z: y.mean() + (z - x.mean(axis=0)) @ b


def test_walk_forward_chooses_each_years_penalty(spark):
    rng, features, grid = np.random.default_rng(4), ["mom", "reversal", "vol"], (1.0, 3.0, 10.0, 30.0, 100.0)
    months = pd.period_range("2015-03", "2021-08", freq="M").to_timestamp()
    rows = pd.DataFrame([(f"s{k}", m.date(), *rng.normal(size=3) * (1, 0.1, 5)) for j, m in enumerate(months) for k in range(7 if j == 60 else 12)], columns=["symbol", "month", *features])
    year = rows["month"].map(lambda d: d.year).to_numpy()
    i = rows["month"].map(lambda d: d.year * 12 + d.month - 1).to_numpy()
    rows["target"] = 0.3 * rows["mom"] * np.where(year % 2, 1, -0.5) + 0.05 * rows["vol"] + rng.normal(size=len(rows))
    x, y = rows[features].to_numpy(), rows["target"].to_numpy()
    want, chosen = {}, set()
    for test in np.unique(year):
        own = i + 1 <= i[year == test].min() - 1
        if own.sum() < 200 or len(np.unique(i[own])) < 36:
            continue
        error = lambda lam: sum(((y[own & (year == k)] - ridge(x[own & (year != k)], y[own & (year != k)], lam)(x[own & (year == k)])) ** 2).sum() for k in np.unique(year[own]))  # noqa: B023, E731
        lam = min(grid, key=error)
        chosen.add(lam)
        guess = ridge(x[own], y[own], lam)(x)
        want |= {(rows["symbol"][j], rows["month"][j]): guess[j] for j in np.flatnonzero(year == test) if (i == i[j]).sum() >= 8}
    got = {(r.symbol, r.month): r.prediction for r in M.walk_forward(spark.createDataFrame(rows, "symbol string, month date, mom double, reversal double, vol double, target double")).collect()}
    assert chosen - {10.0} and min(d.year for _, d in got) == 2019 and (2020, 3) not in {(d.year, d.month) for _, d in got}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


@pytest.mark.parametrize("name,symbols", [("common_window_all", 25), ("curve_shape_all", 5)])
def test_every_symbol_is_there(spark, name, symbols):
    """At the smallest size no date is common to all symbols."""
    import duckdb

    folder, c = "/root/testdata/sf0.1", duckdb.connect()
    for table in ("lineitem", "part", "orders", "customer"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    rows = QUERIES[name](spark, folder).collect()
    assert len({r.symbol for r in rows}) == symbols
    test_queries.test_matches_sql(spark, c, folder, name)


@pytest.mark.parametrize("tile", [3, 7, 512])
def test_pairs_come_from_tiles(spark, tile):
    """Whatever the tiles, the moments are those of pandas; no pair is missing or doubled."""
    bars = bars_smooth(spark, "/root/testdata/sf0.01")
    r = X.returns(bars).where("symbol <> 'Brand#11' or date > '1999-01-01'")
    got = {(m.a, m.b): m for m in X.gram(r, tile=tile).collect()}
    wide = r.toPandas().pivot(index="date", columns="symbol", values="ret").astype(float)
    names = sorted(wide.columns)
    assert set(got) == {(a, b) for i, a in enumerate(names) for b in names[i + 1 :]}
    for (a, b), m in list(got.items())[::17]:
        both = wide[[a, b]].dropna()
        assert m.n == len(both) and m.xy == pytest.approx(((both[a] - both[a].mean()) * (both[b] - both[b].mean())).sum(), abs=1e-12)


def test_many_symbols_in_many_tiles(spark):
    r = spark.range(2000 * 6).selectExpr("concat('S', lpad(id % 2000, 4, '0')) AS symbol", "date_add(DATE'2024-01-01', CAST(id / 2000 AS INT)) AS date", "sin(id * 1.7) AS ret")
    x = X.gram(r, tile=256)
    n, a, b = x.selectExpr("count(*)", "count(DISTINCT a)", "count_if(a >= b or n <> 6)").first()
    assert (n, a, b) == (2000 * 1999 // 2, 1999, 0)


def test_as_of_one_series(spark):
    series = spark.createDataFrame([("2024-01-05", 1.0), ("2024-01-20", 2.0), ("2024-04-02", 3.0), ("2024-04-02", None), ("2024-05-01", None)], "d string, close double").selectExpr("CAST(d AS DATE) AS d", "close")
    asked = ["2024-01-04", "2024-01-05", "2024-01-19", "2024-01-31", "2024-02-10", "2024-04-01", "2024-04-02", "2025-09-09", None]
    left = spark.createDataFrame([(x,) for x in asked], "at string").selectExpr("CAST(at AS DATE) AS at", "1 AS v", "2 AS d")
    got = {str(r["at"]): r.close for r in X.as_of_series(left, series, "at", "d", "close").collect()}
    assert got == dict(zip(map(str, asked), [None, 1.0, 1.0, 2.0, 2.0, 2.0, 3.0, 3.0, None]))
    assert X.as_of_series(left, series.limit(0), "at", "d", "close").where("close is not null").count() == 0
