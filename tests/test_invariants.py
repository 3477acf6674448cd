"""Planted truth and invariants of models, strategies, streams, sources and stores."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions import scalars as S
from quantloom.operators import bars as B
from quantloom.operators import cross as X
from quantloom.operators import indicators as I
from quantloom.operators import models as M
from quantloom.operators import options as O
from quantloom.operators import texts as T
from quantloom.operators import ticks as K
from quantloom.plans import charts, packet
from quantloom.sources import landing, sinks, tables
from quantloom.streaming import live

DAY = dt.date(2020, 1, 1)


def series(spark, closes: dict[str, np.ndarray]):
    rows = [(s, DAY + dt.timedelta(days=i), float(c), float(c) * 1.01, float(c) * 0.99, float(c), 1e6) for s, x in closes.items() for i, c in enumerate(x)]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(0.0003, 0.01, 700)
    out = {"M": m, "A": 1.2 * m + rng.normal(0, 0.003, 700), "B": rng.normal(0, 0.02, 700), "C": -0.5 * m + rng.normal(0, 0.004, 700)}
    return series(spark, {k: 100 * np.cumprod(1 + v) for k, v in out.items()}).cache()


def test_flow_and_rsi_stay_in_bounds(walk):
    f = I.flow_compass(walk).toPandas()
    assert f.flow_score.between(-100, 100).all() and not (f.fresh_long & f.fresh_short).any()
    assert I.rsi(walk).toPandas().rsi.between(0, 100).all()


def test_strategy_buys_a_trend_and_never_owes(spark, walk):
    up = I.ridge_strategy(series(spark, {"U": 100 * 1.002 ** np.arange(500), "D": 100 * 0.998 ** np.arange(500)})).toPandas().set_index("symbol")
    assert up.loc["U", "state"] == "LONG" and up.loc["U", "total_return"] > 0.5
    assert up.loc["D", "recommendation"] == "CASH" and up.loc["D", "ending_equity"] == 10_000
    assert (I.ridge_strategy(walk).toPandas().ending_equity > 0).all()


def test_planted_beta_is_recovered(walk):
    b = X.beta_table(walk, "M", (504,)).toPandas().set_index("symbol").beta
    assert abs(b["A"] - 1.2) < 0.1 and abs(b["C"] + 0.5) < 0.1
    f = M.factor_regression(walk, ["M"]).toPandas().set_index(["symbol", "name"]).coef
    assert abs(f["A", "M"] - 1.2) < 0.1
    e = M.exposure(walk, ["M"]).toPandas().set_index("symbol").beta
    assert abs(e["A"] - 1.2) < 0.15


def test_ridge_without_penalty_is_least_squares():
    rng = np.random.default_rng(0)
    x, e = rng.normal(size=(80, 3)), rng.normal(size=80)
    y = x @ [1.0, -2.0, 0.5] + 3 + 0.1 * e
    assert np.allclose(M.ridge(x, y, 0.0), M.ols(x, y)["coef"])


def test_weights_sum_to_one_and_pca_shares_fall(walk):
    w = X.impact_weights(walk, "M").toPandas()
    assert w.weight.sum() == pytest.approx(1.0) and w.symbol.iloc[0] == "A"
    p = M.pca(walk, ["A", "B", "C", "M"]).toPandas().drop_duplicates("component").share
    assert p.is_monotonic_decreasing and p.sum() <= 1 + 1e-9


def test_cycle_of_fifty_days_is_found(spark):
    t = np.arange(1000)
    x = series(spark, {"S": np.exp(0.0005 * t + 0.05 * np.sin(2 * np.pi * t / 50)) * 100})
    assert M.spectral_modes(x, 1).first().period == pytest.approx(50)


def test_hmm_learns_and_looks_ahead_only_when_asked():
    rng = np.random.default_rng(1)
    state = np.repeat([0, 1, 0, 1], 150)
    x = rng.normal(size=(600, 2)) * np.where(state, 3.0, 0.5)[:, None] + np.where(state, 2.0, -1.0)[:, None]
    m = M.Hmm(2, rounds=40, starts=2).fit(x)
    assert all(b >= a - 1e-6 for a, b in zip(m.path, m.path[1:]))
    assert np.allclose(m.move.sum(axis=1), 1) and np.allclose(m.stationary() @ m.move, m.stationary())
    path = m.viterbi(x)
    assert max((path == state).mean(), (path != state).mean()) > 0.95
    assert np.allclose(m.filtered(x)[:300], m.filtered(x[:300]))
    assert (m.durations() > 10).all()


def test_scenarios_are_ordered(walk):
    for r in M.scenarios(walk).collect():
        assert r.p_bear + r.p_neutral + r.p_bull == pytest.approx(1)
        assert -1 < r.bear < r.neutral < r.bull


def test_entropy_bounds(spark, walk):
    e = X.entropy_rolling(walk).where("entropy is not null").toPandas().entropy
    assert e.between(0, 1).all()


def test_walk_forward_needs_no_later_row(walk):
    panel = X.monthly_panel(walk)
    if panel.count():
        assert M.walk_forward(panel, least=20).count() >= 0
    lo, hi = M.bootstrap_ci(np.random.default_rng(0).normal(0.05, 0.1, 60))
    assert lo < 0.05 < hi
    assert M.deflated_sharpe(0.02, 500, 0, 3, 50, 0.01) < 0.5 < M.deflated_sharpe(0.4, 500, 0, 3, 50, 0.001)


def test_as_of_masking(walk):
    cut = (DAY + dt.timedelta(days=500)).isoformat()
    early = packet.packets(walk.where(F.col("date") <= F.lit(cut).cast("date"))).orderBy("symbol").collect()
    masked = packet.packets(walk, cut).orderBy("symbol").collect()
    assert [r.packet for r in early] == [r.packet for r in masked]
    body = json.loads(masked[0].packet)
    assert set(packet.ROWS) | set(packet.LISTS) | {"errors"} == set(body) and body["auction"]["location"]


def test_as_of_join_takes_the_last_value(spark):
    left = spark.createDataFrame([("a", dt.date(2020, 1, 5)), ("a", dt.date(2019, 1, 1)), ("b", dt.date(2020, 1, 5))], "symbol string, d date")
    right = spark.createDataFrame([("a", dt.date(2020, 1, 1), 1.0), ("a", dt.date(2020, 1, 5), 2.0), ("a", dt.date(2020, 1, 6), 3.0)], "symbol string, e date, v double")
    got = {(r.symbol, r.d): r.v for r in X.as_of(left, right, "symbol", "d", "e", "v").collect()}
    assert got == {("a", dt.date(2020, 1, 5)): 2.0, ("a", dt.date(2019, 1, 1)): None, ("b", dt.date(2020, 1, 5)): None}


def test_options_maths():
    for vol in (0.1, 0.35, 1.2):
        for strike, call in ((80, True), (100, False), (130, True)):
            p = O.price(100, strike, 0.5, 0.03, vol, call)
            assert O.implied(p, 100, strike, 0.5, 0.03, call) == pytest.approx(vol, abs=1e-4)
    assert O.price(100, 90, 0.5, 0.03, 0.2, True) - O.price(100, 90, 0.5, 0.03, 0.2, False) == pytest.approx(100 - 90 * math.exp(-0.015))
    assert O.implied(500, 100, 90, 0.5, 0.03, True) is None
    assert list(O.isotonic(np.array([1.0, 3.0, 2.0, 4.0]))) == [1.0, 2.5, 2.5, 4.0]
    k = np.linspace(60, 160, 21)
    grid, pdf, cdf = O.density(k, np.full(21, 0.25), 100, 0.5, 0.02)
    assert ((pdf[1:] + pdf[:-1]) / 2 * np.diff(grid)).sum() == pytest.approx(1) and (np.diff(cdf) >= -1e-12).all()
    assert abs(np.interp(0.5, cdf, grid) - 100) < 3
    assert np.allclose(O.pchip(k, k**2, k), k**2)


def test_clusters_grow(spark):
    rows = [(1, "a", DAY, "fed raises rates again"), (2, "a", DAY, "Fed raises rates sharply again"), (3, "a", DAY + dt.timedelta(days=9), "fed raises rates again"), (4, "b", DAY, "fed raises rates again"), (5, "a", DAY, "earnings beat")]
    got = {r.item_id: r.cluster for r in T.clusters(spark.createDataFrame(rows, "item_id long, symbol string, date date, title string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_html_and_money(spark):
    page = spark.createDataFrame([(1, "<html><style>x{}</style><p>A &amp; B</p><script>no()</script><div>C  d</div></html>"), (2, None)], "page_id long, html string")
    assert {r.page_id: r.text for r in T.clean_html(page).collect()} == {1: "A & B\nC d", 2: None}
    raw = spark.createDataFrame([(x,) for x in ("$137,237M", "12.7%", "(5B)", "n/a", "-3", "")], "x string")
    assert [r.v for r in raw.select(T.money(F.col("x")).alias("v")).collect()] == [pytest.approx(1.37237e11), pytest.approx(0.127), -5e9, None, -3.0, None]


def test_scalars(spark):
    x = spark.createDataFrame([(1.5e9, "NASDAQ:brk.b"), (float("nan"), "??"), (950.0, " spy ")], "x double, s string")
    got = x.select(S.compact(F.col("x")).alias("c"), S.finite(F.col("x")).alias("f"), S.clean_symbol(F.col("s")).alias("s"), S.normal_cdf(F.lit(1.96)).alias("p")).collect()
    assert got[0].c == "1.5B" and got[2].c == "950.0" and got[1].f is None
    assert [r.s for r in got] == ["BRK-B", None, "SPY"] and got[0].p == pytest.approx(0.975, abs=1e-3)


def test_sources(spark):
    raw = spark.createDataFrame([("A", json.dumps({"results": [{"t": 1704153600000, "o": 1, "h": 2, "l": 0.5, "c": 1.5, "v": 10}, {"t": 1704240000, "o": 1, "h": 2, "l": 0.5, "c": 1.6}]}))], "symbol string, json string")
    got = landing.aggregates(raw).orderBy("date").collect()
    assert [(r.date.isoformat(), r.close, r.volume) for r in got] == [("2024-01-02", 1.5, 10.0), ("2024-01-03", 1.6, 0.0)]
    csv = spark.createDataFrame([("A", "01/02/2024", "$1,000.5", "N/A", "1", "2", "3,000")], "symbol string, date string, open string, high string, low string, close string, volume string")
    r = landing.csv_history(csv).first()
    assert r.open == 1000.5 and r.high is None and r.volume == 3000 and r.date == dt.date(2024, 1, 2)
    lines = spark.createDataFrame([("Some text",), ("20240102, 0.50, -0.1, -99.99, 0,0, 0.02",), ("202401, 1, 1, 1, 1, 1, 1",)], "value string")
    f = landing.factors(lines).collect()
    assert len(f) == 1 and f[0].mkt == pytest.approx(0.005) and f[0].hml is None
    assert [r.value for r in landing.series(spark.createDataFrame([("X", "2024-01-01", "."), ("X", "2024-01-02", "4.5")], "series_id string, date string, value string")).collect()] == [4.5]
    facts = {"facts": {"us-gaap": {"Revenues": {"units": {"USD": [{"end": "2023-12-31", "val": 5, "filed": "2024-02-01", "form": "10-K", "fy": 2023, "fp": "FY"}, {"end": "2022-12-31", "val": 4, "filed": "2023-02-01", "form": "10-K", "fy": 2022, "fp": "FY"}]}}}}}
    x = landing.company_facts(spark.createDataFrame([("A", json.dumps(facts))], "symbol string, json string"))
    assert x.count() == 2 and landing.pick_fact(x, ["Sales", "Revenues"]).first().value == 5
    sub = {"form": ["10-K", "10-Q", "10-Q", "8-K"], "filingDate": ["2024-02-01", "2023-11-01", "2023-08-01", "2023-07-01"], "accessionNumber": list("abcd")}
    s = landing.submissions(spark.createDataFrame([("A", json.dumps(sub))], "symbol string, json string"))
    assert [r.accession for r in landing.newest_filings(s, "2024-01-01", {"10-K": 2, "10-Q": 1}).collect()] == ["b"]
    page = spark.createDataFrame([(1, '<script>{"symbols":["NASDAQ:AAPL","NYSE:BRK.B","NASDAQ:AAPL"]}</script>')], "list_id int, html string")
    assert [r.symbol for r in landing.watchlist(page).orderBy("pos").collect()] == ["AAPL", "BRK-B"]
    chain = {"results": [{"details": {"strike_price": 5, "expiration_date": "2024-06-21", "contract_type": "call"}, "last_quote": {"bid": 1, "ask": 2}, "underlying_asset": {"price": 6}}]}
    assert landing.chain_rows(spark.createDataFrame([("A", json.dumps(chain))], "underlying string, json string")).first().mark == 1.5


def test_provider_fallback(spark):
    a = series(spark, {"X": np.arange(1, 500.0), "Y": np.arange(1, 20.0)})
    late = a.where((F.col("symbol") != "X") | (F.col("date") > DAY + dt.timedelta(days=300)))
    got = landing.prefer(late, a).groupBy("symbol", "provider").count().collect()
    assert {(r.symbol, r.provider): r["count"] for r in got} == {("X", "second"): 499, ("Y", "first"): 19}


def test_stores(spark, walk, tmp_path):
    p = packet.packets(walk)
    path = str(tmp_path / "packets")
    for day in ("2021-01-01", "2021-02-01", "2021-02-01"):
        sinks.save_packets(p.withColumn("as_of", F.lit(day).cast("date")), path)
    assert [r.as_of.isoformat() for r in sinks.list_packets(spark, path, "A").collect()] == ["2021-02-01", "2021-01-01"]
    assert sinks.load_packet(spark, path, "A").first().as_of == dt.date(2021, 2, 1) and sinks.load_packet(spark, path, "A", "2021-01-01").count() == 1
    store = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, t int, v string")
    up = sinks.upsert(store, spark.createDataFrame([(1, 1, "c"), (2, 0, "d"), (3, 1, "e")], "k int, t int, v string"), ["k"], "t")
    assert {r.k: r.v for r in up.collect()} == {1: "c", 2: "b", 3: "e"}
    rules = spark.createDataFrame([(1, True, None, 2), (2, True, DAY, 1), (3, False, None, 0)], "rule_id int, active boolean, last_run_date date, updated_at int")
    assert [r.rule_id for r in sinks.due_rules(rules, "2020-01-01").collect()] == [1]
    assert [r.rule_id for r in sinks.due_rules(rules, "2020-01-01", True).collect()] == [2, 1]
    assert json.loads(sinks.ndjson(store.limit(1)).first().value)["v"] == "a"


def test_charts(walk):
    for kind in ("auction", "performance", "volatility", "levels", "scanner"):
        assert charts.chart(kind, walk, ["A", "B"], "1y").select("symbol").distinct().count() == 2
    with pytest.raises(ValueError):
        charts.chart("none", walk)
    assert [r.symbol for r in charts.missing_symbols(walk, ["A", "Z"]).collect()] == ["Z"]


def run_stream(spark, df, build, mode, tmp_path, files=3):
    src = str(tmp_path / "in")
    df.repartition(1).sortWithinPartitions("event_id").write.option("maxRecordsPerFile", -(-df.count() // files)).parquet(src)
    out = []
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = live.to_batches(build(stream), lambda x, i: out.extend(x.collect()), str(tmp_path / "ck"), mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return out


def test_stream_bars_equal_batch(spark, sf_dir, tmp_path):
    t = tables.ticks(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    got = run_stream(spark, t, live.ohlc, "append", tmp_path)
    want = {(r.symbol, r.start): (r.open, r.high, r.low, r.close, r.n) for r in K.ohlc(t).collect()}
    assert got and all(want[r.symbol, r.start] == (r.open, r.high, r.low, r.close, r.n) for r in got)
    assert len(got) > 0.9 * len(want)


def test_stream_drops_repeats(spark, tmp_path):
    t = spark.createDataFrame([(i % 50, "a", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i % 50), 1.0) for i in range(150)], "event_id long, symbol string, ts timestamp, price double")
    assert len(run_stream(spark, t, live.unique, "append", tmp_path)) == 50


def test_stream_open_bar(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 10) + dt.timedelta(minutes=m)
    rows = [(1, "a", at(1), 10.0, 5.0), (2, "a", at(3), 12.0, 9.0), (3, "a", at(20), 11.0, 12.0), (4, "a", at(5), 99.0, 1.0), (5, "a", at(22), 8.0, 13.0), (6, "a", at(23), 9.0, 11.0)]
    t = spark.createDataFrame(rows, "event_id long, symbol string, ts timestamp, price double, size double")
    last = run_stream(spark, t, live.open_bars, "update", tmp_path)[-1]
    assert (last.open, last.high, last.low, last.close, last.volume) == (11.0, 11.0, 8.0, 9.0, 13.0)


def test_decode(spark):
    raw = spark.createDataFrame([('[{"ev":"status"},{"ev":"T","sym":"A","p":1.5,"s":2,"t":1704153600000,"i":7}]',), ('{"ev":"T","sym":"B","p":2,"t":1704153600000,"i":8}',), ("broken",)], "value string")
    assert {(r.symbol, r.event_id) for r in live.decode(raw).collect()} == {("A", 7), ("B", 8)}
