"""Settled forecasts, ranks, spells, statement trends and smiles on planted rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantloom.operators import fundamentals as Q
from quantloom.operators import history as H
from quantloom.operators import options as O


def bars(spark, closes, symbol="a"):
    start = dt.date(2020, 1, 1)
    rows = [(symbol, start + dt.timedelta(i), float(c), float(c), float(c), float(c), 1.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def test_settled_forecasts_never_look_ahead(spark):
    closes = [100 + (i * 7919) % 23 + i / 10 for i in range(120)]
    b = bars(spark, closes)
    labels = b.select("symbol", "date", F.when(F.dayofyear("date") % 2 == 0, "x").otherwise("y").alias("label"))
    signals = b.select("symbol", "date", F.dayofyear("date").cast("double").alias("x"))
    for op, other in ((lambda x, y: H.settled_means(x, y, 5, 3, 3), labels), (lambda x, y: H.settled_lines(x, y, 5, 10), signals)):
        whole = {r.date: r[2] for r in op(b, other).collect()}
        part = {r.date: r[2] for r in op(b.where("date < '2020-03-20'"), other.where("date < '2020-03-20'")).collect()}
        assert part and all(whole[d] == pytest.approx(v) if v is not None else whole[d] is None for d, v in part.items())


def test_settled_lines_find_a_planted_line(spark):
    closes, signal = [100.0], []
    for i in range(60):
        signal.append(((i * 31) % 11) / 1000)
        closes.append(closes[-1] * (1 + 0.001 + 2 * signal[-1]))
    b = bars(spark, closes)
    x = spark.createDataFrame([("a", dt.date(2020, 1, 1) + dt.timedelta(i), v) for i, v in enumerate(signal)], "symbol string, date date, x double")
    got = [r for r in H.settled_lines(b, x, 1, 10).collect() if r.predicted is not None]
    assert len(got) == 50 and all(r.predicted == pytest.approx(r.realized) for r in got)


def test_split_half_of_exact_forecasts(spark):
    rows = [("k", dt.date(2000 + i // 12, i % 12 + 1, 1), 0.5, 0.5) for i in range(24)] + [("few", dt.date(2000, i + 1, 1), 0.1, 0.2) for i in range(7)]
    got = {r.key: r for r in H.split_half(spark.createDataFrame(rows, "key string, month date, predicted double, actual double"), "key").collect()}
    assert (got["k"].coverage, got["k"].width, got["k"].n_late) == (1.0, 0.0, 11)
    assert got["few"].coverage is None and got["few"].months == 7


def test_rank_signals_puts_the_copy_first(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(80)]
    ret = [((i * 37) % 17 - 8) / 1000 for i in range(80)]
    target = spark.createDataFrame(list(zip(days, ret)), "date date, ret double")
    rows = [("copy", d, r) for d, r in zip(days, ret)] + [("noise", d, ((i * 53) % 13) / 100) for i, d in enumerate(days)] + [("short", d, r) for d, r in zip(days[:5], ret)]
    got = {r.signal: r for r in H.rank_signals(spark.createDataFrame(rows, "signal string, date date, x double"), target).collect()}
    assert got["copy"].rank == 1 and got["copy"].corr_252 == pytest.approx(1.0)
    assert got["short"].corr_252 is None and got["short"].rank == 3


def test_labels_and_trends(spark):
    days = [dt.date(2020, 1, 30) + dt.timedelta(i) for i in range(6)]
    labels = spark.createDataFrame([("a", d, x) for d, x in zip(days, "uuuduu")] + [("b", days[0], "u")], "symbol string, date date, label string")
    assert {r.symbol: (r.label, r.days) for r in H.label_age(labels).collect()} == {"a": ("u", 2), "b": ("u", 1)}
    assert {(r.symbol, r.month.month): r.label for r in H.label_months(labels).collect()} == {("a", 1): "u", ("a", 2): "u", ("b", 1): "u"}
    path = spark.createDataFrame([(s, days[i], float(v)) for s, k in (("up", 1), ("down", -1), ("flat", 0)) for i, v in enumerate(range(0, 6 * k, k) if k else [1] * 6)] + [("few", days[0], 1.0)], "symbol string, date date, v double")
    assert {r.symbol: r.trend for r in H.trend_label(path, "v").collect()} == {"up": "rising", "down": "falling", "flat": "flat", "few": "flat"}
    assert H.relative_average(bars(spark, [1, 2]), "a", spark.createDataFrame([], "symbol string, weight double")).count() == 0


def test_short_series_give_nulls(spark):
    b = bars(spark, [1, 2, 3, 4, 5])
    row = H.technicals(b).collect()[0]
    assert (row.perf_3m, row.to_sma_20, row.ratio_high) == (None, None, 1.0)
    assert H.setup_label(b).collect()[0].setup == "Balance"
    assert H.vol_of_vol(b).count() == 0


def quarters(spark, revenue, symbol="a"):
    rows = [(symbol, dt.date(2018 + i // 4, 3 * (i % 4) + 1, 28), float(v), v / 2.0, v / 10.0, v / 8.0, -v / 20.0) for i, v in enumerate(revenue)]
    return spark.createDataFrame(rows, "symbol string, period_end date, revenue double, gross_profit double, operating_income double, cfo double, capex double")


def test_statement_trends(spark):
    q = quarters(spark, [100, 100, 100, 100, 101, 104, 110, 120]).unionByName(quarters(spark, [100, 90, 80], "falls")).unionByName(quarters(spark, [5], "one"))
    trend = {(r.symbol, r.metric): r for r in Q.metric_trends(q).collect()}
    assert trend["a", "revenue"].trend == "accelerating" and trend["a", "revenue"].yoy == pytest.approx(0.2)
    assert trend["falls", "revenue"].trend == "declining" and trend["one", "revenue"].trend == "stable" and trend["one", "revenue"].qoq is None
    path = {r.symbol: r for r in Q.trajectory(q).collect()}
    assert path["a"].revenue_accelerates is True and path["a"].growth_slope > 0 and path["one"].revenue_accelerates is None
    both = {r.symbol: r for r in Q.momentum_and_margins(q).collect()}
    assert both["a"].gross_stability == "very stable" and both["one"].gross_stability == "insufficient" and both["one"].accelerating is False


def test_ratios_prefer_statements(spark):
    q = quarters(spark, [100, 100, 100, 100]).selectExpr("*", "1.0D AS eps", "10.0D AS net_income", "20.0D AS ebitda", "5.0D AS fcf", "100.0D AS shares", "50.0D AS cash", "CAST(NULL AS DOUBLE) AS investments", "150.0D AS total_debt", "0.0D AS equity")
    prices = spark.createDataFrame([("a", 8.0, 1.0)], "symbol string, price double, vendor_cap double")
    provided = spark.createDataFrame([("a", "pe", 99.0), ("a", "pb", 3.0)], "symbol string, ratio string, value double")
    got = {r.ratio: (r.value, r.source) for r in Q.ratios(q, prices, provided).collect()}
    assert got["pe"] == (2.0, "statements") and got["pb"] == (3.0, "provider") and got["debt_to_equity"] == (None, None)
    assert got["ps"] == (2.0, "statements") and got["ev_sales"] == (2.25, "statements") and got["net_cash_per_share"] == (-1.0, "statements")


def test_smile(spark):
    d = dt.date(2024, 1, 19)
    rows = [("u", d, 90.0, "put", 0.30, -0.25), ("u", d, 100.0, "put", 0.22, -0.5), ("u", d, 100.0, "call", 0.20, 0.5), ("u", d, 110.0, "call", 0.18, 0.3), ("u", d, 120.0, "call", 9.0, None), ("far", d, 90.0, "put", 0.3, -0.6), ("far", d, 99.0, "call", 0.3, 0.25)]
    points = spark.createDataFrame(rows, "underlying string, expiry date, strike double, type string, iv double, delta double")
    got = {r.underlying: r for r in O.smile(points, 101.0).collect()}
    assert (got["u"].atm_strike, got["u"].atm_iv, got["u"].skew_25d) == (100.0, pytest.approx(0.21), pytest.approx(0.12)) and got["far"].skew_25d is None
    kept = O.without_outliers(points).groupBy("underlying").count().collect()
    assert {r.underlying: r["count"] for r in kept} == {"u": 4, "far": 2}
