"""Queries over setup scores, odds and evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.operators import bars as B
from quantloom.operators import cross as X
from quantloom.operators import evidence as E
from quantloom.operators import fundamentals as Q
from quantloom.operators import scoring as S
from quantloom.queries import Catalog
from quantloom.queries.bar_queries import AGE, W
from quantloom.queries.sql import QUARTERS, RETURNS, SMOOTH
from quantloom.sources import tables

#: Features of the setup query: technicals from the bars; the rest, which the test tables lack, from the symbol's own figures.
FEATURES = """SELECT symbol, ret_252 * 2 AS yoy, ret_21 AS qoq, ret_63 > 0 AS accelerating, 40 + ret_126 * 20 AS gross_margin, ret_63 * 5 AS leverage,
    CASE WHEN ret_63 > 0.1 THEN 'high' WHEN ret_63 > 0 THEN 'moderate' WHEN ret_63 > -0.1 THEN 'low' ELSE 'negative' END AS leverage_label, ret_21 > 0 AS margin_up, ret_252 > 0 AS revenue_up, 3 + abs(ret_504) * 10 AS ps,
    1e9 * (1 + ret_126) AS market_cap, ret_63 AS perf_3m, ret_126 AS perf_6m, 50 + ret_21 * 200 AS rsi, 1 + ret_5 AS ratio_50, 1 + from_high AS ratio_high, CASE WHEN ret_5 > 0 THEN 'Old' ELSE 'New' END AS industry FROM {perf}"""
#: The setup by hand: points of each component, total, stage and advice.
SETUP = """
    SELECT *, CASE WHEN stage = 'Coiled Spring' THEN 'BUY' WHEN stage = 'Inflecting' THEN 'BUY SETUP' WHEN stage = 'Proof Phase' THEN 'HOLD' WHEN stage = 'Extended' THEN 'AVOID' ELSE 'WAIT' END AS advice FROM (
    SELECT *, CASE WHEN technical < 30 THEN 'Extended' WHEN revenue >= 50 AND technical >= 50 AND total >= 75 THEN 'Coiled Spring' WHEN revenue >= 50 AND total >= 60 AND NOT total >= 75 THEN 'Inflecting'
        WHEN technical >= 70 AND total >= 70 THEN 'Renaming Phase' WHEN valuation < 75 AND technical <= 70 AND total >= 60 THEN 'Proof Phase' ELSE 'No Setup' END AS stage FROM (
    SELECT *, round(0.25 * revenue + 0.2 * margin + 0.15 * valuation + 0.15 * op_leverage + 0.15 * technical + 0.1 * reclass, 6) AS total FROM (
    SELECT symbol, CASE WHEN yoy IS NULL THEN 50 WHEN pace > 30 AND coalesce(qoq, 0) < -0.03 THEN greatest(30, pace - 15) ELSE pace END AS revenue,
        least(100, greatest(0, CASE WHEN gross_margin IS NULL THEN 30 + 20 * leverage ELSE 1.2 * gross_margin + 25 * leverage END)) AS margin,
        least(100, greatest(0, CASE WHEN ps IS NULL THEN 50 ELSE 100 - (CASE WHEN yoy > 0.15 THEN 15 ELSE 25 END) * ps - 8 * greatest(0, ps - 8) + 10 * CAST(market_cap >= 5e8 AND market_cap <= 8e9 AS INTEGER) END)) AS valuation,
        least(100, (CASE leverage_label WHEN 'high' THEN 80 WHEN 'moderate' THEN 50 WHEN 'low' THEN 25 ELSE 10 END) + 20 * CAST(margin_up AND revenue_up AS INTEGER)) AS op_leverage,
        CASE WHEN perf_3m > 1 OR rsi > 80 OR ratio_50 > 1.25 THEN 15 ELSE least(100, greatest(0, 50 + strength + swing + trend + room)) END AS technical,
        CASE WHEN industry = 'Old' AND yoy > 0.15 THEN 80 WHEN industry = 'New' THEN 30 ELSE 50 END AS reclass FROM (
    SELECT *, CASE WHEN yoy < 0 THEN 0 WHEN yoy < 0.1 AND NOT accelerating THEN 30 WHEN yoy < 0.25 THEN 60 WHEN yoy < 0.5 THEN 65 + 15 * CAST(accelerating AS INTEGER) ELSE 80 + 20 * CAST(accelerating AS INTEGER) END AS pace,
        CASE WHEN coalesce(perf_6m, perf_3m) > 0.8 THEN 6 WHEN coalesce(perf_6m, perf_3m) >= 0.05 THEN 18 WHEN coalesce(perf_6m, perf_3m) > 0 THEN 8 WHEN coalesce(perf_6m, perf_3m) IS NULL THEN 0 ELSE -12 END AS strength,
        CASE WHEN rsi IS NULL THEN 0 WHEN rsi >= 45 AND rsi <= 70 THEN 14 WHEN rsi >= 35 AND rsi <= 75 THEN 4 ELSE -8 END AS swing, CASE WHEN ratio_50 IS NULL THEN 0 WHEN ratio_50 >= 0.9 AND ratio_50 <= 1.18 THEN 10 ELSE -6 END AS trend,
        CASE WHEN ratio_high >= 0.55 AND ratio_high <= 0.95 THEN 8 WHEN ratio_high > 0.98 THEN -6 ELSE 0 END AS room FROM f))))"""  # fmt: skip
LABELS = "labels AS (SELECT DISTINCT date, CASE WHEN month(date) <= 6 THEN 'first' ELSE 'second' END AS label FROM bars)"


def register(c: Catalog) -> None:
    smooth = tables.bars_smooth
    spans = ", ".join(f"max(close) FILTER (age = 1) / max(close) FILTER (age = least({k + 1}, n)) - 1 AS ret_{k}" for k in (5, 21, 63, 126, 252, 504))
    perf = SMOOTH + f", perf AS (SELECT symbol, {spans}, max(close) FILTER (age = 1) / max(close) FILTER (age <= 252) - 1 AS from_high FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT *, {AGE} FROM bars) WHERE age <= 505) GROUP BY symbol), f AS (" + FEATURES.format(perf="perf") + ")"

    c.add("torque_setup", lambda s, d: S.setup(s.sql(FEATURES, perf=B.performance(smooth(s, d))), stale=["Old"], hot=["New"]), "symbol ~revenue ~margin ~valuation ~op_leverage ~technical ~reclass ~total stage advice", perf, SETUP)
    run_rate = "symbol, revenue, gross_profit / revenue AS gross_margin, gross_profit - operating_income AS opex, 1000.0 + fiscal_quarter AS shares, yoy, fiscal_quarter / 10.0 AS gap"

    def rates_now(s, d):
        q = Q.growth_metrics(tables.quarters(s, d))
        latest = tables.quarters(s, d).join(q.select("symbol", "period_end", "yoy"), ["symbol", "period_end"])
        return latest.withColumn("age", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("period_end")))).where("age = 1").selectExpr(*run_rate.split(", "))

    c.add("price_targets", lambda s, d: S.price_targets(rates_now(s, d)), "symbol ~bear ~base ~bull", QUARTERS + f", now AS (SELECT {run_rate} FROM (SELECT *, CASE WHEN lag(revenue, 4) OVER w > 0 THEN revenue / lag(revenue, 4) OVER w - 1 END AS yoy FROM quarters WINDOW w AS (PARTITION BY symbol ORDER BY period_end)) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC) = 1)", """
        SELECT symbol, CASE WHEN bear > 0 AND gross_margin > 0.03 THEN round(bear, 2) END AS bear, CASE WHEN base > 0 AND gross_margin > 0 THEN round(base, 2) END AS base, CASE WHEN bull > 0 AND gross_margin > -0.02 THEN round(bull, 2) END AS bull FROM (SELECT symbol, gross_margin,
            12 * (4 * revenue * (gross_margin - 0.03) - 4 * opex) / shares AS bear, 20 * (4 * revenue * (1 + coalesce(yoy, 0)) * gross_margin - 4 * opex) / shares AS base,
            28 * (1 + gap / 2) * (4 * revenue * (1 + 1.3 * coalesce(yoy, 0)) * (gross_margin + 0.02) - 4 * opex) / shares AS bull FROM now)""")  # fmt: skip
    rets = SMOOTH + ", " + RETURNS.replace("rets AS", "r0 AS") + ", rets AS (SELECT symbol, date, ret FROM r0 WHERE ret IS NOT NULL)"
    labels = lambda b: b.select("date").distinct().withColumn("label", F.when(F.month("date") <= 6, "first").otherwise("second"))
    c.add("regime_flips", lambda s, d: E.regime_flips(smooth(s, d), labels(smooth(s, d)), least_corr=0.001), "a b ~lo ~hi state", rets + ", " + LABELS, """SELECT a, b, lo, hi, CASE WHEN lo < 0 AND hi > 0 AND weakest >= 0.001 THEN 'broken' WHEN lo * hi > 0 AND hi - lo <= 0.25 THEN 'invariant' ELSE 'mixed' END AS state FROM (
        SELECT a, b, min(c) AS lo, max(c) AS hi, min(abs(c)) AS weakest, count(*) AS k FROM (SELECT a.symbol AS a, b.symbol AS b, label, corr(a.ret, b.ret) AS c FROM rets a JOIN rets b ON a.date = b.date AND a.symbol < b.symbol JOIN labels l ON l.date = a.date GROUP BY ALL HAVING count(*) >= 20) GROUP BY a, b) WHERE k > 1""")  # fmt: skip
    c.add("stats_by_regime", lambda s, d: E.stats_by_label(smooth(s, d), labels(smooth(s, d))), "symbol label ~mean ~sd ~hit n:long", SMOOTH + ", " + RETURNS + ", " + LABELS, f"SELECT symbol, label, avg(next) AS mean, stddev_samp(next) AS sd, avg(CAST(next > 0 AS INTEGER)) AS hit, count(*) AS n FROM (SELECT symbol, date, lead(ret) {W}) AS next FROM rets) JOIN labels USING (date) WHERE next IS NOT NULL GROUP BY ALL HAVING count(*) >= 5")
    c.add("load_bearing", lambda s, d: E.load_bearing(X.impact_weights(smooth(s, d), "Brand#11")), "symbol ~weight ~delta load_bearing", rets, "SELECT symbol, weight, CASE WHEN weight < 1 THEN 2 * weight END AS delta, 2 * weight >= 0.05 AS load_bearing FROM (SELECT symbol, r2 / sum(r2) OVER () AS weight FROM (SELECT symbol, corr(a.ret, b.ret) ** 2 AS r2 FROM rets a JOIN (SELECT date, ret FROM rets WHERE symbol = 'Brand#11') b USING (date) WHERE a.symbol <> 'Brand#11' GROUP BY symbol ORDER BY r2 DESC, symbol LIMIT 8))")
    c.add("compounded_months", lambda s, d: E.compounded_months(smooth(s, d)), "symbol month ~ret n:long", rets, "SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS month, product(1 + ret) - 1 AS ret, count(*) AS n FROM rets GROUP BY ALL HAVING count(*) >= 10")
    c.add("monthly_points", lambda s, d: E.monthly_points(smooth(s, d)), "symbol month ~last ~mean ~change", SMOOTH, "SELECT symbol, month, last, mean, change FROM (SELECT *, (last - lag(last) OVER w) / abs(lag(last) OVER w) AS change, row_number() OVER (PARTITION BY symbol ORDER BY month DESC) AS age FROM (SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS month, max_by(close, date) AS last, avg(close) AS mean FROM bars GROUP BY ALL) WINDOW w AS (PARTITION BY symbol ORDER BY month)) WHERE age <= 12")

    def members(s, d):
        o, cu = tables.table(s, d, "orders"), tables.table(s, d, "customer")
        return o.join(cu, o.o_custkey == cu.c_custkey).groupBy(F.col("c_mktsegment").alias("symbol"), F.col("o_orderpriority").alias("member"), F.to_date(F.date_trunc("year", "o_orderdate")).alias("period_end")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))

    c.add("segments", lambda s, d: E.segments(members(s, d)), "symbol member period_end ~value ~growth ~share", "m AS (SELECT c_mktsegment AS symbol, o_orderpriority AS member, CAST(date_trunc('year', o_orderdate) AS DATE) AS period_end, round(sum(o_totalprice), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)", "SELECT symbol, member, period_end, value, CASE WHEN prior > 0 THEN value / prior - 1 END AS growth, value / sum(value) OVER (PARTITION BY symbol) AS share FROM (SELECT a.*, b.value AS prior, row_number() OVER (PARTITION BY a.symbol, a.member ORDER BY a.period_end DESC) AS rn FROM m a LEFT JOIN m b ON a.symbol = b.symbol AND a.member = b.member AND b.period_end = CAST(a.period_end - INTERVAL 1 YEAR AS DATE)) WHERE rn = 1")
    claim = "SELECT o_orderkey % 50 AS doc_id, o_orderpriority AS key, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE round(o_totalprice / 1000, 0) END AS value FROM {orders}"
    fact = "SELECT o_orderpriority AS key, round(avg(o_totalprice) / 1000, 0) AS value FROM {orders} WHERE o_orderpriority <> '5-LOW' GROUP BY o_orderpriority"

    def claims(s, d):
        orders = tables.table(s, d, "orders")
        return E.verify(s.sql(claim, orders=orders), s.sql(fact, orders=orders), 0.2)

    status = "checked AS (SELECT doc_id, c.key, CASE WHEN c.value IS NULL THEN 'uncheckable' WHEN f.value IS NULL THEN 'concept_missing' WHEN abs(c.value - f.value) / greatest(abs(c.value), abs(f.value), 1.0) <= 0.2 THEN 'verified' ELSE 'value_mismatch' END AS status FROM (" + claim.format(orders="orders") + ") c LEFT JOIN (" + fact.format(orders="orders") + ") f ON c.key = f.key)"
    for tail in ("", "_all"):  # every order is a claim; one query under the two names it has had
        c.add("claims_verified" + tail, lambda s, d: claims(s, d).groupBy("key", "status").agg(F.count("*").alias("n")), "key status n:long", status, "SELECT key, status, count(*) AS n FROM checked GROUP BY ALL")
        c.add("verified_share" + tail, lambda s, d: E.verified_share(claims(s, d)), "doc_id:long n:long ~share", status, "SELECT doc_id, n, CASE WHEN n = 0 THEN 1.0 ELSE ok / n END AS share FROM (SELECT doc_id, count(*) FILTER (status = 'verified') AS ok, count(*) FILTER (status IN ('verified', 'value_mismatch')) AS n FROM checked GROUP BY doc_id)")
    c.add("filing_sections", lambda s, d: E.longest_between(tables.table(s, d, "documents"), [r"\bthe\b"], [r"\n"], 40).selectExpr("doc_id", "length(section) AS n"), "doc_id n:int")
