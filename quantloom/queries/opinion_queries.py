"""Queries over reclassification, agreement, timing, exposure legs and stored series."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import bars as B
from quantloom.operators import cross as X
from quantloom.operators import forecasts as G
from quantloom.operators import opinions as P
from quantloom.queries import Catalog
from quantloom.queries.bar_queries import AGE, W
from quantloom.queries.sql import RETURNS, SMOOTH
from quantloom.sources import tables

#: A symbol's reclassification inputs, from its own performance.
REPORT = """SELECT symbol, ret_5 > 0 AS stale, CAST(floor(abs(ret_126) * 30) AS INT) AS evidence, CASE WHEN ret_21 > -0.05 THEN 'optical networking' END AS theme, CASE WHEN ret_63 > -0.3 THEN ret_252 END AS yoy, ret_63 > 0 AS accelerating,
    CASE WHEN ret_504 > 0.3 THEN 'High' WHEN ret_504 > 0 THEN 'moderate' ELSE 'low' END AS leverage, 1e10 * (0.5 + ret_21) AS market_cap, CASE WHEN ret_5 < -0.02 THEN 'missing' WHEN ret_5 > 0.02 THEN 'partial' ELSE 'available' END AS status,
    ret_21 > 0 AS product, CAST(floor(abs(ret_63) * 20) AS INT) AS mentions, ret_63 AS ret_3m, ret_21 AS ret_1m, CASE WHEN ret_21 < 0.1 THEN 0.4003 + ret_504 / 10 END AS gross_margin FROM {perf}"""
RECIPES = {"SMB": [("Brand#12", "Brand#11")], "HML": [("Brand#99", "Brand#13"), ("Brand#13", "Brand#14")], "RMW": [("Brand#98", "Brand#11")]}
LEGS, SPREADS, CHANGES = {"SPY": "Brand#11", "GLD": "Brand#21", "NONE": "Brand#97"}, {"SIZE": ("Brand#12", "Brand#11")}, {"D_LOW": "5-LOW", "D_NONE": "9-NONE"}


def register(c: Catalog) -> None:
    smooth = tables.bars_smooth
    spans = ", ".join(f"max(close) FILTER (age = 1) / max(close) FILTER (age = least({k + 1}, n)) - 1 AS ret_{k}" for k in (5, 21, 63, 126, 252, 504))
    perf = SMOOTH + f", perf AS (SELECT symbol, {spans} FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT *, {AGE} FROM bars) WHERE age <= 505) GROUP BY symbol), report AS (" + REPORT.format(perf="perf") + ")"
    stage = """SELECT *, CASE WHEN NOT known AND s > 1 THEN 1 ELSE s END AS proof_stage FROM (SELECT *, CASE WHEN (m2 OR m4) AND ((coalesce(ret_1m < -0.1, false) AND m4) OR slow) THEN 5 WHEN m4 THEN 4 WHEN m1 AND m2 AND m3 THEN 3 WHEN m1 AND m2 THEN 2 WHEN m1 THEN 1 ELSE 0 END AS s FROM (
        SELECT *, status IN ('available', 'partial') AS known, evidence >= 3 AND product AS m1, coalesce(accelerating AND yoy > 0.15, false) AS m2, coalesce(yoy > 0.3 AND lower(leverage) IN ('high', 'moderate'), false) AS m3, mentions > 4 OR ret_3m > 0.4 AS m4,
        coalesce(yoy < 0.05 OR (NOT accelerating AND yoy < 0.1), false) AS slow, CASE WHEN stale THEN 3 ELSE 0 END + CASE WHEN evidence >= 5 THEN 4 ELSE 0 END + CASE WHEN yoy > 0.25 THEN 2 ELSE 0 END + CASE WHEN market_cap < 5e9 THEN 1 ELSE 0 END AS tenths FROM report))"""  # fmt: skip
    names = "['Narrative only', 'Product proof', 'Financial bend', 'Proof / guide-up', 'Public renaming', 'Overbuild / fatigue']"
    rows = lambda s, d: P.reclassified(s.sql(REPORT, perf=B.performance(smooth(s, d))))
    c.add("reclassification", rows, "symbol ~gap proof_stage:int proof_name", perf, f"SELECT symbol, greatest(0, least(10, CASE WHEN known THEN tenths ELSE greatest(0, tenths - 2) END)) / 10.0 AS gap, proof_stage, {names}[proof_stage + 1] AS proof_name FROM ({stage})")
    c.add("reclassification_watch", lambda s, d: rows(s, d).select("symbol", F.col("catalysts")[2].alias("margin_watch"), F.col("catalysts")[4].alias("capex_watch"), F.col("kill_criteria")[1].alias("margin_kill")), "symbol margin_watch capex_watch margin_kill", perf, "SELECT symbol, CASE WHEN gross_margin IS NULL THEN 'Gross margin stability vs prior quarter' ELSE 'Gross margin stability at >' || CAST(round(gross_margin * 100) AS INTEGER) || '%' END AS margin_watch, CASE WHEN theme IS NULL THEN 'Sector capex confirmation in customer 10-Qs and call transcripts' ELSE 'Industry capex confirmation around: ' || theme END AS capex_watch, CASE WHEN gross_margin IS NULL THEN 'Gross margin contracts by more than 5pp' ELSE 'Gross margin falls below ' || CAST(round((gross_margin - 0.05) * 100) AS INTEGER) || '%' END AS margin_kill FROM report")
    said = "SELECT symbol, h, name, mean FROM {means}"
    means = "(SELECT symbol, 21 AS h, 'drift' AS name, ret_21 AS mean FROM perf UNION ALL SELECT symbol, 21, 'season', ret_5 * 2 FROM perf UNION ALL SELECT symbol, 21, 'prior', ret_252 / 12 FROM perf UNION ALL SELECT symbol, 126, 'drift', ret_126 FROM perf UNION ALL SELECT symbol, 126, 'prior', CASE WHEN ret_5 > 0 THEN ret_252 / 2 END FROM perf)"

    def agreed(s, d):
        p = B.performance(smooth(s, d))
        return P.agreement(s.sql(said.format(means=means.replace("FROM perf", "FROM {perf}")), perf=p), X.returns(smooth(s, d)).groupBy("symbol").agg(F.avg("ret").alias("daily")))

    daily = f", daily AS (SELECT symbol, avg(ret) AS daily FROM (SELECT symbol, close / lag(close) {W}) - 1 AS ret FROM bars) GROUP BY symbol)"
    c.add("component_agreement", agreed, "symbol h:int n:long ~stdev ~spread ~reference collinear", perf + daily, f"SELECT symbol, h, count(*) AS n, stddev_samp(mean) AS stdev, max(mean) - min(mean) AS spread, max(ref) AS reference, count(*) FILTER (abs(mean - ref) <= 0.25 * greatest(abs(ref), 1e-9)) >= 3 AS collinear FROM (SELECT m.*, (1 + daily) ** h - 1 AS ref FROM {means} m JOIN daily USING (symbol) WHERE mean IS NOT NULL) GROUP BY symbol, h")
    timed = "SELECT symbol, CASE WHEN ret_5 > -0.03 THEN ret_21 END AS mean, abs(ret_63) / 4 AS std, 0.5 + ret_5 AS p_bull, 0.3 - ret_5 AS p_bear, CASE WHEN ret_126 > 0 THEN 0.6 END AS hit FROM {perf}"
    c.add("timing_labels", lambda s, d: P.timing(s.sql(timed, perf=B.performance(smooth(s, d)))), "symbol ~score timing", perf, f"SELECT symbol, score, CASE WHEN score IS NULL THEN 'unknown' WHEN score > 0.25 THEN 'good' WHEN score < -0.25 THEN 'bad' ELSE 'neutral' END AS timing FROM (SELECT symbol, CASE WHEN mean IS NOT NULL THEN coalesce(mean / nullif(std, 0), 0) + p_bull - p_bear + coalesce(hit - 0.5, 0) END AS score FROM ({timed.format(perf='perf')}))")
    weights = lambda b: X.impact_weights(b, "Brand#11").select("symbol", "weight", F.col("r2").alias("share"))
    rets = SMOOTH + ", " + RETURNS.replace("rets AS", "r0 AS") + ", rets AS (SELECT symbol, date, ret FROM r0 WHERE ret IS NOT NULL)"
    c.add("watch_signals", lambda s, d: P.watched(weights(smooth(s, d))), "rank:int symbol ~weight ~share condition", rets, "SELECT row_number() OVER (ORDER BY weight DESC, symbol) AS rank, symbol, weight, share, symbol || ' moves more than 5% over 20 sessions' AS condition FROM (SELECT symbol, r2 AS share, r2 / sum(r2) OVER () AS weight FROM (SELECT a.symbol, corr(a.ret, b.ret) ** 2 AS r2 FROM rets a JOIN rets b ON a.date = b.date AND b.symbol = 'Brand#11' WHERE a.symbol <> 'Brand#11' GROUP BY a.symbol ORDER BY r2 DESC, a.symbol LIMIT 8)) QUALIFY rank <= 6")
    c.add("proxy_factors", lambda s, d: P.proxy_factors(smooth(s, d), RECIPES, "Brand#11", 0.02), "date factor ~value", rets, "SELECT date, 'MKT' AS factor, ret - 0.02 / 252 AS value FROM rets WHERE symbol = 'Brand#11' UNION ALL SELECT a.date, CASE b.symbol WHEN 'Brand#11' THEN 'SMB' ELSE 'HML' END, a.ret - b.ret FROM rets a JOIN rets b ON a.date = b.date AND ((a.symbol = 'Brand#12' AND b.symbol = 'Brand#11') OR (a.symbol = 'Brand#13' AND b.symbol = 'Brand#14'))")
    points = lambda s, d: tables.table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("date")).agg(F.max("o_totalprice").alias("value"))
    macro = "pts AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS value FROM orders GROUP BY ALL), mm AS (SELECT *, level - lag(level) OVER (PARTITION BY series_id ORDER BY month) AS change FROM (SELECT series_id, CAST(date_trunc('month', date) AS DATE) AS month, max_by(value, date) AS level FROM pts GROUP BY ALL))"
    c.add("macro_months", lambda s, d: P.macro_months(points(s, d)), "series_id month ~level ~change", macro, "SELECT * FROM mm")
    logs = "m0 AS (SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS month, max_by(close, date) AS close FROM bars GROUP BY ALL), lm AS (SELECT symbol, month, value FROM (SELECT symbol, month, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY month)) AS value, max(month) OVER (PARTITION BY symbol) AS newest FROM m0) WHERE month < newest AND value IS NOT NULL)"
    legs = "SELECT CASE symbol WHEN 'Brand#11' THEN 'SPY' ELSE 'GLD' END AS leg, month, value FROM lm WHERE symbol IN ('Brand#11', 'Brand#21') UNION ALL SELECT 'SIZE', a.month, a.value - b.value FROM lm a JOIN lm b ON a.month = b.month WHERE a.symbol = 'Brand#12' AND b.symbol = 'Brand#11' UNION ALL SELECT 'D_LOW', month, change FROM mm WHERE series_id = '5-LOW' AND change IS NOT NULL"
    made = lambda s, d: P.basket(smooth(s, d), points(s, d), LEGS, SPREADS, CHANGES)
    c.add("exposure_basket", made, "leg month ~value", SMOOTH + ", " + logs + ", " + macro, legs)

    def kept(s, d):
        b = made(s, d)
        short = b.where("leg <> 'GLD' OR month >= DATE'1998-01-01'")  # a leg with little history goes
        names, _ = P.pruned_legs(short, b.where("leg = 'SPY'"), 60)
        return short.where(F.col("leg").isin(*names)).groupBy("leg").agg(F.count("*").alias("n"))

    c.add("pruned_basket", kept, "leg n:long", SMOOTH + ", " + logs + ", " + macro, f"SELECT leg, count(*) AS n FROM ({legs}) WHERE leg <> 'GLD' GROUP BY leg")
    c.add("entropy_labels", lambda s, d: X.entropy_rolling(smooth(s, d)).groupBy("symbol").agg(F.max_by("entropy", "date").alias("entropy")).withColumn("label", P.entropy_label(F.col("entropy"))), "symbol label", "", "")
    c.sql["entropy_labels"] = "SELECT symbol, CASE WHEN entropy IS NULL THEN 'unknown' WHEN entropy < 0.35 THEN 'structure' WHEN entropy > 0.7 THEN 'noise' ELSE 'mixed' END AS label FROM (SELECT symbol, arg_max_null(entropy, date) AS entropy FROM (" + c.sql["entropy_rolling"] + ") GROUP BY symbol)"
    asked = "SELECT n_nationkey AS id, [' 15MIN', 'D', '', 'weekly', '5m', '1w'][n_nationkey % 6 + 1] AS raw, ['1d', '1y', '1mo', '10y'][n_nationkey % 4 + 1] AS period FROM nation"

    def options(s, d):
        x = tables.table(s, d, "nation").selectExpr("n_nationkey AS id", "array(' 15MIN', 'D', '', 'weekly', '5m', '1w')[n_nationkey % 6] AS raw", "array('1d', '1y', '1mo', '10y')[n_nationkey % 4] AS period")
        return x.withColumn("at", P.interval(F.col("raw"))).withColumn("span", P.clamped_period(F.col("period"), F.col("at")))

    c.add("interval_options", options, "id at span", "", f"SELECT id, at, CASE WHEN at = '15m' AND period NOT IN ('1d', '5d', '1mo') THEN '5d' ELSE period END AS span FROM (SELECT *, CASE raw WHEN ' 15MIN' THEN '15m' WHEN 'weekly' THEN '1w' WHEN '1w' THEN '1w' WHEN 'D' THEN '1d' WHEN '' THEN '1d' END AS \"at\" FROM ({asked}))".replace("id, at,", 'id, "at",').replace("WHEN at =", 'WHEN "at" ='))
    c.sql["interval_options"] = c.sql["interval_options"].replace("SELECT id, at, span", 'SELECT id, "at", span')
    c.add("series_payloads", lambda s, d: P.payload_series(P.series_payload(points(s, d))), "series_id date ~value", macro, "SELECT series_id, date, value FROM pts")
    shrunk = lambda b: X.base_rates(b).selectExpr("symbol", "h", "q25", "q75", "shrunk AS q50")
    c.add("base_rate_spreads", lambda s, d: P.spreads_by_horizon(shrunk(smooth(s, d))), "symbol h:int ~iqr ~median")
    c.sql["base_rate_spreads"] = "SELECT symbol, h, round(q75 - q25, 6) AS iqr, shrunk AS median FROM (SELECT * FROM (" + c.sql["base_rates"].replace("round(CAST(q25 AS DOUBLE), 6) + 0.0 AS q25", "q25").replace("round(CAST(q75 AS DOUBLE), 6) + 0.0 AS q75", "q75") + ")) JOIN (" + c.sql["shrunk_base_rates"] + ") USING (symbol, h)"

    def settled(s, d):
        """Forecasts as they stood, and what came of them."""
        x = c.queries["settled_means"](s, d)
        both = x.selectExpr("symbol", "date", "stack(2, 'seasonality', seasonal, 'regime', by_label) AS (component, predicted)")
        return G.skills(both, x.select("symbol", "date", "realized"))

    skill = f"""sm AS ({c.sql['settled_means']}), ag AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS age, count(*) OVER (PARTITION BY symbol) AS n FROM sm WHERE realized IS NOT NULL),
        bs AS (SELECT symbol, avg(realized) AS base FROM ag WHERE age > 252 GROUP BY symbol), te AS (SELECT ag.*, avg((realized - base) ** 2) OVER (PARTITION BY symbol) AS spread FROM ag JOIN bs USING (symbol) WHERE age <= 252 AND n > 312),
        lg AS (SELECT symbol, 'seasonality' AS component, realized, spread, seasonal AS predicted FROM te UNION ALL SELECT symbol, 'regime', realized, spread, by_label FROM te),
        sk AS (SELECT symbol, component, CASE WHEN count(predicted) >= 30 AND max(spread) > 0 THEN 1 - avg((realized - predicted) ** 2) / max(spread) END AS skill, count(predicted) AS n_test FROM (SELECT DISTINCT symbol FROM sm) CROSS JOIN (SELECT unnest(['seasonality', 'regime']) AS component) LEFT JOIN lg USING (symbol, component) GROUP BY symbol, component)"""  # fmt: skip
    c.add("component_skill", settled, "symbol component ~skill n_test:long", skill, "SELECT * FROM sk")
    wt = """, pr AS (SELECT *, CASE component WHEN 'regime' THEN 0.25 ELSE 0.15 END / 0.4 AS prior, greatest(skill, 0) AS up, count(skill) OVER (PARTITION BY symbol) AS k, min(skill) OVER (PARTITION BY symbol) AS worst FROM sk),
        cr AS (SELECT *, CASE WHEN skill IS NULL THEN NULL WHEN k >= 2 AND (SELECT sum(up) FROM pr p WHERE p.symbol = pr.symbol) <= 0 THEN skill - worst ELSE up END AS credit FROM pr),
        me AS (SELECT *, CASE WHEN coalesce(sum(credit) OVER w, 0) <= 0 OR skill IS NULL THEN prior ELSE credit / sum(credit) OVER w * sum(CASE WHEN skill IS NOT NULL THEN prior END) OVER w END AS measured FROM cr WINDOW w AS (PARTITION BY symbol))"""  # fmt: skip
    c.add("component_weights", lambda s, d: G.weights(settled(s, d), G.PRIOR), "symbol component ~weight", skill + wt, "SELECT symbol, component, 0.5 * prior + 0.5 * measured / sum(measured) OVER (PARTITION BY symbol) AS weight FROM me")
    parts = "SELECT symbol, CAST(h AS INT) AS h, 'drift' AS component, CASE WHEN ret_5 > -0.03 THEN ret_126 END AS value, abs(ret_21) * 5 AS evidence, CASE WHEN ret_63 > 0 THEN ret_63 / 4 - 0.02 END AS skill, CASE WHEN ret_21 > 0 THEN 1500 END AS n_obs, CASE WHEN ret_252 > -0.3 THEN 8e-2 * h / 252 END AS prior, -0.1 AS low, 0.12 AS high FROM {perf} {each}"
    c.add("shrunk_components", lambda s, d: G.shrunk(s.sql(parts.replace("{each}", "LATERAL VIEW explode(array(21, 126)) t AS h"), perf=B.performance(smooth(s, d)))), "symbol h:int ~confidence ~calibrated clamped", perf, f"""SELECT symbol, h, confidence, CASE WHEN raw < low THEN low WHEN raw > high THEN high ELSE raw END AS calibrated, CASE WHEN raw < low THEN 'low' WHEN raw > high THEN 'high' END AS clamped FROM (SELECT *, coalesce(confidence * value + (1 - confidence) * prior, value) AS raw FROM (
        SELECT *, least(0.9, least(1, evidence) * CASE WHEN skill IS NULL THEN 0.5 ELSE greatest(0.25, 0.5 + least(1, greatest(-1, skill / 0.05)) / 2) END * (coalesce(n_obs, 2520) / h) / (coalesce(n_obs, 2520) / h + 10)) AS confidence FROM ({parts.format(perf='perf', each=', unnest([21, 126]) AS t(h)')})))""")  # fmt: skip
