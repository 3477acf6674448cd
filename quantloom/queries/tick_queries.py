"""Queries over ticks, option contracts, vectors and the alert workflow."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import options as O
from quantloom.operators import ticks as T
from quantloom.operators import workflow as A
from quantloom.functions import scalars as S
from quantloom.plans import charts
from quantloom.queries import Catalog
from quantloom.queries.bar_queries import AGE
from quantloom.queries.sql import CONTRACTS, SMOOTH
from quantloom.sources import tables

SPOT = 120.0


def register(c: Catalog) -> None:
    ticks = tables.ticks
    bucket = "time_bucket(INTERVAL 15 MINUTE, ts)"
    c.add("ticks_15m_ohlc", lambda s, d: T.ohlc(ticks(s, d)), "symbol start ~open ~high ~low ~close n:long", "", f"SELECT event_type AS symbol, {bucket} AS start, min_by(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, max_by(value, row(ts, event_id)) AS close, count(*) AS n FROM events GROUP BY ALL")
    c.add("ticks_session", lambda s, d: T.sessions(ticks(s, d)), "user_id start n:long ~total", "", """SELECT user_id, min(ts) AS start, count(*) AS n, sum(value) AS total FROM (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM (
        SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE, true) AS new FROM events)) GROUP BY user_id, sid""")  # fmt: skip
    c.add("latest_per_key", lambda s, d: T.latest(ticks(s, d)), "symbol user_id ~price ts", "", "SELECT event_type AS symbol, user_id, max_by(value, row(ts, event_id)) AS price, max(ts) AS ts FROM events GROUP BY ALL")
    c.add("live_bar_upsert", lambda s, d: T.open_bars(ticks(s, d)), "symbol bucket ~open ~high ~low ~close n:long", "", f"""SELECT symbol, bucket, min_by(value, event_id) AS open, max(value) AS high, min(value) AS low, max_by(value, event_id) AS close, count(*) AS n FROM (
        SELECT *, event_type AS symbol, {bucket} AS bucket, max({bucket}) OVER (PARTITION BY event_type ORDER BY event_id) AS newest FROM events) WHERE bucket = newest GROUP BY ALL""")  # fmt: skip
    c.add("run_deltas", lambda s, d: T.deltas(ticks(s, d)), "event_id ~delta", "", "SELECT event_id, value - lag(value) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS delta FROM events")
    c.add("props_json", lambda s, d: ticks(s, d).withColumn("k", F.explode(F.json_object_keys("props"))).groupBy("k").agg(F.count("*").alias("n")), "k n:long", "", "SELECT k, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY k")
    con = tables.contracts
    days = "date_diff('day', DATE '2024-01-15', expiry)"
    c.add("nearest_expiry", lambda s, d: O.nearest_expiry(con(s, d), "2024-01-15"), "underlying target:int expiry", CONTRACTS, f"SELECT underlying, target, min_by(expiry, row(abs({days} - target), {days})) AS expiry FROM (SELECT DISTINCT underlying, expiry FROM contracts), unnest([30, 61, 91, 182, 365, 548]) AS t(target) WHERE {days} > 0 GROUP BY ALL")
    lad = "lad AS (SELECT underlying, strike, coalesce(sum(oi) FILTER (type = 'call'), 0) AS call_oi, coalesce(sum(oi) FILTER (type = 'put'), 0) AS put_oi FROM contracts GROUP BY ALL)"
    c.add("nearest_strikes", lambda s, d: O.ladder(con(s, d), SPOT), "underlying strike call_oi:long put_oi:long net:long ~pcr", CONTRACTS + ", " + lad, f"SELECT *, call_oi - put_oi AS net, coalesce(put_oi / nullif(call_oi, 0), 0) AS pcr FROM (SELECT *, row_number() OVER (PARTITION BY underlying ORDER BY abs(strike - {SPOT}), strike) AS rn FROM lad) WHERE rn <= 9")
    c.add("open_interest", lambda s, d: O.open_interest(con(s, d), SPOT), "underlying calls:long puts:long ~peak net_near:long ~pcr", CONTRACTS + ", " + lad, f"SELECT *, puts / nullif(calls, 0) AS pcr FROM (SELECT underlying, sum(call_oi) AS calls, sum(put_oi) AS puts, max_by(strike, row(call_oi + put_oi, -strike)) AS peak, min_by(call_oi - put_oi, row(abs(strike - {SPOT}), strike)) AS net_near FROM lad GROUP BY underlying)")
    c.add("third_friday", lambda s, d: tables.table(s, d, "orders").select(F.trunc("o_orderdate", "month").alias("month")).distinct().select("month", O.third_friday("month").alias("third")), "month third", "", "SELECT month, CAST(month + CAST((5 - isodow(month) + 7) % 7 + 14 AS INTEGER) AS DATE) AS third FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders)")
    c.add("implied_density", lambda s, d: O.implied_density(con(s, d), SPOT, "2024-01-01"), "underlying expiry ~q25 ~q50 ~q75 n:int")
    smooth = tables.bars_smooth
    c.add("cockpit_rank", lambda s, d: A.cockpit(smooth(s, d)), "symbol ~score lane rank:long")
    scan = "scan AS (SELECT s.symbol, score, CASE WHEN score >= 45 THEN 'Priority' WHEN score >= 18 THEN 'Watch' WHEN score <= -18 THEN 'Risk' ELSE 'Review' END AS lane, row_number() OVER (ORDER BY score DESC, s.symbol) AS rank FROM (SELECT symbol, round((last / first - 1) * 100, 2) AS score FROM (SELECT symbol, max_by(close, date) AS last, min_by(close, date) AS first FROM bars GROUP BY symbol)) s)"

    def lanes(s, d):
        g = smooth(s, d).groupBy("symbol").agg(F.round((F.max_by("close", "date") / F.min_by("close", "date") - 1) * 100, 2).alias("score"))
        return A.scan_filter(g.withColumn("lane", A.lane("score")))

    c.add("scan_lanes", lanes, "symbol ~score lane rank:long", SMOOTH + ", " + scan, "SELECT * FROM scan")
    c.add("torque_filter_sort", lambda s, d: A.scan_filter(lanes(s, d), ["WATCH", "risk", "priority"], low=-60, limit=10), "symbol ~score lane rank:long", SMOOTH + ", " + scan, "SELECT * FROM (SELECT symbol, score, lane, row_number() OVER (ORDER BY score DESC, symbol) AS rank FROM scan WHERE lane IN ('Watch', 'Risk', 'Priority') AND score >= -60) WHERE rank <= 10")
    c.add("stage_counts", lambda s, d: A.stage_counts(lanes(s, d)), "lane n:long", SMOOTH + ", " + scan, "SELECT lane, count(*) AS n FROM scan GROUP BY lane")

    def flagged(s, d):
        where = {r: F.when(F.col("score") > 30, "above value").when(F.col("score") < -30, "below value").otherwise("inside value") for r in ("location",)}
        return lanes(s, d).withColumns({"location": where["location"], "recommendation": F.when(F.col("score") > 50, "BUY").when(F.col("score") < -50, "SELL").otherwise("CASH"), "fresh_long": F.col("rank") % 5 == 0, "fresh_short": F.col("rank") % 10 == 0, "volatility": F.col("rank") / 50.0})

    rule = [("lane = 'Priority'", "priority-setup", "High", "Setup"), ("lane = 'Risk'", "risk-lane", "High", "Risk"), ("rank % 10 = 0", "fresh-short-flow", "High", "Flow"), ("rank % 5 = 0 AND rank % 10 <> 0", "fresh-long-flow", "Medium", "Flow"), ("score < -50", "ridge-sell", "High", "Ridge"), ("score > 50", "ridge-buy", "High", "Ridge"), ("score > 30", "auction-above-value", "Medium", "Auction"), ("score < -30", "auction-below-value", "Medium", "Auction"), ("rank / 50.0 >= 0.45", "high-volatility", "Medium", "Volatility")]
    found = SMOOTH + ", " + scan + ", alerts AS (" + " UNION ALL ".join(f"SELECT symbol, rank, lane, score, '{k}' AS kind, '{v}' AS severity, '{g}' AS category, lower(symbol) || '-{k}' AS id FROM scan WHERE {w}" for w, k, v, g in rule) + ")"
    c.add("alerts_explode", lambda s, d: A.alerts(flagged(s, d)), "id symbol rank:long lane ~score kind severity category", found, "SELECT * FROM alerts")
    c.add("alert_digest", lambda s, d: A.digest(A.alerts(flagged(s, d)), 12), "id severity ~score rank:long", found, "SELECT * FROM alerts ORDER BY CASE WHEN severity = 'High' THEN 0 ELSE 1 END, score DESC, rank, id LIMIT 12")
    c.add("alert_digest_grouping_sets", lambda s, d: A.digest_counts(A.alerts(flagged(s, d))), "dimension value n:long", found, "SELECT CASE WHEN severity IS NOT NULL THEN 'severity' WHEN category IS NOT NULL THEN 'category' ELSE 'lane' END AS dimension, coalesce(severity, category, lane) AS value, count(*) AS n FROM alerts GROUP BY GROUPING SETS ((severity), (category), (lane))")
    c.add("key_levels", lambda s, d: A.key_levels(smooth(s, d)), "symbol level ~value rank:long", SMOOTH, f"""SELECT symbol, level, value, row_number() OVER (PARTITION BY symbol ORDER BY abs(value / close - 1), level) AS rank FROM (UNPIVOT (
        SELECT symbol, max_by(close, date) AS close, max(high) FILTER (age BETWEEN 2 AND 22) AS vah, min(low) FILTER (age BETWEEN 2 AND 22) AS val, quantile_cont(close, 0.5) FILTER (age BETWEEN 2 AND 22) AS poc, max(high) AS high_252, min(low) AS low_252, max(high) FILTER (age <= 21) AS high_21, min(low) FILTER (age <= 21) AS low_21
        FROM (SELECT *, {AGE} FROM bars) WHERE age <= 252 GROUP BY symbol) ON vah, val, poc, high_252, low_252, high_21, low_21 INTO NAME level VALUE value)""")  # fmt: skip
    c.add("bundle_windows", lambda s, d: charts.windows(smooth(s, d)).groupBy("window", "symbol").agg(F.count("*").alias("n"), F.max("high").alias("high")), "window symbol n:long ~high", SMOOTH, """SELECT w AS "window", symbol, count(*) AS n, max(high) AS high FROM bars JOIN (SELECT symbol, max(date) AS last FROM bars GROUP BY symbol) USING (symbol),
        (VALUES ('1mo', 1), ('3mo', 3), ('1y', 12)) AS t(w, m) WHERE date > CAST(last - to_months(CAST(m AS INTEGER)) AS DATE) GROUP BY ALL""")  # fmt: skip
    c.sql["bundle_windows"] = c.sql["bundle_windows"].replace("SELECT window,", 'SELECT "window",', 1)
    c.add("session_bucket_eastern", lambda s, d: ticks(s, d).select("event_id", *(S.session_bucket(F.col("ts").cast("timestamp"), i).cast("timestamp_ntz").alias(n) for i, n in (("15m", "m15"), ("1d", "day"), ("1w", "week")))), "event_id m15 day week", "", """SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts) AS m15,
        date_trunc('day', ts - INTERVAL 5 HOUR) + INTERVAL 5 HOUR AS day, date_trunc('week', ts - INTERVAL 5 HOUR) + INTERVAL 5 HOUR AS week FROM events""")  # fmt: skip
    c.add("epoch_units", lambda s, d: ticks(s, d).select("event_id", S.from_epoch(F.unix_millis(F.col("ts").cast("timestamp")) * F.element_at(F.array(*map(F.lit, (1, 1000, 1000000))), (F.col("event_id") % 3 + 1).cast("int"))).alias("ts")).select("event_id", F.unix_millis("ts").alias("ms")), "event_id ms:long", "", "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")
    c.add("compact_numbers", lambda s, d: tables.table(s, d, "orders").select("o_orderkey", S.compact(F.col("o_totalprice").cast("double") * 1000).alias("label")), "o_orderkey label")
