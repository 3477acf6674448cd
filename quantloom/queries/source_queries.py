"""Queries over sources, stores, scalar functions, streams and the alert workflow.

What a vendor would send (JSON, CSV, HTML) is written from the test tables first, so that each query parses texts of the
landed form and its SQL knows the values in them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions import scalars as S
from quantloom.operators import bars as B
from quantloom.operators import fundamentals as Q
from quantloom.operators import options as O
from quantloom.operators import alertruns as R
from quantloom.operators import workflow as A
from quantloom.queries import Catalog
from quantloom.queries.bar_queries import AGE
from quantloom.queries.sql import CONTRACTS, QUARTERS, SMOOTH
from quantloom.session import shared_folder
from quantloom.sources import landing, sinks, tables
from quantloom.streaming import live

#: A symbol's parts of a cockpit score, from its own performance: the recursive parts have tests of their own.
PARTS = """SELECT symbol, ret_63 * 100 AS scan, ret_21 * 300 AS flow_score, CASE WHEN ret_5 > 0 THEN 'LONG OK' ELSE 'NEUTRAL' END AS flow_state,
    CASE WHEN ret_126 > 0.3 THEN 'BUY' WHEN ret_126 > 0.1 THEN 'BUY SETUP' WHEN ret_126 > 0 THEN 'HOLD LONG' WHEN ret_126 > -0.1 THEN 'WATCH' WHEN ret_126 > -0.2 THEN 'CASH' ELSE 'SELL' END AS recommendation,
    CASE WHEN ret_126 > 0 THEN 'LONG' WHEN ret_63 > 0 THEN 'WATCH' ELSE 'CASH' END AS state, CASE WHEN ret_21 > 0.05 THEN 'above value' WHEN ret_21 < -0.05 THEN 'below value' ELSE 'inside value' END AS location,
    ret_5 > 0.02 AS fresh_long, ret_5 < -0.02 AS fresh_short, ret_504 AS total_return, from_high AS max_drawdown, abs(ret_126) AS volatility,
    CASE WHEN ret_21 > -0.1 THEN round(50 + ret_252 * 60, 4) END AS setup_total, CASE WHEN ret_252 > 0.2 THEN 'Coiled Spring' WHEN ret_252 > 0 THEN 'Inflecting' WHEN ret_252 > -0.2 THEN 'Proof Phase' ELSE 'No Setup' END AS stage FROM {perf}"""
POINTS = """CASE recommendation WHEN 'BUY' THEN 30 WHEN 'BUY SETUP' THEN 22 WHEN 'HOLD LONG' THEN 18 WHEN 'WATCH' THEN 6 WHEN 'CASH' THEN -8 ELSE -30 END + CASE state WHEN 'LONG' THEN 8 WHEN 'WATCH' THEN 2 ELSE -5 END
    + CASE location WHEN 'above value' THEN 8 WHEN 'inside value' THEN 2 ELSE -8 END + CASE WHEN fresh_long THEN 10 ELSE 0 END - CASE WHEN fresh_short THEN 14 ELSE 0 END"""
MEMBERS = "orders JOIN customer ON o_custkey = c_custkey"


def register(c: Catalog) -> None:
    smooth, table = tables.bars_smooth, tables.table
    sources(c, smooth, table)
    filings(c, table)
    dimensions(c, smooth, table)
    stores(c, smooth, table)
    workflow(c, smooth)
    streams(c)


def sources(c: Catalog, smooth, table) -> None:
    c.add("history_in_period", lambda s, d: landing.in_period(smooth(s, d), "6mo", "1998-06-30"), "symbol date ~close", SMOOTH, "SELECT symbol, date, close FROM bars WHERE date BETWEEN DATE '1998-07-01' - 220 AND DATE '1998-07-01'")

    def vendor_json(s, d):
        epoch = F.unix_seconds(F.col("date").cast("timestamp"))
        unit = F.element_at(F.array(F.lit(1), F.lit(1000), F.lit(1000000), F.lit(1000000000)), F.month("date") % 4 + 1)
        row = F.struct((epoch * unit).alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.when(F.month("date") != 5, F.col("volume")).alias("v"))
        return smooth(s, d).groupBy("symbol", F.year("date")).agg(F.to_json(F.struct(F.collect_list(row).alias("results"))).alias("json"))

    c.add("vendor_aggregates", lambda s, d: landing.aggregates(vendor_json(s, d)), "symbol date ~open ~high ~low ~close ~volume", SMOOTH, "SELECT symbol, date, open, high, low, close, CASE WHEN month(date) <> 5 THEN volume ELSE 0 END AS volume FROM bars")
    cents = lambda k: F.floor(F.col(k) * 100).cast("long")

    def vendor_csv(s, d):
        text = lambda k: F.when(F.col("symbol") == "Brand#21", F.lit("N/A") if k == "low" else F.lit("")).otherwise(F.concat(F.lit("$"), F.format_number((cents(k) / 100).cast("decimal(20,2)"), 2)))
        b = smooth(s, d)
        return b.select("symbol", F.date_format("date", "MM/dd/yyyy").alias("date"), *((text(k) if k in ("low", "close") else F.concat(F.lit("$"), F.format_number((cents(k) / 100).cast("decimal(20,2)"), 2))).alias(k) for k in ("open", "high", "low", "close")), F.format_number(F.col("volume"), 0).alias("volume"))

    money = lambda k: f"CASE WHEN symbol <> 'Brand#21' THEN floor({k} * 100) / 100 END AS {k}" if k in ("low", "close") else f"floor({k} * 100) / 100 AS {k}"
    c.add("vendor_csv", lambda s, d: landing.csv_history(vendor_csv(s, d)), "symbol date ~open ~high ~low ~close ~volume", SMOOTH, f"SELECT symbol, date, {', '.join(map(money, ('open', 'high', 'low', 'close')))}, volume FROM bars")
    late = "date >= CASE WHEN symbol < 'Brand#3' THEN DATE '1900-01-01' ELSE DATE '1994-01-01' END"
    c.add("provider_fallback", lambda s, d: landing.prefer(smooth(s, d).where(late + " and symbol < 'Brand#5'"), smooth(s, d)).groupBy("symbol", "provider").agg(F.count("*").alias("n"), F.min("date").alias("since")), "symbol provider n:long since",
          SMOOTH + f", one AS (SELECT * FROM bars WHERE {late} AND symbol < 'Brand#5'), span AS (SELECT symbol, min(date) AS lo, max(date) AS hi FROM bars GROUP BY symbol), good AS (SELECT symbol FROM span JOIN (SELECT symbol, min(date) AS own FROM one GROUP BY symbol) USING (symbol) WHERE hi - lo < 365 OR own - lo <= 90)",
          "SELECT symbol, provider, count(*) AS n, min(date) AS since FROM (SELECT symbol, date, 'first' AS provider FROM one WHERE symbol IN (FROM good) UNION ALL SELECT symbol, date, 'second' FROM bars WHERE symbol NOT IN (FROM good)) GROUP BY ALL")
    monthly = "SELECT o_orderpriority AS series_id, date_trunc('month', o_orderdate) AS m, count(*) AS n FROM {orders} GROUP BY 1, 2"
    c.add("economic_series", lambda s, d: landing.series(s.sql(monthly, orders=table(s, d, "orders")).selectExpr("series_id", "date_format(m, 'yyyy-MM-dd') AS date", "if(n % 5 = 0, '.', concat(n, '.25')) AS value")), "series_id date ~value", "", f"SELECT series_id, CAST(m AS DATE) AS date, n + 0.25 AS value FROM ({monthly.format(orders='orders')}) WHERE n % 5 <> 0")

    def factor_file(s, d):
        x = smooth(s, d).where("symbol = 'Brand#11'").selectExpr("date", "cast(floor(close * 10) as long) AS a", "cast(volume as long) AS b")
        line = F.concat_ws(", ", F.date_format("date", "yyyyMMdd"), (F.col("a") / 100).cast("decimal(20,2)").cast("string"), F.when(F.col("b") % 7 == 0, "-99.99").otherwise(F.col("b").cast("string")), F.when(F.col("b") % 5 == 0, "-999").otherwise("1.50"), F.lit("0.25"), F.lit("-0.10"), F.lit("0.01"))
        head = s.createDataFrame([("This file was created for a test",), ("",), (",Mkt-RF,SMB,HML,RMW,CMA,RF",), ("Copyright 2024",), ("1998, 1.0, 2.0",)], "value string")
        return head.unionByName(x.select(line.alias("value")))

    c.add("factor_file", lambda s, d: landing.factors(factor_file(s, d)), "date ~mkt ~smb ~hml ~rmw ~cma ~rf", SMOOTH, "SELECT date, floor(close * 10) / 1e4 AS mkt, CASE WHEN CAST(volume AS BIGINT) % 7 <> 0 THEN volume / 100 END AS smb, CASE WHEN CAST(volume AS BIGINT) % 5 <> 0 THEN 0.015 END AS hml, 0.0025 AS rmw, -0.001 AS cma, 0.0001 AS rf FROM bars WHERE symbol = 'Brand#11'")

    def pages(s, d):
        o = table(s, d, "customer").select(F.col("c_nationkey").alias("list_id"), F.concat(F.lit("NYSE:"), F.lower(F.substring("c_name", -6, 6)), F.when(F.col("c_custkey") % 3 == 0, ".b").when(F.col("c_custkey") % 11 == 0, " no").otherwise("")).alias("t"))
        return o.groupBy("list_id").agg(F.concat(F.lit('<script>{"x": 1, "symbols" : '), F.to_json(F.collect_list("t")), F.lit('}</script>')).alias("html"))

    name = "upper(right(c_name, 6)) || CASE WHEN c_custkey % 3 = 0 THEN '-B' WHEN c_custkey % 11 = 0 THEN ' NO' ELSE '' END"
    c.add("watchlist_symbols", lambda s, d: landing.watchlist(pages(s, d)), "list_id symbol", "", f"SELECT DISTINCT c_nationkey AS list_id, {name} AS symbol FROM customer WHERE {name} NOT LIKE '% NO'")

    def news(s, d):
        e = table(s, d, "events")
        return e.select(F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("url"), F.to_date("ts").alias("published"), F.array_distinct(F.array("event_type", F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string")), F.lit("t1"))).alias("tickers"))

    c.add("news_about", lambda s, d: landing.news_about(news(s, d), "t2", 2, 50), "url published", "", "SELECT 'u' || event_id AS url, CAST(ts AS DATE) AS published FROM events WHERE user_id % 4 = 2 ORDER BY published DESC, url LIMIT 50")

    def chain(s, d):
        k = tables.contracts(s, d)
        bid = F.when(F.col("oi") % 2 == 0, F.col("mark") - 0.5).otherwise(0.0)
        r = F.struct(F.struct(F.col("strike").alias("strike_price"), F.col("expiry").cast("string").alias("expiration_date"), F.col("type").alias("contract_type")).alias("details"), F.when(F.col("oi") > 1, F.col("oi").cast("double")).alias("open_interest"),
                     F.lit(0.25).alias("implied_volatility"), F.struct(F.lit(0.5).alias("delta")).alias("greeks"), F.struct(bid.alias("bid"), (F.col("mark") + 1.5).alias("ask")).alias("last_quote"), F.struct(F.col("mark").alias("close")).alias("day"), F.struct(F.lit(120.0).alias("price")).alias("underlying_asset"))
        return k.groupBy("underlying").agg(F.to_json(F.struct(F.collect_list(r).alias("results"))).alias("json"))

    c.add("option_chain_rows", lambda s, d: landing.chain_rows(chain(s, d)), "underlying expiry ~strike type ~oi ~iv ~delta ~mark ~spot", CONTRACTS, "SELECT underlying, expiry, strike, type, CASE WHEN oi > 1 THEN oi ELSE 0 END AS oi, 0.25 AS iv, 0.5 AS delta, CASE WHEN oi % 2 = 0 AND mark > 0.5 THEN mark + 0.5 ELSE mark END AS mark, 120.0 AS spot FROM contracts WHERE strike > 0")
    quoted = "SELECT underlying, expiry, strike, type, CASE WHEN oi % 3 = 0 THEN NULL ELSE mark - 1 END AS bid, CASE WHEN oi % 2 = 0 THEN mark - 2 ELSE mark + 1 END AS ask, CASE WHEN oi % 4 = 0 THEN 0.0 ELSE mark END AS day_close, mark * 2 AS last FROM {contracts}"
    c.add("quote_mid", lambda s, d: s.sql(quoted, contracts=tables.contracts(s, d)).withColumn("mid", O.mid()), "underlying expiry ~strike type ~mid", CONTRACTS, f"SELECT *, CASE WHEN bid > 0 AND ask >= bid THEN (bid + ask) / 2 WHEN day_close > 0 THEN day_close WHEN last > 0 THEN last END AS mid FROM ({quoted.format(contracts='contracts')})")
    c.add("first_at_strike", lambda s, d: O.first_at_strike(tables.contracts(s, d)), "underlying ~strike call:long put:long", CONTRACTS, "SELECT underlying, strike, coalesce(min_by(oi, row(expiry, oi)) FILTER (type = 'call'), 0) AS call, coalesce(min_by(oi, row(expiry, oi)) FILTER (type = 'put'), 0) AS put FROM contracts GROUP BY ALL")
    zoned = "SELECT underlying AS symbol, CAST(h AS INT) AS h, CASE WHEN underlying = 'Brand#11' THEN NULL ELSE 100.0 END AS spot, -h * avg(mark) / 400 AS q25, h * max(mark) / 400 AS q75 FROM {contracts} {each} GROUP BY 1, 2, 3, h"
    c.add("implied_zones", lambda s, d: O.zones(s.sql(zoned.replace("{each}", "LATERAL VIEW explode(array(1, 3, 6)) t AS h"), contracts=tables.contracts(s, d))), "symbol ~cheap_lo ~cheap_hi ~rich_lo ~rich_hi horizon", CONTRACTS, f"SELECT symbol, round(min(100 * (1 + q25)), 4) AS cheap_lo, round(max(100 * (1 + q25)), 4) AS cheap_hi, round(min(100 * (1 + q75)), 4) AS rich_lo, round(max(100 * (1 + q75)), 4) AS rich_hi, '3m-6m' AS horizon FROM ({zoned.format(contracts='contracts', each=', unnest([3, 6]) AS t(h)')}) WHERE spot > 0 GROUP BY symbol")


def filings(c: Catalog, table) -> None:
    def facts(s, d):
        q = tables.quarters(s, d)
        row = F.struct(F.col("period_end").cast("string").alias("end"), F.col("value").alias("val"), F.col("filing_date").cast("string").alias("filed"), F.lit("10-Q").alias("form"), F.col("fiscal_year").alias("fy"), F.concat(F.lit("Q"), F.col("fiscal_quarter").cast("string")).alias("fp"))
        long = q.select("symbol", "period_end", "filing_date", "fiscal_year", "fiscal_quarter", F.expr("stack(2, 'Revenues', revenue, 'GrossProfit', gross_profit) AS (concept, value)"))
        units = long.groupBy("symbol", "concept").agg(F.create_map(F.lit("USD"), F.collect_list(row)).alias("units"))
        concepts = units.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("concept", F.struct("units")))).alias("c"))
        return concepts.select("symbol", F.to_json(F.struct(F.create_map(F.lit("us-gaap"), F.col("c")).alias("facts"))).alias("json"))

    long = "(SELECT symbol, period_end, filing_date, fiscal_year, 'Q' || fiscal_quarter AS fiscal_period, unnest(['Revenues', 'GrossProfit']) AS concept, unnest([revenue, gross_profit]) AS value FROM quarters)"
    c.add("company_facts", lambda s, d: landing.company_facts(facts(s, d)), "symbol taxonomy concept unit period_end ~value filing_date form fiscal_year:int fiscal_period", QUARTERS, f"SELECT *, 'us-gaap' AS taxonomy, 'USD' AS unit, '10-Q' AS form FROM {long}")
    c.add("pick_fact", lambda s, d: landing.pick_fact(landing.company_facts(facts(s, d)), ["SalesRevenueNet", "Revenues", "GrossProfit"]), "symbol concept ~value period_end", QUARTERS, f"SELECT symbol, concept, value, period_end FROM {long} WHERE concept = 'Revenues' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY filing_date DESC) = 1")

    def index(s, d):
        o, cu = table(s, d, "orders"), table(s, d, "customer")
        x = o.join(cu, o.o_custkey == cu.c_custkey).select(F.col("c_mktsegment").alias("symbol"), F.col("o_orderkey").alias("k"), F.element_at(F.create_map(F.lit("F"), F.lit("10-K"), F.lit("O"), F.lit("10-Q"), F.lit("P"), F.lit("8-K")), F.col("o_orderstatus")).alias("form"), F.to_date("o_orderdate").cast("string").alias("day"))
        rows = x.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("k", "form", "day"))).alias("r"))
        return rows.select("symbol", F.to_json(F.struct(F.col("r.form").alias("form"), F.col("r.day").alias("filingDate"), F.transform("r", lambda y: y["k"].cast("string")).alias("accessionNumber"))).alias("json"))

    subs = f"subs AS (SELECT c_mktsegment AS symbol, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_orderkey) - 1 AS pos, CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-Q' ELSE '8-K' END AS form, CAST(o_orderdate AS DATE) AS filing_date, CAST(o_orderkey AS VARCHAR) AS accession FROM {MEMBERS})"
    c.add("filing_index", lambda s, d: landing.submissions(index(s, d)), "symbol pos:int form filing_date accession", subs, "SELECT * FROM subs")
    c.add("newest_filings", lambda s, d: landing.newest_filings(landing.submissions(index(s, d)), "1997-01-01", {"10-K": 2, "10-Q": 4}), "symbol form filing_date accession", subs, "SELECT * FROM subs WHERE filing_date <= DATE '1997-01-01' AND form IN ('10-K', '10-Q') QUALIFY row_number() OVER (PARTITION BY symbol, form ORDER BY filing_date DESC, pos) <= CASE form WHEN '10-K' THEN 2 ELSE 4 END")

    def merged(s, d):
        q = tables.quarters(s, d)
        dims = ["symbol", "period_end", "fiscal_quarter", "fiscal_year", "filing_date"]
        income = q.where("fiscal_quarter <> 2").select(*dims, "revenue", "gross_profit", "operating_income", (F.col("operating_income") * 0.7).alias("net_income"))
        balance = q.select(*dims, F.when(F.col("fiscal_quarter") != 3, F.col("revenue") * 0.5).alias("long_term_debt"), F.when(F.col("fiscal_quarter") == 4, F.col("revenue") * 0.1).alias("debt_current"))
        cash = q.where("fiscal_quarter <> 1").select(*dims, "cfo", "capex")
        return Q.merge_statements(income, balance, cash, 8)

    gone = lambda k, q: f"CASE WHEN fiscal_quarter <> {q} THEN {k} END"
    c.add("merged_statements", merged, "symbol period_end fiscal_quarter:int ~revenue ~fcf ~total_debt ~gross_margin ~net_margin ~fcf_margin", QUARTERS,
          f"SELECT *, fcf / nullif(revenue, 0) AS fcf_margin, gp / nullif(revenue, 0) AS gross_margin, oi * 0.7 / nullif(revenue, 0) AS net_margin FROM (SELECT symbol, period_end, fiscal_quarter, {gone('revenue', 2)} AS revenue, {gone('gross_profit', 2)} AS gp, {gone('operating_income', 2)} AS oi, {gone('cfo - abs(capex)', 1)} AS fcf, CASE WHEN fiscal_quarter = 4 THEN revenue * 0.6 WHEN fiscal_quarter <> 3 THEN revenue * 0.5 END AS total_debt, row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC) AS age FROM quarters) WHERE age <= 8")


def dimensions(c: Catalog, smooth, table) -> None:
    def ids(s, d):
        x = table(s, d, "customer").select(F.struct(F.lower(F.substring("c_name", -6, 6)).alias("ticker"), (F.col("c_custkey") * 7).alias("cik_str")).alias("v"), F.col("c_custkey").cast("string").alias("k"))
        return x.groupBy(F.substring("k", 1, 2)).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("json"))

    c.add("company_ids", lambda s, d: landing.company_ids(ids(s, d)), "symbol cik", "", "SELECT upper(right(c_name, 6)) AS symbol, lpad(CAST(max_by(c_custkey * 7, c_custkey) AS VARCHAR), 10, '0') AS cik FROM customer GROUP BY 1")
    dim = lambda s, d: table(s, d, "part").groupBy(F.col("p_brand").alias("symbol")).agg(F.element_at(F.split(F.min("p_type"), " "), 1).alias("sector"))
    dims = "dim AS (SELECT p_brand AS symbol, lower(split_part(min(p_type), ' ', 1)) AS sector FROM part GROUP BY 1)"
    c.add("peer_universe", lambda s, d: landing.universe(dim(s, d), symbol="Brand#11", broad=True, limit=20), "symbol pos:int", dims, "SELECT symbol, row_number() OVER (ORDER BY CASE WHEN sector = (SELECT sector FROM dim WHERE symbol = 'Brand#11') THEN 1 ELSE 2 END, symbol) AS pos FROM dim QUALIFY pos <= 20")
    c.add("stock_summary", lambda s, d: B.summary(smooth(s, d)), "symbol ~price ~change ~change_percent ~annual ~trend ~high ~low", SMOOTH + f", ag AS (SELECT *, {AGE} FROM (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM bars))",
          "SELECT symbol, price, price - before AS change, (price - before) / before * 100 AS change_percent, annual, CASE WHEN n >= 50 THEN price / mean - 1 ELSE 0 END AS trend, high, low FROM (SELECT symbol, max(close) FILTER (age = 1) AS price, coalesce(max(close) FILTER (age = 2), max(close) FILTER (age = 1)) AS before, coalesce(stddev_samp(ret) * sqrt(252), 0) AS annual, avg(close) FILTER (age <= 50) AS mean, count(*) AS n, max(close) FILTER (age <= 252) AS high, min(close) FILTER (age <= 252) AS low FROM ag WHERE age <= 504 GROUP BY symbol)")
    c.add("axis_labels", lambda s, d: table(s, d, "events").select("event_id", S.series_label(F.col("ts"), F.when(F.col("event_id") % 2 == 0, "15m").otherwise("1d")).alias("label")), "event_id label", "", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%d') END AS label FROM events")

    def walked(s, d):
        quarters = F.struct(F.array(F.struct(F.col("r_name").alias("Revenue"), F.col("r_regionkey").alias("key"))).alias("Quarters"))
        path = F.element_at(F.array(F.lit("Quarters[0].revenue"), F.lit("quarters[0].key"), F.lit("Quarters[1].key"), F.lit("Quarters.key")), F.col("r_regionkey") % 4 + 1)
        return table(s, d, "region").select("r_regionkey", S.walk_path(F.to_json(quarters), path).alias("found"))

    c.add("walked_paths", walked, "r_regionkey found", "", "SELECT r_regionkey, CASE r_regionkey % 4 WHEN 0 THEN r_name WHEN 1 THEN CAST(r_regionkey AS VARCHAR) END AS found FROM region")


def stores(c: Catalog, smooth, table) -> None:
    c.add("ndjson_rows", lambda s, d: sinks.ndjson(table(s, d, "nation")), "value", "", "SELECT CAST(to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey}) AS VARCHAR) AS value FROM nation")
    keyed = "SELECT o_custkey AS k, o_orderdate AS seen, o_orderkey AS v FROM {orders} WHERE o_orderkey % 2 = "
    c.add("cache_upsert", lambda s, d: sinks.upsert(s.sql(keyed + "0", orders=table(s, d, "orders")), s.sql(keyed + "1", orders=table(s, d, "orders")), ["k"], "seen").select("k", "seen"), "k seen", "", "SELECT o_custkey AS k, max(o_orderdate) AS seen FROM orders GROUP BY 1")
    rules = "SELECT c_custkey AS rule_id, c_acctbal > 0 AS active, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE date_add(DATE'2024-01-01', cast(c_custkey % 5 as int)) END AS last_run_date, date_add(DATE'2023-01-01', cast(c_custkey % 97 as int)) AS updated_at FROM {customer}"
    due = "due AS (SELECT c_custkey AS rule_id FROM customer WHERE c_acctbal > 0 AND (c_custkey % 3 = 0 OR c_custkey % 5 < 2))"
    c.add("due_rules", lambda s, d: sinks.due_rules(s.sql(rules, customer=table(s, d, "customer")), "2024-01-03"), "rule_id", due, "SELECT rule_id FROM due")
    runs = lambda s, d: table(s, d, "customer").where("c_custkey % 2 = 0").selectExpr("c_custkey AS rule_id", "DATE'2024-01-03' AS run_date")
    c.add("new_runs", lambda s, d: sinks.new_runs(sinks.due_rules(s.sql(rules, customer=table(s, d, "customer")), "2024-01-03"), runs(s, d), "2024-01-03"), "rule_id run_date", due, "SELECT rule_id, DATE '2024-01-03' AS run_date FROM due WHERE rule_id % 2 = 1")
    raw = "CASE p_partkey % 6 WHEN 0 THEN 'NYSE:' || lower(p_brand) WHEN 1 THEN ' brk.' || (p_partkey % 9) WHEN 2 THEN '^gspc' WHEN 3 THEN 'eurusd=x' WHEN 4 THEN '' ELSE 'toolongasymboltobeone' END"
    c.add("clean_symbols", lambda s, d: table(s, d, "part").selectExpr("p_partkey AS id", raw + " AS raw").withColumn("symbol", S.clean_symbol(F.col("raw"))), "id symbol", "", "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 1 THEN 'BRK-' || (p_partkey % 9) WHEN 2 THEN '^GSPC' WHEN 3 THEN 'EURUSD=X' END AS symbol FROM part")
    value = "CASE l_linenumber WHEN 1 THEN 'NaN' WHEN 2 THEN 'Infinity' WHEN 3 THEN 'n/a' ELSE CAST(l_quantity - 20.5 AS STRING) END"
    c.add("finite_values", lambda s, d: table(s, d, "lineitem").selectExpr("l_linenumber AS k", value + " AS raw").withColumn("x", S.finite(F.col("raw"))).groupBy("k").agg(F.count("x").alias("n"), F.sum("x").alias("total"), F.min(S.percent(F.col("raw"), 1, True)).alias("least")), "k:int n:long ~total least", "", "SELECT l_linenumber AS k, count(*) FILTER (l_linenumber > 3) AS n, sum(l_quantity - 20.5) FILTER (l_linenumber > 3) AS total, min(printf('%+.1f%%', (l_quantity - 20.5) * 100)) FILTER (l_linenumber > 3) AS least FROM lineitem GROUP BY 1")
    turns = "SELECT conv_id AS conversation, turn AS at, ' ab' AS symbol, CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'assistant' END AS role, text AS content FROM {conversations} WHERE turn "

    def chats(s, d):
        t = table(s, d, "conversations").dropDuplicates(["conv_id", "turn"])
        none = s.createDataFrame([], "conversation long, seq long, symbol string, role string, content string")
        first = sinks.append_chat(none, s.sql(turns + "< 2", conversations=t))
        return sinks.append_chat(first, s.sql(turns + ">= 2", conversations=t)).groupBy("conversation", "symbol").agg(F.max("seq").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"))

    c.add("chat_store", chats, "conversation symbol turns:long asked:long", "t AS (SELECT conv_id, turn, any_value(role) AS role FROM conversations GROUP BY ALL)", "SELECT conv_id AS conversation, 'AB' AS symbol, count(*) AS turns, count(*) FILTER (role = 'user') AS asked FROM t GROUP BY 1")
    c.add("scan_providers", lambda s, d: sinks.providers(table(s, d, "supplier").select(F.element_at(F.array(F.lit("massive"), F.lit(""), F.lit("csv"), F.lit(None).cast("string")), (F.col("s_suppkey") % 4 + 1).cast("int")).alias("provider"))), "provider", "", "SELECT 'csv+massive' AS provider")
    c.add("cache_keys", lambda s, d: table(s, d, "nation").select("n_nationkey", S.cache_key(F.lit("v1"), F.col("n_name"), F.col("n_regionkey").cast("string")).alias("key")), "n_nationkey key", "", "SELECT n_nationkey, sha256('v1:' || n_name || ':' || n_regionkey) AS key FROM nation")
    c.add("trimmed_texts", lambda s, d: table(s, d, "documents").select("doc_id", S.trimmed(F.col("text"), 40).alias("short")).select("doc_id", F.length("short").alias("n"), F.col("short").endswith("…").alias("cut")), "doc_id n:int cut", "t AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS t FROM documents)", "SELECT doc_id, CASE WHEN length(t) > 40 THEN length(rtrim(left(t, 39))) + 1 ELSE length(t) END AS n, length(t) > 40 AS cut FROM t")
    c.add("compact_shown", lambda s, d: table(s, d, "orders").select("o_orderkey", S.compact((F.floor("o_totalprice") * 100 + 7) * F.element_at(F.array(F.lit(1), F.lit(1000), F.lit(1000000)), (F.col("o_orderkey") % 3 + 1).cast("int"))).alias("shown")).groupBy("shown").agg(F.count("*").alias("n")), "shown n:long", "v AS (SELECT (CAST(floor(o_totalprice) AS BIGINT) * 100 + 7) * [1, 1000, 1000000][o_orderkey % 3 + 1] AS v FROM orders)",
          "SELECT CASE WHEN v >= 1e12 THEN printf('%.1fT', v / 1e12) WHEN v >= 1e9 THEN printf('%.1fB', v / 1e9) WHEN v >= 1e6 THEN printf('%.1fM', v / 1e6) WHEN v >= 1e3 THEN printf('%.1fK', v / 1e3) ELSE printf('%.1f', CAST(v AS DOUBLE)) END AS shown, count(*) AS n FROM v GROUP BY 1")


def workflow(c: Catalog, smooth) -> None:
    spans = ", ".join(f"max(close) FILTER (age = 1) / max(close) FILTER (age = least({k + 1}, n)) - 1 AS ret_{k}" for k in (5, 21, 63, 126, 252, 504))
    perf = SMOOTH + f", perf AS (SELECT symbol, {spans}, max(close) FILTER (age = 1) / max(close) FILTER (age <= 252) - 1 AS from_high FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT *, {AGE} FROM bars) WHERE age <= 505) GROUP BY symbol), parts AS (" + PARTS.format(perf="perf") + ")"
    scored = perf + f""", scored AS (SELECT *, coalesce(CASE WHEN setup_total IS NOT NULL AND stage IN ('Coiled Spring', 'Inflecting') AND score >= 25 THEN 'Misclassified Inflection' END, CASE WHEN score >= 45 THEN 'Priority' WHEN score >= 18 THEN 'Watch' WHEN score <= -18 THEN 'Risk' ELSE 'Review' END) AS lane,
        recommendation || ' / ' || flow_state || ' / ' || location || CASE WHEN setup_total IS NOT NULL THEN ' / ' || stage ELSE '' END AS setup, row_number() OVER (ORDER BY score DESC, symbol) AS rank FROM (SELECT *, round(scan * 0.65 + flow_score * 0.35 + {POINTS} + total_return * 30 - abs(least(max_drawdown, 0)) * 35
        + CASE WHEN setup_total IS NULL THEN 0 ELSE (setup_total - 50) * 0.4 + CASE stage WHEN 'Coiled Spring' THEN 12 WHEN 'Inflecting' THEN 8 WHEN 'Proof Phase' THEN 4 ELSE -4 END END, 2) AS score FROM parts))"""  # fmt: skip
    rows = lambda s, d: A.cockpit_scores(s.sql(PARTS, perf=B.performance(smooth(s, d))))
    c.add("cockpit_scores", rows, "symbol ~score lane setup rank:long", scored, "SELECT * FROM scored")
    kinds = {"priority-setup": ("High", "lane = 'Priority'"), "risk-lane": ("High", "lane = 'Risk'"), "fresh-short-flow": ("High", "fresh_short"), "fresh-long-flow": ("Medium", "fresh_long AND NOT fresh_short"), "ridge-sell": ("High", "recommendation = 'SELL'"), "ridge-buy": ("High", "recommendation = 'BUY'"), "ridge-buy-setup": ("Medium", "recommendation = 'BUY SETUP'"), "auction-above-value": ("Medium", "location = 'above value'"), "auction-below-value": ("Medium", "location = 'below value'"), "high-volatility": ("Medium", "volatility >= 0.45")}
    fired = ", fired AS (" + " UNION ALL ".join(f"SELECT *, '{k}' AS kind, '{sev}' AS severity FROM scored WHERE {cond}" for k, (sev, cond) in kinds.items()) + ")"
    told = """SELECT symbol, kind, CASE kind WHEN 'priority-setup' THEN printf('%s is ranked #%d with a %.1f cockpit score and %s.', symbol, rank, score, setup) WHEN 'risk-lane' THEN printf('%s is in the Risk lane with a %.1f cockpit score.', symbol, score)
        WHEN 'fresh-short-flow' THEN symbol || ' printed a fresh short Flow Compass shift.' WHEN 'fresh-long-flow' THEN symbol || ' printed a fresh long Flow Compass shift.' WHEN 'ridge-sell' THEN symbol || ' has a Ridge SELL recommendation.' WHEN 'ridge-buy' THEN symbol || ' has a Ridge BUY recommendation.'
        WHEN 'ridge-buy-setup' THEN symbol || ' has a Ridge BUY SETUP recommendation.' WHEN 'auction-above-value' THEN symbol || ' is accepting above auction value.' WHEN 'auction-below-value' THEN symbol || ' is trading below auction value.' ELSE printf('%s is running at %.1f%% annualized volatility.', symbol, volatility * 100) END AS message FROM fired"""  # fmt: skip
    c.add("alert_texts", lambda s, d: A.with_texts(A.alerts(rows(s, d)), rows(s, d)), "symbol kind message", scored + fired, told)
    level = "CASE WHEN kind LIKE 'ridge%' THEN 'urgent' WHEN kind LIKE 'auction%' THEN 'noise' WHEN kind LIKE 'fresh%' THEN 'material' WHEN kind = 'risk-lane' THEN 'minor' END"
    c.add(
        "material_alerts", lambda s, d: A.material(A.alerts(rows(s, d)).withColumn("materiality", F.expr(level)), " Material "), "symbol kind severity", scored + fired,
        "SELECT symbol, kind, severity FROM fired WHERE kind NOT LIKE 'auction%' AND kind <> 'risk-lane'",
    )

    def keyed(s, d):
        own = rows(s, d)
        found = A.with_texts(A.alerts(own), own)
        return R.content_key(found.join(own.select("symbol", F.col("volatility").alias("volatility_now")), "symbol"))

    def scorer(found: list[dict]) -> list[dict | None]:
        """Stands for the service: grave alerts are likely material, others minor; those of the auction get no answer."""
        grave, mild = {"material": 0.6, "urgent": 0.4}, {"minor": 0.7, "material": 0.3}
        return [None if x["category"] == "Auction" else {"probabilities": grave if x["severity"] == "High" else mild, "confidence": 0.8} for x in found]

    def judged(s, d):
        return R.with_scores(keyed(s, d), R.score(keyed(s, d), scorer))

    c.add(
        "scored_alerts", judged, "symbol kind materiality ~materiality_score ~materiality_confidence", scored + fired,
        """
        SELECT symbol, kind,
               CASE WHEN kind LIKE 'auction%' THEN NULL WHEN severity = 'High' THEN 'material' ELSE 'minor' END AS materiality,
               CASE WHEN kind LIKE 'auction%' THEN NULL WHEN severity = 'High' THEN (0.6 * 2 + 0.4 * 3) / 3 ELSE (0.7 + 0.3 * 2) / 3 END AS materiality_score,
               CASE WHEN kind LIKE 'auction%' THEN NULL ELSE 0.8 END AS materiality_confidence
        FROM fired""",
    )

    def watchers(s, d):
        """A rule for each customer: tickers, materiality and delivery by its key."""
        return tables.table(s, d, "customer").selectExpr(
            "c_custkey AS rule_id", "c_acctbal > 0 AS active", "c_custkey AS updated_at", "CASE WHEN c_custkey % 3 = 0 THEN DATE'2024-01-03' END AS last_run_date",
            "1 + c_custkey % 25 AS a", "1 + c_custkey % 7 AS b",
        ).selectExpr(
            "rule_id", "active", "updated_at", "last_run_date", "array('BRAND#' || a, ' brand#' || b) AS tickers", "CAST(1 + a % 2 AS INT) AS max_results", "5 AS max_alerts", "0.3 AS volatility",
            "CASE a % 3 WHEN 0 THEN 'material' WHEN 1 THEN 'urgent' END AS least", "CASE b % 2 WHEN 0 THEN 'webhook' ELSE 'none' END AS channel", "CASE b % 3 WHEN 0 THEN 'high' ELSE 'any' END AS severity",
        )

    def scheduled(s, d):
        return R.runs(watchers(s, d), judged(s, d).withColumn("symbol", F.upper("symbol")), "2024-01-03").withColumn("alert_ids", F.array_join("alert_ids", ","))

    c.add("alert_runs", scheduled, "rule_id run_date status alert_count:long high_alert_count:long headline alert_ids delivery")
    names = lambda cond: f"(SELECT string_agg(symbol, ', ' ORDER BY rank) FROM (SELECT symbol, rank FROM scored WHERE {cond} ORDER BY rank LIMIT 5))"
    note = f"""SELECT CASE WHEN high > 0 THEN high || ' high-priority alert' || CASE WHEN high = 1 THEN '' ELSE 's' END || tail WHEN n > 0 THEN n || ' watchlist alert' || CASE WHEN n = 1 THEN '' ELSE 's' END || tail ELSE 'No high-signal alerts' || tail END AS headline,
        coalesce(nullif(concat_ws(' | ', 'Priority: ' || {names("lane = 'Priority'")}, 'Risk: ' || {names("lane = 'Risk'")}, 'Flow shifts: ' || {names('fresh_long OR fresh_short')}), ''), 'No names crossed the alert rules in this run.') AS summary
        FROM (SELECT count(*) AS n, count(*) FILTER (severity = 'High') AS high, ' across ' || (SELECT count(*) FROM scored) || ' names' AS tail FROM fired)"""  # fmt: skip
    c.add("digest_note", lambda s, d: A.digest_note(rows(s, d), A.alerts(rows(s, d))), "headline summary", scored + fired, note)


def streams(c: Catalog) -> None:
    def frames(s, d):
        e = tables.table(s, d, "events")
        one = F.struct(F.lit("T").alias("ev"), F.col("event_type").alias("sym"), F.col("value").alias("p"), F.lit(1.0).alias("s"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("i"))
        many = e.where("event_id % 3 <> 0").groupBy(F.floor(F.col("event_id") / 50)).agg(F.to_json(F.collect_list(one)).alias("value")).select("value")
        status = s.createDataFrame([('{"ev": "status", "status": "connected"}',), ('[{"ev": "status", "message": "auth"}]',)], "value string")
        return many.unionByName(e.where("event_id % 3 = 0").select(F.to_json(one).alias("value"))).unionByName(status)

    c.add("stream_decode", lambda s, d: live.decode(frames(s, d)).select("event_id", "symbol", F.unix_millis("ts").alias("ms"), "price"), "event_id symbol ms:long ~price", "", "SELECT event_id, event_type AS symbol, epoch_us(ts) // 1000 AS ms, value AS price FROM events")

    def land(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
        """The frames written as lines of text in the shared folder, read as a stream of decoded ticks; and where."""
        at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
        frames(spark, sf_dir).write.text(f"{at}/in")
        return live.decode(spark.readStream.text(f"{at}/in")), at

    def run(stream: DataFrame, at: str, mode: str = "append") -> DataFrame:
        """Every micro-batch of what is there, appended to a table."""
        write = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{at}/out")
        live.to_batches(stream, write, f"{at}/log", mode).trigger(availableNow=True).start().awaitTermination()
        return stream.sparkSession.read.parquet(f"{at}/out")

    def newest(spark, sf_dir):
        ticks, at = land(spark, sf_dir)
        out = run(live.open_bars(ticks), at, "update")
        return out.groupBy("symbol").agg(*(F.max_by(k, "batch").alias(k) for k in ("bucket", "open", "high", "low", "close")))

    c.add("stream_open_bars", newest, "symbol ~open ~high ~low ~close", "", """SELECT symbol, min_by(value, event_id) AS open, max(value) AS high, min(value) AS low, max_by(value, event_id) AS close FROM (
        SELECT *, event_type AS symbol, time_bucket(INTERVAL 15 MINUTE, ts) AS bucket, max(time_bucket(INTERVAL 15 MINUTE, ts)) OVER (PARTITION BY event_type ORDER BY event_id) AS seen, max(time_bucket(INTERVAL 15 MINUTE, ts)) OVER (PARTITION BY event_type) AS newest FROM events) WHERE bucket = seen AND bucket = newest GROUP BY ALL""")  # fmt: skip
    def distinct(spark, sf_dir):
        ticks, at = land(spark, sf_dir)
        return run(live.unique(ticks.unionByName(ticks), "3650 days"), at).select("event_id", "symbol")

    c.add("stream_distinct", distinct, "event_id symbol", "", "SELECT DISTINCT event_id, event_type AS symbol FROM events")
