"""Queries over quarterly statements and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import cross as X
from quantloom.operators import fundamentals as Q
from quantloom.operators import texts as T
from quantloom.queries import Catalog
from quantloom.queries.sql import QUARTERS, SMOOTH
from quantloom.sources import tables

#: Fixed values of the theme and sentiment queries, in the words of the test documents.
THEMES = {"function": ["the", "of", "and"], "german": ["der", "die", "und"], "license": ["license", "copyright"], "romance": ["la", "de", "que"]}
POSITIVE, NEGATIVE = ["good", "the", "with", "for", "und"], ["bad", "worthless", "not", "la", "stupid"]
WQ = "OVER (PARTITION BY symbol ORDER BY period_end"
TOKENS = "regexp_extract_all(lower({x}), '[a-z0-9%]+')"
PAIRS = "pairs AS (SELECT a.doc_id, a.text AS before, b.text AS after FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"


def pairs(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.withColumnRenamed("text", "before").join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("after")), "doc_id")


def register(c: Catalog) -> None:
    def quarter(name: str, op, columns: str, sql: str) -> None:
        c.add(name, lambda s, d: op(tables.quarters(s, d)), columns, QUARTERS, sql)

    derived = "(SELECT *, gross_profit / nullif(revenue, 0) AS gross_margin, operating_income / nullif(revenue, 0) AS operating_margin, cfo - abs(capex) AS fcf FROM quarters)"
    quarter("quarter_margins", Q.with_derived, "symbol period_end ~gross_margin ~operating_margin ~fcf", f"SELECT * FROM {derived}")
    quarter("known_at", lambda q: Q.known_at(q, "1997-06-15"), "symbol period_end ~revenue", "SELECT * FROM quarters WHERE coalesce(filing_date, period_end) <= DATE '1997-06-15'")
    four = f"{WQ} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
    quarter("ttm", Q.trailing_year, "symbol period_end ~ttm_revenue ~ttm_operating_income ~ttm_fcf", "SELECT symbol, period_end, " + ", ".join(f"CASE WHEN count({k}) {four} = 4 THEN sum({k}) {four} END AS ttm_{k}" for k in ("revenue", "operating_income", "fcf")) + f" FROM {derived}")
    grow = f"""(SELECT *, yoy - lag(yoy) {WQ}) AS acceleration FROM (SELECT symbol, period_end, operating_margin, CASE WHEN lag(revenue, 4) {WQ}) > 0 THEN revenue / lag(revenue, 4) {WQ}) - 1 END AS yoy,
        CASE WHEN lag(revenue) {WQ}) > 0 THEN revenue / lag(revenue) {WQ}) - 1 END AS qoq, gross_margin - lag(gross_margin, 4) {WQ}) AS margin_change FROM {derived}))"""  # fmt: skip
    quarter("growth_yoy", Q.growth_metrics, "symbol period_end ~yoy ~qoq ~margin_change ~acceleration trend", f"SELECT *, CASE WHEN acceleration IS NULL THEN NULL WHEN acceleration > 0.005 THEN 'accelerating' WHEN acceleration < -0.005 THEN 'decelerating' ELSE 'stable' END AS trend FROM {grow}")
    quarter("company_stage", Q.stage, "symbol ~yoy ~acceleration stage", f"""SELECT *, CASE WHEN yoy IS NULL THEN 'unknown' WHEN operating_margin < 0 AND acceleration > 0 THEN 'turnaround' WHEN yoy < -0.02 THEN 'declining'
        WHEN yoy > 0.05 AND acceleration < -0.02 THEN 'peaking' WHEN yoy > 0.05 THEN 'growing' ELSE 'stable' END AS stage FROM (SELECT symbol, max_by(yoy, period_end) AS yoy, max_by(acceleration, period_end) AS acceleration, max_by(operating_margin, period_end) AS operating_margin FROM {grow} GROUP BY symbol)""")  # fmt: skip
    quarter("operating_leverage", Q.operating_leverage, "symbol period_end ~leverage label", f"SELECT *, CASE WHEN leverage IS NULL THEN NULL WHEN leverage > 2 THEN 'high' WHEN leverage >= 1 THEN 'moderate' WHEN leverage >= 0 THEN 'low' ELSE 'negative' END AS label FROM (SELECT symbol, period_end, (operating_income - lag(operating_income, 4) {WQ})) / nullif(revenue - lag(revenue, 4) {WQ}), 0) AS leverage FROM quarters)")
    quarter("revenue_moving_average", Q.moving_averages, "symbol period_end ~mean ~distance", f"SELECT symbol, period_end, avg(revenue) {four} AS mean, revenue / avg(revenue) {four} - 1 AS distance FROM quarters")
    quarter("forecast_4q", Q.forecast, "symbol step:int ~revenue", f"""SELECT l.symbol, step, greatest(0, base + slope * (n + step - 1)) * coalesce(factor, 1) AS revenue FROM
        (SELECT symbol, regr_slope(revenue, i) AS slope, regr_intercept(revenue, i) AS base, count(*) AS n, max_by(fiscal_quarter, i) AS last_q FROM (SELECT *, CAST(row_number() {WQ}) - 1 AS DOUBLE) AS i FROM quarters) GROUP BY symbol HAVING count(*) >= 6) l, unnest([1, 2, 3, 4]) AS t(step)
        LEFT JOIN (SELECT symbol, fiscal_quarter, avg(revenue / nullif(base + slope * i, 0)) AS factor FROM (SELECT *, CAST(row_number() {WQ}) - 1 AS DOUBLE) AS i FROM quarters)
            JOIN (SELECT symbol, regr_slope(revenue, i) AS slope, regr_intercept(revenue, i) AS base FROM (SELECT *, CAST(row_number() {WQ}) - 1 AS DOUBLE) AS i FROM quarters) GROUP BY symbol) USING (symbol) GROUP BY ALL) f
        ON f.symbol = l.symbol AND f.fiscal_quarter = (last_q + step - 1) % 4 + 1""")  # fmt: skip

    def q4(spark, sf_dir):
        q = tables.quarters(spark, sf_dir)
        return Q.fourth_quarters(q, q.groupBy("symbol", "fiscal_year").agg(F.sum("revenue").alias("revenue")))

    c.add("q4_derivation", q4, "symbol fiscal_year ~q4", QUARTERS, "SELECT symbol, fiscal_year, y - s AS q4 FROM (SELECT symbol, fiscal_year, sum(revenue) AS y, sum(revenue) FILTER (fiscal_quarter < 4) AS s, count(*) FILTER (fiscal_quarter < 4) AS n FROM quarters GROUP BY ALL) WHERE n = 3")

    def facts(spark, sf_dir):
        o, cu = tables.table(spark, sf_dir, "orders"), tables.table(spark, sf_dir, "customer")
        day = F.to_date("o_orderdate")
        return o.join(cu, o.o_custkey == cu.c_custkey).select(F.col("c_mktsegment").alias("symbol"), F.col("o_orderstatus").alias("concept"), F.trunc(day, "quarter").alias("period_end"), day.alias("filing_date"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value"))

    fact_sql = "facts AS (SELECT c_mktsegment AS symbol, o_orderstatus AS concept, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period_end, CAST(o_orderdate AS DATE) AS filing_date, o_orderkey AS seq, o_totalprice AS value FROM orders JOIN customer ON o_custkey = c_custkey)"
    c.add("quarter_facts_latest_filed", lambda s, d: Q.latest_filed(facts(s, d)), "symbol concept period_end ~value filing_date", fact_sql, "SELECT symbol, concept, period_end, max_by(value, row(filing_date, seq)) AS value, max(filing_date) AS filing_date FROM facts GROUP BY ALL")
    c.add("quarter_first_filed", lambda s, d: Q.first_filed(facts(s, d).drop("concept")), "symbol period_end filing_date ~value", fact_sql, "SELECT symbol, period_end, min(filing_date) AS filing_date, min_by(value, row(filing_date, seq)) AS value FROM facts GROUP BY ALL")

    def priced(spark, sf_dir):
        q = tables.quarters(spark, sf_dir)
        price = tables.bars_smooth(spark, sf_dir).where("symbol = 'Brand#11'").select("date", "close")
        return Q.value_z(X.as_of_series(q, price, "filing_date", "date", "close"))

    c.add("value_z", priced, "symbol period_end ~ps ~z", SMOOTH + ", " + QUARTERS, f"""SELECT symbol, period_end, ps, CASE WHEN count(ps) {WQ} ROWS UNBOUNDED PRECEDING) >= 8 THEN (ps - avg(ps) {WQ} ROWS UNBOUNDED PRECEDING)) / nullif(stddev_samp(ps) {WQ} ROWS UNBOUNDED PRECEDING), 0) END AS z FROM (
        SELECT symbol, period_end, CASE WHEN count(revenue) {four} = 4 THEN close / sum(revenue) {four} * 1e9 END AS ps FROM (SELECT q.*, close FROM quarters q ASOF LEFT JOIN (SELECT date, close FROM bars WHERE symbol = 'Brand#11') b ON q.filing_date >= b.date))""")  # fmt: skip
    tens = lambda s, d: tables.quarters(s, d).select(F.col("period_end").alias("date"), F.explode(F.array(*map(F.lit, (2, 5, 10, 20)))).alias("tenor"), F.col("revenue"), F.col("symbol")).selectExpr("symbol", "date", "tenor", "round(tenor * (revenue % 100 - 30) / 400, 6) AS value")
    # one query under the two names it has had
    for name in ("curve_shape", "curve_shape_all"):
        c.add(name, lambda s, d: Q.curve_shape(tens(s, d), ("symbol", "date")), "symbol date ~s2s10 ~s5s20 shape", QUARTERS, "SELECT *, CASE WHEN s2s10 IS NULL THEN NULL WHEN s2s10 < -0.05 THEN 'inverted' WHEN s2s10 < 0.25 THEN 'flat' WHEN s2s10 < 1.5 THEN 'normal' ELSE 'steep' END AS shape FROM (SELECT symbol, period_end AS date, round(10 * (revenue % 100 - 30) / 400, 6) - round(2 * (revenue % 100 - 30) / 400, 6) AS s2s10, round(20 * (revenue % 100 - 30) / 400, 6) - round(5 * (revenue % 100 - 30) / 400, 6) AS s5s20 FROM quarters)")

    docs = lambda s, d: tables.table(s, d, "documents")
    c.add("doc_tokens_topk", lambda s, d: T.top_tokens(docs(s, d)), "token n:long", "", f"SELECT token, count(*) AS n FROM (SELECT unnest({TOKENS.format(x='text')}) AS token FROM documents) GROUP BY token ORDER BY n DESC, token LIMIT 20")
    vector = "v AS (SELECT doc_id, side, CAST(('0x' || substr(md5(token), 1, 16))::UBIGINT % 256 AS INTEGER) AS bucket, count(*) AS n FROM (SELECT doc_id, 'x' AS side, unnest({a}) AS token FROM pairs UNION ALL SELECT doc_id, 'y', unnest({b}) FROM pairs) GROUP BY ALL)".format(a=TOKENS.format(x="before"), b=TOKENS.format(x="after"))
    c.add("hashing_vector", lambda s, d: T.hashing_vector(docs(s, d)), "doc_id bucket n:long", "", f"SELECT doc_id, CAST(('0x' || substr(md5(token), 1, 16))::UBIGINT % 256 AS INTEGER) AS bucket, count(*) AS n FROM (SELECT doc_id, unnest({TOKENS.format(x='text')}) AS token FROM documents) GROUP BY ALL")
    c.add("change_score", lambda s, d: T.change_score(pairs(s, d)), "doc_id ~score", PAIRS + ", " + vector, """SELECT p.doc_id, CASE WHEN trim(coalesce(before, ''), E' \\t\\n\\r') = '' AND trim(coalesce(after, ''), E' \\t\\n\\r') = '' THEN 0 WHEN xx IS NULL OR xx = 0 OR yy = 0 THEN 1 ELSE 1 - xy / sqrt(CAST(xx AS DOUBLE) * yy) END AS score FROM pairs p LEFT JOIN (
        SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, sum(coalesce(a.n, 0) * coalesce(b.n, 0)) AS xy, coalesce(sum(a.n * a.n), 0) AS xx, coalesce(sum(b.n * b.n), 0) AS yy
        FROM (SELECT * FROM v WHERE side = 'x') a FULL JOIN (SELECT * FROM v WHERE side = 'y') b ON a.doc_id = b.doc_id AND a.bucket = b.bucket GROUP BY 1) s ON p.doc_id = s.doc_id""")  # fmt: skip
    sent = "list_filter(list_transform(string_split_regex(regexp_replace({x}, '([.!?])\\s+', '\\1\x01', 'g'), '\x01'), lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))), lambda s: len(s) >= 20)"
    c.add("sentence_diff", lambda s, d: T.sentence_diff(pairs(s, d)).selectExpr("doc_id", "size(added) AS n_added", "size(removed) AS n_removed"), "doc_id n_added:long n_removed:long", PAIRS, f"SELECT doc_id, len(list_filter(list_distinct(a), lambda s: NOT list_contains(b, s))) AS n_added, len(list_filter(list_distinct(b), lambda s: NOT list_contains(a, s))) AS n_removed FROM (SELECT doc_id, {sent.format(x='before')} AS b, {sent.format(x='after')} AS a FROM pairs)")
    hits = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS theme, " + " + ".join(f"CAST(regexp_matches(lower(text), '(^|[^a-z0-9]){w}([^a-z0-9]|$)') AS INTEGER)" for w in v) + " AS hits FROM documents" for k, v in THEMES.items())
    c.add("keyword_themes", lambda s, d: T.keyword_themes(docs(s, d), THEMES), "doc_id theme hits:int rank:long", "", f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, theme) AS rank FROM ({hits}) WHERE hits > 0")
    c.add("lexicon_sentiment", lambda s, d: T.sentiment(docs(s, d), POSITIVE, NEGATIVE), "doc_id ~score label", "", f"SELECT *, CASE WHEN score > 0.5 THEN 'positive' WHEN score < -0.5 THEN 'negative' ELSE 'neutral' END AS label FROM (SELECT doc_id, coalesce((p - q) / nullif(p + q, 0), 0) AS score FROM (SELECT doc_id, len(list_intersect(t, {POSITIVE})) AS p, len(list_intersect(t, {NEGATIVE})) AS q FROM (SELECT doc_id, list_distinct({TOKENS.format(x='text')}) AS t FROM documents)))")
    pages = lambda s, d: tables.table(s, d, "pages")
    c.add("url_dedupe", lambda s, d: T.first_by_url(pages(s, d)), "key page_id n:long", "", "SELECT regexp_replace(regexp_replace(lower(url), '[?#].*$', ''), '/+$', '') AS key, min(page_id) AS page_id, count(*) AS n FROM pages GROUP BY 1")
    c.add("html_clean", lambda s, d: T.clean_html(pages(s, d)), "page_id text")
    c.add("citation_extract", lambda s, d: T.citations(docs(s, d)).groupBy("doc_id", "kind").agg(F.count("*").alias("n")), "doc_id kind n:long", "", r"SELECT doc_id, kind, count(*) AS n FROM (SELECT doc_id, CASE WHEN regexp_matches(raw, '^\d{4}-\d{2}-\d{2}$') THEN 'date' WHEN regexp_matches(raw, '^\+?[\d ()-]{7,}$') THEN 'number' WHEN regexp_matches(raw, '\d%') THEN 'percent' WHEN regexp_matches(raw, '\w+\s*[:=]\s*\S') THEN 'key' WHEN regexp_matches(raw, '\d') THEN 'figure' END AS kind FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\(([^()]{2,})\)', 1)) AS raw FROM documents)) WHERE kind IS NOT NULL GROUP BY ALL")
    shown = "CASE l_linenumber % 5 WHEN 0 THEN '$' || CAST(l_quantity AS INTEGER) || 'M' WHEN 1 THEN CAST(l_quantity AS INTEGER) || '%' WHEN 2 THEN '(' || CAST(l_quantity AS INTEGER) || 'B)' WHEN 3 THEN 'n/a' ELSE '$1,' || (100 + CAST(l_quantity AS INTEGER)) END"
    c.add("money_parse", lambda s, d: tables.table(s, d, "lineitem").selectExpr(f"{shown} AS raw").select("raw", T.money(F.col("raw")).alias("value")).groupBy("raw").agg(F.max("value").alias("value"), F.count("*").alias("n")), "raw ~value n:long", "", f"SELECT raw, max(CASE WHEN raw = 'n/a' THEN NULL ELSE CAST(regexp_extract(replace(raw, ',', ''), '\\d+') AS DOUBLE) * CASE WHEN raw LIKE '%M' THEN 1e6 WHEN raw LIKE '%B)' THEN -1e9 WHEN raw LIKE '%\\%' ESCAPE '\\' THEN 0.01 ELSE 1 END END) AS value, count(*) AS n FROM (SELECT {shown} AS raw FROM lineitem) GROUP BY raw")

    def events(spark, sf_dir):
        e = tables.table(spark, sf_dir, "events")
        return e.selectExpr("event_id AS item_id", "event_type AS symbol", "to_date(ts) AS date", "concat('item ', user_id % 9, ' of ', event_type, ' ', cast(value as int) % 4) AS title")

    c.add("event_clusters", lambda s, d: T.clusters(events(s, d)), "item_id cluster")
