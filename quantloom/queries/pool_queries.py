"""Queries over industry pools, distribution families, quantile bins, model states and the search of securities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators import pools as P
from quantloom.queries import Catalog
from quantloom.queries.bar_queries import W, frame
from quantloom.queries.sql import RETURNS, SMOOTH
from quantloom.sources import securities as D
from quantloom.sources import tables

#: Month closes with their cell, and each symbol's newest one.
MONTHS = SMOOTH + f""",
lr AS (SELECT symbol, date, close, ln(close / lag(close) {W})) AS lr FROM bars),
vols AS (SELECT symbol, date, close, CASE WHEN count(lr) {frame(21)} >= 21 THEN stddev_samp(lr) {frame(21)} * sqrt(252) END AS vol FROM lr),
meds AS (
    SELECT *, CASE WHEN count(vol) {frame(504)} >= 63 THEN quantile_cont(vol, 0.5) {frame(504)} END AS med,
           close / lag(close, 252) {W}) - close / lag(close, 21) {W}) AS trend
    FROM vols),
cells AS (
    SELECT symbol, date, close, CASE WHEN med IS NOT NULL AND trend IS NOT NULL
           THEN CASE WHEN vol > med THEN 'highvol_' ELSE 'lowvol_' END || CASE WHEN trend > 0 THEN 'up' ELSE 'down' END END AS cell
    FROM meds),
cm AS (
    SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS month, max_by(close, date) AS close, arg_max_null(cell, date) AS cell
    FROM cells GROUP BY ALL),
now AS (SELECT symbol, arg_max_null(cell, month) AS cell FROM cm GROUP BY symbol),
members AS (SELECT symbol, min(symbol) OVER (PARTITION BY right(symbol, 1)) AS pool FROM (SELECT DISTINCT symbol FROM bars)),
fw AS (
    SELECT symbol AS pool, h, lead(close, CAST(h AS INTEGER)) OVER (PARTITION BY symbol, h ORDER BY month) / close - 1 AS r, cell
    FROM cm, (SELECT unnest([1, 3, 6, 12]) AS h)),
every AS (
    SELECT pool, h, quantile_cont(r, 0.25) AS q25, quantile_cont(r, 0.5) AS q50, avg(CAST(r > 0 AS INTEGER)) AS hit, count(*) AS n
    FROM fw WHERE r IS NOT NULL GROUP BY ALL),
own AS (
    SELECT m.symbol, h, quantile_cont(r, 0.25) AS c25, quantile_cont(r, 0.5) AS c50, avg(CAST(r > 0 AS INTEGER)) AS chit, count(*) AS cn
    FROM members m JOIN now ON now.symbol = m.symbol JOIN fw ON fw.pool = m.pool AND fw.cell = now.cell WHERE r IS NOT NULL GROUP BY ALL)"""
POOLED = """SELECT symbol, pool, h, cell, n, cond_n, cond_q50, w, coalesce(w * c25 + (1 - w) * q25, q25) AS shrunk_q25,
    coalesce(w * cond_q50 + (1 - w) * q50, q50) AS shrunk_q50, coalesce(w * chit + (1 - w) * hit, hit) AS shrunk_hit
FROM (
    SELECT m.symbol, m.pool, e.h, now.cell, e.n, coalesce(cn, 0) AS cond_n, c50 AS cond_q50, (coalesce(cn, 0) / e.h) / (coalesce(cn, 0) / e.h + 24) AS w,
           c25, chit, q25, q50, hit
    FROM members m JOIN every e ON e.pool = m.pool JOIN now ON now.symbol = m.symbol LEFT JOIN own ON own.symbol = m.symbol AND own.h = e.h)"""

#: Families whose distribution function SQL has, over daily volumes.
CLOSED = """
g AS (SELECT symbol, count(*) AS n, avg(volume) AS mean, quantile_cont(volume, 0.5) AS median, min(volume) AS low FROM bars GROUP BY symbol HAVING count(*) >= 8),
v AS (SELECT b.symbol, volume AS x, n, mean, median, g.low, row_number() OVER (PARTITION BY b.symbol ORDER BY volume) AS i FROM bars b JOIN g ON g.symbol = b.symbol),
h AS (SELECT symbol, avg(abs(x - median)) AS mad, avg(ln(x / low)) AS lratio FROM v GROUP BY symbol),
f AS (
    SELECT symbol, n, i, 'laplace' AS family, CASE WHEN x < median THEN 0.5 * exp((x - median) / mad) ELSE 1 - 0.5 * exp((median - x) / mad) END AS cdf
    FROM v JOIN h USING (symbol) WHERE mad > 0
    UNION ALL SELECT symbol, n, i, 'exponential', 1 - exp(-x / mean) FROM v WHERE low > 0
    UNION ALL SELECT symbol, n, i, 'pareto', 1 - pow(low / x, 1 / lratio) FROM v JOIN h USING (symbol) WHERE low > 0 AND lratio > 0)"""


def register(c: Catalog) -> None:
    smooth = tables.bars_smooth

    def pooled(spark, sf_dir) -> DataFrame:
        b = smooth(spark, sf_dir)
        own = b.select("symbol", F.substring("symbol", -1, 1).alias("last")).distinct()
        members = own.join(own.groupBy("last").agg(F.min("symbol").alias("pool")), "last").select("symbol", "pool")
        return P.pooled_base_rates(b, members)

    c.add("pooled_base_rates", pooled, "symbol pool h:int cell n:long cond_n:long ~cond_q50 ~w ~shrunk_q25 ~shrunk_q50 ~shrunk_hit", MONTHS, POOLED)

    volumes = lambda s, d: P.fitted_families(smooth(s, d).selectExpr("symbol", "volume AS value"))
    c.add("distribution_families", volumes, "symbol family ~loc ~scale ~ks rank:int")
    c.add("distribution_closed_forms", lambda s, d: volumes(s, d).where("family in ('laplace', 'exponential', 'pareto')"), "symbol family ~ks", SMOOTH + "," + CLOSED, "SELECT symbol, family, max(greatest(i / n - cdf, cdf - (i - 1) / n)) AS ks FROM f GROUP BY ALL")

    inner = " + ".join(f"CAST(ret > e[{k}] OR (ret = e[{k}] AND e[{k}] > e[{k - 1}]) AS INTEGER)" for k in range(2, 11))
    binned = SMOOTH + ", " + RETURNS + f""",
r AS (SELECT symbol, date, ret FROM rets WHERE ret IS NOT NULL),
grid AS (SELECT symbol, quantile_cont(ret, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS q FROM r GROUP BY symbol),
edges AS (SELECT symbol, CASE WHEN len(list_distinct(q)) < 3 THEN list_transform(range(11), lambda k: q[1] + (q[11] - q[1]) * k / 10) ELSE q END AS e FROM grid),
placed AS (
    SELECT symbol, age, {inner} AS bin
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS age FROM r) JOIN edges USING (symbol)),
counts AS (SELECT symbol, w, bin, count(*) AS c FROM placed, (SELECT unnest([21, 63, 252]) AS w) WHERE age <= w GROUP BY ALL)"""
    c.add("entropy_quantile_bins", lambda s, d: P.quantile_entropy(smooth(s, d)), "symbol days:int ~entropy n:long", binned,
          'SELECT symbol, w AS days, sum(c) AS n, least(greatest((log2(sum(c)) - sum(c * log2(c)) / sum(c)) / log2(10), 0), 1) AS entropy FROM counts GROUP BY symbol, w HAVING sum(c) >= 10')
    c.add("state_opinion", lambda s, d: P.state_opinion(smooth(s, d)), "symbol state ~p label ~days ~share ~path_share path_now n_days")

    def found(spark, sf_dir) -> DataFrame:
        part = tables.table(spark, sf_dir, "part")
        listed = part.selectExpr(
            "concat(' p', p_partkey) AS ticker", "concat(p_name, ' ', p_type) AS name", "p_brand AS primary_exchange", "if(p_size % 5 = 0, 'etf', 'CS') AS type",
            "if(p_size % 7 = 0, 'indices', 'stocks') AS market", "p_size % 11 != 0 AS active",
        )
        asked = part.selectExpr("explode(array(p_name, substring(p_type, 1, 3), concat('P', p_partkey))) AS query")
        return D.search(D.securities(listed), asked, 8)

    c.add("security_search", found, "query rank:int symbol name exchange asset_type", """
d AS (
    SELECT 'P' || p_partkey AS symbol, p_name || ' ' || p_type AS name, p_brand AS exchange, CASE WHEN p_size % 7 = 0 THEN 2 ELSE 1 END AS turn,
           CASE WHEN p_size % 7 = 0 THEN 'index' WHEN p_size % 5 = 0 THEN 'etf' ELSE 'equity' END AS asset_type
    FROM part WHERE p_size % 11 <> 0),
q AS (SELECT DISTINCT query FROM (SELECT unnest([p_name, substr(p_type, 1, 3), 'P' || p_partkey]) AS query FROM part) WHERE query <> ''),
s AS (SELECT DISTINCT symbol, turn, name, exchange, asset_type, unnest(range(1, len(symbol) + 1)) AS k FROM d),
hits AS (
    SELECT query, CASE WHEN lower(symbol) = lower(query) THEN 0 ELSE 1 END AS kind, turn, symbol, name, exchange, asset_type
    FROM q JOIN s ON lower(substr(symbol, 1, k)) = lower(query)
    UNION ALL
    SELECT query, 2, turn, symbol, name, exchange, asset_type FROM q JOIN d ON contains(' ' || lower(name), ' ' || lower(query))
    WHERE NOT starts_with(lower(symbol), lower(query)))""",
          "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY kind, turn, symbol) AS rank FROM hits) WHERE rank <= 8")
