"""Queries over the second packet: the packet itself, its summary, Markdown and validation, the guard of snapshots, width labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import bars as B
from quantloom.operators import cross as X
from quantloom.operators import exposures as E
from quantloom.operators import implied as I
from quantloom.operators import memos as M
from quantloom.operators import opinions as P
from quantloom.operators import options as O
from quantloom.operators import scoring as S
from quantloom.plans import situation
from quantloom.queries import Catalog
from quantloom.queries.forecast_queries import AS_OF, FACTORS, MARKET, RATES, basket, chain
from quantloom.queries.sql import RETURNS, SMOOTH
from quantloom.sources import tables

FIVE = ("q05", "q25", "q50", "q75", "q95")
REASONS = {"fundamentals": "the statements are of market segments, not of brands", "text": "no filings of brands", "stack": "left out of this build", "tabular": "no weights of a tabular model"}
SOURCES = [("line items", "daily bars"), ("parts", "profiles and option chains")]


def state(bars: DataFrame, market: str) -> DataFrame:
    """symbol, market_cell and ticker_cell: the newest cells, the market's beside each symbol's own."""
    now = B.cells(bars).groupBy("symbol").agg(F.max_by("cell", "date").alias("ticker_cell"))
    of_market = now.where(F.col("symbol") == market).select(F.col("symbol").alias("market"), F.col("ticker_cell").alias("market_cell"))
    return now.withColumn("market", F.lit(market)).join(F.broadcast(of_market), "market", "left").select("symbol", "market_cell", "ticker_cell")  # one row


def levels(bars: DataFrame, implied: DataFrame) -> DataFrame:
    """symbol, current_price, poc, vah, val and the zones that the implied quantiles give."""
    z = O.zones(implied.select("symbol", F.col("months").alias("h"), "spot", "q25", "q75"))
    zone = lambda n: F.when(F.col(f"{n}_lo").isNotNull(), F.struct(F.col(f"{n}_lo").alias("lo"), F.col(f"{n}_hi").alias("hi"))).alias(n)
    x = B.auction_levels(bars).join(z, "symbol", "left")
    return x.select("symbol", F.col("close").alias("current_price"), "poc", "vah", "val", zone("cheap"), zone("rich"))


def situations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets of all brands as of a day, from bars, parts and quotes up to that day."""
    bars = tables.written(tables.bars_smooth(spark, sf_dir).where(F.col("date") <= F.lit(AS_OF).cast("date")))
    quotes = tables.written(chain(spark, sf_dir, bars))
    rates = tables.written(X.base_rates(bars))
    spread = P.spreads_by_horizon(rates.selectExpr("symbol", "h", "q25", "q75", "shrunk AS q50")).withColumnRenamed("h", "months")
    implied = tables.written(I.to_base_rates(I.implied(quotes, AS_OF), spread).withColumnRenamed("underlying", "symbol"))
    real = implied.select("symbol", F.col("months").alias("h"), *(F.col(f"rw_{q}").alias(q) for q in FIVE))
    blended = S.blend_sources(rates, real)
    one = {
        "profile": tables.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("symbol")).agg(F.min("p_type").alias("industry"), F.count("*").alias("products")),
        "exposure": E.exposures(E.log_returns(bars.where(~F.col("symbol").isin(FACTORS + RATES))), basket(bars), FACTORS + RATES),
        "state": state(bars, MARKET),
        "implied": quotes.groupBy(F.col("underlying").alias("symbol")).agg(F.lit(AS_OF).alias("snapshot_ts"), F.max("spot").alias("underlying_price")),
        "levels": levels(bars, implied),
    }
    many = {"base_rates": rates, "implied": implied.drop("expiry"), "odds": situation.odds_of(rates, real), "scenarios": S.scenario_paths(blended)}
    symbols = bars.select("symbol").distinct().withColumn("as_of", F.lit(AS_OF).cast("date"))
    return situation.situations(symbols, one, many, REASONS, SOURCES, F.lit(AS_OF))


def snapshots(bars: DataFrame) -> DataFrame:
    """Each bar's day as as_of, with quotes taken on the symbol's last day of that month."""
    last = bars.groupBy("symbol", F.trunc("date", "month").alias("month")).agg(F.max("date").cast("string").alias("snapshot_ts"), F.count("*").alias("n"))
    x = bars.select("symbol", F.col("date").alias("as_of"), F.trunc("date", "month").alias("month")).join(last, ["symbol", "month"])
    rows = F.when(F.col("n") >= 8, F.array(F.struct(F.lit(1).alias("months"))))
    return x.select("symbol", "as_of", F.struct("snapshot_ts", rows.alias("by_horizon")).alias("implied"))


def widths(bars: DataFrame, windows: dict[int, int]) -> DataFrame:
    """symbol, months and ratio: deviation of the newest rows' returns over that of all."""
    r = X.returns(bars).where("ret is not null").withColumn("age", F.row_number().over(B.newest()))
    g = r.groupBy("symbol").agg(F.stddev_samp("ret").alias("usual"), *(F.stddev_samp(F.when(F.col("age") <= n, F.col("ret"))).alias(f"s{m}") for m, n in windows.items()))
    return g.select("symbol", "usual", F.expr(f"stack({len(windows)}, {', '.join(f'{m}, s{m}' for m in windows)}) AS (months, s)")).select("symbol", "months", (F.col("s") / F.nullif("usual", F.lit(0.0))).alias("ratio"))


def register(c: Catalog) -> None:
    smooth = tables.bars_smooth
    c.add("situation_packet", lambda s, d: situation.packets(situations(s, d)), "symbol as_of packet")
    c.add("situation_summary", lambda s, d: situation.summary(situations(s, d)).select("symbol", "posture.*", F.to_json("unavailable_sections").alias("missing"), F.size("odds").alias("n_odds")), "symbol stance horizon:int ~conviction ~p_up ~q50 one_line missing n_odds:int")
    c.add("situation_markdown", lambda s, d: situation.markdown(situations(s, d)), "symbol as_of markdown")
    c.add("packet_violations", lambda s, d: situation.violations(situation.packets(situations(s, d))).withColumn("problems", F.array_join("problems", "\n")), "symbol as_of problems")

    c.add("implied_guard", lambda s, d: situation.guarded(snapshots(smooth(s, d))).withColumn("kept", F.col("implied").isNotNull()), "symbol as_of kept implied_error implied_note", SMOOTH + """,
ends AS (SELECT symbol, date_trunc('month', date) AS month, max(date) AS snapshot, count(*) AS n FROM bars GROUP BY ALL),
lags AS (
    SELECT b.symbol, b.date AS as_of, n, datediff('day', b.date, snapshot) AS lag,
           'option snapshot of ' || CAST(snapshot AS VARCHAR) || ' is ' || datediff('day', b.date, snapshot) || ' days younger than as_of ' || CAST(b.date AS VARCHAR) AS why
    FROM bars b JOIN ends e ON e.symbol = b.symbol AND e.month = date_trunc('month', b.date))""",
          "SELECT symbol, as_of, NOT (lag > 4 AND n >= 8) AS kept, CASE WHEN lag > 4 AND n >= 8 THEN why END AS implied_error, CASE WHEN lag > 4 AND n < 8 THEN why END AS implied_note FROM lags")
    c.add("width_labels", lambda s, d: widths(smooth(s, d), {1: 21, 3: 63, 12: 252}).withColumn("label", M.width_label(F.col("ratio"))), "symbol months:int ~ratio label", SMOOTH + ", " + RETURNS + """,
aged AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS age FROM rets WHERE ret IS NOT NULL),
ratios AS (
    SELECT symbol, months, stddev_samp(CASE WHEN age <= w THEN ret END) / nullif(stddev_samp(ret), 0) AS ratio
    FROM aged, (VALUES (1, 21), (3, 63), (12, 252)) AS v(months, w) GROUP BY ALL)""",
          "SELECT *, CASE WHEN ratio > 1.15 THEN 'wider' WHEN ratio < 0.85 THEN 'narrower' WHEN ratio IS NOT NULL THEN 'in_line' END AS label FROM ratios")
