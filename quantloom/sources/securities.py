"""The dimension of securities, and ranked search in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Markets in the order in which their securities are listed.
MARKETS = ("stocks", "indices", "crypto")
#: Characters of a query at most.
LONGEST = 100


def securities(listed: DataFrame) -> DataFrame:
    """symbol, name, exchange, asset_type and turn of active listings (ticker, name, primary_exchange, type, market, active).

    Tickers are trimmed and upper-cased, empty ones dropped; of one ticker's listings the first market's counts, then the
    least name and exchange. Nulls in name and exchange count as empty.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    kind = F.upper(text("type"))
    asset = F.when((F.col("market") == "crypto") | (kind == "CRYPTOCURRENCY"), "crypto").when((F.col("market") == "indices") | (kind == "INDEX"), "index").when(kind == "ETF", "etf").otherwise("equity")
    turn = F.array_position(F.array(*map(F.lit, MARKETS)), F.col("market")).cast("int")
    x = listed.where("active").select(F.upper(text("ticker")).alias("symbol"), text("name").alias("name"), text("primary_exchange").alias("exchange"), asset.alias("asset_type"), turn.alias("turn"))
    best = x.where("symbol != '' and turn > 0").groupBy("symbol").agg(F.min(F.struct("turn", "name", "exchange", "asset_type")).alias("x"))
    return best.select("symbol", "x.name", "x.exchange", "x.asset_type", "x.turn")


def search(dimension: DataFrame, queries: DataFrame, limit: int = 8) -> DataFrame:
    """query, rank, symbol, name, exchange and asset_type of the securities that each query (query) finds.

    A query finds symbols that begin with it and names in which it stands at the beginning of a word, in any case. The very symbol
    comes first, then symbols, then names; within these by market and symbol. Queries are trimmed; empty ones and those
    beyond LONGEST characters find nothing. All beginnings are keys of an equality join, at most LONGEST for each word of a name.
    """
    if not 1 <= limit <= 10:
        raise ValueError("limit must be between 1 and 10")
    q = queries.select(F.trim("query").alias("query")).where(f"length(query) between 1 and {LONGEST}").distinct().withColumn("key", F.lower("query"))
    beginnings = lambda s: F.transform(F.sequence(F.lit(1), F.least(F.length(s), F.lit(LONGEST))), lambda n: F.substring(s, F.lit(1), n))
    words = F.filter(F.split(F.lower("name"), " "), lambda w: w != "")
    tails = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), " "))
    names = F.when(F.size(words) > 0, F.flatten(F.transform(tails, beginnings))).otherwise(F.array().cast("array<string>"))
    d = dimension.withColumn("low", F.lower("symbol"))
    keys = d.select("*", F.explode(F.array_distinct(F.concat(beginnings(F.col("low")), names))).alias("key"))
    kind = F.when(F.col("low") == F.col("key"), 0).when(F.startswith("low", "key"), 1).otherwise(2)
    found = keys.join(q, "key").select("query", kind.alias("kind"), "turn", "symbol", "name", "exchange", "asset_type")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("kind", "turn", "symbol"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit).select("query", "rank", "symbol", "name", "exchange", "asset_type")
