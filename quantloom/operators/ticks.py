"""Ticks to bars: tumbling and session windows, the newest per key, and the open bar's upsert, in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ohlc(ticks: DataFrame, width: str = "15 minutes") -> DataFrame:
    """Bars of a fixed width; works on a stream with a watermark as on a table."""
    at = F.struct("ts", "event_id")
    return ticks.groupBy("symbol", F.window("ts", width).alias("w")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").alias("n")).select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "n")


def sessions(ticks: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: runs of events with less than ``gap`` between them."""
    g = ticks.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("price").alias("total"))
    return g.select("user_id", F.col("w.start").alias("start"), "n", "total")


def latest(ticks: DataFrame) -> DataFrame:
    """The newest price of each (symbol, user)."""
    return ticks.groupBy("symbol", "user_id").agg(F.max_by("price", F.struct("ts", "event_id")).alias("price"), F.max("ts").alias("ts"))


def open_bars(ticks: DataFrame, width: str = "15 minutes") -> DataFrame:
    """The live bar rule over a table in order of arrival (event_id): a tick of an older bucket than one seen is dropped;
    within a bucket high and low extend, close is the last and volume the greatest."""
    w = Window.partitionBy("symbol").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    x = ticks.withColumn("bucket", F.window("ts", width).start).withColumn("newest", F.max("bucket").over(w)).where("bucket = newest")
    return x.groupBy("symbol", "bucket").agg(F.min_by("price", "event_id").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "event_id").alias("close"), F.count("*").alias("n"))


def deltas(runs: DataFrame) -> DataFrame:
    """Change of each key's value from its run before."""
    return runs.withColumn("delta", F.col("price") - F.lag("price").over(Window.partitionBy("symbol", "user_id").orderBy("ts", "event_id")))
