"""Streams of ticks: decoding, bars, sessions, the open bar's upsert and sinks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "struct<ev: string, sym: string, p: double, s: double, t: bigint, i: bigint>"


def decode(raw: DataFrame) -> DataFrame:
    """value (a JSON array of events, or one event) to ticks; status events are consumed."""
    many = F.from_json("value", f"array<{EVENT}>")
    x = raw.select(F.explode(F.when(F.substring(F.ltrim("value"), 1, 1) == "[", many).otherwise(F.array(F.from_json("value", EVENT)))).alias("e"))
    return x.where("e.ev is not null and e.ev != 'status'").select(F.col("e.i").alias("event_id"), F.col("e.sym").alias("symbol"), F.timestamp_millis("e.t").alias("ts"), F.col("e.p").alias("price"), F.col("e.s").alias("size"))


def unique(ticks: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each event once, within the watermark."""
    return ticks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def ohlc(ticks: DataFrame, width: str = "15 minutes", delay: str = "10 minutes") -> DataFrame:
    """Bars of a fixed width that close once the watermark has passed; later ticks are dropped."""
    at = F.struct("ts", "event_id")
    bars = ticks.withWatermark("ts", delay).groupBy("symbol", F.window("ts", width).alias("w"))
    out = bars.agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").alias("n"))
    return out.select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "n")


def sessions(ticks: DataFrame, key: str = "user_id", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    out = ticks.withWatermark("ts", delay).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("price").alias("total"))
    return out.select(key, F.col("w.start").alias("start"), "n", "total")


def open_bars(ticks: DataFrame, minutes: int = 15) -> DataFrame:
    """The open bar of each symbol, updated by each micro-batch in order of event_id.

    A tick of the same bucket extends high and low, sets the close and raises the volume to its own if that is more (a
    day's volume is cumulative); a newer bucket starts a bar at its price; an older one is dropped.
    """
    state = "bucket long, open double, high double, low double, close double, volume double"

    def step(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        bar = list(kept.get) if kept.exists else None
        rows = pd.concat(list(batches)).sort_values("event_id")
        bucket = rows["ts"].to_numpy("datetime64[s]").astype("int64") // (minutes * 60) * minutes * 60
        seen = np.maximum.accumulate(bucket if bar is None else np.r_[bar[0], bucket])[-len(bucket) :]
        last = int(seen[-1])
        own = rows[(bucket == seen) & (bucket == last)]  # ticks of a bucket older than one seen are dropped
        if len(own):
            price, size = own["price"], own["size"]
            new = [last, price.iloc[0], price.max(), price.min(), price.iloc[-1], size.max()]
            if bar is not None and bar[0] == last:
                new = [last, bar[1], max(bar[2], new[2]), min(bar[3], new[3]), new[4], max(bar[5], new[5])]
            bar = [last, *map(float, new[1:])]
        kept.update(tuple(bar))
        yield pd.DataFrame([[key[0], pd.Timestamp(bar[0], unit="s"), *bar[1:]]], columns=["symbol", "bucket", "open", "high", "low", "close", "volume"])

    schema = "symbol string, bucket timestamp, open double, high double, low double, close double, volume double"
    return ticks.select("symbol", "event_id", "ts", "price", "size").groupBy("symbol").applyInPandasWithState(step, schema, state, "update", GroupStateTimeout.NoTimeout)


def to_ndjson(stream: DataFrame, path: str, checkpoint: str):
    """Append each micro-batch as lines of JSON; the sink's log makes a repeated batch harmless."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def to_batches(stream: DataFrame, write, checkpoint: str, mode: str = "update"):
    """Hand each micro-batch to ``write(df, batch_id)``."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode)
