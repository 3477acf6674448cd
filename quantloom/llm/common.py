"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The ASCII white space that the word and equality contracts name.
SPACES = " \t\n\x0b\x0c\r"
#: Python work on texts is done on slices of about so many bytes, so that a task's memory stays bounded.
SLICE_BYTES = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only on a local master, whose tasks are in the driver's own machine, may it be unset; then one is made.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="quantloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage and survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again (columnar, so later readers prune columns)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_heavy(left: DataFrame, right: DataFrame, keys: list[str], count: str, most_heavy: int = 1000) -> DataFrame:
    """Inner join of many rows with one row per key, where a key may hold a large share of the rows.

    ``right`` has one row per key and the number of left rows in ``count``. A key that holds more than 1/most_heavy
    of all rows is heavy; there are fewer than ``most_heavy`` of those whatever the data, so only they are broadcast.
    The others always meet in a shuffled join, however small the tables. Keys must not be null.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    least = max(1, total // most_heavy)
    heavy = right.where(F.col(count) > least)
    flagged = left.join(F.broadcast(heavy.select(*keys, F.lit(True).alias("__heavy"))), keys, "left")
    a = flagged.where("__heavy").drop("__heavy").join(F.broadcast(heavy), keys)
    b = flagged.where("__heavy is null").drop("__heavy").join(right.where(F.col(count) <= least).hint("merge"), keys)
    return a.unionByName(b)


def marked(rows: DataFrame, key: str, keys: DataFrame, log2_maps: int = 12) -> DataFrame:
    """``rows`` with a boolean, may: whether ``key`` (a hash, long) may be among ``keys``; it is false for most that aren't.

    The keys are folded into 2 ** log2_maps bit maps of 4 KB, which are broadcast: 16 MB at most, whatever the tables. The
    more keys there are, the more rows are marked in vain; none that belongs is ever left out.
    """
    part = lambda c: F.pmod(c, F.lit(1 << log2_maps))
    bit = lambda c: F.shiftrightunsigned(c, 20).bitwiseAND(F.lit(32767))
    maps = keys.groupBy(part(F.col(key)).alias("__part")).agg(F.bitmap_construct_agg(bit(F.col(key))).alias("__map"))
    out = rows.withColumn("__part", part(F.col(key))).join(F.broadcast(maps), "__part", "left")
    at = bit(F.col(key))
    byte = F.conv(F.hex(F.substring("__map", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.expr("coalesce(cast(shiftright(__byte, __bit) & 1 as boolean), false)")
    return out.withColumn("__byte", byte).withColumn("__bit", at.bitwiseAND(F.lit(7)).cast("int")).withColumn("may", held).drop("__part", "__map", "__byte", "__bit")


def may_hold(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The ``rows`` that :func:`marked` marks."""
    return marked(rows, key, keys).where("may").drop("may")


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch with about SLICE_BYTES of text each (at least one row)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, column: str = "text") -> DataFrame:
    """``mapInArrow`` over bounded slices of a table with a text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, column):
                out = fn(part)
                if out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the murmur3 finaliser) over an unsigned array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def bucket_of(column, modulus: int):
    """crc32 of an id as text, modulo ``modulus``: the held-out rule of the contracts."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(modulus))


def bounded_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` rows (fewer than 1.2 x bound) chosen by a hash of ``key``: same rows in every run."""
    n = df.count()
    if n <= bound:
        return df
    turn = F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit("sample")), 1)  # 63 bits: fine enough for any number of rows
    return df.where(turn < F.lit(int((1 << 63) * (bound / n))))
