"""Stores: packets by symbol and date, keyed caches, newest-row upserts, and lines of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def save_packets(packets: DataFrame, path: str) -> None:
    """Write packets by (symbol, as_of); a packet written again replaces its partition only."""
    packets.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "as_of").parquet(path)


def list_packets(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    x = spark.read.parquet(path).select("symbol", "as_of")
    return (x.where(F.col("symbol") == symbol) if symbol else x).distinct().orderBy("symbol", F.desc("as_of"))


def load_packet(spark: SparkSession, path: str, symbol: str, as_of: str | None = None) -> DataFrame:
    """The packet of a date, or the newest."""
    x = spark.read.parquet(path).where(F.col("symbol") == symbol)
    return x.where(F.col("as_of") == F.lit(as_of).cast("date")) if as_of else x.orderBy(F.desc("as_of")).limit(1)


def upsert(store: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The store after some changes: of each key the row that is newest by ``order``, a change before a stored row."""
    both = store.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("__new"))
    return both.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__new")


def ndjson(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def due_rules(rules: DataFrame, run_date: str, force: bool = False) -> DataFrame:
    """Active rules not yet run on a date, the longest untouched first."""
    day = F.lit(run_date).cast("date")
    due = F.col("active") & (F.lit(force) | F.col("last_run_date").isNull() | (F.col("last_run_date") < day))
    return rules.where(due).orderBy("updated_at", "rule_id")


def new_runs(due: DataFrame, runs: DataFrame, run_date: str) -> DataFrame:
    """Runs to write for the due rules, at most one scheduled run of a rule and day."""
    x = due.select("rule_id", F.lit(run_date).cast("date").alias("run_date"))
    return x.join(runs, ["rule_id", "run_date"], "left_anti")


def append_chat(store: DataFrame, turns: DataFrame) -> DataFrame:
    """The store (conversation, seq, symbol, role, content) with new turns behind each conversation's last; other roles are an error.

    ``turns`` has conversation, at (their order), symbol, role and content; symbols are trimmed capitals, null texts empty.
    """
    role = F.when(F.col("role").isin("user", "assistant"), F.col("role")).otherwise(F.raise_error(F.lit("chat role must be 'user' or 'assistant'")))
    last = store.groupBy("conversation").agg(F.max("seq").alias("__last"))
    new = turns.join(last, "conversation", "left").withColumn("seq", F.coalesce("__last", F.lit(0)) + F.row_number().over(Window.partitionBy("conversation").orderBy("at")))
    own = new.select("conversation", F.col("seq").cast("long").alias("seq"), F.upper(F.trim(F.coalesce("symbol", F.lit("")))).alias("symbol"), role.alias("role"), F.coalesce("content", F.lit("")).alias("content"))
    return store.select("conversation", F.col("seq").cast("long").alias("seq"), "symbol", "role", "content").unionByName(own)


def providers(rows: DataFrame) -> DataFrame:
    """One row: the providers of a scan's rows, sorted and joined by a plus sign; empty where none is named."""
    named = F.collect_set(F.nullif(F.col("provider"), F.lit("")))
    return rows.agg(F.array_join(F.array_sort(named), "+").alias("provider"))
