"""Logical tables over the star schema: trades, bars, smooth bars, ticks, quarters and option contracts.

Each is a lazy DataFrame; filters and columns chosen by a caller reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.session import shared_folder

#: All columns of a line item; together they are a key, and so a total order within a day.
SEQ = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint in the shared folder, for tables that what follows reads several times."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def mean(name: str) -> Column:
    """A double column's mean from a sum of decimals, which no order of rows changes; of doubles where a value is no such decimal.

    Sums of doubles differ by order in their last bits, which is enough to round a mean that lies half-way up or down.
    """
    d = F.col(name).try_cast("decimal(38,18)")
    exact = F.try_divide(F.try_sum(d).cast("double"), F.count(d))
    return F.coalesce(F.when(F.count(d) == F.count(name), exact), F.avg(name))


def rounded(x: Column, places: int) -> Column:
    """Rounded as SQL engines round doubles, the scaled value half away from zero; F.round goes by the shortest decimal."""
    return F.round(x * 10.0**places) / 10.0**places


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, price, size and seq of every line item, a part's brand being the symbol."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    item = table(spark, sf_dir, "lineitem")
    return item.join(part, item.l_partkey == part.p_partkey).select(
        "symbol", F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("size"), F.struct(*SEQ).alias("seq")
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of raw unit prices."""
    by = trades(spark, sf_dir).groupBy("symbol", "date")
    return by.agg(F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.sum("size").alias("volume"))


def bars_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars whose closes behave like prices: returns are a day's mean discount about its centre."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    item = table(spark, sf_dir, "lineitem")
    day = item.join(part, item.l_partkey == part.p_partkey).groupBy("symbol", F.to_date("l_shipdate").alias("date"))
    d = day.agg(
        rounded((mean("l_discount") - 0.05) / 2, 9).alias("r"), rounded(mean("l_tax") / 10, 9).alias("t"), F.sum("l_quantity").alias("volume")
    )
    w = Window.partitionBy("symbol").orderBy("date")
    c = d.withColumn("close", F.round(100 * F.exp(F.sum("r").over(w.rowsBetween(Window.unboundedPreceding, 0))), 6))
    o = c.withColumn("open", F.coalesce(F.lag("close").over(w), F.lit(100.0)))
    return o.select(
        "symbol", "date", "open", F.round(F.greatest("open", "close") * (1 + F.col("t")), 6).alias("high"),
        F.round(F.least("open", "close") / (1 + F.col("t")), 6).alias("low"), "close", "volume",
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, symbol, user_id, ts, price and props of every event."""
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("symbol"), "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("price"), "props")


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly statements by market segment: revenue, cost and cash figures, filed 30 days after the period's end."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    base = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("c_mktsegment").alias("symbol"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("start"), "o_totalprice", "c_acctbal"
    )
    agg = base.groupBy("symbol", "start").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.round(F.avg("c_acctbal"), 2).alias("acct"), F.count("*").alias("n_orders"))
    end = F.date_sub(F.add_months("start", 3), 1)
    return agg.select(
        "symbol", end.alias("period_end"), F.date_add(end, 30).alias("filing_date"), F.year("start").alias("fiscal_year"), F.quarter("start").alias("fiscal_quarter"), "revenue",
        F.round(F.col("revenue") * (0.45 + F.pmod(F.col("n_orders"), F.lit(17)) / 100), 2).alias("gross_profit"),
        F.round(F.col("revenue") * (0.10 + F.pmod(F.col("n_orders"), F.lit(11)) / 100), 2).alias("operating_income"),
        F.round(F.col("revenue") * 0.12 + F.col("acct"), 2).alias("cfo"), F.round(-F.col("revenue") * 0.04, 2).alias("capex"),
    )


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of option contracts: one underlying per brand, strikes about its parts' sizes, expiries by container."""
    part = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_partkey") % 2 == 0, "call").otherwise("put")
    expiry = F.date_add(F.lit("2024-01-01").cast("date"), (F.pmod(F.col("p_partkey"), F.lit(24)) * 30 + 18).cast("int"))
    by = part.groupBy(F.col("p_brand").alias("underlying"), expiry.alias("expiry"), (F.col("p_size") * 5).cast("double").alias("strike"), kind.alias("type"))
    return by.agg(F.count("*").alias("oi"), rounded(mean("p_retailprice") / 100, 4).alias("mark"))
