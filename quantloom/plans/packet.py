"""Research packets: one row per symbol, each section a struct that is null with an error where it could not be built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, StructType

from quantloom.operators import bars as B
from quantloom.operators import models as M
from quantloom.operators import workflow as A

#: Sections of a packet, in order: each turns bars into one row (or a sorted list of rows) per symbol.
ROWS = {"auction": B.auction_location, "volatility": B.volatility_table, "performance": B.performance, "extremes": B.price_extremes, "trend": B.regression_direction, "realized": B.volatility_percentile, "drawdown": B.drawdown}
LISTS = {"seasonality": B.seasonal_stats, "levels": A.key_levels, "scenarios": M.scenarios, "bounds": B.return_bounds}


def gather(symbols: DataFrame, one: dict[str, DataFrame], many: dict[str, DataFrame] | None = None) -> DataFrame:
    """``symbols`` (symbol and columns of its own, a row each) with a struct for each of ``one`` and a sorted array of structs for each of ``many``.

    The sections' rows are laid under one another and grouped once, so that their number adds rows to one shuffle and no joins. A
    section is null where a symbol has no row in it; rows of other symbols are left out. Of several rows in ``one`` the greatest counts.
    """
    many = many or {}
    own = [c for c in symbols.columns if c != "symbol"]
    x = symbols.withColumn("__own", F.lit(True))
    for name, df in (one | many).items():
        x = x.unionByName(df.select("symbol", F.struct(*(c for c in df.columns if c != "symbol")).alias(name)), allowMissingColumns=True)
    lists = [F.array_sort(F.collect_list(name)).alias(name) for name in many]
    g = x.groupBy("symbol").agg(*(F.max(c).alias(c) for c in [*own, "__own", *one]), *lists).where("__own")
    return g.select("symbol", *own, *one, *(F.when(F.size(name) > 0, F.col(name)).alias(name) for name in many))


def assemble(bars: DataFrame, as_of: str | None = None) -> DataFrame:
    """(symbol, as_of, sections…, errors): every section is there, null where it has no row, and then named in errors."""
    bars = bars.where(F.col("date") <= F.lit(as_of).cast("date")) if as_of else bars
    symbols = bars.groupBy("symbol").agg(F.max("date").alias("as_of"))
    out = gather(symbols, {name: op(bars) for name, op in ROWS.items()}, {name: op(bars) for name, op in LISTS.items()})
    errors = F.filter(F.array(*(F.when(F.col(n).isNull(), F.lit(n)) for n in (*ROWS, *LISTS))), lambda x: x.isNotNull())
    return out.withColumn("errors", errors)


def packets(bars: DataFrame, as_of: str | None = None) -> DataFrame:
    """Each packet as JSON, with numbers that are NaN or infinite as nulls, however deep they lie."""
    x = assemble(bars, as_of)
    own = [finite(F.col(f.name), f.dataType).alias(f.name) for f in x.schema if f.name not in ("symbol", "as_of")]
    return x.select("symbol", "as_of", F.to_json(F.struct(*own), {"ignoreNullFields": "false"}).alias("packet"))


def finite(value: Column, kind: DataType) -> Column:
    """The value with every number that is NaN or infinite as null; texts are left alone."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*(finite(value[f.name], f.dataType).alias(f.name) for f in kind)))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda v: finite(v, kind.elementType))
    return value
