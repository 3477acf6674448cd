"""The library's queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Queries and their SQL. Columns are named once for both: ``~x`` is rounded to six places, ``~~x`` to ten (where six
    would often round a tie), ``x:type`` is cast."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, fn: Query, columns: str, ctes: str = "", sql: str = "") -> None:
        names = columns.split()

        def finish(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.select(*((F.round(F.col(c.lstrip("~")).cast("double"), 10 if c[1] == "~" else 6) + F.lit(0.0)).alias(c.lstrip("~")) if c[0] == "~" else F.col(c.split(":")[0]).cast(c.split(":")[1]).alias(c.split(":")[0]) if ":" in c else F.col(c) for c in names))

        self.queries[name] = finish
        if sql:
            kinds = {"long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "date": "DATE", "string": "VARCHAR"}
            shown = ", ".join(f"round(CAST({c.lstrip('~')} AS DOUBLE), {10 if c[1] == '~' else 6}) + 0.0 AS {c.lstrip('~')}" if c[0] == "~" else f"CAST({c.split(':')[0]} AS {kinds[c.split(':')[1]]}) AS {c.split(':')[0]}" if ":" in c else c for c in names)
            self.sql[name] = f"{'WITH ' + ctes if ctes else ''} SELECT {shown} FROM ({sql})"


def catalog() -> Catalog:
    from quantloom.queries import bar_queries, cross_queries, eigen_queries, filing_queries, forecast_queries, history_queries, model_queries, opinion_queries, packet_queries, pool_queries, scoring_queries, source_queries, tick_queries

    out = Catalog()
    for module in (bar_queries, cross_queries, filing_queries, tick_queries, model_queries, scoring_queries, history_queries, source_queries, opinion_queries, forecast_queries, pool_queries, packet_queries, eigen_queries):
        module.register(out)
    return out
