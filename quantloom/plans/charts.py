"""Chart packs by type: what a caller can ask for, over any number of symbols at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators import bars as B
from quantloom.operators import cross as X
from quantloom.operators import indicators as I
from quantloom.operators import models as M
from quantloom.operators import workflow as A
from quantloom.sources.landing import in_period

CHARTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "auction": B.auction_location, "performance": B.month_map, "regression": B.regression_channel, "volatility": B.volatility_table, "ridge-growth": I.ridge_strategy, "flow-compass": I.flow_compass,
    "seasonality": B.seasonal_stats, "forward": B.forward_stats, "levels": A.key_levels, "scanner": B.scanner, "cockpit": A.cockpit, "alerts": lambda b: A.alerts(A.cockpit(b)),
    "entropy": X.entropy_rolling, "cells": B.cells, "base-rates": X.base_rates, "spectral": M.spectral_modes, "regimes": M.regimes, "scenarios": M.scenarios, "correlations": lambda b: X.correlations(X.returns(b)),
}
#: Reached bars are thinned to so many points for a client.
WINDOWS = {"1mo": 1, "3mo": 3, "1y": 12}


def chart(kind: str, bars: DataFrame, symbols: list[str] | None = None, period: str = "max", today: str | None = None) -> DataFrame:
    """One chart pack; symbols and period become filters of the scan. An unknown kind is an error."""
    if kind not in CHARTS:
        raise ValueError(f"no chart {kind!r}; there are {', '.join(sorted(CHARTS))}")
    x = bars.where(F.col("symbol").isin(symbols)) if symbols else bars
    if period != "max" and today is None:
        today = str(x.agg(F.max("date")).first()[0])
    return CHARTS[kind](in_period(x, period, today) if period != "max" else x)


def missing_symbols(bars: DataFrame, symbols: list[str]) -> DataFrame:
    """The asked symbols that have no bars."""
    asked = bars.sparkSession.createDataFrame([(s,) for s in symbols], "symbol string")
    return asked.join(bars.select("symbol").distinct(), "symbol", "left_anti")


def windows(bars: DataFrame) -> DataFrame:
    """Each symbol's bars cut to a month, a quarter and a year before its last bar, from one scan."""
    last = bars.groupBy("symbol").agg(F.max("date").alias("last"))
    each = last.select("symbol", "last", F.explode(F.create_map(*(F.lit(v) for k, m in WINDOWS.items() for v in (k, m)))).alias("window", "months"))
    return bars.join(each, "symbol").where(F.col("date") > F.add_months("last", -F.col("months"))).select("window", *bars.columns)
