"""The eigen section of a packet: a row a symbol of axes, ranking, symmetry and load."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators import eigen as E
from quantloom.plans.packet import gather


def section(signals: DataFrame, target: DataFrame, names: list[str], labels: DataFrame | None = None, weigh: E.Weigh | None = None) -> DataFrame:
    """symbol, pca, ranking, symmetry and load_bearing; the last two are null without labels or a weighing, and where a symbol has no rows.

    A symbol of the target without signals has nulls throughout.
    """
    many = {"ranking": E.ranking(signals, target, names)}
    if labels is not None:
        many["symmetry"] = E.symmetry(signals, labels, names)
    if weigh is not None:
        many["load_bearing"] = E.load_bearing(E.candidates(signals, target, names), weigh)
    x = gather(target.groupBy("symbol").agg(F.count("ret").alias("n_target")), {"pca": E.axes(signals, names)}, many)
    return x.withColumns({n: F.lit(None).cast("string") for n in ("symmetry", "load_bearing") if n not in many})
