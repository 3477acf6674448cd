"""Sector forecasts: a classifier learns from a sector's labelled months which fifth a peer's excess return falls into.

Context rows, their fifths and their means are Spark's. The classifier is a plug-in, a function of (context features, labels, query
features) that gives a row of probabilities a query; it sees one sector's context at a time, whose rows the feature itself bounds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The fifths from the lowest up, the least labelled rows, the most of a context, the least probability of a point call.
BUCKETS = ("strong_under", "under", "inline", "over", "strong_over")
LEAST_ROWS, MOST_ROWS, SURE = 60, 8000, 0.55
FEATURES = ("mom_12_1", "rev_1m", "vol_dummy", "trend_dummy")
Predictor = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def gaussian_bayes(context: np.ndarray, labels: np.ndarray, query: np.ndarray) -> np.ndarray:
    """The built-in classifier: independent normal features in each class, with variances of a hundredth of the whole at least."""
    floor = 0.01 * context.var(axis=0) + 1e-12
    log = np.full((len(query), len(BUCKETS)), -np.inf)
    for k in np.unique(labels):
        own = context[labels == k]
        var = own.var(axis=0) + floor
        log[:, k] = np.log(len(own) / len(context)) - 0.5 * (((query - own.mean(axis=0)) ** 2) / var + np.log(var)).sum(axis=1)
    p = np.exp(log - log.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def forecasts(panel: DataFrame, sectors: DataFrame, horizon: int = 3, predictor: Predictor = gaussian_bayes, features: tuple[str, ...] = FEATURES, most: int = MOST_ROWS) -> DataFrame:
    """A row a peer with complete features in its sector's newest month, ranked in its sector by expected excess return.

    ``panel`` is a feature panel, ``sectors`` has symbol and sector. The context is the sector's newest ``most`` rows whose label had
    ended by the month asked about; a target on an edge between fifths counts below. expected is the sum of probabilities times the fifths'
    mean returns, over fifths that have one. predicted_last and realized_last are of the newest labelled month, forecast with the context
    of that time. Features that are missing in a whole sector's panel make it incomplete. A sector with fewer than 60 context
    rows or a target in a single fifth has no rows; without a context of that time, predicted_last is null. The panel is read several times: store it first.
    """
    target = f"target_h{horizon}"
    i = F.year("month") * 12 + F.month("month") - 1
    whole = " and ".join(f"{f} is not null and not isnan({f})" for f in features)
    x = panel.join(F.broadcast(sectors.select("symbol", "sector")), "symbol").select("sector", "symbol", "month", i.alias("i"), F.col(target).alias("target"), *features)  # a row a symbol
    labelled = x.where(f"{whole} and target is not null and not isnan(target)")
    newest = x.groupBy("sector").agg(F.max("i").alias("at")).withColumn("task", F.lit("live"))
    last = labelled.groupBy("sector").agg(F.max("i").alias("at")).withColumn("task", F.lit("last"))
    asked = newest.unionByName(last)  # two rows a sector
    query = x.where(whole).join(F.broadcast(asked), "sector").where("i = at")
    recent = Window.partitionBy("sector", "task").orderBy(F.desc("month"), F.desc("symbol"))
    context = labelled.join(F.broadcast(asked), "sector").where(F.col("i") + horizon <= F.col("at"))
    context = context.withColumn("place", F.row_number().over(recent)).where(F.col("place") <= most)
    edges = context.groupBy("sector", "task").agg(F.percentile("target", F.array(*map(F.lit, (0.2, 0.4, 0.6, 0.8)))).alias("edges"), F.count("*").alias("rows")).where(F.col("rows") >= LEAST_ROWS)
    context = context.join(F.broadcast(edges), ["sector", "task"]).withColumn("bucket", F.size(F.filter("edges", lambda e: e < F.col("target"))))
    each = context.groupBy("sector", "task", "bucket").agg(F.avg("target").alias("mean"))
    means = each.groupBy("sector", "task").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "mean"))).alias("means")).where(F.size("means") > 1)  # five at most
    names = list(features)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        known, wanted = rows[rows["bucket"].notna()], rows[rows["bucket"].isna()]
        if not len(known) or not len(wanted) or known["bucket"].nunique() < 2:
            return pd.DataFrame(columns=["sector", "task", "symbol", "month", "target", "p"])
        known, wanted = known.sort_values(["month", "symbol"]), wanted.sort_values("symbol")
        p = np.maximum(np.nan_to_num(predictor(known[names].to_numpy(float), known["bucket"].to_numpy(int), wanted[names].to_numpy(float))), 0.0)
        if p.shape != (len(wanted), len(BUCKETS)):
            raise ValueError("the predictor must give a row of five probabilities for each query")
        total = p.sum(axis=1, keepdims=True)
        return wanted[["sector", "task", "symbol", "month", "target"]].assign(p=list(np.divide(p, total, out=p, where=total > 0)))

    key = ["sector", "task"]
    own = context.select(*key, "symbol", "month", "bucket", "target", *names).unionByName(query.select(*key, "symbol", "month", F.lit(None).cast("int").alias("bucket"), "target", *names))
    got = own.groupBy(*key).applyInPandas(run, "sector string, task string, symbol string, month date, target double, p array<double>").join(F.broadcast(means), key)
    held = lambda f: sum((F.coalesce(f(k), F.lit(0.0)) for k in range(len(BUCKETS))), F.lit(0.0))
    mean = lambda k: F.col("means")[F.lit(k)]
    weight = held(lambda k: F.when(mean(k).isNotNull(), F.col("p")[k]))
    got = got.withColumn("expected", F.when(weight > 0, held(lambda k: F.col("p")[k] * mean(k)) / weight))
    live = got.where("task = 'live'")
    past = got.where("task = 'last'").select("sector", "symbol", F.col("expected").alias("predicted_last"))
    seen = labelled.join(F.broadcast(last), "sector").where("i = at").select("sector", "symbol", F.col("target").alias("realized_last"))
    top = F.array_max("p")
    out = live.join(past, ["sector", "symbol"], "left").join(seen, ["sector", "symbol"], "left")
    bucket = F.element_at(F.array(*map(F.lit, BUCKETS)), F.array_position("p", top).cast("int"))
    ranked = F.row_number().over(Window.partitionBy("sector").orderBy(F.desc_nulls_last("expected"), "symbol"))
    shown = [F.col("p")[k].alias(f"p_{b}") for k, b in enumerate(BUCKETS)]
    return out.select("sector", "symbol", "month", ranked.alias("rank"), bucket.alias("bucket"), "expected", top.alias("confidence"), (top >= SURE).alias("sure"), *shown, "predicted_last", "realized_last")


def projected(found: DataFrame, symbol: str) -> DataFrame:
    """One symbol's row of :func:`forecasts` with its peers, best first; no row if it has none."""
    own = found.where(F.col("symbol") == symbol)
    peers = found.join(own.select("sector"), "sector").groupBy("sector").agg(F.sort_array(F.collect_list(F.struct("rank", "symbol", "bucket", "expected", "confidence"))).alias("peers"))  # a sector's symbols
    return own.join(peers, "sector")
