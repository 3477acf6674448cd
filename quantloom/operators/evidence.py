"""Evidence: filing sections, claims against facts, what regimes break, and what a weighting rests on."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators import bars as B
from quantloom.operators import cross as X


def longest_between(docs: DataFrame, starts: list[str], ends: list[str], least: int = 200) -> DataFrame:
    """doc_id and the longest span from a start pattern to the nearest end pattern after it (or the text's end)."""
    head, tail = re.compile("|".join(starts), re.I), re.compile("|".join(ends), re.I)

    def cut(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            best = ""
            for m in head.finditer(t or ""):
                e = tail.search(t, m.end())
                span = t[m.start() : e.start() if e else len(t)]
                best = span if len(span) > len(best) else best
            out.append(best if len(best) >= least else None)
        return pd.Series(out, dtype=object)

    return docs.select("doc_id", F.pandas_udf(cut, "string")("text").alias("section"))


def verify(claims: DataFrame, facts: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Each claim (doc_id, key, value) as verified, value_mismatch, concept_missing, or uncheckable where it has no value."""
    x = claims.join(facts.select("key", F.col("value").alias("fact")), "key", "left")
    close = F.abs(F.col("value") - F.col("fact")) / F.greatest(F.abs("value"), F.abs("fact"), F.lit(1.0)) <= tolerance
    return x.withColumn("status", F.when(F.col("value").isNull(), "uncheckable").when(F.col("fact").isNull(), "concept_missing").when(close, "verified").otherwise("value_mismatch"))


def verified_share(checked: DataFrame) -> DataFrame:
    """By document: verified claims over checkable ones, 1 where none is checkable."""
    g = checked.groupBy("doc_id").agg(F.count_if(F.col("status") == "verified").alias("ok"), F.count_if(F.col("status").isin("verified", "value_mismatch")).alias("n"))
    return g.select("doc_id", "n", F.when(F.col("n") == 0, 1.0).otherwise(F.col("ok") / F.col("n")).alias("share"))


def regime_flips(bars: DataFrame, labels: DataFrame, least_rows: int = 20, least_corr: float = 0.2, most_spread: float = 0.25) -> DataFrame:
    """Pairs whose correlation changes sign between regimes (broken) or hardly moves (invariant)."""
    r = X.returns(bars).join(labels, "date")
    c = X.gram(r, ("label",)).select("a", "b", "label", X.correlation().alias("c"), "n").where(F.col("n") >= least_rows)
    g = c.groupBy("a", "b").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(F.abs("c")).alias("weakest"), F.count("*").alias("regimes"))
    state = F.when((F.col("lo") < 0) & (F.col("hi") > 0) & (F.col("weakest") >= least_corr), "broken").when((F.col("lo") * F.col("hi") > 0) & (F.col("hi") - F.col("lo") <= most_spread), "invariant").otherwise("mixed")
    return g.where("regimes > 1").select("a", "b", "lo", "hi", state.alias("state"))


def stats_by_label(bars: DataFrame, labels: DataFrame, least: int = 5, forward: bool = True) -> DataFrame:
    """Mean, deviation, hit rate and count of returns by label; ``forward`` takes the next row's return."""
    r = B.with_returns(bars)
    r = r.withColumn("ret", F.lead("ret").over(B.by())) if forward else r
    g = r.where("ret is not null").join(labels, "date").groupBy("symbol", "label")
    return g.agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), F.avg((F.col("ret") > 0).cast("double")).alias("hit"), F.count("*").alias("n")).where(F.col("n") >= least)


def load_bearing(weights: DataFrame, threshold: float = 0.05) -> DataFrame:
    """How far the rest of a weighting moves when one name is dropped and the survivors are scaled up: L1 distance."""
    w = Window.partitionBy()
    x = weights.withColumn("weight", F.col("weight") / F.sum("weight").over(w))
    moved = F.when(F.col("weight") < 1, 2 * F.col("weight"))  # the dropped share, and as much spread over the others
    return x.select("symbol", "weight", moved.alias("delta"), (moved >= threshold).alias("load_bearing"))


def compounded_months(bars: DataFrame, least: int = 10) -> DataFrame:
    """Monthly return as the product of daily ones, for months with enough days."""
    g = X.returns(bars).groupBy("symbol", F.trunc("date", "month").alias("month")).agg((F.product(1 + F.col("ret")) - 1).alias("ret"), F.count("*").alias("n"))
    return g.where(F.col("n") >= least)


def monthly_points(bars: DataFrame, months: int = 12) -> DataFrame:
    """Last and mean level of each symbol's newest months, and the change from the month before over its size."""
    w = Window.partitionBy("symbol").orderBy("month")
    g = bars.groupBy("symbol", F.trunc("date", "month").alias("month")).agg(F.max_by("close", "date").alias("last"), F.avg("close").alias("mean"))
    g = g.withColumn("change", (F.col("last") - F.lag("last").over(w)) / F.abs(F.lag("last").over(w))).withColumn("age", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("month"))))
    return g.where(F.col("age") <= months)


def segments(rows: DataFrame) -> DataFrame:
    """Newest value of each (symbol, member), its growth over the same period a year before, and its share of the symbol's."""
    w = Window.partitionBy("symbol", "member").orderBy("period_end")
    prior = rows.select("symbol", "member", F.add_months("period_end", 12).alias("period_end"), F.col("value").alias("prior"))
    x = rows.join(prior, ["symbol", "member", "period_end"], "left").withColumn("rn", F.row_number().over(w.orderBy(F.desc("period_end")))).where("rn = 1")
    return x.select("symbol", "member", "period_end", "value", F.when(F.col("prior") > 0, F.col("value") / F.col("prior") - 1).alias("growth"), (F.col("value") / F.sum("value").over(Window.partitionBy("symbol"))).alias("share"))
