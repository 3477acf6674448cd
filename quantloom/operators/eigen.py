"""Signals of each symbol in one frame of reference: axes, ranking against a target, symmetry between regimes, what bears load.

``signals`` are rows of symbol, date, signal and x; ``names`` lists the signals that count (a short list: moments grow with its
square). Null, NaN and infinite values are missing. All symbols are worked at once, from one row of moments a symbol.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Gives (symbol, dropped, name, weight) for the rows of :func:`candidates`, each by its surviving names alone.
Weigh = Callable[[DataFrame], DataFrame]
#: Rows of a ranking's windows; least correlation of a flip and widest spread of an invariant pair; moved weight that bears load.
WINDOWS, LEAST_CORR, MOST_SPREAD, BEARS = (252, 126, 63), 0.20, 0.25, 0.05


def wide(signals: DataFrame, names: list[str]) -> DataFrame:
    """symbol, date and x, an array in the order of ``names`` with null where a value is missing; of repeated values the largest counts."""
    x = F.col("x").cast("double")
    x = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    return signals.where(F.col("signal").isin(names)).groupBy("symbol", "date").agg(F.array(*(F.max(F.when(F.col("signal") == n, x)) for n in names)).alias("x"))


def moments(rows: DataFrame, k: int, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``by``, n, there (which of the k values occur at all) and s, the k by k sums of products about the means of the complete rows.

    A row is complete when it has every value that occurs in its group. The means come first, by a window of the same partitioning,
    so that values far from zero lose nothing; s has null for what doesn't occur.
    """
    w = Window.partitionBy(*by)
    at = lambda i: F.col(f"v{i}")
    x = rows.select(*by, *(F.col("x")[i].alias(f"v{i}") for i in range(k)))
    x = x.select("*", *(F.max(at(i).isNotNull()).over(w).alias(f"t{i}") for i in range(k)))
    whole = ~F.greatest(F.lit(0), *((F.col(f"t{i}") & at(i).isNull()).cast("int") for i in range(k))).cast("boolean")
    x = x.withColumn("some", F.greatest(F.lit(0), *(F.col(f"t{i}").cast("int") for i in range(k))) > 0).where(whole & F.col("some"))
    c = x.select(*by, *(F.col(f"t{i}") for i in range(k)), *((at(i) - F.avg(at(i)).over(w)).alias(f"c{i}") for i in range(k)))
    sums = [F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]
    g = c.groupBy(*by).agg(F.count("*").alias("n"), F.array(*(F.max(f"t{i}") for i in range(k))).alias("there"), *sums)
    return g.select(*by, "n", "there", F.array(*(F.col(f"s{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k))).alias("s"))


def _correlation(s: Column, k: int, i: int, j: int) -> Column:
    """Of moments; null where a side is constant or doesn't occur."""
    size = F.sqrt(s[i * k + i] * s[j * k + j])
    return F.when(size > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s[i * k + j] / size)))  # greatest and least pass over nulls


def axes(signals: DataFrame, names: list[str], components: int = 5) -> DataFrame:
    """symbol, n, features, constant, eigenvalues, shares and loadings (component, signal, loading) of the standardised complete rows.

    Signals without variation are listed as constant and left out. Eigenvalues are of the covariance (over n - 1) of columns scaled to
    one by n, as of a singular value decomposition; an axis points to where its largest loading (the first, of equal ones) is positive. A symbol of fewer than two complete
    rows, or without a varying signal, has no axes.
    """
    k = len(names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            out = []
            for symbol, n, s in zip(rows["symbol"], rows["n"], rows["s"]):
                s = np.array([np.nan if v is None else v for v in s], float).reshape(k, k)
                own = np.diag(s)
                keep = np.flatnonzero(own > 0)
                values, loadings, total = np.zeros(0), [], 1.0
                if n >= 2 and len(keep):
                    d = np.sqrt(own[keep])
                    value, vector = np.linalg.eigh(s[np.ix_(keep, keep)] / np.outer(d, d) * n / (n - 1))
                    order = np.argsort(-value)[:components]
                    values, total = np.clip(value[order], 0, None), float(value.sum())
                    for c, v in enumerate(vector[:, order].T):
                        v = v * np.sign(v[np.argmax(np.abs(v).round(9))])
                        loadings += [(c + 1, names[i], float(x)) for i, x in zip(keep, v)]
                out.append((symbol, int(n), [names[i] for i in keep], [names[i] for i in np.flatnonzero(own == 0)], values.tolist(), (values / total).tolist(), loadings))
            yield pd.DataFrame(out, columns=["symbol", "n", "features", "constant", "eigenvalues", "shares", "loadings"])

    kinds = "symbol string, n int, features array<string>, constant array<string>, eigenvalues array<double>, shares array<double>, loadings array<struct<component: int, signal: string, loading: double>>"
    return moments(wide(signals, names), k).select("symbol", "n", "s").mapInPandas(run, kinds)


def ranking(signals: DataFrame, target: DataFrame, names: list[str], windows: tuple[int, ...] = WINDOWS, ahead: int = 21, least: int = 20) -> DataFrame:
    """symbol, signal, its correlation with the target's returns (symbol, date, ret) over each window (and rows), with the return ahead, and its rank.

    Windows are of a symbol's newest rows that have a signal and a row of the target. Ranks go by the size of the longest window's
    correlation; where no signal has one, by the forward one; where none has that either, there are none. Ties go by name.
    """
    least = max(3, min(least, *windows))
    w = Window.partitionBy("symbol").orderBy("date")
    x = wide(signals, names).join(target.select("symbol", "date", "ret"), ["symbol", "date"])
    next_ = w.rowsBetween(1, ahead)
    x = x.withColumn("age", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).withColumn("next", F.when(F.count("ret").over(next_) == ahead, F.expm1(F.sum(F.log1p("ret")).over(next_))))
    each = x.select("symbol", "age", "ret", "next", F.inline(F.array(*(F.struct(F.lit(n).alias("signal"), F.col("x")[i].alias("x")) for i, n in enumerate(names)))))

    def r(y: str, inside: Column) -> Column:
        on = inside & F.col("x").isNotNull() & F.col(y).isNotNull()
        a, b = F.when(on, F.col("x")), F.when(on, F.col(y))
        spread = F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))  # corr itself divides by zero
        return F.when(F.count(a) >= least, F.covar_pop(a, b) / spread)

    own = [f(k) for k in windows for f in (lambda k: r("ret", F.col("age") <= k).alias(f"corr_{k}"), lambda k: F.count(F.when((F.col("age") <= k) & F.col("ret").isNotNull(), F.col("x"))).alias(f"n_{k}"))]
    g = each.groupBy("symbol", "signal").agg(*own, r("next", F.lit(True)).alias("forward_corr"), F.count("x").alias("n"))
    longest, every = f"corr_{max(windows)}", Window.partitionBy("symbol")
    by = F.when(F.count(longest).over(every) > 0, longest).when(F.count("forward_corr").over(every) > 0, "forward_corr")
    g = g.withColumn("ranked_by", by)
    size = F.coalesce(F.abs(F.when(F.col("ranked_by") == longest, F.col(longest)).otherwise(F.col("forward_corr"))), F.lit(0.0))
    return g.withColumn("rank", F.when(F.col("ranked_by").isNotNull(), F.row_number().over(every.orderBy(F.desc(size), "signal"))))


def symmetry(signals: DataFrame, labels: DataFrame, names: list[str], least: int = 30, least_corr: float = LEAST_CORR, most_spread: float = MOST_SPREAD) -> DataFrame:
    """symbol, a, b, regimes, lo, hi, spread and state of each pair of signals over the symbol's regimes (symbol, date, label).

    broken: the sign changes and no correlation is smaller than ``least_corr``; invariant: one sign, and a spread of at most ``most_spread``;
    else mixed. Regimes of fewer than ``least`` complete rows or two signals take no part; with fewer than two left a symbol has no rows.
    A pair must occur in each of them.
    """
    k = len(names)
    m = moments(wide(signals, names).join(labels.where("label is not null").select("symbol", "date", "label"), ["symbol", "date"]), k, ("symbol", "label"))
    used = m.where((F.col("n") >= least) & (F.size(F.filter("there", lambda t: t)) >= 2))
    pairs = [(i, j) for i in range(k) for j in range(k) if names[i] < names[j]]
    there = F.col("there")
    one = lambda i, j: F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), (there[i] & there[j]).alias("both"), _correlation(F.col("s"), k, i, j).alias("c"))
    g = used.select("symbol", F.inline(F.array(*(one(i, j) for i, j in pairs)))).groupBy("symbol", "a", "b")
    g = g.agg(F.every("both").alias("both"), F.count("c").alias("regimes"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(F.abs("c")).alias("weakest")).where("both and regimes > 1")
    x = g.withColumn("spread", F.col("hi") - F.col("lo"))
    flips = (F.col("lo") < 0) & (F.col("hi") > 0)
    state = F.when(flips & (F.col("weakest") >= least_corr), "broken").when(~flips & (F.col("spread") <= most_spread), "invariant").otherwise("mixed")
    return x.select("symbol", "a", "b", "regimes", "lo", "hi", "spread", state.alias("state"))


def candidates(signals: DataFrame, target: DataFrame, names: list[str]) -> DataFrame:
    """symbol, dropped (null: none), names (the survivors), n, strength and s: every set of a symbol's signals with one left out, and the whole set.

    strength has each survivor's correlation with the target's returns, s their correlations with one another (in rows), both from one row of
    moments of the complete rows; constant signals have no part in any set.
    """
    k = len(names)
    rows = signals.where(F.col("signal").isin(names)).select("symbol", "date", "signal", "x")
    both = rows.unionByName(target.select("symbol", "date", F.lit("").alias("signal"), F.col("ret").alias("x")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in frames:
            out = []
            for symbol, n, s in zip(part["symbol"], part["n"], part["s"]):
                s = np.array([np.nan if v is None else v for v in s], float).reshape(k + 1, k + 1)
                own = np.diag(s)
                live = np.flatnonzero(own[:k] > 0) if own[k] > 0 else np.zeros(0, int)
                d = np.sqrt(np.where(own > 0, own, 1.0))
                c = np.clip(s / np.outer(d, d), -1, 1)
                for gone in [None, *live] if len(live) else []:
                    left = [i for i in live if i != gone]
                    out.append((symbol, None if gone is None else names[gone], [names[i] for i in left], int(n), c[left, k].tolist(), c[np.ix_(left, left)].tolist()))
            yield pd.DataFrame(out, columns=["symbol", "dropped", "names", "n", "strength", "s"])

    kinds = "symbol string, dropped string, names array<string>, n int, strength array<double>, s array<array<double>>"
    return moments(wide(both, [*names, ""]), k + 1).where("n >= 2").select("symbol", "n", "s").mapInPandas(run, kinds)


def by_strength(sets: DataFrame) -> DataFrame:
    """Weights by squared correlation with the target, scaled to one; a set without any correlation has none."""
    total = F.aggregate("strength", F.lit(0.0), lambda t, r: t + r * r)
    x = sets.withColumn("total", total).where("total > 0")
    return x.select("symbol", "dropped", "total", F.inline(F.arrays_zip(F.col("names").alias("name"), F.col("strength").alias("r")))).selectExpr("symbol", "dropped", "name", "r * r / total AS weight")


def by_ridge(penalty: float = 0.1) -> Weigh:
    """Weights by the size of the coefficients of a ridge on standardised signals, scaled to one: here survivors take over from what is dropped."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            out = []
            for symbol, dropped, names, r, s in zip(rows["symbol"], rows["dropped"], rows["names"], rows["strength"], rows["s"]):
                if len(names):
                    b = np.abs(np.linalg.solve(np.array([list(v) for v in s]) + penalty * np.eye(len(names)), np.asarray(r, float)))
                    out += [(symbol, dropped, name, float(w)) for name, w in zip(names, b / b.sum())] if b.sum() > 0 else []
            yield pd.DataFrame(out, columns=["symbol", "dropped", "name", "weight"])

    return lambda sets: sets.mapInPandas(run, "symbol string, dropped string, name string, weight double")


def load_bearing(sets: DataFrame, weigh: Weigh, threshold: float = BEARS) -> DataFrame:
    """symbol, signal, baseline, delta, survivor_delta, load_bearing and rank: how the weights move when a signal is dropped.

    delta is the L1 distance of all weights; survivor_delta that of the survivors' from their own baseline scaled to one, which leaves out
    what dropping moves by arithmetic. The latter decides, or delta where fewer than two weights survive or they had none. A set that
    ``weigh`` gives nothing for has nulls, and so have all of a symbol whose whole set has none. Ranks go by the size moved, ties by name.
    """
    maps = weigh(sets).groupBy("symbol", "dropped").agg(F.map_from_entries(F.collect_list(F.struct("name", "weight"))).alias("w"))
    asked = sets.select("symbol", F.col("dropped").alias("signal")).where("signal is not null")
    base = maps.where("dropped is null").select("symbol", F.col("w").alias("base"))
    alt = maps.where("dropped is not null").select("symbol", F.col("dropped").alias("signal"), F.col("w").alias("alt"))
    x = asked.join(base, "symbol", "left").join(alt, ["symbol", "signal"], "left")
    of = lambda m, k: F.coalesce(F.element_at(m, k), F.lit(0.0))
    total = lambda keys, f: F.aggregate(keys, F.lit(0.0), lambda t, k: t + f(k))
    kept, b, a = F.array_sort(F.map_keys("alt")), F.col("base"), F.col("alt")
    x = x.withColumn("delta", total(F.array_sort(F.array_union(F.map_keys("base"), F.map_keys("alt"))), lambda k: F.abs(of(a, k) - of(b, k)))).withColumn("mass", total(kept, lambda k: of(b, k)))
    moved = F.when((F.size(kept) >= 2) & (F.col("mass") > 0), total(kept, lambda k: F.abs(of(a, k) - of(b, k) / F.col("mass"))))
    x = x.withColumn("survivor_delta", moved).withColumn("size", F.coalesce("survivor_delta", "delta"))
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc(F.round(F.coalesce("size", F.lit(0.0)), 12)), "signal"))
    return x.select("symbol", "signal", F.element_at("base", F.col("signal")).alias("baseline"), "delta", "survivor_delta", (F.col("size") >= threshold).alias("load_bearing"), rank.alias("rank"))
