"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. Vectors are posted, with the pivot's rank, in an inverted file
for each of their pivots. A query visits the files of its own nearest pivots, ranks what it meets by the footrule
distance between the two orders, and reranks the best by the exact inner product. Pivots are a bounded sample; every
vector is posted. Shards of the vectors hold their own inverted files, so memory is bounded by the shard.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PermutationConfig:
    """pivots: how many are sampled. prefix: nearest pivots that represent a vector. candidates: share of a shard, and
    least number, that is reranked. shard_rows, query_rows: the most vectors and queries of one task."""

    pivots: int = 512
    prefix: int = 96
    candidates: float = 0.15
    least_candidates: int = 200
    shard_rows: int = 8192
    query_rows: int = 4096


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part: not null, not zero, and all components finite."""
    good = "embedding is not null and vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x != 0)"
    return vectors.select("vec_id", "embedding").where(good)


def dimension(vectors: DataFrame) -> int:
    """The commonest length of vectors, the longer of two; 0 if there is none. Vectors of another length take no part."""
    found = vectors.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return found.d if found else 0


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def _lifted(x: np.ndarray, norm: float) -> np.ndarray:
    """Vectors on a sphere of one more dimension, where the nearest is that of the largest inner product."""
    return np.c_[x, np.sqrt(np.maximum(0.0, norm * norm - (x * x).sum(axis=1)))]


def _first_copies(x: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Rows (in order of id) with at most ``most`` of equal vectors: no later copy can be among the nearest."""
    order = np.lexsort((ids, *x.T[::-1]))
    same = np.r_[False, (x[order][1:] == x[order][:-1]).all(axis=1)]
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    keep = order[np.arange(len(order)) - start < most]
    return keep[np.argsort(ids[keep], kind="stable")]


def _most(x: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` largest, in order of place; of equals the first."""
    if len(x) <= n:
        return np.arange(len(x))
    least = np.partition(x, -n)[-n]
    above, equal = np.flatnonzero(x > least), np.flatnonzero(x == least)
    return np.sort(np.r_[above, equal[: n - len(above)]])


def _search(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, pivots: np.ndarray, norm: float, k: int, config: PermutationConfig, scale: float = 1.0) -> pd.DataFrame:
    """The k best of one shard for each query. Pivots and norm are of vectors divided by ``scale``; scores are of the vectors."""
    keep = _first_copies(x, ids, k + 1)
    ids, x = ids[keep], x[keep]
    m = min(config.prefix, len(pivots))
    near = np.argsort(-(_lifted(x / scale, norm) @ pivots.T), axis=1, kind="stable")[:, :m]
    files = np.zeros((len(pivots), len(ids)), np.uint16 if m < 362 else np.int64)  # the inverted files: what a posted vector can agree on, by pivot
    files[near, np.arange(len(ids))[:, None]] = m - np.arange(m)
    asked = np.argsort(-(np.c_[q / scale, np.zeros(len(q))] @ pivots.T), axis=1, kind="stable")[:, :m]
    own = (m - np.arange(m)).astype(files.dtype)[:, None]
    most = max(config.least_candidates, int(len(ids) * config.candidates), 2 * k)
    found, visited, met = [], np.empty((m, len(ids)), files.dtype), np.empty((min(most, len(ids)), x.shape[1]))
    for i in range(len(q)):
        np.minimum(np.take(files, asked[i], axis=0, out=visited, mode="clip"), own, out=visited)
        best = _most(visited.sum(axis=0, dtype=files.dtype), most)  # the footrule distance is a constant less twice the sum
        best = best[ids[best] != qids[i]]
        with np.errstate(over="ignore", invalid="ignore"):
            score = np.multiply(np.take(x, best, axis=0, out=met[: len(best)], mode="clip"), q[i], out=met[: len(best)]).sum(axis=1)
        order = np.where(np.isnan(score), -np.inf, score)
        top = np.flatnonzero(order >= np.partition(order, -k)[-k]) if len(order) > k else np.arange(len(order))
        top = top[np.lexsort((ids[best[top]], -order[top]))[:k]]
        found.append((np.full(len(top), qids[i]), ids[best[top]], score[top]))
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found))))) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, config: PermutationConfig = PermutationConfig()) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's ``k`` nearest by inner product, in double precision.

    Both tables have vec_id and embedding. A query's own id is no candidate. Ties go to the smaller vec_id. Vectors that are
    null, zero, hold a null or a component that isn't finite, or whose length isn't the commonest take no part, as queries
    either. A product too large for a double is infinite, and one of opposite infinities ranks last. Repeated rows are
    candidates each. An empty table gives no rows. Queries meet every shard of the vectors in blocks.
    """
    spark = vectors.sparkSession
    data = usable(vectors)
    size = dimension(data)
    data, asked = (x.where(F.size("embedding") == size) for x in (data, usable(queries)))
    scale = data.agg(F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))))).first()[0] or 1.0
    squared = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.pow(x.cast("double") / scale, F.lit(2)))
    n, norm = data.agg(F.count("*"), F.sqrt(F.max(squared))).first()
    sample = data.select("embedding").distinct().orderBy(F.xxhash64("embedding")).limit(config.pivots).collect()  # bounded
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards, blocks = max(1, -(-n // config.shard_rows)), max(1, -(-asked.count() // config.query_rows))
    pivots = spark.sparkContext.broadcast(_lifted(np.array([x[0] for x in sample], np.float64) / scale, norm))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("int")
    left = data.select(shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "embedding")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), block.alias("block"), "vec_id", "embedding")

    def search(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        return _search(x["vec_id"].to_numpy(), _matrix(x["embedding"]), q["vec_id"].to_numpy(), _matrix(q["embedding"]), pivots.value, norm, k, config, scale)

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
