"""Hard negatives by lists that a cluster of anchors shares.

Anchors are clustered by direction. By the triangle inequality of angles, an anchor u within angle b of its cluster's centre
meets a row x at an angle of no less than (angle of x to the centre) - b, so u.x <= |u| |x| cos of that. For each cluster
the rows are sorted by this bound once; every member walks the list in blocks and stops as soon as the next bound shows that no later
row can enter its result. Rows lie in shards and anchors in blocks of bounded size, so a task's memory is bounded;
the shards' best are merged by a window. Products are of integers and exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.ann import dimension


@dataclass(frozen=True)
class NegativeConfig:
    """positives, negatives: how many of each. low, high: percent of the positive's score between which a negative's lies.

    clusters: how many centres are fitted, over a sample of at most ``sample`` anchors. shard_rows, block_anchors: the
    rows and anchors that one task holds, about. step: how many rows of a list are scored at first; it doubles as the walk goes on.
    """

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    clusters: int = 64
    sample: int = 4096
    shard_rows: int = 8192
    block_anchors: int = 2048
    step: int = 256


def usable(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, label and v (floor of ``scale`` times each component, long) of the rows that take part.

    Rows with a null vec_id, label or vector, an empty vector, or a component that is null, not finite, or so large that a
    product might not fit in a long take no part; nor do vectors of another than the commonest length.
    """
    whole = vectors.select("vec_id", "label", "embedding").where(
        "vec_id is not null and label is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    )
    size = dimension(whole)
    most = (2.0**55 / max(size, 1)) ** 0.5  # 100 times a product of two vectors stays below 2 ** 62
    whole = whole.where(F.size("embedding") == size)
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(scale)))
    return whole.where(F.forall("embedding", lambda x: F.abs(x.cast("double") * F.lit(scale)) < most - 1)).select("vec_id", "label", v.alias("v"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros(x.shape), where=norm > 0)


def centres(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit vectors of at most ``k`` clusters of directions (spherical k-means over a bounded sample)."""
    x = _unit(x.astype(np.float64))
    out = np.unique(x[np.random.default_rng(seed).permutation(len(x))[:k]], axis=0)
    for _ in range(rounds):
        own = (x @ out.T).argmax(axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, x)
        out = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), out)
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    if len(a) and len(b) and a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max()) < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _first(who: np.ndarray, score: np.ndarray, row: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` rows for each of ``who``: higher scores first, ties by smaller id."""
    order = np.lexsort((ids[row], -score, who))
    who, score, row = who[order], score[order], row[order]
    at = np.arange(len(who))
    begin = np.maximum.accumulate(np.where(np.r_[True, who[1:] != who[:-1]], at, 0)) if len(who) else at
    keep = at - begin < k
    return who[keep], score[keep], row[keep]


def walk(u: np.ndarray, x: np.ndarray, ids: np.ndarray, centre: np.ndarray, k: int, fits, floor: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For each member of one cluster, its first ``k`` rows among those that fit: member, score, row, and how many products were made.

    ``fits(members, rows, scores)`` says which pairs may enter (a boolean matrix). ``floor``: no score below it can enter a
    member's result. The list is shared: rows in falling order of their bound for the whole cluster.
    """
    lengths, far = np.linalg.norm(x.astype(np.float64), axis=1), np.linalg.norm(u.astype(np.float64), axis=1)
    angle = np.arccos(np.clip(_unit(x.astype(np.float64)) @ centre, -1, 1))
    spread = np.arccos(np.clip(_unit(u.astype(np.float64))[far > 0] @ centre, -1, 1)).max(initial=0.0) + 1e-6
    bound = lengths * np.cos(np.clip(angle - spread, 0.0, np.pi)) + 1e-6 * lengths
    order = np.argsort(-bound, kind="stable")
    bound = bound[order]
    need, made = floor.astype(np.float64), 0
    who, score, row = (np.zeros(0, np.int64) for _ in range(3))
    open_, at = np.arange(len(u)), 0
    while at < len(order):
        open_ = open_[far[open_] * bound[at] + 1e-3 >= need[open_]]  # the certificate: no later row reaches what is needed
        if not len(open_):
            break
        rows = order[at : at + step]
        s = _products(u[open_], x[rows])
        made += s.size
        m, c = np.nonzero(fits(open_, rows, s) & (s >= need[open_][:, None]))
        if len(m):
            who, score, row = _first(np.r_[who, open_[m]], np.r_[score, s[m, c]], np.r_[row, rows[c]], ids, k)
            n = np.bincount(who, minlength=len(u))
            full = np.flatnonzero(n >= k)
            need[full] = np.maximum(need[full], score[np.cumsum(n)[full] - 1])
        at += len(rows)
        step *= 2
    return who, score, row, made


def _blocks(anchors: DataFrame, config: NegativeConfig) -> tuple[DataFrame, int, np.ndarray] | None:
    """Anchors with their cluster and block, the number of blocks, and the centres; none without anchors.

    Members of a cluster stand together, and a large cluster fills several blocks.
    """
    spark = anchors.sparkSession
    sample = anchors.select("v").orderBy(F.xxhash64("v", "vec_id")).limit(config.sample).collect()  # bounded
    if not sample:
        return None
    middle = centres(np.array([r.v for r in sample]), config.clusters)
    shared = spark.sparkContext.broadcast(middle)

    def nearest(frames):
        for f in frames:
            if len(f):
                f["cluster"] = (_unit(_matrix(f["v"]).astype(np.float64)) @ shared.value.T).argmax(axis=1).astype(np.int32)
                yield f

    schema = "vec_id long, label int, v array<long>, cluster int"
    placed = anchors.mapInPandas(nearest, schema)
    n = {r.cluster: r.n for r in placed.groupBy("cluster").agg(F.count("*").alias("n")).collect()}  # at most config.clusters rows
    base, at = {}, 0
    for c in sorted(n):
        base[c] = at
        at += n[c]
    rows = spark.createDataFrame([(c, base[c], n[c]) for c in sorted(n)], "cluster int, base long, n long")
    turn = F.col("base") + F.pmod(F.xxhash64("vec_id"), F.col("n"))
    block = F.floor(turn / F.lit(config.block_anchors)).cast("int")
    return placed.join(F.broadcast(rows), "cluster").select("vec_id", "label", "v", "cluster", block.alias("block")), -(-at // config.block_anchors), middle


def _meet(rows: DataFrame, asked: DataFrame, shards: int, blocks: int, fn, schema: str) -> DataFrame:
    """Every shard of the rows meets every block of the anchors."""
    left = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "label", "v")
    right = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(fn, schema)


def _each_cluster(x: pd.DataFrame, q: pd.DataFrame):
    rows, ids, labels = _matrix(x["v"]), x["vec_id"].to_numpy(), x["label"].to_numpy()
    for c, own in q.groupby("cluster"):
        yield c, own.reset_index(drop=True), _matrix(own["v"]), rows, ids, labels


def mine(vectors: DataFrame, anchors: DataFrame, config: NegativeConfig = NegativeConfig()) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score of each anchor's hard negatives.

    Both tables are of :func:`usable` rows. A score is the integer inner product with the anchor; higher ones come first, ties
    by smaller vec_id. An anchor's positives are its first rows of its label; a positive's negatives are the first rows of
    other labels whose score lies between ``low`` and ``high`` percent of the positive's. Rows of the anchor's own vec_id are no partners. Of
    anchors that share a vec_id the smallest (label, v) asks; repeated rows are partners each. A positive without a negative, an
    anchor without a positive and an empty table give no rows.
    """
    spark = vectors.sparkSession
    asked = anchors.groupBy("vec_id").agg(F.min(F.struct(F.col("label").cast("int").alias("label"), "v")).alias("x")).select("vec_id", "x.label", "x.v")
    dealt = _blocks(asked, config)
    if dealt is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    asked, blocks, middle = dealt
    shards = max(1, -(-vectors.count() // config.shard_rows))
    shared = spark.sparkContext.broadcast(middle)
    k, most, low, high, step = config.positives, config.negatives, config.low, config.high, config.step

    def positives(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"anchor_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})]
        for c, own, u, rows, ids, labels in _each_cluster(x, q) if len(x) and len(q) else ():
            mine_, kind = own["vec_id"].to_numpy(), own["label"].to_numpy()
            fits = lambda m, r, s: (labels[r] == kind[m][:, None]) & (ids[r] != mine_[m][:, None])  # noqa: E731, B023
            who, score, row, _ = walk(u, rows, ids, shared.value[c], k, fits, np.full(len(u), -np.inf), step)
            out.append(pd.DataFrame({"anchor_id": mine_[who], "id": ids[row], "score": score}))
        return pd.concat(out)

    found = _meet(vectors, asked, shards, blocks, positives, "anchor_id long, id long, score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    first = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    known = first.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("p"))  # at most k each
    known = asked.join(known, "vec_id").select("vec_id", "label", "v", "cluster", "block", F.col("p.place").alias("place"), F.col("p.id").alias("id"), F.col("p.score").alias("score"))

    def negatives(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        names = ("anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score")
        out = [pd.DataFrame({n: np.zeros(0, np.int64) for n in names})]
        for c, own, u, rows, ids, labels in _each_cluster(x, q) if len(x) and len(q) else ():
            mine_, kind = own["vec_id"].to_numpy(), own["label"].to_numpy()
            n = own["place"].map(len).to_numpy()
            of = np.repeat(np.arange(len(own)), n)  # one member for each anchor and positive
            place, pid, ps = (np.concatenate(own[f].to_numpy()).astype(np.int64) for f in ("place", "id", "score"))
            fits = lambda m, r, s: (labels[r] != kind[of[m]][:, None]) & (ids[r] != mine_[of[m]][:, None]) & (100 * s >= low * ps[m][:, None]) & (100 * s <= high * ps[m][:, None])  # noqa: E731, B023, E501
            lowest = np.where(ps < 0, np.inf, -(-low * ps // 100).astype(np.float64)) if low <= high else np.full(len(ps), np.inf)
            who, score, row, _ = walk(u[of], rows, ids, shared.value[c], most, fits, lowest, step)
            out.append(pd.DataFrame(dict(zip(names, (mine_[of[who]], place[who], pid[who], ps[who], ids[row], score)))))
        return pd.concat(out)

    schema = "anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long"
    met = _meet(vectors, known, shards, blocks, negatives, schema)
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    out = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
