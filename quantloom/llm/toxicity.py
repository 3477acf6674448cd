"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import bounded_sample, map_texts, mix64

_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class FtrlConfig:
    """bits: log2 of the weights' places. alpha, beta: per-coordinate rate. l1, l2: penalties. positive: weight of a
    toxic row. max_docs: bound of the labelled rows that the fit reads."""

    bits: int = 20
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 0.1
    positive: float = 2.0
    epochs: int = 3
    max_docs: int = 16_000


@dataclass(frozen=True)
class Weights:
    """The places with a weight other than zero, and the bias."""

    bits: int
    place: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.place] = self.weight
        return out


def features(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, place) of each word, pair of neighbours and pair with one word skipped; repeats included."""
    words = [_WORD.findall((x or "").lower()) for x in texts]
    n = np.array([len(x) for x in words], np.int64)
    h = np.fromiter((xxhash.xxh64_intdigest(x.encode("utf-8", "replace")) for x in chain.from_iterable(words)), np.uint64, int(n.sum()))
    text = np.repeat(np.arange(len(texts)), n)
    rows, places = [text], [mix64(h)]
    for skip in (1, 2):
        if len(h) > skip:
            same = text[skip:] == text[:-skip]
            rows.append(text[skip:][same])
            places.append(mix64((h[:-skip] * _BASE + h[skip:] + np.uint64(skip))[same]))
    return np.concatenate(rows), (np.concatenate(places) >> np.uint64(64 - bits)).astype(np.int64)


def _train(rows: list[tuple[str, int]], config: FtrlConfig) -> Weights:
    """Rows in a fixed order; the last place is the bias, which has no L1 penalty."""
    size = 1 << config.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    penalty = np.full(size + 1, config.l1)
    penalty[size] = 0.0

    def weight(at: np.ndarray) -> np.ndarray:
        s = z[at]
        return np.where(np.abs(s) <= penalty[at], 0.0, -(s - np.sign(s) * penalty[at]) / ((config.beta + np.sqrt(n[at])) / config.alpha + config.l2))

    data = [(np.r_[np.unique(features([x], config.bits)[1]), size].astype(np.int32), y) for x, y in rows]
    for _ in range(config.epochs):
        for at, y in data:
            w = weight(at)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y) * (config.positive if y else 1.0)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / config.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weight(np.arange(size + 1))
    place = np.flatnonzero(w[:size])
    return Weights(config.bits, place, w[place].astype(np.float32), float(w[size]))


def fit(labelled: DataFrame, config: FtrlConfig = FtrlConfig()) -> Weights:
    """Weights from rows of doc_id, text and toxic (0 or 1).

    The fit reads about ``config.max_docs`` rows, chosen by a hash of doc_id: that bound, not the table's size, is what
    the one training task holds. Rows with a null label are not learned from; a null text has no features.
    """
    rows = bounded_sample(labelled.select("doc_id", "text", "toxic").where("toxic is not null"), "doc_id", config.max_docs)
    rows = rows.withColumn("turn", F.xxhash64("doc_id", F.lit("turn"))).repartition(1).sortWithinPartitions("turn", "doc_id", "text")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = [x for b in batches for x in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist())]
        w = _train([(x or "", int(y)) for x, y in data], config)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[w.place, -1]), pa.array(np.r_[w.weight.astype(float), w.bias])], ["place", "weight"])

    got = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(train, "place long, weight double").collect()
    bias = sum(x.weight for x in got if x.place < 0)
    own = sorted((x.place, x.weight) for x in got if x.place >= 0)
    return Weights(config.bits, np.array([x for x, _ in own], np.int64), np.array([x for _, x in own], np.float32), bias)


def score(docs: DataFrame, weights: Weights) -> DataFrame:
    """doc_id and score (0 to 1) of every row; null, empty and wordless texts score the bias alone.

    A feature counts once a text however often it occurs. Repeated rows get the same score each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    dense: list[np.ndarray] = []

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        if not dense:
            dense.append(shared.value.dense())
        text, place = features(rows.column("text").to_pylist(), shared.value.bits)
        hit = np.flatnonzero(dense[0][place])
        pairs = np.unique(text[hit] * (1 << shared.value.bits) + place[hit])
        total = np.bincount(pairs >> shared.value.bits, weights=dense[0][pairs & ((1 << shared.value.bits) - 1)], minlength=rows.num_rows) + shared.value.bias
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], ["doc_id", "score"])

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, score double")
