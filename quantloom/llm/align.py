"""Alignment of the tokens of two tokenizers.

Both encode a text; a token covers a range of its bytes. Per batch, token starts are keyed by document (a document's bytes begin where
the last one's ended, so one sorted number is the key) and each start finds, by ``merge_asof``, the other side's token that
covers it. Of two tokens that overlap, the one that starts later begins within the other, so both directions together
give all overlaps, and equal starts give theirs twice. Where ends are equal a group ends.

How many documents hold a pair of ids linked is counted over the whole corpus. Pairs that more than a 2^-20th of all
(document, pair) rows hold are fewer than 2^20 whatever the corpus; only those are broadcast, as two sorted arrays. The rows of rarer
pairs meet their counts in a join, where no key is heavy.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm import pieces
from quantloom.llm.common import map_texts, stored, text_slices
from quantloom.llm.packing import Encoder

#: Separators of a written grouping, by code.
_SEPARATORS = (",", "|", ";", "")
#: Distinct pairs that a task counts before it hands its sums on.
HELD_PAIRS = 1 << 20
#: A pair is frequent if more than one in so many rows of (document, pair) is of it: there are fewer frequent pairs than this.
FREQUENT = 1 << 20
_sides: dict[tuple[str, str], "Sides"] = {}


class Sides:
    """Both vocabularies: the bytes of each id, and ids written with each separator."""

    def __init__(self, name_a: str, name_b: str):
        import public_tokenizers as P

        with open(P.path(name_a.removesuffix(".json") + ".tiktoken"), "rb") as lines:
            ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
        self.bytes_a = [ranks.get(i, b"") for i in range(max(ranks) + 1)]
        self.encoder = Encoder(P.path(name_a.removesuffix(".json") + ".tiktoken"), P.PATTERN, {})  # no special tokens
        self.model = pieces.model(name_b)
        self.bytes_b = self.model.table
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.most = max(len(self.bytes_a), len(self.bytes_b))
        self.written = np.array([f"{i}{s}" for s in _SEPARATORS for i in range(self.most)], object)


def sides(name_a: str, name_b: str) -> Sides:
    """The worker's copy of two vocabularies."""
    if (name_a, name_b) not in _sides:
        _sides[name_a, name_b] = Sides(name_a, name_b)
    return _sides[name_a, name_b]


def _tokens(own: Sides, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids of both sides of each text; none if a side's bytes aren't a space and the text. B's new words are searched together."""
    none = np.zeros(0, np.int64)
    out = []
    for text, raw_b in zip(texts, own.model.encode([x or "" for x in texts])):
        want = (" " + (text or "")).encode()
        a = np.frombuffer(own.encoder.encode(" " + text) if text else b"", "<u2").astype(np.int64)
        b = np.frombuffer(raw_b, own.model.kind).astype(np.int64)
        joined = (b"".join([table[i] for i in ids.tolist()]) for ids, table in ((a, own.bytes_a), (b, own.bytes_b)))
        out.append((a, b) if text and all(x == want for x in joined) else (none, none))
    return out


def overlaps(start_a: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the A and B tokens that overlap, in order. Starts are sorted and both sides begin together in each document."""
    a, b = (pd.DataFrame({"at": s, k: np.arange(len(s))}) for s, k in ((start_a, "a"), (start_b, "b")))
    by_a = pd.merge_asof(a, b, on="at")
    by_b = pd.merge_asof(b, a, on="at")
    later = start_a[by_b["a"].to_numpy()] < start_b  # equal starts are known from the other direction
    i = np.r_[by_a["a"].to_numpy(), by_b["a"].to_numpy()[later]]
    j = np.r_[by_a["b"].to_numpy(), by_b["b"].to_numpy()[later]]
    order = np.argsort(i * (len(start_b) + 1) + j)
    return i[order], j[order]


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def _slice(own: Sides, texts: list[str | None]) -> dict[str, list]:
    """Tokens, groups and links of some documents."""
    both = _tokens(own, texts)
    n_a, n_b = (np.array([len(x[k]) for x in both], np.int64) for k in (0, 1))
    a, b = (np.concatenate([x[k] for x in both]) if both else np.zeros(0, np.int64) for k in (0, 1))
    start_a, start_b = _starts(own.length_a[a]), _starts(own.length_b[b])
    end_a, end_b = start_a + own.length_a[a], start_b + own.length_b[b]
    doc_a = np.repeat(np.arange(len(texts)), n_a)
    i, j = overlaps(start_a, start_b) if len(a) else (np.zeros(0, np.int64),) * 2
    # groups: an end is a group's end if both sides have it
    last_a, last_b = (np.isin(x, y, assume_unique=True) for x, y in ((end_a, end_b), (end_b, end_a)))
    group_a, group_b = (np.cumsum(x) - x for x in (last_a, last_b))
    size_a, size_b = (np.bincount(x, minlength=int(last_a.sum())) for x in (group_a, group_b))
    place_a = np.arange(len(a)) + _starts(size_b)[group_a]
    place_b = np.arange(len(b)) + np.cumsum(size_a)[group_b]
    n_groups = np.bincount(doc_a[last_a], minlength=len(texts))
    text_a, text_b = a + own.most * last_a, b + own.most * np.where(last_b, 2, 0)
    finals = (np.cumsum(n_b) - 1)[n_b > 0]
    text_b[finals] = b[finals] + 3 * own.most
    order = np.empty(len(a) + len(b), np.int64)
    order[place_a], order[place_b] = text_a, text_b
    written, ends = own.written[order].tolist(), np.cumsum(n_a + n_b).tolist()
    groups = ["".join(written[lo:hi]) for lo, hi in zip([0, *ends], ends)]
    links = np.bincount(doc_a[i], minlength=len(texts))
    return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": links, "groups": groups, "i": i, "j": j, "doc": doc_a[i], "a": a, "b": b, "group_a": group_a, "start_a": start_a, "start_b": start_b}


def _distinct(doc: np.ndarray, pair: np.ndarray, n: int) -> tuple[list[bytes], list[bytes]]:
    """For each document its distinct pairs in order (64-bit) and how often each is linked there (32-bit)."""
    order = np.lexsort((pair, doc))
    doc, pair = doc[order], pair[order]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])]) if len(doc) else np.zeros(0, np.int64)
    times = np.diff(np.r_[new, len(doc)]).astype("<u4")
    cut = np.searchsorted(doc[new], np.arange(n + 1)).tolist()
    raw_p, raw_t = pair[new].astype("<u8").tobytes(), times.tobytes()
    return [raw_p[8 * lo : 8 * hi] for lo, hi in zip(cut, cut[1:])], [raw_t[4 * lo : 4 * hi] for lo, hi in zip(cut, cut[1:])]


def align(docs: DataFrame, name_a: str = "byte_bpe_50k.json", name_b: str = "piece_bpe_32k.model") -> DataFrame:
    """The alignment itself: doc_id, a and b (ids), links (places of overlapping A and B tokens) and groups (text), one row per row.

    A encodes a space and the text, B the text, both without special tokens, whose spellings are plain text. A text that is null or
    empty, or whose A or B bytes joined aren't the space and the text, has no tokens: empty lists and an empty text. Repeated
    rows, and rows with a null doc_id, are aligned each by itself. Other columns of ``docs`` are not read.
    """

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        x = _slice(sides(name_a, name_b), rows.column("text").to_pylist())
        n = rows.num_rows
        cut_a, cut_b, cut = (np.r_[0, np.cumsum(v)] for v in (x["n_a"], x["n_b"], x["n_links"]))
        listed = lambda v, at: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v, pa.int64()))
        own = [x["i"] - cut_a[x["doc"]], x["j"] - cut_b[x["doc"]]]
        links = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in own], ["a", "b"]))
        assert len(links) == n
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), listed(x["a"], cut_a), listed(x["b"], cut_b), links, pa.array(x["groups"], pa.string())], ["doc_id", "a", "b", "links", "groups"])

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, a array<long>, b array<long>, links array<struct<a: long, b: long>>, groups string")


def aligned(docs: DataFrame, name_a: str = "byte_bpe_50k.json", name_b: str = "piece_bpe_32k.model") -> DataFrame:
    """part and no (a row's key), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct pairs of ids with their links.

    A pair is one number, A id times the size of B's vocabulary plus B id: pairs (64-bit) and times (32-bit) are little-endian.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, no = sides(name_a, name_b), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in text_slices(batch, "text"):
                x = _slice(own, rows.column("text").to_pylist())
                n = rows.num_rows
                pairs, times = _distinct(x["doc"], x["a"][x["i"]] * len(own.bytes_b) + x["b"][x["j"]], n)
                sha = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in x["groups"]]
                counts = [pa.array(x[k], pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(no, no + n)), rows.column("doc_id"), *counts, pa.array(sha), pa.array(pairs, pa.binary()), pa.array(times, pa.binary())],
                    ["part", "no", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )
                no += n

    schema = "part int, no long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(table: DataFrame, size_b: int) -> DataFrame:
    """pair, n (documents that hold it) and best (whether n is the highest of its A id) over a table of :func:`aligned`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            new = np.concatenate([np.frombuffer(x, "<i8") for x in batch.column("pairs").to_pylist()] or [held[:0]])
            pair, at = np.unique(np.r_[held, new], return_inverse=True)
            n = np.bincount(at, weights=np.r_[n, np.ones(len(new))], minlength=len(pair)).astype(np.int64)
            held = pair
            if len(held) > HELD_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n)], ["pair", "n"])
                held, n = held[:0], n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n)], ["pair", "n"])

    n = table.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    n = stored(n.withColumn("a", F.floor(F.col("pair") / F.lit(size_b))), "align-pairs")
    top = n.groupBy("a").agg(F.max("n").alias("top"))  # a row for each id of A's vocabulary at most
    return n.join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def link_counts(docs: DataFrame, name_a: str = "byte_bpe_50k.json", name_b: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    n_best: links whose pair's count is the highest of its A id, ties included. count_sum: counts summed over the links. Texts without
    tokens (see :func:`align`) have zeros and an empty groups_sha256. A row is a document, so repeated rows, and rows with a null doc_id,
    count each. An empty table gives no rows.
    """
    size_b = len(sides(name_a, name_b).bytes_b)
    table = stored(aligned(docs, name_a, name_b), "align")
    counts = pair_counts(table, size_b)
    total = table.agg(F.sum(F.octet_length("pairs")) / 8).first()[0] or 0
    least = max(1, int(total) // FREQUENT)
    often = counts.where(F.col("n") > least).orderBy("pair").toArrow()  # fewer than FREQUENT rows
    pair, n, best = (often.column(k).to_numpy() for k in ("pair", "n", "best"))
    shared = docs.sparkSession.sparkContext.broadcast((pair, n, best))

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        pair, n, best = shared.value
        out: list[list] = [[] for _ in range(4)]
        for p, t in zip(rows.column("pairs").to_pylist(), rows.column("times").to_pylist()):
            p, t = np.frombuffer(p, "<i8"), np.frombuffer(t, "<u4").astype(np.int64)
            at = np.minimum(np.searchsorted(pair, p), max(len(pair) - 1, 0))
            known = pair[at] == p if len(pair) else np.zeros(len(p), bool)
            at, rest = at[known], ~known
            for column, value in zip(out, (int((t[known] * best[at]).sum()), int((t[known] * n[at]).sum()), p[rest], t[rest])):
                column.append(value)
        lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(v) for v in x])], pa.int32()), pa.array(np.concatenate([*x, np.zeros(0, np.int64)]), pa.int64())) for x in out[2:]]
        return pa.RecordBatch.from_arrays([*(rows.column(k) for k in keys), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), *lists], [*keys, "n_best", "count_sum", "rest", "times"])

    keys = ["part", "no", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = "part int, no long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rest array<long>, times array<long>"
    known = stored(map_texts(table.select(*keys, "pairs", "times"), run, schema, "pairs"), "align-known")
    rare = known.select("part", "no", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("part", "no", F.col("x.rest").alias("pair"), F.col("x.times").alias("times"))
    met = rare.hint("merge").join(counts.where(F.col("n") <= least), "pair")
    sums = met.groupBy("part", "no").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
    out = known.select(*keys, "n_best", "count_sum").join(sums, ["part", "no"], "left")
    add = lambda x, y: (F.col(x) + F.coalesce(F.col(y), F.lit(0))).alias(x)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", add("n_best", "more_best"), add("count_sum", "more"), "groups_sha256")
