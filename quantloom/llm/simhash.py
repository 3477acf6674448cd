"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into (k // 2) + 1 segments for k differing bits: of two fingerprints that differ by k bits
or fewer, one segment differs by at most one bit. Each segment is indexed whole, and once for every bit that is wild.
Fingerprints meet on an equal key; under a wildcard key only those with a 0 there meet those with a 1, so that copies
and near copies that agree in a segment do not meet again under its 32 wildcards. Who meets is verified on all 64 bits,
and only a spanning forest of each key's links is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import join_heavy, map_texts, stored
from quantloom.llm.components import components

#: Rows of one key that a task holds at a time; a larger key is dealt out in pairs of blocks.
BLOCK = 4096


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of the word shingles of a text (ASCII lower case; null and wordless texts: 0)."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    n = max(1, len(w) - words + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n)
    ones = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text) and fp (the fingerprint as a signed long) of every row.

    Null, empty and wordless texts have fingerprint zero. Repeated rows, and rows with a null doc_id, get theirs each.
    """

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(x, words) for x in rows.column("text").to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_hash"), pa.array(fp.view(np.int64))], ["doc_id", "text_hash", "fp"])

    return map_texts(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), run, "doc_id long, text_hash long, fp long")


def _keys(nodes: DataFrame, segments: int) -> DataFrame:
    """key, node, fp: each segment whole (wildcard = width) and with each of its bits wild."""
    width = 64 // segments
    at = nodes.select("node", "fp", F.explode(F.sequence(F.lit(0), F.lit(segments * (width + 1) - 1))).alias("k"))
    part = f"(shiftrightunsigned(fp, int(k div {width + 1}) * {width}) & {(1 << width) - 1}L)"
    wild = f"if(k % {width + 1} = {width}, 0L, shiftleft(1L, k % {width + 1}))"
    return at.select(F.expr(f"shiftleft(bigint(k), {width}) | ({part} & ~{wild})").alias("key"), "node", "fp")


def _forest(nodes: np.ndarray, fps: np.ndarray, side: np.ndarray | None, most: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between fingerprints; with side, only links between sides 0 and 1 are sought."""
    left = list(range(len(nodes))) if side is None else np.flatnonzero(side == 0).tolist()
    rest = np.arange(len(nodes)) if side is None else np.flatnonzero(side == 1)
    label, out = np.arange(len(nodes)), []
    for i in left:
        other = rest[rest > i] if side is None else rest
        other = other[label[other] != label[i]]
        for j in other[np.bitwise_count(fps[other] ^ fps[i]) <= most]:
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                out.append((int(nodes[i]), int(nodes[j])))
    return out


def _side(keys: np.ndarray, fps: np.ndarray, segments: int) -> np.ndarray:
    """The wild bit of each row, or 2 under a key without one."""
    width = 64 // segments
    k = keys >> width
    wild, segment = k % (width + 1), k // (width + 1)
    bit = (fps >> (segment * width + np.minimum(wild, width - 1)).astype(np.uint64)) & np.uint64(1)
    return np.where(wild == width, 2, bit.astype(np.int64))


def links(nodes: DataFrame, most: int = 3) -> DataFrame:
    """Edges (a, b) that connect all nodes whose fingerprints differ in ``most`` bits or fewer, directly or by others.

    ``nodes`` has node (long) and fp, each fp once. Keys are dealt out by hash and read in order. A key of more than
    BLOCK rows isn't held: its rows are written out in blocks, and every pair of blocks is one group of the next step.
    """
    segments = 2 if most < 4 else 4
    if most >= 2 * segments:
        raise ValueError("too many differing bits for the segments")

    def emit(a, b, key=None, fp=None) -> pa.RecordBatch:
        rest = [pa.nulls(len(a), pa.int64())] * 2 if key is None else [pa.array(key), pa.array(fp)]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *rest], ["a", "b", "key", "fp"])

    def close(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        side = _side(keys, fps, segments)
        ones = np.add.reduceat(side, starts)
        found: list[tuple[int, int]] = []
        for g in np.flatnonzero((sizes > 1) & (ones > 0) & (ones != sizes)):
            at = slice(starts[g], starts[g] + sizes[g])
            found += _forest(nodes[at], fps[at], None if side[starts[g]] == 2 else side[at], most)
        if found:
            yield emit(*zip(*found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, spilled, written = None, None, 0  # rows of the last key; a key too large to hold, and how many of it were written

        def spill(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            nonlocal written
            block = (written + np.arange(len(keys))) // BLOCK
            written += len(keys)
            return emit(nodes, block, keys, fps.view(np.int64))

        for batch in batches:
            keys, nodes, fps = (batch.column(c).to_numpy() for c in ("key", "node", "fp"))
            rows = (keys, nodes, fps.view(np.uint64))
            if spilled is not None:
                cut = np.searchsorted(keys, spilled, side="right")
                if cut:
                    yield spill(*(x[:cut] for x in rows))
                rows = tuple(x[cut:] for x in rows)
                if len(rows[0]):
                    spilled, written = None, 0
            if held is not None:
                rows = tuple(np.concatenate(x) for x in zip(held, rows))
            if not len(rows[0]):
                continue
            first = np.searchsorted(rows[0], rows[0][-1])  # the last key may go on in the next batch
            if first:
                yield from close(*(x[:first] for x in rows))
            held = tuple(x[first:] for x in rows)
            if len(held[0]) > BLOCK:
                spilled = held[0][0]
                yield spill(*held)
                held = None
        if held is not None:
            yield from close(*held)

    dealt = _keys(nodes, segments).repartition("key").sortWithinPartitions("key")
    found = stored(dealt.mapInArrow(run, "a long, b long, key long, fp long"), "simhash-links")
    edges = found.where("key is null").select("a", "b")
    large = found.where("key is not null").select("key", F.col("a").alias("node"), F.col("b").alias("block"), "fp")
    return edges.unionByName(_across_blocks(large, segments, most)).distinct()


def _across_blocks(large: DataFrame, segments: int, most: int) -> DataFrame:
    """The links under keys with many rows: one group for each pair of a key's blocks."""
    blocks = large.groupBy("key").agg((F.max("block") + 1).alias("n"))
    each = large.join(blocks, "key").select("key", "node", "fp", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("other"))
    pairs = each.select("key", "node", "fp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        fps = rows["fp"].to_numpy().view(np.uint64)
        side = _side(rows["key"].to_numpy(), fps, segments)
        found = _forest(rows["node"].to_numpy(), fps, None if side[0] == 2 else side, most)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return pairs.groupBy("key", "i", "j").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, most: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id linked, itself included) and text_hash of every row.

    Null, empty and wordless texts have fingerprint zero and are linked like any other; texts of fewer words than a
    shingle have the whole sequence as their one shingle. Rows that share a doc_id may have several fingerprints, each
    with its own component. A row with a null doc_id gets its fingerprint, links nothing and has a null component.
    """
    fps = stored(fingerprints(docs, words), "simhash")
    nodes = stored(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-nodes")
    roots = components(links(nodes.select(F.col("fp").alias("node"), "fp"), most)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(least.hint("merge"), "root").select("fp", "n", "component_id")
    out = join_heavy(fps.where("doc_id is not null"), of, ["fp"], "n").select("doc_id", "fp", "component_id", "text_hash")
    rest = fps.where("doc_id is null").select("doc_id", "fp", F.lit(None).cast("long").alias("component_id"), "text_hash")
    return out.unionByName(rest).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash")


def keep_one(docs: DataFrame, words: int = 3, most: int = 3) -> DataFrame:
    """The rows of ``docs`` but those with a smaller doc_id in their component. Rows with a null doc_id stay.

    A row is known by its doc_id and the hash of its text: of rows that share a doc_id each is judged by its own text.
    """
    gone = near_duplicates(docs, words, most).where("component_id != doc_id").select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__of")).distinct()
    own = docs.withColumn("__own", F.xxhash64("text"))
    return own.join(gone.hint("merge"), (own["doc_id"] == gone["__gone"]) & (own["__own"] == gone["__of"]), "left_anti").drop("__own")
