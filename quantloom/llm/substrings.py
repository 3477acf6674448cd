"""Substring dedup over a De Bruijn graph of words.

A run of k words is an edge between the nodes of its first and last k - 1 words. An edge that starts in documents of
different ids is repeated, and its words go from all but the document with the smallest id. The graph is compacted in two
steps, as is done for graphs too large to hold:

1. Consecutive edges of a document that share their minimiser (the smallest hash of ``anchor`` consecutive words) are one
   stretch before anything is shuffled: a row holds the minimiser, the source coordinates (document, text, position) and a
   48-bit hash of each edge. As the minimiser depends on an edge's own words only, equal edges always meet under it. Equal
   stretches are nonbranching there and are settled whole; where stretches branch off, they are settled by the edge.
2. Repeated stretches that follow one another both in their document and in the document they repeat are one path, however
   many minimisers it passes: they are put together by their coordinates.

Each path is then verified: its source coordinates are joined to the source document, and a digest of the words that
stand there to the document that repeats it, which compares it with its own words before it cuts. Hashes only find paths.
Different words that share their hashes are to be expected in a large corpus. What the comparison rejects is settled by the
words themselves: the rejected edges' occurrences in all documents are found again and grouped by their words' digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import join_heavy, map_texts, marked, mix64, stored, text_slices

#: Words of a minimiser.
ANCHOR = 5
#: Distinct stretches under one minimiser that a task holds; beyond, they are settled by a grouped join.
HELD = 200_000
_HASH = 6  # bytes of an edge's hash
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: A place is a text's tag (32 bits of its hash, for ids that have several texts) above a word's position.
_TAG = "shiftleft(xxhash64(text), 32)"
_AT = "bigint(4294967295)"


def _rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each run of k word hashes."""
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = out * _BASE + h[j : len(h) - k + 1 + j]
    return mix64(out)


def _stretches(texts: list[str | None], k: int, seed: int = 0, bits: int = 64) -> tuple[np.ndarray, ...]:
    """For compacted stretches: text number, first edge's position, minimiser, and the edges' hashes (flat) with ends."""
    anchor = min(ANCHOR, k)
    words = [(x or "").encode("utf-8", "replace").split() for x in texts]
    n = np.array([len(x) for x in words], np.int64)
    total = int(n.sum())
    none = np.zeros(0, np.int64)
    if total < k:
        return none, none, none, np.zeros((0, _HASH), np.uint8), none
    h = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words), repeat(seed)), np.uint64, total) >> np.uint64(64 - bits)
    text = np.repeat(np.arange(len(texts)), n)
    anchors, edges = _rolling(h, anchor), _rolling(h, k)
    m, span = len(edges), k - anchor + 1
    best, at = anchors[:m].copy(), np.zeros(m, np.int64)
    for j in range(1, span):
        less = anchors[j : j + m] < best
        best[less] = anchors[j : j + m][less]
        at[less] = j
    at += np.arange(m)
    inside = np.flatnonzero(text[:m] == text[k - 1 : k - 1 + m])  # edges that lie in one text
    if not len(inside):
        return none, none, none, np.zeros((0, _HASH), np.uint8), none
    first = np.r_[True, (np.diff(inside) != 1) | (at[inside][1:] != at[inside][:-1]) | (text[inside][1:] != text[inside][:-1])]
    starts = inside[first]
    base = np.cumsum(n) - n
    hashes = edges[inside].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_HASH]
    ends = np.r_[np.flatnonzero(first)[1:], len(inside)]
    return text[starts], starts - base[text[starts]], best[starts].view(np.int64), hashes, ends


class Repeats:
    """What a task has met more than once: keys of whole stretches with the first place of the smallest document so far.

    It plays the part of a map-side combine: a later document's copy of a known stretch is settled before the shuffle, so
    a line that many documents share sends a few rows a task, not one a document. What isn't known here is settled later.
    """

    def __init__(self, most: int = 200_000):
        none = np.zeros(0, np.int64)
        self.most, self.keys, self.doc, self.place = most, np.zeros(0, np.uint64), none, none

    def settled(self, key: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which stretches also start in a smaller document met by this task; that document, and where."""
        order = np.lexsort((place, doc, key))
        k, d, p = key[order], doc[order], place[order]
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(k)]))
        least, where = d[starts], p[starts]
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, k[starts]), len(self.keys) - 1)
            sooner = (self.keys[at] == k[starts]) & (self.doc[at] < least)
            least, where = np.where(sooner, self.doc[at], least), np.where(sooner, self.place[at], where)
        gone, source, there = np.zeros(len(key), bool), np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        gone[order], source[order], there[order] = d > least[group], least[group], where[group]
        again = np.unique(group[gone[order]])
        if len(again):
            keys, docs, places = np.r_[self.keys, k[starts][again]], np.r_[self.doc, least[again]], np.r_[self.place, where[again]]
            by = np.lexsort((places, docs, keys))
            first = np.r_[True, keys[by][1:] != keys[by][:-1]]
            if first.sum() <= self.most:
                self.keys, self.doc, self.place = keys[by][first], docs[by][first], places[by][first]
        return gone, source, there


def stretches(docs: DataFrame, k: int, seed: int = 0, bits: int = 64) -> DataFrame:
    """anchor, doc_id, place, n, src, src_place and edges of every compacted stretch.

    n is 0 and edges has the hashes (_HASH bytes each) where the stretch is still open; where its task has settled that it
    goes, n is its number of edges, src and src_place say where it stands in a smaller document, and the anchor is arbitrary
    so that such rows spread evenly. Rows with a null doc_id or text, and texts of fewer than k words, have no stretch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Repeats()
        for batch in batches:
            for rows in text_slices(batch, "text"):
                text, pos, anchor, hashes, ends = _stretches(rows.column("text").to_pylist(), k, seed, bits)
                if not len(text):
                    continue
                doc, place = rows.column("doc_id").to_numpy()[text], rows.column("tag").to_numpy()[text] + pos
                starts = np.r_[0, ends[:-1]]
                size = ends - starts
                step = (np.arange(len(hashes)) - np.repeat(starts, size)).astype(np.uint64)
                key = np.add.reduceat(mix64(_wide(hashes) + step * _BASE), starts) ^ mix64(anchor.view(np.uint64))
                gone, source, there = known.settled(key, doc, place)
                anchor = np.where(gone, mix64(doc.view(np.uint64) * _BASE + place.view(np.uint64)).view(np.int64), anchor)
                offsets = np.r_[0, np.cumsum(np.where(gone, 0, size)) * _HASH].astype(np.int32)
                left = np.ascontiguousarray(hashes[~np.repeat(gone, size)])
                data = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(left.tobytes())])
                shown = [pa.array(x, pa.int64(), mask=~gone) for x in (source, there)]
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(doc), pa.array(place), pa.array(np.where(gone, size, 0).astype(np.int32)), *shown, data], ["anchor", "doc_id", "place", "n", "src", "src_place", "edges"])

    own = docs.where("doc_id is not null and text is not null").select("doc_id", "text", F.expr(_TAG).alias("tag"))
    return own.mapInArrow(run, "anchor long, doc_id long, place long, n int, src long, src_place long, edges binary")


def _wide(hashes: np.ndarray) -> np.ndarray:
    """Rows of _HASH bytes as integers."""
    wide = np.zeros((len(hashes), 8), np.uint8)
    wide[:, :_HASH] = hashes
    return wide.view("<u8").ravel()


def _edges_of(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes in a binary column, as integers, and how many each row has."""
    offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].reshape(-1, _HASH)
    return _wide(raw), np.diff(offsets) // _HASH


def _settle(anchor: np.ndarray, doc: np.ndarray, place: np.ndarray, edges: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Edges that start in a document with a smaller id, among stretches with the same minimisers: doc, place, and those there."""
    row = np.repeat(np.arange(len(n)), n)
    at = place[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    order = np.lexsort((at, doc[row], edges, anchor[row]))
    a, e, d, p = anchor[row][order], edges[order], doc[row][order], at[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (e[1:] != e[:-1])]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    hit = d > d[first]
    return d[hit], p[hit], d[first][hit], p[first][hit]


_SPAN = ("doc_id", "place", "n", "src", "src_place")


def spans(found: DataFrame) -> DataFrame:
    """doc_id, place, n, src and src_place of runs of edges that also start in a document with a smaller id, src."""

    def emit(doc, place, n, src, there) -> pa.RecordBatch:
        cols = [pa.array(doc, pa.int64()), pa.array(place, pa.int64()), pa.array(np.asarray(n, np.int32)), pa.array(src, pa.int64()), pa.array(there, pa.int64())]
        return pa.RecordBatch.from_arrays([*cols, pa.nulls(len(doc), pa.int64()), pa.nulls(len(doc), pa.binary())], [*_SPAN, "anchor", "edges"])

    def leave(part: pa.RecordBatch) -> pa.RecordBatch:
        """Stretches under a minimiser that a task can't hold, for the grouped join."""
        none = pa.nulls(part.num_rows, pa.int64())
        return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("place"), pa.array(np.zeros(part.num_rows, np.int32)), none, none, part.column("anchor"), part.column("edges")], [*_SPAN, "anchor", "edges"])

    def settle(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Branching: minimisers with several distinct stretches in several documents."""
        rows = pa.Table.from_batches(held).combine_chunks()
        anchor = rows.column("anchor").to_numpy()
        if not len(anchor):
            return
        doc, place = rows.column("doc_id").to_numpy(), rows.column("place").to_numpy()
        starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        sizes = np.diff(np.r_[starts, len(anchor)])
        many = np.flatnonzero(np.repeat(np.maximum.reduceat(doc, starts) > np.minimum.reduceat(doc, starts), sizes))
        if len(many):
            edges, n = _edges_of(rows.column("edges").take(pa.array(many)).combine_chunks())
            d, p, src, there = _settle(anchor[many], doc[many], place[many], edges, n)
            if len(d):
                yield emit(d, p, np.ones(len(d)), src, there)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # first stretches under the last minimiser, which is still open
        last = None  # the last stretch read: anchor and edges, and the smallest document with it and its place
        over = None  # a minimiser with more stretches than a task holds
        for batch in batches:
            done = batch.column("n").to_numpy() > 0
            if done.any():
                own = batch.filter(pa.array(done))
                yield emit(*(own.column(c) for c in _SPAN))
                batch = batch.filter(pa.array(~done))
            if not batch.num_rows:
                continue
            anchor, doc, place = (batch.column(c).to_numpy() for c in ("anchor", "doc_id", "place"))
            text = batch.column("edges").to_pylist()
            new = np.r_[True, (anchor[1:] != anchor[:-1]) | np.fromiter((x != y for x, y in zip(text[1:], text)), bool, len(text) - 1)]
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            src, there = doc[first], place[first]
            if last is not None and last[:2] == (anchor[0], text[0]):
                goes_on = slice(0, np.flatnonzero(np.r_[new[1:], True])[0] + 1)
                src[goes_on], there[goes_on] = last[2:]
            last = (anchor[-1], text[-1], src[-1], there[-1])
            again = doc > src
            if again.any():
                rows = np.flatnonzero(again)
                yield emit(doc[rows], place[rows], [len(text[i]) // _HASH for i in rows], src[rows], there[rows])
            batch = batch.filter(pa.array(~again))
            if not batch.num_rows:
                continue
            anchor = batch.column("anchor").to_numpy()
            if over is not None:
                cut = int(np.searchsorted(anchor, over, side="right"))
                if cut:
                    yield leave(batch.slice(0, cut))
                batch, anchor = batch.slice(cut), anchor[cut:]
                if not batch.num_rows:
                    continue
                over = None
            cut = int(np.searchsorted(anchor, anchor[-1]))  # the last minimiser may go on in the next batch
            if cut or (held and held[-1].column("anchor")[-1].as_py() != anchor[-1]):
                yield from settle([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
            if sum(x.num_rows for x in held) > HELD:
                over = anchor[-1]
                yield from map(leave, held)
                held = []
        if held:
            yield from settle(held)

    dealt = found.repartition("anchor").sortWithinPartitions("anchor", "edges", "doc_id", "place")
    out = stored(dealt.mapInArrow(run, "doc_id long, place long, n int, src long, src_place long, anchor long, edges binary"), "substring-spans")
    return out.where("anchor is null").select(*_SPAN).unionByName(_grouped(out.where("anchor is not null")))


def _grouped(open_: DataFrame) -> DataFrame:
    """The same for minimisers with too many distinct stretches: grouped minima of single edges, and a join."""

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        edges, n = _edges_of(rows.column("edges"))
        row = np.repeat(np.arange(len(n)), n)
        at = rows.column("place").to_numpy()[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        take = pa.array(row)
        return pa.RecordBatch.from_arrays([rows.column("anchor").take(take), pa.array(edges.astype(np.int64)), rows.column("doc_id").take(take), pa.array(at)], ["anchor", "edge", "doc_id", "place"])

    each = map_texts(open_.select("anchor", "edges", "doc_id", "place"), run, "anchor long, edge long, doc_id long, place long", "edges")
    first = F.min(F.struct("doc_id", "place"))
    least = each.groupBy("anchor", "edge").agg(first.alias("first"), F.max("doc_id").alias("most"), F.count("*").alias("count")).where("first.doc_id < most")
    least = least.select("anchor", "edge", "count", F.col("first.doc_id").alias("src"), F.col("first.place").alias("src_place"))
    return join_heavy(each, least, ["anchor", "edge"], "count").where("doc_id > src").select("doc_id", "place", F.lit(1).alias("n"), "src", "src_place")


def paths(found: DataFrame) -> DataFrame:
    """Runs put together: those that follow one another in their document and in the one they repeat are one path.

    One sort by document. Repeated rows give their runs twice, which count once.
    """
    w = Window.partitionBy("doc_id", F.shiftright("place", 32)).orderBy("place", "n", "src", "src_place")
    before = lambda c: F.lag(c).over(w)
    same = (before("src") == F.col("src")) & (F.col("place") - before("place") == F.col("src_place") - before("src_place"))
    marked_ = found.select("*", F.coalesce(same & (F.col("place") == before("place") + before("n")), F.lit(False)).alias("on"), F.coalesce(same & (F.col("place") == before("place")) & (F.col("n") == before("n")), F.lit(False)).alias("twice"))
    runs = marked_.where("not twice").withColumn("path", F.sum((~F.col("on")).cast("long")).over(w))
    out = runs.groupBy("doc_id", F.shiftright("place", 32).alias("tag"), "path").agg(F.min("place").alias("place"), F.sum("n").cast("int").alias("n"), F.min("src").alias("src"), F.min("src_place").alias("src_place"))
    return out.select(*_SPAN)


def _own(docs: DataFrame) -> DataFrame:
    """doc_id, text, the text's tag and a hash of both."""
    return docs.select("doc_id", "text", F.expr(_TAG).alias("tag")).withColumn("row", F.xxhash64("doc_id", "tag"))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def _digest(words: list[bytes], at: int, n: int, k: int) -> bytes:
    """Of the words of n edges, which are joined by single spaces: no other words give the same bytes."""
    return hashlib.blake2b(b" ".join(words[at : at + n + k - 1]), digest_size=16).digest()


def digests(docs: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The paths with the digest of the words at their source coordinates.

    Only documents that are a source of a path are moved. A source that many documents repeat is asked once for each place.
    """
    asked = found.groupBy("src", "src_place", "n").agg(F.count("*").alias("count"))
    by = asked.groupBy(F.col("src").alias("__src"), F.expr(f"src_place & ~{_AT}").alias("__tag")).agg(F.collect_list(F.struct(F.expr(f"int(src_place & {_AT})").alias("at"), "n")).alias("asked"))
    by = stored(by.withColumn("row", F.xxhash64("__src", "__tag")), "substring-sources")
    own = marked(_own(docs), "row", by).where("may").dropDuplicates(["doc_id", "tag"])
    both = own.join(by.drop("row").hint("merge"), (own["doc_id"] == by["__src"]) & (own["tag"] == by["__tag"]))

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {c: [] for c in ("src", "src_place", "n", "digest")}
        for doc, tag, text, asked in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "tag", "text", "asked"))):
            words = _words(text)
            for x in asked:
                for c, v in zip(out, (doc, tag + x["at"], x["n"], _digest(words, x["at"], x["n"], k))):
                    out[c].append(v)
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], list(out))

    said = map_texts(both.select("doc_id", "tag", "text", "asked"), run, "src long, src_place long, n int, digest binary")
    said = stored(said.join(asked.hint("merge"), ["src", "src_place", "n"]), "substring-digests")
    return join_heavy(found, said, ["src", "src_place", "n"], "count")


def _edge_hashes(words: list[bytes], k: int) -> np.ndarray:
    """A 64-bit hash of each run of k words."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    return _rolling(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), k)


def _bits(hashes: DataFrame) -> np.ndarray:
    """The hashes' first 27 bits as one map of 16 MB, whatever their number."""
    at = F.shiftrightunsigned("hash", 37)
    maps = hashes.groupBy(F.shiftright(at, 15).cast("int").alias("part")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("map"))
    out = np.zeros((1 << 12, 1 << 12), np.uint8)
    for r in maps.collect():  # 4,096 rows of 4 KB at most
        out[r["part"]] = np.frombuffer(r["map"], np.uint8)
    return out.ravel()


def settled(docs: DataFrame, wrong: DataFrame, k: int) -> DataFrame:
    """doc_id, place, n (1) and digest of edges that also start in a smaller document, among those of rejected paths.

    ``wrong`` has doc_id, text and the rejected paths' places in it (wrong: at and n). All documents are read once more; of
    their edges those go on whose hash may be a rejected one, and are grouped by their words' digest. What that lets
    through beside them is judged by its words too, so it does no harm.
    """

    def asked(rows: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, paths_ in zip(rows.column("text").to_pylist(), rows.column("wrong").to_pylist()):
            hashes = _edge_hashes(_words(text), k)
            out += [hashes[x["at"] : x["at"] + x["n"]] for x in paths_]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64))], ["hash"])

    said = docs.sparkSession.sparkContext.broadcast(_bits(map_texts(wrong, asked, "hash long")))

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        doc, place, digest = [], [], []
        for i, tag, text in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "tag", "text"))):
            words = _words(text)
            at = _edge_hashes(words, k) >> np.uint64(37)
            hit = np.flatnonzero(said.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).tolist()
            doc += [i] * len(hit)
            place += [tag + x for x in hit]
            digest += [_digest(words, x, 1, k) for x in hit]
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(place, pa.int64()), pa.array(digest, pa.binary())], ["doc_id", "place", "digest"])

    own = _own(docs).where("doc_id is not null and text is not null").select("doc_id", "tag", "text")
    seen = stored(map_texts(own, run, "doc_id long, place long, digest binary"), "substring-seen")
    least = seen.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("count")).where("least < most")
    return join_heavy(seen, least.drop("most"), ["digest"], "count").where("doc_id > least").select("doc_id", "place", F.lit(1).alias("n"), "digest")


def _cut(own: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The columns of ``cut_repeats`` for the rows of ``own``, with their text's tag and hash, and the paths (wrong: at and
    n) whose words are not those of their digest, which cut nothing."""
    cuts = found.groupBy(F.col("doc_id").alias("__doc"), F.expr(f"place & ~{_AT}").alias("__tag"))
    cuts = cuts.agg(F.collect_list(F.struct(F.expr(f"int(place & {_AT})").alias("at"), "n", "digest")).alias("cuts"))
    own = marked(own, "row", found.select(F.xxhash64("doc_id", F.expr(f"place & ~{_AT}")).alias("row")))
    hit = own.where("may")  # the others aren't moved
    hit = hit.join(cuts.hint("merge"), (hit["doc_id"] == cuts["__doc"]) & (hit["tag"] == cuts["__tag"]), "left").select("doc_id", "tag", "row", "text", "cuts")
    rest = own.where("not may").select("doc_id", "tag", "row", "text", F.lit(None).cast(cuts.schema["cuts"].dataType).alias("cuts"))
    paths_ = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        words_n, removed_n, kept, wrong = [], [], [], []
        for text, cuts in zip(rows.column("text").to_pylist(), rows.column("cuts").to_pylist()):
            words = _words(text)
            total, rejected = len(words), []
            if cuts:
                edge = np.zeros(total + 1, np.int64)
                for x in cuts:
                    if _digest(words, x["at"], x["n"], k) == x["digest"]:
                        edge[x["at"]] += 1
                        edge[x["at"] + x["n"] + k - 1] -= 1
                    else:
                        rejected.append({"at": x["at"], "n": x["n"]})
                words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
            words_n.append(total)
            removed_n.append(total - len(words))
            kept.append(b" ".join(words).decode("utf-8", "replace"))
            wrong.append(rejected or None)
        own_ = [rows.column(c) for c in ("doc_id", "tag", "row")]
        return pa.RecordBatch.from_arrays([*own_, pa.array(words_n, pa.int64()), pa.array(removed_n, pa.int64()), pa.array(kept, pa.string()), pa.array(wrong, paths_)], ["doc_id", "tag", "row", "n_words", "n_removed", "kept", "wrong"])

    return map_texts(hit.unionByName(rest), run, "doc_id long, tag long, row long, n_words long, n_removed long, kept string, wrong array<struct<at: int, n: int>>")


def cut_repeats(docs: DataFrame, k: int = 13, seed: int = 0, bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by single spaces) of every row.

    A word goes if a run of ``k`` words (1 or more) that covers it also starts in a document with a smaller doc_id; runs are
    judged on the input. Words are unchanged; null, empty and wordless texts have none, and texts of fewer than k words lose
    none. Rows with a null doc_id are kept whole and are no source. A repeated row (same doc_id and text) is cut like the
    first; of rows that share a doc_id with different texts each is cut by itself, and none for the sake of another. A
    document does not lose what repeats only within it. Other columns are not read.

    Different runs of words that share their hashes are told apart by their words: only then are all texts read once more,
    and the rows that this concerns cut again. ``bits`` of a word's hash are used (fewer are for tests).
    """
    if k < 1:
        raise ValueError("a run has one word or more")
    found = stored(paths(spans(stretches(docs, k, seed, bits))), "substring-paths")
    told = digests(docs, found, k).select("doc_id", "place", "n", "digest")
    own = _own(docs)
    out = stored(_cut(own, told, k), "substring-kept")
    shown = ["doc_id", "n_words", "n_removed", "kept"]
    wrong = out.where("wrong is not null").select("doc_id", "tag", "row", "wrong")
    if wrong.isEmpty():
        return out.select(shown)
    asked = wrong.select(F.col("doc_id").alias("__doc"), F.col("tag").alias("__tag"), "wrong").dropDuplicates(["__doc", "__tag"])
    with_text = marked(own, "row", wrong).where("may")
    with_text = with_text.join(asked.hint("merge"), (with_text["doc_id"] == asked["__doc"]) & (with_text["tag"] == asked["__tag"])).select("text", "wrong")
    more = stored(settled(docs, with_text, k), "substring-settled")
    anew = more.select(F.xxhash64("doc_id", F.expr(f"place & ~{_AT}")).alias("row"))
    mended = _cut(marked(own, "row", anew).where("may").select(own.columns), told.unionByName(more), k)
    return marked(out, "row", anew).where("not may").select(shown).unionByName(mended.select(shown))
