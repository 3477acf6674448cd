"""Packing by concatenate and cut.

Two passes over prefix sums: the first encodes each document once, stores its ids and the running token count within
its partition; the totals of the partitions (two numbers each) give each partition's global base. The second is a pure
map: a document's place in the corpus-wide id stream is base + running count, and the stream is cut every ``window`` ids.
A document that crosses a cut gives one boundary record per piece. No row is sorted or grouped for this, so neither
a hot source nor a very long document gathers rows in one task.
"""

from __future__ import annotations

import base64
import json
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import map_texts, stored, text_slices

#: A worker's cache of pieces of text is emptied beyond so many entries.
CACHE_PIECES = 250_000
_UNSAFE = re.compile(r"\s[ \n]")
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Byte-level BPE ids of whole texts, as packed unsigned 16-bit numbers, with a cache of space-delimited pieces.

    No pre-token of the vocabulary's pattern spans a place between a character that isn't white space and white space
    after it, so a text may be cut there and its pieces encoded on their own. Where white space follows white space
    the text is encoded in one go. The spellings of ``specials`` in a text are those ids; what stands between is encoded apart.
    """

    def __init__(self, ranks_path: str, pattern: str, specials: dict[str, int]):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if max((*ranks.values(), *specials.values())) >= 1 << 16:
            raise ValueError("ids are kept in 16 bits; the vocabulary has more")
        self._encode = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._cache: dict[str, bytes] = {}
        self._counts: dict[str, int] = {}
        self._pattern = regex.compile(pattern)
        self._specials = specials
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        #: A pre-token can depend on so many characters after its end.
        self.context = 2 + max(map(len, specials), default=0)

    def _ids(self, piece: str) -> bytes:
        return array("H", self._encode(piece)).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian unsigned 16-bit numbers."""
        if self._special is None or not self._special.search(text):
            return self._plain(text)
        parts = self._special.split(text)
        return b"".join([array("H", [self._specials[x]]).tobytes() if k % 2 else self._plain(x) for k, x in enumerate(parts)])

    def _plain(self, text: str) -> bytes:
        if _UNSAFE.search(text):
            return self._ids(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        cache = self._cache
        try:
            return self._ids(first) + b"".join([cache[x] for x in rest])
        except KeyError:
            if len(cache) > CACHE_PIECES:
                cache.clear()
            for x in set(rest).difference(cache):
                cache[x] = self._ids(x if x.startswith("\n") else " " + x)
            return self._ids(first) + b"".join([cache[x] for x in rest])

    def pretokens(self, text: str) -> list[str]:
        """The text cut into pre-tokens (the unit that BPE merges within) and specials."""
        if self._special is None or not self._special.search(text):
            return self._pattern.findall(text)
        return [y for k, x in enumerate(self._special.split(text)) for y in ([x] if k % 2 else self._pattern.findall(x))]

    def special_spans(self, text: str) -> list[tuple[int, int]]:
        """Where the special tokens of a text stand, in order."""
        return [m.span() for m in self._special.finditer(text)] if self._special else []

    def cuts_from(self, text: str, at: int, specials: list[tuple[int, int]]) -> Iterator[int]:
        """Where the pre-tokens end, one by one, from a pre-token's beginning on; ``specials`` are the text's :meth:`special_spans`."""
        k = bisect_left(specials, (at, 0)) if specials else 0
        while at < len(text):
            start, end = specials[k] if k < len(specials) else (len(text), len(text))
            for m in self._pattern.finditer(text, at, start):
                yield m.end()
            if end > start:
                yield end
            at, k = end, k + 1

    def counts(self, pretokens: list[str]) -> list[int]:
        """How many ids each pre-token has."""
        known = self._counts
        try:
            return [known[x] for x in pretokens]
        except KeyError:
            if len(known) > CACHE_PIECES:
                known.clear()
            for x in set(pretokens).difference(known):
                known[x] = 1 if x in self._specials else len(self._encode(x))
            return [known[x] for x in pretokens]


def encoder(tokenizer: str) -> Encoder:
    """The worker's encoder for a vocabulary file of the public tokenizers.

    ``name.json`` and ``name.tiktoken`` are one vocabulary; only the first names special tokens, which are found in texts.
    """
    if tokenizer not in _encoders:
        import public_tokenizers as P

        specials = {}
        if tokenizer.endswith(".json"):
            with open(P.path(tokenizer), encoding="utf-8") as file:
                specials = {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}
        _encoders[tokenizer] = Encoder(P.path(tokenizer.removesuffix(".json") + ".tiktoken"), P.PATTERN, specials)
    return _encoders[tokenizer]


def encoded(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """First pass: part, before (ids ahead within the part), doc_id, n, ids (16-bit little-endian, with the end id).

    Null and empty texts have the end id alone; repeated rows, and rows with a null doc_id, are encoded each by itself.
    """
    end = int(end_id).to_bytes(2, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in text_slices(batch, "text"):
                ids = [enc.encode(x or "") + end for x in rows.column("text").to_pylist()]
                n = np.array([len(x) // 2 for x in ids], np.int64)
                at = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), pa.array(at), rows.column("doc_id"), pa.array(n), pa.array(ids, pa.binary())],
                    ["part", "before", "doc_id", "n", "ids"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "part int, before long, doc_id long, n long, ids binary")


def pack(docs: DataFrame, window: int = 1024, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """Pack whole documents into sequences of ``window`` ids; one row per piece.

    Returns doc_id, start, length, doc_tokens, sequence_id, offset and ids (binary, unsigned 32-bit little-endian).
    Every id lies in exactly one piece; only the last sequence of the corpus is not full (its reader pads it).
    Null and empty texts are the end id alone. Repeated rows, and rows with a null doc_id, are packed each by itself.
    An empty table gives no rows. Other columns of ``docs`` are not read.
    """
    table = stored(encoded(docs, tokenizer, end_id), "packing")
    totals = table.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("total"))  # a row for each partition of the input
    ahead = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    table = table.join(F.broadcast(totals.select("part", ahead.alias("base"))), "part")

    def cut(rows: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")}
        for at, doc, n, ids in zip(*(rows.column(k).to_pylist() for k in ("at", "doc_id", "n", "ids"))):
            own, start = np.frombuffer(ids, "<u2").astype("<u4"), 0
            while start < n:
                length = min(n - start, window - (at + start) % window)
                for k, v in zip(out, (doc, start, length, n, (at + start) // window, (at + start) % window, own[start : start + length].tobytes())):
                    out[k].append(v)
                start += length
        kinds = [pa.int64()] * 6 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return map_texts(table.select((F.col("base") + F.col("before")).alias("at"), "doc_id", "n", "ids"), cut, schema, "ids")


def digest(pieces: DataFrame) -> DataFrame:
    """The contract's columns of packed pieces: ids as their checksum. One row per row of ``pieces``, nulls in doc_id kept."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
