"""Token counts that follow edits.

A document's pre-tokens (the units that BPE merges within) are the leaves of a segment tree, whose nodes hold the sums of
characters and of tokens below them. :func:`trees` adds a document's leaves to its row, so they can be stored and edited
later without encoding the text again. :func:`apply_edits` finds the leaves that an edit touches by the sums of
characters, cuts and encodes again from the last leaf that the edit can't reach up to the first old border behind it where
cutting falls into step again, and updates the sums above. What lies outside is not encoded. The leaves are what is stored; the sums
above them are formed again, by slices, for each row that is edited.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import chain
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import map_texts
from quantloom.llm.packing import Encoder, encoder


class CountTree:
    """Segment tree over one text's leaves: characters and tokens. An edit may leave several pre-tokens in one leaf."""

    def __init__(self, text: str, lengths: np.ndarray, tokens: np.ndarray, enc: Encoder):
        self.text, self._enc, self.leaves = text, enc, len(lengths)
        self.size = size = 1 << max(0, len(lengths) - 1).bit_length()
        self.sums = np.zeros((2, 2 * size), np.int64)
        self.sums[0, size : size + len(lengths)], self.sums[1, size : size + len(lengths)] = lengths, tokens
        while size > 1:
            half = size // 2
            self.sums[:, half:size] = self.sums[:, size : 2 * size : 2] + self.sums[:, size + 1 : 2 * size : 2]
            size = half
        self.reencoded = self.touched = 0  # pre-tokens encoded again; nodes that the last edit wrote

    @classmethod
    def of(cls, text: str, enc: Encoder) -> CountTree:
        own = enc.pretokens(text)
        return cls(text, np.array([len(x) for x in own], np.int64), np.array(enc.counts(own), np.int64), enc)

    @property
    def total(self) -> int:
        return int(self.sums[1, 1])

    def stored(self) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and tokens of the leaves that hold text."""
        own = self.sums[:, self.size : self.size + self.leaves]
        return tuple(own[:, own[0] > 0])

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at``, and where it begins; beyond the end, the number of leaves."""
        if at >= self.sums[0, 1]:
            return self.leaves, int(self.sums[0, 1])
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if at - before >= self.sums[0, i]:
                before += int(self.sums[0, i])
                i += 1
        return i - self.size, before

    def _set(self, leaves: np.ndarray, values: np.ndarray) -> None:
        """New values of some leaves, and the sums above them: of each level only the nodes above a changed leaf."""
        at = self.size + leaves
        self.sums[:, at] = values
        self.touched = len(at)
        while len(at) and at[0] > 1:
            at = at >> 1
            at = at[np.r_[True, at[1:] != at[:-1]]]  # the leaves are in order
            self.sums[:, at] = self.sums[:, 2 * at] + self.sums[:, 2 * at + 1]
            self.touched += len(at)

    def _finder(self, asked: int):
        """How to find the leaf of a character: by the tree, or, for many, by the borders of all leaves."""
        if asked * self.size.bit_length() < self.leaves // 8:
            return self._leaf
        borders = np.cumsum(self.sums[0, self.size : self.size + self.leaves]).tolist()
        end = borders[-1] if borders else 0

        def find(at: int) -> tuple[int, int]:
            if at >= end:
                return self.leaves, end
            leaf = bisect_right(borders, at)
            return leaf, borders[leaf - 1] if leaf else 0

        return find

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Apply edits (start, end, replacement) at positions of the text as it is now.

        Positions beyond the text are moved to its ends. Of edits that overlap, the later start loses what is gone.
        """
        todo, done, parts, size = [], 0, [], len(self.text)
        for a, b, new in sorted(edits, key=itemgetter(0, 1)):
            a = min(max(a, done), size)
            b = min(max(a, b), size)
            parts += (self.text[done:a], new)
            todo.append((a, b, len(new) - (b - a)))
            done = b
        text = "".join(parts) + self.text[done:]
        find, specials, context = self._finder(len(todo)), self._enc.special_spans(text), self._enc.context
        cut, least, most, chars, cuts = self._enc.cuts_from, [], [], [], []  # the changes are of the old leaves
        flat: list[str] = []
        shift, k, end, more = 0, 0, int(self.sums[0, 1]), len(todo)  # characters that earlier regions have added
        while k < more:
            first, at = find(max(todo[k][0] - context, 0))
            if first >= self.leaves > 0:
                first, at = self.leaves - 1, end - int(self.sums[0, self.size + self.leaves - 1])
            start = here = at + shift
            last, (_, b, added) = self.leaves, todo[k]
            moved, k = shift + added, k + 1
            for x in cut(text, here, specials):
                flat.append(text[here:x])
                here = x
                while k < more and here - moved + context > todo[k][0]:  # the next edit is of this region
                    b, moved, k = todo[k][1], moved + todo[k][2], k + 1
                if here - moved >= b:
                    leaf, begin = find(here - moved)
                    if begin == here - moved and leaf > first:
                        last = leaf
                        break
            else:  # the text's end: edits behind it have nothing left to cut
                moved += sum(x[2] for x in todo[k:])
                k = more
            least.append(first)
            most.append(last)
            chars.append(here - start)
            cuts.append(len(flat))
            shift = moved
        if not self.leaves:
            self.leaves = 1
        self.reencoded += len(flat)
        if least:
            before = np.r_[0, np.cumsum(np.array(self._enc.counts(flat), np.int64))][[0, *cuts]]
            first = np.array(least, np.int64)
            n = np.maximum(np.array(most, np.int64) - first, 1)  # a region's first leaf takes all of it, the others are emptied
            starts = np.cumsum(n) - n
            values = np.zeros((2, int(n.sum())), np.int64)
            values[:, starts] = chars, np.diff(before)
            self._set(np.repeat(first - starts, n) + np.arange(values.shape[1]), values)
        self.text = text


def trees(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """The rows of ``docs`` (any columns, with text) and lengths, tokens (of its pre-tokens, in order) and n_tokens.

    Null and empty texts have no leaves and no tokens. Repeated rows get theirs each. Columns of these names are replaced.
    """
    docs = docs.drop("lengths", "tokens", "n_tokens")

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(tokenizer)
        own = [enc.pretokens(x or "") for x in rows.column("text").to_pylist()]
        flat, ends = list(chain.from_iterable(own)), np.cumsum([0, *map(len, own)])
        tokens, offsets = np.array(enc.counts(flat), np.int32), pa.array(ends, pa.int32())
        lengths = np.fromiter(map(len, flat), np.int32, len(flat))
        total = np.r_[0, np.cumsum(tokens, dtype=np.int64)][ends]
        lists = [*(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (lengths, tokens)), pa.array(np.diff(total))]
        return pa.RecordBatch.from_arrays([*rows.columns, *lists], [*rows.schema.names, "lengths", "tokens", "n_tokens"])

    return map_texts(docs, run, _ddl(docs) + "lengths array<int>, tokens array<int>, n_tokens long")


def apply_edits(trees_: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """The rows of :func:`trees` after their ``edits``: text, lengths, tokens and n_tokens follow, edits are null.

    ``edits`` is an array of (start, end, replacement) in code points of the text; null edits are none, a null text is empty,
    a null replacement too. n_tokens_before is the count before them and n_reencoded how many pre-tokens were cut
    and encoded for them: nothing else of the text is encoded. Columns of these two names are replaced.
    """
    trees_ = trees_.drop("n_tokens_before", "n_reencoded")
    names = trees_.columns

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(tokenizer)
        edits = {i: own for i, own in enumerate(rows.column("edits").to_pylist()) if own}
        again = np.zeros(rows.num_rows, np.int64)
        out = {x: rows.column(x) for x in names} | {"edits": pa.nulls(rows.num_rows, rows.schema.field("edits").type)}
        new: dict[str, list] = {x: [] for x in ("text", "lengths", "tokens", "n_tokens")}
        for i, own in edits.items():
            text, lengths, tokens = (rows.column(x)[i] for x in ("text", "lengths", "tokens"))
            tree = CountTree(text.as_py() or "", lengths.values.to_numpy(), tokens.values.to_numpy(), enc)
            tree.edit([(e["start"], e["end"], e["replacement"] or "") for e in own])
            again[i] = tree.reencoded
            for x, v in zip(new, (tree.text, *tree.stored(), tree.total)):
                new[x].append(v)
        if edits:  # the edited rows behind the others, then each in its place
            at = np.arange(rows.num_rows)
            at[list(edits)] = rows.num_rows + np.arange(len(edits))
            for x, v in new.items():
                out[x] = pa.concat_arrays([out[x], pa.array(v, out[x].type)]).take(pa.array(at))
        return pa.RecordBatch.from_arrays([*out.values(), rows.column("n_tokens"), pa.array(again)], [*out, "n_tokens_before", "n_reencoded"])

    return map_texts(trees_, run, _ddl(trees_) + "n_tokens_before long, n_reencoded long")


def _ddl(df: DataFrame) -> str:
    return "".join(f"`{x.name}` {x.dataType.simpleString()}, " for x in df.schema)


#: Personal data that the edits of :func:`with_masks` replace: what follows the at sign, and numbers of nine digits or more.
_MAIL, _LOCAL = re.compile(r"@[\w-]+(?:\.[\w-]+)+"), re.compile(r"[\w.+-]")
_NUMBER = re.compile(r"\+?\(?\d(?:[ ()-]{0,2}\d){8,}")
_EDITS = "array<struct<start:int,end:int,replacement:string>>"


def masks(text: str) -> list[dict]:
    """Edits that mask e-mail addresses and long numbers, in order, without overlaps; linear in the text."""
    found, at = [], text.find("@")
    while at >= 0:
        start, done = at, found[-1][1] if found else 0
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _MAIL.match(text, at) if start < at else None
        if m:
            found.append((start, m.end(), "<email>"))
        at = text.find("@", m.end() if m else at + 1)
    found += [(*m.span(), "<number>") for m in _NUMBER.finditer(text)]
    out, end = [], 0
    for a, b, new in sorted(found):
        if a >= end:
            out.append({"start": a, "end": b, "replacement": new})
            end = b
    return out


def with_masks(docs: DataFrame) -> DataFrame:
    """doc_id, text and edits that mask e-mail addresses and long numbers; null and empty texts have no edits."""
    edits = F.pandas_udf(lambda text: pd.Series([masks(x or "") for x in text]), _EDITS)
    return docs.select("doc_id", "text", edits("text").alias("edits"))


def counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited, n_leaves and n_reencoded of every row of doc_id, text and edits.

    A row's tree is built once and its edits are applied to it, as :func:`apply_edits` says. n_leaves is that of the tree
    before them. Repeated rows are counted each by itself. An empty text has no tokens and no leaves.
    """
    own = trees(docs.select("doc_id", "text", "edits"), tokenizer).withColumn("n_leaves", F.size("lengths").cast("long"))
    return apply_edits(own, tokenizer).select("doc_id", F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), "n_leaves", "n_reencoded")
