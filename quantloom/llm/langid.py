"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order byte context tree (contexts of 0 to 3 bytes, text in ASCII lower case), held as
counts of byte strings of length 1 to 4. With frozen statistics the code length of a byte after its context is fixed:

    p_k(b | c) = n(cb) / (n(c) + u(c))                     where cb was seen,
               = u(c) / (n(c) + u(c)) * p_{k-1}(b | c')    otherwise (c' drops the oldest byte),
    p_{-1}     = 1 / 256

with n the count and u the number of distinct bytes that followed c (escape method C). A text's code length in a
language is the sum over its bytes; the shortest code wins. As a length depends on four bytes only, lengths of byte
quadruples are tabulated for the commonest byte pairs, and worked out from the tree for the rest; both are exact.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import map_texts

#: Byte pairs with a place in the table of quadruples (PAIRS ** 2 rows of one float a language), and the most bytes of the
#: table, which goes to every task: with many languages fewer pairs have a place. The tree answers for the rest.
PAIRS, TABLE_BYTES = 1000, 64_000_000
_LETTER = re.compile(r"[^\W\d_]")


def _codes(data: np.ndarray, order: int) -> np.ndarray:
    """Big-endian integers of each run of ``order`` bytes, by its last byte (the first order - 1 have none)."""
    out = np.zeros(len(data) - order + 1, np.uint32)
    for k in range(order):
        out = (out << np.uint32(8)) | data[k : len(data) - order + 1 + k].astype(np.uint32)
    return out


def _bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' lower-cased bytes, each after three line feeds that give the first bytes a context; and the ends."""
    rows = [b"\n\n\n" + x.encode("utf-8", "replace").lower() for x in texts]
    return np.frombuffer(b"".join(rows), np.uint8), np.cumsum([len(x) for x in rows])


class Ppm:
    """Frozen byte statistics of several languages."""

    def __init__(self, grams: dict[str, list[tuple[int, int]] | np.ndarray], pairs: int = PAIRS):
        """grams: by language, (quadruple of bytes, count) pairs."""
        self.langs = sorted(grams)
        rows = {x: np.asarray(grams[x], np.int64).reshape(-1, 2) for x in self.langs}
        self._trees = [self._tree(rows[x]) for x in self.langs]
        total = np.zeros(1 << 16, np.int64)
        for own in rows.values():
            np.add.at(total, own[:, 0] & 0xFFFF, own[:, 1])
        most = min(pairs, int((TABLE_BYTES / 4 / max(1, len(self.langs))) ** 0.5))
        common = [x for x in np.argsort(-total, kind="stable")[:most].tolist() if total[x]]
        self._pair = np.full(1 << 16, -1, np.int32)
        self._pair[common] = np.arange(len(common))
        self._n = len(common)
        at = np.array(common, np.uint32)
        table = np.zeros((self._n, self._n, len(self.langs)), np.float32)
        for k in range(0, self._n, 50):
            quad = (at[k : k + 50, None] << np.uint32(16)) | at[None, :]
            table[k : k + 50] = self.lengths(quad.ravel()).reshape(-1, self._n, len(self.langs))
        self._table = table.reshape(self._n * self._n, len(self.langs))

    @staticmethod
    def _tree(rows: np.ndarray) -> list[tuple]:
        """For each order 0..3: sorted strings with counts, and sorted contexts with totals and distinct successors."""
        out = []
        for order in range(4):
            codes = rows[:, 0] & ((1 << 8 * (order + 1)) - 1)
            strings, inverse = np.unique(codes, return_inverse=True)
            n = np.bincount(inverse, weights=rows[:, 1], minlength=len(strings))
            contexts, inverse = np.unique(strings >> 8, return_inverse=True)
            out.append((strings, n, contexts, np.bincount(inverse, weights=n, minlength=len(contexts)), np.bincount(inverse, minlength=len(contexts))))
        return out

    def lengths(self, quads: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each quadruple after the other three, by language."""
        out = np.empty((len(quads), len(self.langs)), np.float32)
        q = quads.astype(np.int64)
        for j, tree in enumerate(self._trees):
            p = np.full(len(q), 1 / 256)
            for order, (strings, n, contexts, totals, distinct) in enumerate(tree):
                code = q & ((1 << 8 * (order + 1)) - 1)
                if not len(strings):
                    continue
                c = np.minimum(np.searchsorted(contexts, code >> 8), len(contexts) - 1)
                known = contexts[c] == code >> 8
                s = np.minimum(np.searchsorted(strings, code), len(strings) - 1)
                seen = strings[s] == code
                all_ = totals[c] + distinct[c]
                p = np.where(~known, p, np.where(seen, n[s] / all_, distinct[c] / all_ * p))
            out[:, j] = -np.log2(p)
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        """Code lengths in bits, a row a text and a column a language."""
        data, ends = _bytes(texts)
        quads_at = np.arange(3, len(data))
        pair = self._pair[_codes(data, 2)]  # of bytes i, i + 1
        hi, lo = pair[quads_at - 3], pair[quads_at - 1]
        index = hi.astype(np.int64) * self._n + lo
        rare = np.flatnonzero((hi < 0) | (lo < 0))
        index[rare] = 0
        bits = self._table[index] if self._n else np.zeros((len(index), len(self.langs)), np.float32)
        if len(rare):
            codes, inverse = np.unique(_codes(data, 4)[rare], return_inverse=True)
            bits[rare] = self.lengths(codes)[inverse]
        starts = np.concatenate([[0], ends[:-1]])
        out = np.zeros((len(texts), len(self.langs)))
        for j in range(len(self.langs)):
            total = np.concatenate([[0.0], np.cumsum(bits[:, j], dtype=np.float64)])
            out[:, j] = total[ends - 3] - total[starts]
        return out


def fit(docs: DataFrame, max_docs: int = 1000) -> Ppm:
    """Context trees from documents with text and lang.

    The fit reads at most about ``max_docs`` documents of each language, chosen by a hash of doc_id and text, and whole texts
    of those. That is a bound of the fit alone: every text is scored whole. Their quadruples are summed in Spark, and
    all of them make the trees; no more of them than the sample has bytes can reach the driver. A row that repeats
    is drawn with its copies or not at all. Rows with a null text or lang are not learned from.
    """
    known = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    sizes = known.groupBy("lang").agg(F.count("*").alias("__n"))  # one row a language
    turn = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit("sample")), 11) / F.lit(float(1 << 53))
    sample = known.join(F.broadcast(sizes), "lang").where(turn < F.lit(max_docs) / F.col("__n")).drop("__n")

    def count(rows: pa.RecordBatch) -> pa.RecordBatch:
        by: dict[str, list[str]] = {}
        for text, lang in zip(rows.column("text").to_pylist(), rows.column("lang").to_pylist()):
            by.setdefault(lang, []).append(text)
        langs, codes, counts = [], [], []
        for lang, texts in by.items():
            data, ends = _bytes(texts)
            quads = _codes(data, 4)
            inside = np.ones(len(quads), bool)
            for back in (1, 2, 3):  # quadruples that would end in the next text's line feeds
                at = ends[:-1] - 4 + back
                inside[at[(at >= 0) & (at < len(quads))]] = False
            c, n = np.unique(quads[inside], return_counts=True)
            langs += [lang] * len(c)
            codes.append(c)
            counts.append(n)
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(codes or [[]]).astype(np.int64)), pa.array(np.concatenate(counts or [[]]).astype(np.int64))], ["lang", "code", "n"])

    grams = map_texts(sample, count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    lang = grams.column("lang").to_pandas().astype("category")
    rows = np.c_[grams.column("code").to_numpy(), grams.column("n").to_numpy()]
    return Ppm({x: rows[(lang == x).to_numpy()] for x in lang.cat.categories})


def _answers(ppm: Ppm, texts: list[str | None], sharpness: float) -> tuple[list[str], list[float]]:
    texts = [x or "" for x in texts]
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    if ppm.langs and texts:
        bits = ppm.score(texts)
        best = bits.argmin(axis=1)
        odds = np.exp(-(bits - bits.min(axis=1, keepdims=True)) * (np.log(2) * sharpness))
        p = 1 / odds.sum(axis=1)
        for i, x in enumerate(texts):
            if _LETTER.search(x):
                lang[i], score[i] = ppm.langs[best[i]], float(p[i])
    return lang, score


def predict(docs: DataFrame, model: Ppm, sharpness: float = 0.2) -> DataFrame:
    """doc_id, lang_pred and score of every row.

    ``score`` is the softmax of the negative code lengths in nats, damped by ``sharpness`` for that neighbouring bytes
    are not independent. Null texts, and texts without a letter, are ``und`` with score 0; so is every text where
    nothing was learned. Repeated rows get the same answer each; ties go to the language that sorts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = _answers(shared.value, rows.column("text").to_pylist(), sharpness)
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(lang), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: Ppm, least: float = 0.5, sharpness: float = 0.2) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is known with a score of ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        score = _answers(shared.value, rows.column("text").to_pylist(), sharpness)[1]
        return rows.filter(pa.array([x >= least for x in score], pa.bool_()))

    return map_texts(docs, run, docs.schema)
