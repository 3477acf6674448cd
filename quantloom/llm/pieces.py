"""SentencePiece encoding and decoding by a batched Viterbi search.

A text is cut where no piece can span: before a word mark that follows another character, and around line feeds. What is
left between cuts (words, mostly) is encoded apart; distinct words of a batch that the worker hasn't met are grouped by
length, and all words of one length advance through the search together. Hashes of their substrings probe the sorted
hashes of the pieces, and vectorised maxima keep the best score and where its piece began.

For a model of merges (BPE) the lattice has a second condition: two pieces may stand side by side only if merging their
joint text would end in just these two. Merging treats a text's beginning as it would on its own, so each prefix
has exactly one last piece that may follow the piece before it; the path of allowed neighbours is what merging gives.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quantloom.llm.common import map_texts, mix64

MARK = "▁"
#: A worker's cache of encoded words is emptied beyond so many entries; verdicts on neighbours have so many places.
CACHE_WORDS, CACHE_PAIRS = 250_000, 1 << 20
_BASE = np.uint64(0x100000001B3)
_models: dict[str, "Pieces"] = {}


class Pieces:
    """A vocabulary with scores.

    Of a model with ``merges`` a text's pieces are those that merging by falling score, leftmost first, ends with. Of
    another, they are the segmentation with the largest sum of scores; ties go to the longest last piece. A character that no
    piece holds costs ``unknown`` below the smallest score and is written as its bytes.
    """

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: dict[int, int], unknown: float = 10.0, merges: bool = False):
        """pieces: text and score by id, with an empty text for ids that no text maps to."""
        self.kind = np.dtype("<u2" if len(pieces) <= 1 << 16 else "<u4")  # ids as they are kept and returned
        self.table = [x.replace(MARK, " ").encode() for x, _ in pieces]
        for value, i in byte_ids.items():
            self.table[i] = bytes([value])
        self._bytes = byte_ids
        own = [(i, x, s) for i, (x, s) in enumerate(pieces) if x]
        self.longest = max((len(x) for _, x, _ in own), default=1)
        self.cost = min((s for _, _, s in own), default=0.0) - unknown
        self._of = {x: (i, s) for i, x, s in own}
        if any(MARK in x.lstrip(MARK) or (x[:2] == MARK * 2 and x.strip(MARK)) for x in self._of):
            raise ValueError("a piece holds a word mark after another character, or two before one")
        keys = np.array([self._hash(x) for _, x, _ in own], np.uint64)
        order = np.argsort(keys)
        self._keys = keys[order]
        if len(self._keys) and (self._keys[1:] == self._keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        self._ids = np.array([i for i, _, _ in own], np.int64)[order]
        self._scores = np.array([s for _, _, s in own])[order]
        held = {c for x in self._of for c in x}
        self._apart = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if "\n" not in held else f"{MARK}*[^{MARK}]+|{MARK}+")
        self._cache: dict[str, bytes] = {}
        self.merges = merges
        if merges:
            self._learn_merges(own)

    @staticmethod
    def _hash(text: str) -> int:
        out = 0
        for c in text:
            out = (out * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return out

    def _merged(self, text: str, but: str = "") -> list[str]:
        """The pieces that merging gives, by the rule itself (``but`` is no piece); for single pieces and runs of marks."""
        parts = list(text)
        while True:
            best = min(((-self._of[x][1], i) for i, x in enumerate(map("".join, zip(parts, parts[1:]))) if x in self._of and x != but), default=None)
            if best is None:
                return parts
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _learn_merges(self, own: list[tuple[int, str, float]]) -> None:
        """For each piece by id: its turn among the merges (-1: a single character), its last merge's two halves, its hash."""
        n = len(self.table) + 1  # the last place stands for a character of no piece
        rank = {s: k for k, s in enumerate(sorted({s for _, x, s in own if len(x) > 1}, reverse=True))}
        self._turn, self._left, self._right = np.full(n, -1, np.int64), np.arange(n), np.arange(n)
        self._own, self._power = np.zeros(n, np.uint64), np.ones(n, np.uint64)
        self._whole = np.ones(n, bool)
        power = [1]
        for _ in range(self.longest):
            power.append(power[-1] * int(_BASE) & 0xFFFFFFFFFFFFFFFF)
        for i, x, s in own:
            self._own[i], self._power[i] = self._hash(x), power[len(x)]
            if len(x) > 1:
                self._turn[i] = rank[s]
                halves = self._merged(x, but=x) if x.strip(MARK) else []
                self._whole[i] = len(halves) == 2 and all(h in self._of for h in halves)  # other pieces no merging reaches
                if self._whole[i]:
                    self._left[i], self._right[i] = (self._of[h][0] for h in halves)
        self._met, self._verdict = np.full(CACHE_PAIRS, -1, np.int64), np.zeros(CACHE_PAIRS, bool)
        self._mark = self._of.get(MARK, (0, 0.0))[0]

    def _neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece a may stand before piece b; the verdicts met before are looked up."""
        pair = a * (len(self.table) + 1) + b
        at = (mix64(pair.view(np.uint64)) >> np.uint64(44)).astype(np.int64) % CACHE_PAIRS
        new = np.flatnonzero(self._met[at] != pair)
        out = self._verdict[at]
        if len(new):
            fresh, back = np.unique(pair[new], return_inverse=True)
            verdict = self._stand(fresh // (len(self.table) + 1), fresh % (len(self.table) + 1))
            out[new] = verdict[back]
            self._met[at[new]], self._verdict[at[new]] = pair[new], out[new]
            self._met[at[new]] = np.where(self._verdict[at[new]] == out[new], self._met[at[new]], -1)  # two pairs for one place
        return out

    def _stand(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Take the merges of both pieces back, the last first, and look for a merge across the border that came sooner."""
        out, open_ = np.ones(len(a), bool), np.arange(len(a))
        before = np.full(len(a), np.iinfo(np.int64).max)  # a merge across the border of a smaller turn would have come first
        while len(open_):
            key = self._own[a] * self._power[b] + self._own[b]
            at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            across = (self._keys[at] == key) & (self._turn[self._ids[at]] < before)
            out[open_[across]] = False
            undo_a = (self._turn[a] > self._turn[b]) & (self._turn[a] >= 0)
            undo_b = ~undo_a & (self._turn[b] >= 0)
            before = np.where(undo_a, self._turn[a], self._turn[b] + 1)
            a, b = np.where(undo_a, self._right[a], a), np.where(undo_b, self._left[b], b)
            go = ~across & (undo_a | undo_b)
            a, b, before, open_ = a[go], b[go], before[go], open_[go]
        return out

    def _viterbi(self, words: list[str]) -> list[bytes]:
        """Ids (of the model's kind) of words of one length."""
        n, size = len(words), len(words[0])
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, size).astype(np.uint64) + np.uint64(1)
        prefix = np.zeros((n, size + 1), np.uint64)
        for e in range(size):
            prefix[:, e + 1] = prefix[:, e] * _BASE + chars[:, e]
        reach = min(self.longest, size)
        power = np.cumprod(np.r_[np.uint64(1), np.full(reach, _BASE)])
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0.0
        begin, piece = np.zeros((n, size + 1), np.int64), np.full((n, size + 1), -1, np.int64)
        rows = np.arange(n)
        for e in range(1, size + 1):
            s = np.arange(max(0, e - reach), e)  # where the last piece may begin: the longest first
            key = prefix[:, e, None] - prefix[:, s] * power[e - s]
            at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            known = self._keys[at] == key
            which = np.where(known, self._ids[at], -1)
            score = np.where(known, best[:, s] + self._scores[at], -np.inf)
            alone = ~known[:, -1]  # a character of no piece
            score[alone, -1] = best[alone, e - 1] + self.cost
            if self.merges:
                w, k = np.nonzero(known & np.isfinite(score))
                allowed = self._whole[which[w, k]]
                inner = allowed & (s[k] > 0)
                w_, k_ = w[inner], k[inner]
                before = piece[w_, s[k_]]
                allowed[inner] = (before < 0) | self._neighbours(before % (len(self.table) + 1), which[w_, k_])  # nothing merges with a character of no piece
                score[w[~allowed], k[~allowed]] = -np.inf
            top = score.argmax(axis=1)
            best[:, e], begin[:, e], piece[:, e] = score[rows, top], s[top], which[rows, top]
        ids, at, count = np.zeros((n, size), self.kind), np.full(n, size), np.zeros(n, np.int64)
        for column in range(size - 1, -1, -1):  # pieces from the last to the first, words side by side
            open_ = at > 0
            if not open_.any():
                break
            ids[open_, column] = np.maximum(piece[rows[open_], at[open_]], 0)
            count += open_
            at = np.where(open_, begin[rows, at], 0)
        raw, out, width = ids.tobytes(), [], self.kind.itemsize
        for i, c in enumerate(count.tolist()):
            out.append(raw[width * (size * (i + 1) - c) : width * size * (i + 1)])
        for i in np.flatnonzero((piece[:, 1:] < 0).any(axis=1)):  # a character of no piece may be on the path
            e, parts = size, []
            while e:
                s = begin[i, e]
                parts.append([piece[i, e]] if piece[i, e] >= 0 else [self._bytes[x] for x in words[i][s:e].encode("utf-8", "replace")])
                e = s
            out[i] = np.array([x for part in reversed(parts) for x in part], self.kind).tobytes()
        return out

    def _marks(self, n: int) -> list[int]:
        """Ids of a run of marks: all their merges are of one turn, so the leftmost grows as far as pieces go."""
        out = []
        while n:
            parts = self._merged(MARK * min(n, 2 * self.longest))
            take = parts if n <= 2 * self.longest else parts[:1]
            out += [self._of[x][0] for x in take]
            n -= sum(map(len, take))
        return out

    def _after_marks(self, words: list[str]) -> None:
        """Into the cache, words that begin with several marks: the last mark belongs to the word if a merge takes it."""
        self._known([w.lstrip(MARK) and MARK + w.lstrip(MARK) for w in words])
        for w in words:
            rest = w.lstrip(MARK)
            n, own = len(w) - len(rest), self._cache[MARK + rest] if rest else b""
            width = self.kind.itemsize
            if rest and int.from_bytes(own[:width], "little") == self._mark:
                own = own[width:]
            elif rest:
                n -= 1
            self._cache[w] = np.array(self._marks(n), self.kind).tobytes() + own

    def _known(self, words: list[str]) -> None:
        """Encode words that the cache lacks."""
        by: dict[int, list[str]] = {}
        for w in {w for w in words if w and w not in self._cache}:
            by.setdefault(len(w), []).append(w)
        for own in by.values():
            step = max(1, 250_000 // len(own[0]))
            for lo in range(0, len(own), step):
                self._cache.update(zip(own[lo : lo + step], self._viterbi(own[lo : lo + step])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as numbers of ``kind``: 16 bits, or 32 where the vocabulary has more than 65,536 ids. A mark stands before a text, as before each word; no text, no ids."""
        cut = [self._apart.findall(MARK + x.replace(" ", MARK)) if x else [] for x in texts]
        if len(self._cache) > CACHE_WORDS:
            self._cache.clear()
        new = {w for words in cut for w in words}.difference(self._cache)
        led = {w for w in new if w.startswith(MARK * 2) or w == MARK} if self.merges else set()
        self._known(list(new - led))
        self._after_marks(sorted(led))
        cache = self._cache
        return [b"".join([cache[w] for w in words]) for words in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids; the mark before it is dropped, and bytes that are no UTF-8 are replaced."""
        table = self.table
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace").removeprefix(" ")


def _is_bpe(path: str) -> bool:
    """Whether a model file says that it is of merges (trainer_spec.model_type = BPE)."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    return proto.trainer_spec.model_type == proto.trainer_spec.BPE


def model(name: str = "piece_bpe_32k.model") -> Pieces:
    """The worker's copy of a vocabulary file of the public tokenizers."""
    if name not in _models:
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        ids = range(sp.get_piece_size())
        text = [("", 0.0) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) else (sp.id_to_piece(i), sp.get_score(i)) for i in ids]
        _models[name] = Pieces(text, {int(sp.id_to_piece(i)[1:-1], 16): i for i in ids if sp.is_byte(i)}, merges=_is_bpe(public_tokenizers.path(name)))
    return _models[name]


def _carried(rows: pa.RecordBatch, carry: list[str]) -> list:
    return [rows.column(x) for x in carry]


def _types(df: DataFrame, carry: list[str]) -> str:
    return "".join(f", `{x}` {df.schema[x].dataType.simpleString()}" for x in carry)


def encode(docs: DataFrame, name: str = "piece_bpe_32k.model", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids (binary, unsigned 32-bit little-endian) and the ``carry`` columns of every row.

    Null and empty texts have no ids. Repeated rows, and rows with a null doc_id, are encoded each by itself.
    """

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        ids = [np.frombuffer(x, model(name).kind).astype("<u4").tobytes() for x in model(name).encode([x or "" for x in rows.column("text").to_pylist()])]
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(ids, pa.binary()), *_carried(rows, carry)], ["doc_id", "ids", *carry])

    return map_texts(docs.select(*dict.fromkeys(("doc_id", "text", *carry))), run, "doc_id long, ids binary" + _types(docs, carry))


def decode(encoded: DataFrame, name: str = "piece_bpe_32k.model", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text and the ``carry`` columns of every row of doc_id and ids; null ids give an empty text."""

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        text = [model(name).decode(np.frombuffer(x or b"", "<u4")) for x in rows.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(text, pa.string()), *_carried(rows, carry)], ["doc_id", "text", *carry])

    return map_texts(encoded.select(*dict.fromkeys(("doc_id", "ids", *carry))), run, "doc_id long, text string" + _types(encoded, carry), "ids")
