"""Best-fit packing in bounded space.

Documents are encoded once; one longer than the window is cut into a shorter first piece and full ones. A full piece is a
sequence of its own. The others are dealt to tasks by a hash of their place, so that neither sorted inputs nor a hot source
gives a task pieces of one size, and each task packs its stream online: a piece goes to the open sequence with the
least room that holds it. Open sequences are found in a bitset keyed by free space; there is a fixed number of them, and when
one more is wanted the fullest closes first. Only the short rows (place and length) are dealt; ids of short pieces move
once more, to meet their place, and full ones not at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import map_texts, stored, text_slices
from quantloom.llm.packing import encoder


class OpenBins:
    """At most ``most`` open sequences of ``window`` places, in a bitset of their free space."""

    def __init__(self, window: int, most: int):
        self._window, self._most = window, most
        self._bits = 0  # bit f is set when a sequence with f places free is open
        self._free: list[list[int]] = [[] for _ in range(window + 1)]
        self._open = 0
        self.opened = 0

    def place(self, length: int) -> tuple[int, int]:
        """The sequence that takes ``length`` places and the offset there."""
        room = self._bits >> length
        if room:
            free = length + (room & -room).bit_length() - 1
            own = self._take(free)
        else:
            if self._open == self._most:  # the fullest closes
                self._take((self._bits & -self._bits).bit_length() - 1)
            free, own = self._window, self.opened
            self.opened += 1
        if free > length:
            self._free[free - length].append(own)
            self._bits |= 1 << (free - length)
            self._open += 1
        return own, self._window - free

    def _take(self, free: int) -> int:
        own = self._free[free].pop()
        if not self._free[free]:
            self._bits &= ~(1 << free)
        self._open -= 1
        return own


def pieces(docs: DataFrame, window: int = 1024, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2) -> DataFrame:
    """part, no (unique within the part), doc_id, piece, start, length and ids (16-bit little-endian) of all pieces."""
    end = int(end_id).to_bytes(2, "little")
    names = ("part", "no", "doc_id", "piece", "start", "length", "ids")
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, no = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in text_slices(batch, "text"):
                out: list[list] = [[] for _ in names]
                for doc, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
                    ids = enc.encode(text or "") + end
                    n = len(ids) // 2
                    start, piece = 0, 0
                    while start < n:
                        length = (n % window or window) if start == 0 else window
                        for column, value in zip(out, (part, no, doc, piece, start, length, ids[2 * start : 2 * (start + length)])):
                            column.append(value)
                        start, piece, no = start + length, piece + 1, no + 1
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], list(names))

    return docs.select("doc_id", "text").mapInArrow(run, "part int, no long, doc_id long, piece int, start long, length long, ids binary")


def places(short: DataFrame, window: int, open_bins: int, task_rows: int) -> DataFrame:
    """part, no, sequence_id (even) and offset of pieces shorter than the window, given as part, no and length."""
    tasks = max(1, -(-short.count() // task_rows))
    turn = F.xxhash64("part", "no")
    dealt = short.select("part", "no", "length", turn.alias("turn")).repartition(tasks, "turn").sortWithinPartitions("turn", "part", "no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, first = OpenBins(window, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            got = [bins.place(x) for x in batch.column("length").to_pylist()]
            own = np.array(got, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("no"), pa.array((first + own[:, 0]) * 2), pa.array(own[:, 1])], ["part", "no", "sequence_id", "offset"])

    return dealt.mapInArrow(run, "part int, no long, sequence_id long, offset long")


def pack(docs: DataFrame, window: int = 1024, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, open_bins: int = 1024, task_rows: int = 1 << 16) -> DataFrame:
    """Pack documents whole into sequences of at most ``window`` ids; one row per piece.

    Returns doc_id, piece (from 0), start, length, sequence_id, offset and ids (binary, unsigned 32-bit little-endian). Only a
    document longer than the window is cut: its first piece has what is left over, the others are full. Null and empty
    texts are the end id alone. Repeated rows, and rows with a null doc_id, are packed each by itself. An empty table gives no
    rows. Other columns of ``docs`` are not read. ``open_bins``: open sequences a task; ``task_rows``: short pieces a task.
    """
    table = stored(pieces(docs, window, tokenizer, end_id), "bestfit")
    short = table.where(F.col("length") < window)
    placed = places(short, window, open_bins, task_rows)
    names = ["doc_id", "piece", "start", "length", "sequence_id", "offset", "ids"]
    alone = table.where(F.col("length") >= window).withColumn("sequence_id", (F.col("part").cast("long") * F.lit(1 << 40) + F.col("no")) * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    both = alone.select(*names).unionByName(short.hint("merge").join(placed, ["part", "no"]).select(*names))

    def widen(rows: pa.RecordBatch) -> pa.RecordBatch:
        ids = [np.frombuffer(x, "<u2").astype("<u4").tobytes() for x in rows.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([*(rows.column(n) for n in names[:-1]), pa.array(ids, pa.binary())], names)

    return map_texts(both, widen, "doc_id long, piece int, start long, length long, sequence_id long, offset long, ids binary", "ids")


def digest(packed: DataFrame) -> DataFrame:
    """The contract's columns of packed pieces: ids as their checksum. One row per row of ``packed``, nulls in doc_id kept."""
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
