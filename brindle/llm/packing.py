"""Bounded-space online best-fit packing of token sequences.

Documents become pieces of at most ``capacity`` tokens (only longer documents are cut). Every task packs its pieces as
they come: a fixed number of bins is open, a bitset has a bit for each amount of free space that some open bin has, and
a piece goes to the bin with the least free space that holds it, which is the lowest bit from the piece's length on. With
too many bins open the fullest closes first, the lowest bit of all. Nothing is shuffled and a task holds one batch.

Nulls: a null text counts as empty, so that the document is its end token alone; a null id stays null. Ties between bins
with equal free space go to the bin touched last. Repeated rows are packed each. A very long text is cut in its task. An
empty table gives no rows. Only the id and the text column are read, so further columns can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import encoder

CAPACITY = 2048
OPEN_BINS = 8192
END = 0


class BestFit:
    """Places lengths into bins of ``capacity``; at most ``most`` bins are open."""

    def __init__(self, capacity: int, most: int):
        if capacity < 1 or most < 1:
            raise ValueError("a bin must hold something, and one bin must be open")
        self.capacity, self.most = capacity, most
        self.bits, self.open, self.made = 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            which = self._take(free)
        else:
            free, which = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            self.bins[left].append(which)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return which, self.capacity - free

    def _take(self, free: int) -> int:
        which = self.bins[free].pop()
        if not self.bins[free]:
            self.bits ^= 1 << free
        self.open -= 1
        return which


def pack(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end: int = END) -> DataFrame:
    """Per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit), ``sequence_id``, ``offset``."""
    kinds = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, fit = encoder(tokenizer), BestFit(capacity, open_bins)
        first = TaskContext.get().partitionId() << 40
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids_of.encode(text.as_py()).astype("<u4").tobytes() + last
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, part))
            placed = [fit.place(r[3]) for r in sorted(rows, key=lambda r: -r[3])] if rows else []
            order = sorted(range(len(rows)), key=lambda k: -rows[k][3])
            for low in range(0, len(order), 512):
                some = [(*rows[k], first + b, o) for k, (b, o) in zip(order[low : low + 512], placed[low : low + 512])]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), kinds)], schema=kinds)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(packed, "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")
