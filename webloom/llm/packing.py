"""Harmonic packing of documents into sequences of fixed capacity.

Class j, for j from 1 to `classes`, holds what is longer than capacity / (j + 1) and at most capacity / j, and each of its bins
takes j of them; the last class holds all that is shorter, one after another. A document is cut only where a bin would be left
padded: whole capacities come off a long one first, and the head of the document that comes next fills what a bin of j has
left; its rest goes to the class of its length. A piece of the last class that crosses the end of a bin goes on in the next.
Each worker (Spark partition) fills bins of its own, so there is no shuffle and nothing to agree on; it keeps at most
j - 1 waiting pieces a class. What waits at its end is laid together, cut at the ends of sequences, and the very last
sequence is cut by powers of two, which need no padding. So no sequence is padded, at one to two pieces a document.

Nulls and empty texts are a document of the end id alone. Equal rows are packed once each. Ties (equal lengths) stay in the order
of the rows. A null doc_id stays null. Very long texts are cut like others. An empty table gives no rows. Other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .subwords import subwords

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Bins:
    """The bins of one worker. A piece is (key, start, ids), ids being little-endian unsigned 32-bit bytes; add() and rest() yield (sequence number, offset, piece)."""

    def __init__(self, capacity: int, classes: int = 32):
        self.capacity, self.classes, self.sequences = capacity, classes, 0
        self.waiting: dict[int, list[tuple]] = {}
        self.open: list[tuple] = []  # a bin that has its count of pieces and still some room
        self.room = 0
        self.small: list[tuple] = []
        self.n_small = 0

    def _sequence(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for piece in pieces:
            yield self.sequences, at, piece
            at += len(piece[2]) // 4
        self.sequences += 1

    def add(self, key: object, ids: bytes) -> Iterator[tuple]:
        n, start = len(ids) // 4, min(self.room, len(ids) // 4)
        if start:
            self.open.append((key, 0, ids[: 4 * start]))
            self.room -= start
            if not self.room:
                yield from self._sequence(self.open)
                self.open = []
        while n - start >= self.capacity:
            yield from self._sequence([(key, start, ids[4 * start : 4 * (start + self.capacity)])])
            start += self.capacity
        if start == n:
            return
        piece, j = (key, start, ids[4 * start :]), self.capacity // (n - start)
        if j > self.classes:
            yield from self._last_class(piece)
            return
        waiting = self.waiting.setdefault(j, [])
        waiting.append(piece)
        if len(waiting) == j:
            self.waiting[j] = []
            self.room = self.capacity - sum(len(p[2]) for p in waiting) // 4
            if self.room:
                self.open = waiting
            else:
                yield from self._sequence(waiting)

    def _last_class(self, piece: tuple) -> Iterator[tuple]:
        key, start, ids = piece
        room = self.capacity - self.n_small
        self.small.append((key, start, ids[: 4 * room]))
        self.n_small += min(room, len(ids) // 4)
        if self.n_small == self.capacity:
            yield from self._sequence(self.small)
            rest = ids[4 * room :]
            self.small, self.n_small = [(key, start + room, rest)] if rest else [], len(rest) // 4

    def rest(self) -> Iterator[tuple]:
        left = self.open + self.small + [p for _, pieces in sorted(self.waiting.items()) for p in pieces]
        total = sum(len(p[2]) for p in left) // 4
        sizes = [self.capacity] * (total // self.capacity) + [1 << k for k in reversed(range(self.capacity.bit_length())) if total % self.capacity >> k & 1]
        for size in sizes:
            pieces = []
            while size:
                key, start, ids = left.pop(0)
                n = min(size, len(ids) // 4)
                pieces.append((key, start, ids[: 4 * n]))
                if 4 * n < len(ids):
                    left.insert(0, (key, start + n, ids[4 * n :]))
                size -= n
            yield from self._sequence(pieces)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """A row per piece, see SCHEMA. capacity: a power of two; tokenizer: path of a tokenizers file."""
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    end = end_id.to_bytes(4, "little")

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut_up, bins = subwords(tokenizer), Bins(capacity)
        base = TaskContext.get().partitionId() << 36
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            table = zip(*((key[0], start, len(ids) // 4, zlib.crc32(ids), key[1], base + n, at) for n, at, (key, start, ids) in rows))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in table], names)

        rows: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = cut_up.encode(text.as_py()) + end
                rows.extend(bins.add((doc_id, len(ids) // 4), ids))
                if len(rows) >= 5_000:
                    yield out(rows)
                    rows = []
        rows.extend(bins.rest())
        if rows:
            yield out(rows)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(worker, SCHEMA)
