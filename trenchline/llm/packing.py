"""Harmonic packing of token sequences.

A bin holds ``capacity`` tokens.  A document gives whole bins and a rest; a
rest of more than capacity/(k+1) and at most capacity/k tokens is of class k,
and a bin of class k is made of k rests, for every k from 1 to capacity.  What
such a bin leaves free is filled with the beginning of the next document, whose
remainder then has a class of its own, so closed bins hold no padding and a bin
costs one cut at most.

Each worker fills its own bins: no shuffle, no shared state, and at most
about 2 * sqrt(capacity) classes wait for rests, less than a bin each.  At the
end of a partition what waits is laid into bins one after another, and the
last tokens into sequences whose lengths are powers of two, which need no
padding either.

Null text: empty, one piece with the end id alone.  Repeated rows and equal
ids are packed as often as they occur; a null doc_id is carried.  A very long
text gives as many whole bins as it fills.  Other columns of the input take no
part.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trenchline.llm.tokens import default_path, encoder
from trenchline.llm.words import pieces, tune

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


class Bins:
    """Open bins of one worker.

    A rest is (doc_id, start, tokens of the document, ids): what is left of a
    document from ``start`` on.  ``waiting``: the rests of each class;
    ``open``: bins that have their k rests and room left."""

    def __init__(self, capacity: int, partition: int):
        self.capacity, self.next_id = capacity, partition << 40
        self.waiting: dict[int, list[tuple]] = {}
        self.open: deque[list] = deque()  # [rests, room]
        self.out: list[tuple] = []

    def add(self, doc_id, ids: memoryview) -> None:
        """A document's ids (4 bytes each)."""
        total, size = len(ids) // 4, 4 * self.capacity
        whole = total // self.capacity
        for i in range(whole):
            self._close([(doc_id, i * self.capacity, total, ids[i * size : (i + 1) * size])])
        if total % self.capacity:
            self._rest((doc_id, whole * self.capacity, total, ids[whole * size :]))

    def _rest(self, rest: tuple) -> None:
        doc_id, start, total, ids = rest
        while self.open and len(ids):
            bin_ = self.open[0]
            taken = min(len(ids) // 4, bin_[1])
            bin_[0].append((doc_id, start, total, bytes(ids[: 4 * taken])))
            bin_[1] -= taken
            start, ids = start + taken, ids[4 * taken :]
            if not bin_[1]:
                self._close(self.open.popleft()[0])
        if not len(ids):
            return
        k = self.capacity * 4 // len(ids)
        held = self.waiting.setdefault(k, [])
        held.append((doc_id, start, total, bytes(ids)))
        if len(held) == k:
            room = self.capacity - sum(len(r[3]) for r in held) // 4
            del self.waiting[k]
            if room:
                self.open.append([held, room])
            else:
                self._close(held)

    def _close(self, rests: list[tuple]) -> None:
        offset = 0
        for doc_id, start, total, ids in rests:
            n = len(ids) // 4
            self.out.append((doc_id, start, n, total, self.next_id, offset, bytes(ids)))
            offset += n
        self.next_id += 1

    def finish(self) -> None:
        """Close everything: full bins, then powers of two."""
        left = [r for rests, _ in self.open for r in rests] + [r for k in sorted(self.waiting) for r in self.waiting[k]]
        self.open.clear()
        self.waiting.clear()
        tokens = sum(len(r[3]) for r in left) // 4
        sizes = [self.capacity] * (tokens // self.capacity)
        sizes += [1 << b for b in range(self.capacity.bit_length() - 2, -1, -1) if tokens % self.capacity >> b & 1]
        at = 0
        for room in sizes:
            rests = []
            while room:
                doc_id, start, total, ids = left[at]
                taken = min(len(ids) // 4, room)
                rests.append((doc_id, start, total, ids[: 4 * taken]))
                room -= taken
                if 4 * taken == len(ids):
                    at += 1
                else:
                    left[at] = (doc_id, start + taken, total, ids[4 * taken :])
            self._close(rests)

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def _table(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 7
    kinds = [pa.int64()] * 6 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=PIECES.names)


def pack(docs: DataFrame, capacity: int = 4096, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids) of all texts.

    ``ids`` are little-endian unsigned 32-bit.  ``capacity`` is a power of two."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    path = path or default_path()
    tune(docs.sparkSession)

    def run(batches):
        tokenizer = encoder(path)
        bins = Bins(capacity, TaskContext.get().partitionId())
        for batch in pieces(batches):
            offsets, ids = tokenizer.encode(batch.column("text"), end_id)
            data, bounds = memoryview(ids.tobytes()), (4 * offsets).tolist()
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), bounds[:-1], bounds[1:]):
                bins.add(doc_id, data[a:b])
            yield _table(bins.taken())
        bins.finish()
        yield _table(bins.taken())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def packed_digest(docs: DataFrame, **options) -> DataFrame:
    """The pieces with ``ids_crc32`` in place of the ids."""
    return pack(docs, **options).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
