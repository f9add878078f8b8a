"""Blocks of documents with coded words.

A block is a row for some thousand consecutive documents of an input split:
word ids into the block's own dictionary, the dictionary, and the documents'
other columns as an Arrow stream.  Corpus-wide steps work on blocks: each
first reduces its own words, windows or n-grams to distinct ones, sends those
to shards by key, and gets one answer per shard.  The blocks themselves are
written once, bucketed by block_id, and never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trenchline.llm.common import bucketed
from trenchline.llm.words import coded_words, pieces, tune

#: bytes of text in a block; more make fewer, larger messages between blocks and shards
BLOCK_BYTES = 4 << 20

BLOCKS = T.StructType(
    [
        T.StructField("block_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("ends", T.BinaryType()),  # int64 offset of each document's words, one more than documents
        T.StructField("codes", T.BinaryType()),  # uint32 dictionary index of every word
        T.StructField("words", T.BinaryType()),  # the dictionary, words parted by line feeds
        T.StructField("rest", T.BinaryType()),  # Arrow stream of the documents' columns
    ]
)

MESSAGES = T.StructType(
    [
        T.StructField("shard", T.IntegerType()),
        T.StructField("block_id", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def to_stream(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_stream(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def build_blocks(docs: DataFrame, name: str, lower: bool = False, carry: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Bucketed block table of ``docs``; ``carry``: the columns kept in ``rest`` (all by default)."""
    tune(docs.sparkSession)
    carry = docs.columns if carry is None else carry

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        waiting, size = [], 0

        def emit(group):
            batch = pa.Table.from_batches(group).combine_chunks().to_batches()[0]
            offsets, codes, words = coded_words(batch.column("text"), lower)
            row = [(part << 24) | seq, len(codes), offsets.astype("<i8").tobytes(), codes.astype("<u4").tobytes()]
            row += ["\n".join(words.to_pylist()).encode(), to_stream(batch.select(carry))]
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=BLOCKS.names)

        for batch in pieces(batches, limit=block_bytes // 4):
            waiting.append(batch)
            size += batch.column("text").nbytes
            if size >= block_bytes:
                yield emit(waiting)
                waiting, size, seq = [], 0, seq + 1
        if waiting:
            yield emit(waiting)

    return bucketed(docs.mapInArrow(run, BLOCKS), "block_id", name)


class Block:
    """A block row, decoded."""

    def __init__(self, row: dict):
        self.id = row["block_id"]
        self.ends = np.frombuffer(row["ends"], "<i8")
        self.codes = np.frombuffer(row["codes"], "<u4").astype(np.int64)
        self.words = row["words"].split(b"\n") if row["words"] else []
        self.row = row

    def rest(self) -> pa.Table:
        return from_stream(self.row["rest"])

    def room(self) -> np.ndarray:
        """Words from each position to the end of its document."""
        lengths = np.diff(self.ends)
        return np.repeat(self.ends[1:], lengths) - np.arange(len(self.codes))


def messages(parts: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    shard, block, payload = zip(*parts) if parts else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(block, pa.int64()), pa.array(payload, pa.binary())], names=MESSAGES.names)


def per_block(df: DataFrame, fn: Callable[[dict], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """Apply ``fn`` to each block row in turn (one block in memory at a time)."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from fn({name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)})

    return df.mapInArrow(run, schema)


def by_shard(df: DataFrame, fn: Callable[[int, list[int], list[bytes]], pa.RecordBatch], schema: T.StructType = MESSAGES) -> DataFrame:
    """``fn(shard, block ids, payloads)`` for each shard; blocks in ascending order."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block_id")
        out = fn(table["shard"][0].as_py(), table["block_id"].to_pylist(), table["payload"].to_pylist())
        return pa.Table.from_batches([out])

    return df.groupBy("shard").applyInArrow(run, schema)


def with_answers(blocks: DataFrame, answers: DataFrame, column: str = "answers") -> DataFrame:
    """Blocks with the list of their answers, one (shard, payload) for each shard asked."""
    lists = answers.groupBy("block_id").agg(F.collect_list(F.struct("shard", "payload")).alias(column))
    return blocks.join(lists, "block_id", "left")


def planes(sorted_keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as gaps, byte plane by byte plane: the high planes compress away."""
    gaps = np.diff(sorted_keys, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(data: bytes) -> np.ndarray:
    gaps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(gaps, dtype=np.uint64)


def shard_cuts(sorted_keys: np.ndarray, shards: int, bits: int) -> np.ndarray:
    """Positions at which ascending ``bits``-bit keys pass from shard to shard."""
    edges = [-(-(s << bits) // shards) for s in range(1, shards)]
    inner = np.searchsorted(sorted_keys, np.array(edges, np.uint64), "left") if edges else []
    return np.concatenate([[0], inner, [len(sorted_keys)]]).astype(np.int64)


def shard_count(spark) -> int:
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
