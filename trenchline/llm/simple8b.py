"""Token ids as Simple-8b blocks in Parquet-held files.

A 64-bit word holds a 4-bit selector and up to 60 payload bits: the selector
says how many ids of how many bits the word has.  Ids of 60 bits or more are
escapes, kept in order in an array of their own.  Every ``BLOCK`` ids start a
new word and their word offset is stored, so blocks are coded and decoded as
columns of one numpy array.

A file row ("chunk") holds whole documents: their ids and lengths, the coded
words, block offsets and escapes.  Rows are written in ascending doc_id order
by range partition through Spark's committer, so a lost task leaves nothing
behind.

Null or empty text: the end id alone.  Null ids come first; rows of equal id
are documents of their own and follow by text.  A very long text is one chunk.  An empty table gives files without rows.  Only doc_id and
text are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trenchline.llm.tokens import default_path, encoder
from trenchline.llm.words import gather_ranges, lengths_to_offsets, pieces, tune

BLOCK = 1024
# Ids per word and bits per id for selectors 1 to 15 of Simple-8b; selector 0 is the escape.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
LIMITS = np.array([1 << int(b) for b in BITS[1:]], np.uint64)  # a value below LIMITS[s - 1] fits selector s
PAD = 128
SMALL = 1 << 16
NEED = (np.searchsorted(LIMITS, np.arange(SMALL, dtype=np.uint64), side="right") + 1).astype(np.uint8)  # by value, for small ones


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, escapes) of unsigned values."""
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    grid = np.zeros((blocks, BLOCK + PAD), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = values
    grid[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    # least selector that holds the value; 16: escape
    need = NEED[grid.astype(np.uint16)] if flat.max() < SMALL else (np.searchsorted(LIMITS, grid, side="right") + 1).astype(np.uint8)
    tables, span = {1: need}, 1
    while span * 2 <= 120:
        last = tables[span]
        shifted = np.full_like(last, 1)
        shifted[:, : last.shape[1] - span] = last[:, span:]
        tables[span * 2] = np.maximum(last, shifted)
        span *= 2
    choice = np.where(need[:, :BLOCK] > 15, 0, 15).astype(np.uint8)
    for s in range(14, 0, -1):
        count = int(COUNTS[s])
        span = 1 << (count.bit_length() - 1)
        table = tables[span]
        fits = np.maximum(table[:, :BLOCK], table[:, count - span : count - span + BLOCK]) <= s
        if fits.any():
            choice[fits] = s
    choice = choice.ravel()
    at = np.arange(blocks) * BLOCK
    end = np.minimum(at + BLOCK, n)
    begins = np.zeros(blocks * BLOCK, bool)  # where a word begins: each block is walked from its start, all at once
    while len(at):
        begins[at] = True
        at = at + COUNTS[choice[at]]
        alive = at < end
        at, end = at[alive], end[alive]
    starts = np.flatnonzero(begins)
    selectors, rows = choice[starts], starts // BLOCK
    words = selectors.astype(np.uint64) << np.uint64(60)
    base, plain = starts + rows * PAD, grid.ravel()
    for s in range(2, 16):
        mine = np.flatnonzero(selectors == s)
        if len(mine):
            first, word = base[mine], words[mine]
            for k in range(COUNTS[s]):
                word |= plain[first + k] << np.uint64(k * BITS[s])
            words[mine] = word
    escapes = plain[base[selectors == 0]]
    return words, np.searchsorted(rows, np.arange(blocks)).astype(np.uint32), escapes


def decode(words: np.ndarray, first: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values that ``encode`` was given."""
    if not n:
        return np.zeros(0, np.uint64)
    blocks = len(first)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    ends = lengths_to_offsets(COUNTS[selectors])
    row = np.repeat(np.arange(blocks), np.diff(np.append(first.astype(np.int64), len(words))))
    starts = ends[:-1] - ends[first.astype(np.int64)][row]
    out = np.zeros(blocks * (BLOCK + PAD), np.uint64)
    base = row * (BLOCK + PAD) + starts
    for s in range(2, 16):
        mine = np.flatnonzero(selectors == s)
        if len(mine):
            step = np.arange(COUNTS[s])
            values = (words[mine][:, None] >> (step * BITS[s]).astype(np.uint64)) & np.uint64((1 << int(BITS[s])) - 1)
            out[base[mine][:, None] + step] = values
    out[base[selectors == 0]] = escapes
    return out.reshape(blocks, BLOCK + PAD)[:, :BLOCK].ravel()[:n]


CHUNKS = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("ids_before", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("lengths", T.BinaryType()),
        T.StructField("words", T.BinaryType()),
        T.StructField("first_words", T.BinaryType()),
        T.StructField("escapes", T.BinaryType()),
    ]
)


def write_token_files(docs: DataFrame, path: str, end_id: int = 1, tokenizer: str | None = None, partitions: int | None = None) -> None:
    """Encode all texts in ascending doc_id order (nulls first, ties by text) into files under ``path``.

    Null text: empty, the end id alone."""
    tokenizer = tokenizer or default_path()
    spark = docs.sparkSession
    tune(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        enc, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in pieces(batches):
            offsets, ids = enc.encode(batch.column("text"), end_id)
            words, first, escapes = encode(ids.astype(np.uint64))
            row = [part, before, len(ids), batch.column("doc_id").to_pylist(), np.diff(offsets).astype("<u4").tobytes()]
            row += [words.astype("<u8").tobytes(), first.astype("<u4").tobytes(), escapes.astype("<u8").tobytes()]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=CHUNKS.names)
            before += len(ids)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    ordered.mapInArrow(run, CHUNKS).write.option("compression", "none").parquet(path)


DECODED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in files under ``path``."""
    chunks = spark.read.schema(CHUNKS).parquet(path)
    # one row per file partition: ids of all partitions before it
    starts = chunks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = starts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                lengths = np.frombuffer(r["lengths"], "<u4").astype(np.int64)
                ids = decode(np.frombuffer(r["words"], "<u8"), np.frombuffer(r["first_words"], "<u4"), np.frombuffer(r["escapes"], "<u8"), r["n_ids"])
                offsets = lengths_to_offsets(lengths)
                data = memoryview(ids.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(r["doc_ids"], pa.int64()),
                        pa.array(offsets[:-1] + r["ids_before"] + r["part_start"]),
                        pa.array(lengths),
                        pa.array([bytes(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary()),
                    ],
                    names=DECODED.names,
                )

    # bounded: one (int, long) row per file partition
    return chunks.join(F.broadcast(starts), "part").mapInArrow(run, DECODED)


def decoded_digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
