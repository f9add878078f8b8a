"""Vectorised text helpers used inside Arrow tasks.

A word is a run of ``[^\\x20\\x09-\\x0D]+``; Arrow's ASCII splitter cuts at
exactly those characters.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of text handled at once inside a task (a longer single text is taken whole)
PIECE_BYTES = 8 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def tune(spark) -> None:
    """Bound Arrow batches by bytes as well as rows (very long texts)."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "4000"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))):
        try:
            spark.conf.set(key, value)
        except Exception:  # a setting this Spark version lacks
            pass


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of text."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // limit
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(size)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a)


def flat_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """All words of all texts in order, and the offsets of each text's words."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.flatten()
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    seen = np.concatenate([[0], np.cumsum(full)])
    return seen[offsets - offsets[0]], words.filter(pa.array(full))


def coded_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Offsets, dictionary index of every word, and the dictionary."""
    offsets, words = flat_words(texts, lower)
    coded = words.dictionary_encode()
    return offsets, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (multiply and shift), elementwise."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def word_hashes(words: list) -> np.ndarray:
    """Stable 64-bit hash of each word (str or bytes)."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return mix(pd.util.hash_array(np.array(words, dtype=object), categorize=False).astype(np.uint64))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the pair (a, b), order-sensitive."""
    return mix(a * GOLDEN + b)


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` hashes that start at each position (by doubling).

    The last ``width - 1`` positions hold no window: the result is shorter."""
    size = 1
    while size * 2 <= width:
        h = joined(h[: max(0, len(h) - size)], h[size:])
        size *= 2
    if size < width:
        h = joined(h[: max(0, len(h) - (width - size))], h[width - size :])
    return h


def lengths_to_offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def gather_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0]..+lengths[0], starts[1]..+lengths[1], ... in one array."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def schema_of(df, extra: list[tuple[str, object]], drop: tuple[str, ...] = ()):
    """Spark schema of ``df`` without ``drop`` and without names in ``extra``, plus ``extra``.

    An input column that has the name of an output column gives way to it."""
    from pyspark.sql import types as T

    taken = {name for name, _ in extra} | set(drop)
    return T.StructType([f for f in df.schema.fields if f.name not in taken] + [T.StructField(n, t, True) for n, t in extra])
