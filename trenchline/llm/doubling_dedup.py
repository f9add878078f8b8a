"""Substring dedup by level-wise doubling.

A window of ``window`` words that also starts elsewhere is a repeat, and every
word in a repeated window is removed.  Level by level: windows of a short
length are counted over the whole corpus; only starts at which two repeated
windows join up to twice the length are candidates of the next level, until
the window length is reached or no candidate survives.

A level is one shuffle: each block of documents sends the distinct hashes of
its candidates to shards and gets back one bit for each.  All levels but the
last send hashes cut to log2(words) + 10 bits (a false repeat there only costs
work); the last uses 128 bits.  A text with thousands of copies sends its
windows once per block.

Null text: no words.  Copies lose all words in repeated windows, the first
copy included.  Documents shorter than the window keep every word.  Repeated
rows are documents of their own.
An empty table gives no rows.  Input columns named like an output column
(n_words, n_removed, kept_text) give way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trenchline.llm import blocks as B
from trenchline.llm.common import landed
from trenchline.llm.words import joined, lengths_to_offsets, mix, schema_of, word_hashes

SECOND = np.uint64(0xD6E8FEB86659FD93)

STATE = T.StructType(
    [
        T.StructField("block_id", T.LongType()),
        T.StructField("n_candidates", T.LongType()),
        T.StructField("mask", T.BinaryType()),
    ]
)


def level_lengths(window: int, start: int) -> list[int]:
    """Window lengths of the levels: doubling up to ``window``, the last doubling overlaps."""
    lengths = [min(start, window)]
    while lengths[-1] < window:
        lengths.append(min(2 * lengths[-1], window))
    return lengths


def start_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each position; positions without room have hash 0."""
    out, size = h, 1
    while size < width:
        step = min(size, width - size)
        wide = np.zeros_like(out)
        wide[: len(out) - step] = joined(out[: len(out) - step], out[step:])
        out, size = wide, size + step
    return out


def _hashes(block: B.Block, width: int) -> np.ndarray:
    words = word_hashes(block.words)
    return start_hashes(words[block.codes] if len(words) else np.zeros(0, np.uint64), width)


def _candidates(block: B.Block, lengths: list[int], level: int, mask: bytes | None) -> np.ndarray:
    width, n = lengths[level], len(block.codes)
    here = block.room() >= width
    if level:
        before = np.unpackbits(np.frombuffer(mask, np.uint8), count=n).astype(bool) if mask else np.zeros(n, bool)
        step = width - lengths[level - 1]
        later = np.zeros(n, bool)
        if n > step:  # else no window of this level has room in the block
            later[: n - step] = before[step:]
        here &= before & later
    return np.flatnonzero(here)


def _keys(block: B.Block, lengths: list[int], level: int, at: np.ndarray, bits: int):
    """(ascending distinct first keys, second keys or None, index of each candidate's key, repeated here)."""
    h = _hashes(block, lengths[level])[at]
    if level < len(lengths) - 1:
        keys, inverse, counts = np.unique(h >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
        return keys, None, inverse, counts > 1
    words = mix(word_hashes(block.words) ^ SECOND)
    other = start_hashes(words[block.codes] if len(words) else np.zeros(0, np.uint64), lengths[level])[at]
    order = np.lexsort((other, h))
    a, b = h[order], other[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group = np.cumsum(new) - 1
    inverse = np.empty(len(a), np.int64)
    inverse[order] = group
    return a[new], b[new], inverse, np.bincount(group, minlength=int(new.sum())) > 1


def _ask(lengths, level, bits, shards):
    def fn(row):
        block = B.Block(row)
        at = _candidates(block, lengths, level, row.get("mask"))
        if not len(at):
            return
        keys, second, _, repeated = _keys(block, lengths, level, at, bits)
        cuts = B.shard_cuts(keys, shards, bits if second is None else 64)
        parts = []
        for s in range(shards):
            a, b = int(cuts[s]), int(cuts[s + 1])
            if a < b:
                body = np.packbits(repeated[a:b]).tobytes()
                tail = second[a:b].astype("<u8").tobytes() if second is not None else b""
                parts.append((s, block.id, (b - a).to_bytes(8, "little") + body + tail + B.planes(keys[a:b])))
        yield B.messages(parts)

    return fn


def _answer(last: bool):
    """Which keys of a shard start at two places, as bits for each block."""

    def fn(shard, block_ids, payloads):
        firsts, seconds, heres, sizes = [], [], [], []
        for data in payloads:
            n = int.from_bytes(data[:8], "little")
            at = 8 + (n + 7) // 8
            heres.append(np.unpackbits(np.frombuffer(data[8:at], np.uint8), count=n))
            if last:
                seconds.append(np.frombuffer(data[at : at + 8 * n], "<u8"))
                at += 8 * n
            firsts.append(B.unplanes(data[at:]))
            sizes.append(n)
        keys, here = np.concatenate(firsts), np.concatenate(heres)
        order = np.lexsort((np.concatenate(seconds), keys)) if last else np.argsort(keys, kind="stable")
        ordered = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        if last:
            other = np.concatenate(seconds)[order]
            new[1:] |= other[1:] != other[:-1]
        group = np.cumsum(new) - 1
        n_groups = int(group[-1]) + 1
        twice = (np.bincount(group, minlength=n_groups) > 1) | (np.bincount(group, weights=here[order], minlength=n_groups) > 0)
        found = np.empty(len(keys), bool)
        found[order] = twice[group]
        cut = lengths_to_offsets(np.array(sizes))
        return B.messages([(shard, b, np.packbits(found[cut[i] : cut[i + 1]]).tobytes()) for i, b in enumerate(block_ids)])

    return fn


def _survivors(lengths, level, bits, shards):
    def fn(row):
        block = B.Block(row)
        at = _candidates(block, lengths, level, row.get("mask"))
        mask = np.zeros(len(block.codes), bool)
        if len(at):
            keys, second, inverse, _ = _keys(block, lengths, level, at, bits)
            cuts = B.shard_cuts(keys, shards, bits if second is None else 64)
            found = np.zeros(len(keys), bool)
            for answer in row["answers"] or []:
                a, b = int(cuts[answer["shard"]]), int(cuts[answer["shard"] + 1])
                found[a:b] = np.unpackbits(np.frombuffer(answer["payload"], np.uint8), count=b - a)
            mask[at] = found[inverse]
        yield pa.RecordBatch.from_arrays([pa.array([block.id], pa.int64()), pa.array([int(mask.sum())], pa.int64()), pa.array([np.packbits(mask).tobytes()], pa.binary())], names=STATE.names)

    return fn


def remove_repeats(docs: DataFrame, window: int = 35, start: int = 9, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """All rows with n_words, n_removed and kept_text (kept words joined by one space)."""
    spark = docs.sparkSession
    extra = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_text", T.StringType())]
    schema = schema_of(docs, extra)
    carry = [f.name for f in schema.fields[: -len(extra)]]
    blocks = B.build_blocks(docs.withColumn("text", F.col("text").cast("string")), "dedup_blocks", carry=carry, block_bytes=block_bytes)
    slim = blocks.select("block_id", "ends", "codes", "words")
    lengths, shards = level_lengths(window, start), B.shard_count(spark)
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    bits = min(64, max(8, int(total).bit_length() + 10))
    state = None
    for level in range(len(lengths)):
        rows = slim if state is None else slim.join(state, "block_id", "left")
        asked = B.per_block(rows, _ask(lengths, level, bits, shards), B.MESSAGES)
        answers = B.by_shard(asked, _answer(level == len(lengths) - 1))
        state = landed(B.per_block(B.with_answers(rows, answers), _survivors(lengths, level, bits, shards), STATE), "dedup_state")
        if not (state.agg(F.sum("n_candidates")).first()[0] or 0):
            break  # no candidate survives: nothing repeats at any greater length
    out_names = schema.names

    def cut_words(row):
        block = B.Block(row)
        n = len(block.codes)
        starts = np.unpackbits(np.frombuffer(row["mask"], np.uint8), count=n).astype(np.int64) if row["mask"] else np.zeros(n, np.int64)
        edge = np.zeros(n + window + 1, np.int64)
        edge[:n] += starts
        edge[window : n + window] -= starts
        covered = np.cumsum(edge)[:n] > 0
        removed = lengths_to_offsets(covered)[block.ends]
        kept = lengths_to_offsets(~covered)[block.ends]
        words = np.array(block.words, dtype=object)[block.codes[~covered]].tolist() if n else []
        texts = [b" ".join(words[a:b]).decode("utf-8", "replace") for a, b in zip(kept[:-1].tolist(), kept[1:].tolist())]
        rest = block.rest()
        cols = [rest[c].combine_chunks() for c in carry]
        cols += [pa.array(np.diff(block.ends)), pa.array(np.diff(removed)), pa.array(texts, pa.string())]
        yield from pa.Table.from_arrays([pa.chunked_array([c]) if isinstance(c, pa.Array) else c for c in cols], names=out_names).to_batches()

    final = blocks.join(state.select("block_id", "mask"), "block_id", "left")
    return B.per_block(final, cut_words, schema)
