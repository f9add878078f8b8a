"""Hard negatives by threshold joins over an inverted index (after L2AP).

Rows are dealt into blocks.  In a block the dimensions are ordered by energy,
and a row's last dimensions stay out of the index where the norm of that
suffix cannot reach the threshold on its own.  Rows that index a dimension
stand first, so a dimension's list is a slice.  Partial scores are
accumulated a few dimensions at a time; a pair goes as soon as its score so
far plus the product of the remaining norms is below the threshold.  What is
left is scored exactly, on whole numbers.

Thresholds: every anchor is first joined with one block, where its threshold
is lowered until its window is full there.  The last score of that window is
a floor for the whole table, since other blocks can only add better rows, so
one further join of all blocks above the floor is exact.  This is done once
for the positives and once for the negatives below each of them.

The anchors are a stated query set, joined with all rows block by block; a
block pair is one task's work and holds at most ``BLOCK_ROWS`` rows and
``BLOCK_ANCHORS`` anchors.  A label may hold any share of the rows: blocks are
dealt by a hash of the row, not by label.

Defined results: rows with a null label or vector, or a null or non-finite
component, take no part.  A null id is never an anchor, ranks before other
ids among equal scores, and may be a negative.  Rows that occur several times
are separate rows.  Vectors of unequal length are compared over the common
dimensions (missing ones count as zero).  Scores beyond 64 bits saturate.
An empty table, or one without anchors, gives no rows.  Other columns of the
input take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trenchline.llm.common import landed

BLOCK_ROWS = 8192
BLOCK_ANCHORS = 8192
#: anchors that are accumulated at once, and dimensions between two prunings
BATCH, CHUNK = 128, 8
#: share of live pairs below which they are followed one by one
SPARSE = 0.05
LONG = 1 << 63


def _matrix(vectors: pa.ChunkedArray | pa.Array, width: int, scale: float) -> np.ndarray:
    """floor(scale * x) of list<double> rows, padded with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), width))
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out[np.arange(width) < lengths[:, None]] = np.floor(scale * flat)
    return out


def _exact(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows as whole numbers, saturated at 64 bits."""
    bound = np.abs(a).max(initial=0) * np.abs(x).max(initial=0) * max(a.shape[1], 1)
    if bound < 2.0**53:
        return np.einsum("ij,ij->i", a, x).astype(np.int64)
    whole = [sum(int(p) * int(q) for p, q in zip(r, s)) for r, s in zip(a, x)]
    return np.array([min(max(v, 1 - LONG), LONG - 1) for v in whole], np.int64)


class BlockIndex:
    """The rows of a block as an index of slices, for thresholds on inner products."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.order = np.argsort(-(rows**2).sum(axis=0), kind="stable")
        self.sorted = rows[:, self.order]
        self.rest = self._suffix(self.sorted)

    @staticmethod
    def _suffix(x: np.ndarray) -> np.ndarray:
        """Norms of all suffixes, one more than there are dimensions, rounded up a little."""
        squares = np.cumsum((x**2)[:, ::-1], axis=1)[:, ::-1]
        return np.sqrt(np.concatenate([squares, np.zeros((len(x), 1))], axis=1)) * (1 + 1e-9)

    def above(self, anchors: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of all pairs with a score of at least the anchor's ``least``."""
        found = [np.zeros((3, 0), np.int64)]
        for at in np.array_split(np.argsort(least, kind="stable"), -(-len(anchors) // BATCH) or 1):
            if len(at):
                i, j = self._live(anchors[at], least[at])
                i = at[i]
                score = _exact(anchors[i], self.rows[j])
                keep = score >= least[i]
                found.append(np.stack([i[keep], j[keep], score[keep]]))
        i, j, score = np.concatenate(found, axis=1)
        return i, j, score

    def _live(self, anchors: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that the bounds cannot rule out."""
        a, width = anchors[:, self.order], anchors.shape[1]
        rest = self._suffix(a)
        # a suffix whose norm stays below the least threshold on its own is not indexed
        short = self.rest * rest[:, 0].max(initial=0) < least.min(initial=np.inf)
        indexed = np.where(short.any(axis=1), short.argmax(axis=1), width)
        by_length = np.argsort(-indexed, kind="stable")
        lengths = indexed[by_length]
        x, x_rest = self.sorted[by_length], self.rest[by_length]
        n = int(np.searchsorted(-lengths, 0, side="left"))  # the others cannot reach any threshold
        score = np.zeros((len(a), n))
        slack = 1e-9 * (rest[:, :1] * x_rest[:n, 0]) + 1e-9
        done: list[tuple[np.ndarray, np.ndarray]] = []
        size, end = n, np.full(n, width)
        for start in range(0, width, CHUNK):
            stop = min(start + CHUNK, width)
            in_list = int(np.searchsorted(-lengths, -start, side="left"))  # rows that index a dimension from here on
            end[in_list:size] = np.minimum(end[in_list:size], start)
            size = min(size, in_list)
            if not size:
                break
            score[:, :size] += a[:, start:stop] @ x[:size, start:stop].T
            alive = score[:, :size] + rest[:, stop, None] * x_rest[:size, stop] + slack[:, :size] >= least[:, None]
            if stop < width and alive.mean() < SPARSE:
                done.append(np.nonzero(alive))
                break
        else:
            if size:
                done.append(np.nonzero(alive))
        if size < n:  # lists that ended before: their rows have the suffix left that was not indexed
            tail = np.arange(size, n)
            left = rest[:, end[tail]] * x_rest[tail, end[tail]]
            i, j = np.nonzero(score[:, tail] + left + slack[:, tail] >= least[:, None])
            done.append((i, tail[j]))
        i, j = (np.concatenate(p) for p in zip(*done)) if done else (np.zeros(0, np.int64),) * 2
        return i, by_length[j]


def _first(group: np.ndarray, keys: tuple, k: int) -> np.ndarray:
    """Indices of the first ``k`` entries of each group, ordered by ``keys`` (most significant first)."""
    at = np.lexsort((*keys[::-1], group))
    g = group[at]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    nth = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
    return at[nth < k]


def _windows(index: BlockIndex, ids: np.ndarray, labels: np.ndarray, uids: np.ndarray, asked: dict, k: int, fill: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(asked, row, score): the first ``k`` rows of the block in every asked window.

    A window has an anchor, a kind (same label or another), and score limits
    low and high.  ``fill``: thresholds come down only until the windows are
    full; else they are at the low limit at once."""
    n = len(asked["uid"])
    norm = np.sqrt((asked["vector"] ** 2).sum(axis=1)) * index.rest[:, 0].max(initial=0)
    bottom = np.maximum(asked["low"].astype(float), 0)
    room = np.maximum(np.minimum(asked["high"].astype(float), norm) - bottom, 0)
    limit = np.nextafter(asked["low"].astype(float), -np.inf)
    out, open_ = [np.zeros((3, 0), np.int64)], np.arange(n)
    for share in (0.5, 0.25, 0.0) if fill else (0.0,):
        least = bottom + room * share if share else limit
        # windows of one anchor are asked together, by their least threshold
        anchor, which = np.unique(asked["uid"][open_], return_inverse=True)
        first = np.zeros(len(anchor), np.int64)
        first[which] = open_
        floor = np.full(len(anchor), np.inf)
        np.minimum.at(floor, which, least[open_])
        i, j, score = index.above(asked["vector"][first], floor)
        by_anchor = np.argsort(which, kind="stable")
        counts = np.bincount(which, minlength=len(anchor))
        starts = np.r_[0, np.cumsum(counts)[:-1]]
        for nth in range(int(counts.max(initial=0))):
            has = counts[i] > nth
            window = open_[by_anchor[starts[i[has]] + nth]]
            r, s = j[has], score[has]
            same = labels[r] == asked["label"][window]
            ok = (s >= least[window]) & (s >= asked["low"][window]) & (s <= asked["high"][window]) & (same == asked["same"][window]) & (uids[r] != asked["uid"][window])
            window, r, s = window[ok], r[ok], s[ok]
            best = _first(window, (-s, ids[r]), k)
            out.append(np.stack([window[best], r[best], s[best]]))
        full = np.bincount(np.concatenate([o[0] for o in out]), minlength=n) >= k
        ready = full | (least <= limit)
        if share:
            out = [o[:, ready[o[0]]] for o in out]  # the others are asked anew from a lower threshold
        open_ = np.array([w for w in open_ if not ready[w]], np.int64)
        if not len(open_):
            break
    window, r, s = np.concatenate(out, axis=1)
    return window, r, s


FOUND = pa.schema([("anchor", pa.int64()), ("same", pa.bool_()), ("nth", pa.int32()), ("uid", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def _join(rows: DataFrame, asked: DataFrame, n_blocks: int, n_groups: int, k: int, width: int, scale: float, one_block: bool) -> DataFrame:
    """The first ``k`` rows of every asked window: in one block each, or in all blocks.

    ``asked``: anchor (uid), label, vector, same, nth, low, high."""
    group = F.pmod(F.xxhash64("anchor"), F.lit(n_groups))
    if one_block:
        block = F.pmod(F.xxhash64("anchor", F.lit(1)), F.lit(n_blocks))
    else:
        block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))
    left = asked.withColumn("block", block).withColumn("pair", F.col("block") * n_groups + group).drop("block")
    right = rows.withColumn("pair", F.explode(F.sequence(F.col("block") * n_groups, F.col("block") * n_groups + n_groups - 1))).drop("block")

    # columns of their own on either side: both come from one table
    left = left.select([F.col(c).alias(f"a_{c}") for c in left.columns])
    right = right.select([F.col(c).alias(f"b_{c}") for c in right.columns])

    def search(asks: pa.Table, block: pa.Table) -> pa.Table:
        if not asks.num_rows or not block.num_rows:
            return FOUND.empty_table()
        index = BlockIndex(_matrix(block["b_vector"], width, scale))
        ids = block["b_id"].combine_chunks()
        numbers = ids.fill_null(-LONG).to_numpy(zero_copy_only=False)
        numpy = lambda t, c: t[c].to_numpy().copy()
        uids, labels = numpy(block, "b_uid"), numpy(block, "b_label")
        what = {c: numpy(asks, f"a_{c}") for c in ("label", "same", "nth", "low", "high")} | {"uid": numpy(asks, "a_anchor"), "vector": _matrix(asks["a_vector"], width, scale)}
        w, r, s = _windows(index, numbers, labels, uids, what, k, one_block)
        return pa.table({"anchor": what["uid"][w], "same": what["same"][w], "nth": what["nth"][w].astype(np.int32), "uid": uids[r], "id": ids.take(pa.array(r)), "score": s}, FOUND)

    found = left.groupBy("a_pair").cogroup(right.groupBy("b_pair")).applyInArrow(search, "anchor long, same boolean, nth int, uid long, id long, score long")
    if one_block:
        return found
    best = Window.partitionBy("anchor", "same", "nth").orderBy(F.desc("score"), F.asc_nulls_first("id"), "uid")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _floors(found: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``asked`` with the low limit raised to the last score of windows that are full in one block."""
    full = found.groupBy("anchor", "same", "nth").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
    joined = asked.join(full.drop("n"), ["anchor", "same", "nth"], "left")
    return joined.withColumn("low", F.greatest("low", F.coalesce("floor", "low"))).drop("floor")


def hard_negatives(
    vectors: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str | Column = "label",
    anchors: Column | None = None,
    positives: int = 5,
    negatives: int = 3,
    low_percent: int = 50,
    high_percent: int = 95,
    scale: float = 256.0,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are inner products of floor(scale * x).  ``anchors``: which rows are
    anchors (default: all).  For each anchor the ``positives`` best other rows
    of its label, and below each of them the first ``negatives`` rows of other
    labels whose score lies between the two percentages of the positive's."""
    of = F.col(label) if isinstance(label, str) else label
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    picked = anchors if anchors is not None else F.lit(True)
    rows = vectors.where(F.col(vector).isNotNull() & of.isNotNull()).where(finite)
    rows = rows.select(F.col(id).cast("long").alias("id"), of.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"), (F.coalesce(picked, F.lit(False)) & F.col(id).isNotNull()).alias("anchor"))
    rows = landed(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    n, n_anchors, width = rows.agg(F.count(F.lit(1)), F.count_if("anchor"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = max(1, -(-n // min(BLOCK_ROWS, max(256, -(-n // parts)))))
    n_groups = max(1, -(-n_anchors // BLOCK_ANCHORS))
    blocks = rows.select(F.pmod(F.xxhash64("uid"), F.lit(n_blocks)).alias("block"), "uid", "id", "label", "vector")
    asking = rows.where("anchor").select(F.col("uid").alias("anchor"), "label", "vector")

    def windows(asked: DataFrame, k: int) -> DataFrame:
        first = _join(blocks, asked, n_blocks, n_groups, k, width, scale, True)
        raised = landed(_floors(first, asked, k), "thresholds")
        return landed(_join(blocks, raised, n_blocks, n_groups, k, width, scale, False), "windows")

    limit = F.lit(LONG - 1)
    near = windows(asking.select("anchor", "label", "vector", F.lit(True).alias("same"), F.lit(0).alias("nth"), (-limit).alias("low"), limit.alias("high")), positives)
    near = near.select("anchor", F.col("rank").alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    score = F.col("positive_score").cast("decimal(30,0)")
    low, high = F.ceil(score * low_percent / 100), F.floor(score * high_percent / 100)
    below = near.where(low <= high).join(asking, "anchor").select("anchor", "label", "vector", F.lit(False).alias("same"), "nth", low.cast("long").alias("low"), high.cast("long").alias("high"))
    far = windows(below, negatives).select("anchor", "nth", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = near.join(rows.where("anchor").select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return far.join(named, ["anchor", "nth"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
