"""Ranks of integer keys from compressed bitmaps with a count directory.

The keys of a group are kept as 64-bit words; only words that hold a key
exist.  The directory says how many rows lie before each word.  The rank of a
key is that count plus the bits of its word below it, so rows get their place
by a join on their word and are never sorted.

A key that stands for several rows (``weight``) is one bit and an entry in the
word's short list of surplus rows (64 entries at most).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trenchline.llm.common import landed

#: words (or nodes of the directory) that are summed up in one group, as a power of two
STEP = 12


def _word(key: str) -> F.Column:
    return F.shiftright(F.col(key), 6)


def _bit(key: str) -> F.Column:
    return F.col(key).bitwiseAND(63).cast("int")


def _running(counts: DataFrame, group: str, low: int, high: int) -> DataFrame:
    """(group, node, before): rows of the group before each node, summed level by level.

    No window holds more than 2^STEP nodes, whatever the number of keys."""
    if high - low < 1 << STEP:
        w = Window.partitionBy(group).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        return counts.select(group, "node", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    up = counts.withColumn("parent", F.shiftright("node", STEP))
    parents = up.groupBy(group, F.col("parent").alias("node")).agg(F.sum("n").alias("n"))
    above = _running(parents, group, low >> STEP, high >> STEP).select(group, F.col("node").alias("parent"), F.col("before").alias("start"))
    w = Window.partitionBy(group, "parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    inner = up.select(group, "parent", "node", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("inside"))
    return inner.join(above, [group, "parent"]).select(group, "node", (F.col("start") + F.col("inside")).alias("before"))


def bitmap_index(keys: DataFrame, group: str, key: str, weight: str) -> DataFrame:
    """The bitmaps of ``keys`` (one row for each group and key, ``weight`` rows each).

    Columns: group, word, bits, more (surplus rows by bit), before (rows of the
    group in earlier words), total (rows of the group).  ``group`` is not null."""
    words = landed(
        keys.groupBy(group, _word(key).alias("word")).agg(
            F.bit_or(F.expr(f"shiftleft(1L, cast({key} & 63 as int))")).alias("bits"),
            F.sum(weight).alias("n"),
            F.collect_list(F.when(F.col(weight) > 1, F.struct(_bit(key).alias("bit"), (F.col(weight) - 1).alias("rows")))).alias("more"),
        ),
        "bitmap_words",
    )
    low, high = words.agg(F.min("word"), F.max("word")).first()
    if low is None:
        low = high = 0
    before = _running(words.select(group, F.col("word").alias("node"), "n"), group, low, high).withColumnRenamed("node", "word")
    totals = words.groupBy(group).agg(F.sum("n").alias("total"))
    return words.drop("n").join(before, [group, "word"]).join(totals, group)


def ranked(rows: DataFrame, index: DataFrame, group: str, key: str) -> DataFrame:
    """``rows`` with ``rank`` (rows of the group with a smaller key) and ``total`` (rows of the group)."""
    found = rows.withColumn("word", _word(key)).join(index, [group, "word"])
    below = F.expr(f"bit_count(bits & ~shiftleft(-1L, cast({key} & 63 as int)))").cast("long")
    extra = F.aggregate("more", F.lit(0).cast("long"), lambda a, x: a + F.when(x["bit"] < _bit(key), x["rows"]).otherwise(F.lit(0)))
    return found.select(*rows.columns, (F.col("before") + below + extra).alias("rank"), "total")


def _tied(rows: DataFrame, group: str, key: str, digest: str, copies: str) -> DataFrame:
    """Rows with ``_tie``: how many rows of equal group and key come before.

    The digests of equal keys are ranked like keys, by their first 60 bits
    below a bit that puts null keys first; only equal prefixes are sorted."""
    rows = rows.withColumn("_same", F.concat_ws("/", group, F.col("_slot_key").cast("string")))
    prefix = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    rows = rows.withColumn("_prefix", F.when(F.col(key).isNull(), prefix).otherwise(prefix.bitwiseOR(1 << 60)))
    keys = rows.groupBy("_same", "_prefix").agg(F.sum(copies).alias("_weight"))
    out = ranked(rows, bitmap_index(keys, "_same", "_prefix", "_weight"), "_same", "_prefix")
    w = Window.partitionBy("_same", "_prefix").orderBy(digest).rowsBetween(Window.unboundedPreceding, -1)
    tie = F.col("rank") + F.coalesce(F.sum(copies).over(w), F.lit(0))
    return out.withColumn("_tie", tie).drop("_same", "_prefix", "rank", "total")


def placed(rows: DataFrame, group: str, key: str, digest: str, copies: str) -> DataFrame:
    """Distinct rows with ``place`` (0-based, of the first copy) and ``total`` in their group.

    Order: null keys, then keys, equal keys by ``digest`` (hex text, one for
    each distinct row of a group and key).  ``copies``: how often a row occurs."""
    rows = rows.withColumn("_slot_key", F.coalesce(key, F.lit(-(1 << 63))))
    keys = rows.groupBy(group, "_slot_key").agg(F.sum(copies).alias("_weight"), F.count(F.lit(1)).alias("_kinds"))
    keys = landed(keys, "rank_keys")
    index = landed(bitmap_index(keys, group, "_slot_key", "_weight"), "bitmaps")
    out = ranked(rows, index, group, "_slot_key")
    tied = keys.where("_kinds > 1").select(group, "_slot_key")
    if tied.isEmpty():
        return out.withColumnRenamed("rank", "place").drop("_slot_key")
    shared = out.join(tied, [group, "_slot_key"], "left_semi")
    alone = out.join(tied, [group, "_slot_key"], "left_anti").withColumnRenamed("rank", "place")
    ties = _tied(shared.drop("rank", "total"), group, key, digest, copies).select(group, "_slot_key", digest, F.col(key).alias("_tied_key"), "_tie")
    again = shared.join(ties, [group, "_slot_key", digest]).where(F.col(key).eqNullSafe(F.col("_tied_key")))
    again = again.withColumn("place", F.col("rank") + F.col("_tie"))
    return alone.unionByName(again.select(*alone.columns)).drop("_slot_key")
