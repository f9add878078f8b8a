"""A Merkle manifest of a table, by bitmap ranks and keyed slot arrays.

Every row is a leaf.  Leaves of a group ascend by key; a leaf's place comes
from a rank query on the group's bitmap of keys (``bitmap_rank``), so no rows
are sorted.  A level is reduced by keyed slot arrays: the nodes of a run
(place divided by the fan-out) meet in an array of at most ``fanout`` slots.
One group's root is its subroot; the subroots, in order of the group, are the
leaves of the last tree.

A group that holds a third of all rows is spread by key (ranks) and by page
(reduction); nothing is gathered per group.  Equal rows are counted first and
expanded again after they have their places.

Defined results: a null group comes before all others, a null key before all
keys of its group; rows with equal group and key follow by leaf digest, and
equal rows are interchangeable; a null value is written as "-", empty text as
"0:"; an empty table gives no rows.  Other columns of the input take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trenchline.llm.bitmap_rank import placed
from trenchline.llm.common import landed

FANOUT = 16
#: columns of a document's leaf, in order
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: leaves that are dealt out together, so that two levels need no second shuffle
PAGE = 256


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 of the values: "-" for null, else UTF-8 byte count, ":", the value as text."""

    def coded(v: Column) -> Column:
        text = v.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*[coded(v) for v in values]), 256)


def _runs(nodes: DataFrame, fanout: int) -> DataFrame:
    """(group, n, run, slots): the nodes of each run in an array, by slot; ``n``: nodes of the group."""
    carried = [c for c in nodes.columns if c not in ("_group", "n", "place")]
    keyed = nodes.withColumn("page", F.floor(F.col("place") / PAGE)).repartition("_group", "page")
    slot = F.struct((F.col("place") % fanout).alias("slot"), *carried)
    runs = keyed.groupBy("_group", "page", F.floor(F.col("place") / fanout).alias("run")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(slot)).alias("slots"))
    return runs.drop("page")


def _joined(slots: str = "slots") -> Column:
    return F.array_join(F.transform(slots, lambda x: x["digest"]), "")


class _Tree:
    """The levels of the groups' trees and their tops, bottom up."""

    def __init__(self, leaves: DataFrame, largest: int, fanout: int, name: str):
        self.fanout, self.levels, tops = fanout, [landed(_runs(leaves, fanout), f"{name}_0")], []
        # a lone leaf is the top of its group
        tops.append(self.levels[0].where("n = 1").select("_group", F.col("slots")[0]["digest"].alias("digest"), F.lit(0).alias("height")))
        size = largest
        while size > 1:
            height = len(self.levels)
            below = self.levels[-1].where("n > 1")
            nodes = below.select("_group", F.ceil(F.col("n") / fanout).alias("n"), F.col("run").alias("place"), F.sha2(_joined(), 256).alias("digest"))
            size = -(-size // fanout)
            tops.append(nodes.where("n = 1").select("_group", "digest", F.lit(height).alias("height")))
            if size > 1:
                self.levels.append(landed(_runs(nodes.where("n > 1"), fanout), f"{name}_{height}"))
        self.tops = tops[0]
        for t in tops[1:]:
            self.tops = self.tops.unionByName(t)
        self.height = len(tops) - 1

    def leaves(self, tops: DataFrame) -> DataFrame:
        """All leaves with their path to the top and on; ``tops``: (_group, height, path, ...).

        A path is an array of (left, right): the joined digests of a run's
        other nodes before and after the one that is followed."""
        more = [c for c in tops.columns if c not in ("_group", "height", "path")]
        above = None
        for level in range(self.height - 1, -1, -1):
            ended = tops.where(F.col("height") == level + 1).select("_group", F.lit(0).cast("long").alias("run"), "path", *more)
            above = ended if above is None else above.unionByName(ended)
            runs = self.levels[level].where("n > 1").join(above, ["_group", "run"])
            above = _followed(runs, more, self.fanout) if level else _followed(runs, more, self.fanout, leaf=True)
        lone = self.levels[0].where("n = 1").join(tops.where("height = 0").drop("height"), "_group")
        lone = lone.select("_group", "path", *more, F.col("slots")[0].alias("node"))
        return lone if above is None else above.unionByName(lone)


def _followed(runs: DataFrame, more: list[str], fanout: int, leaf: bool = False) -> DataFrame:
    """Each node of the runs with its path: its own run's others, then the parent's path."""
    every = runs.withColumn("_all", _joined()).select("_group", "run", "_all", "path", *more, F.posexplode("slots").alias("_at", "node"))
    left = F.expr("substring(_all, 1, 64 * _at)")
    right = F.expr("substring(_all, 64 * (_at + 1) + 1)")
    path = F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("path"))
    if leaf:
        return every.select("_group", path.alias("path"), *more, "node")
    return every.select("_group", (F.col("run") * fanout + F.col("_at")).alias("run"), path.alias("path"), *more)


def _in_order(groups: DataFrame) -> DataFrame:
    """The groups with ``place``: their position in bytewise order, by sorted ranges."""
    spark = groups.sparkSession
    ranges = groups.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "_group").sortWithinPartitions("_group")
    ranges = landed(ranges.withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "merkle_groups")
    # one row for each range, not for each group
    counts = ranges.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    start = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranges.join(counts.select("_part", start.alias("_start")), "_part").withColumn("place", F.col("_start") + F.col("_nth")).drop("_part", "_nth", "_start")


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf digest gives with the siblings of ``path``."""
    return F.aggregate(path, digest, lambda a, x: F.sha2(F.concat(x["left"], a, x["right"]), 256))


def proof(path: Column) -> Column:
    """The siblings' digests, level by level, left to right, as one text."""
    return F.array_join(F.flatten(F.transform(path, lambda x: F.array(x["left"], x["right"]))), "")


def merkle_manifest(docs: DataFrame, columns=LEAF_COLUMNS, group: str = "source", key: str = "doc_id", fanout: int = FANOUT, carry: dict[str, Column] | None = None) -> DataFrame:
    """Each row's key, group, leaf, subroot, root and path (see ``fold`` and ``proof``).

    ``key`` is an integer column.  ``carry``: text columns made from the rows
    of ``docs`` that come along."""
    carry = carry or {}
    name = F.col(group).cast("string")
    coded = F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), name))
    rows = docs.select(coded.alias("_group"), F.col(key).cast("long").alias("_key"), leaf_digest([F.col(c) for c in columns]).alias("leaf"), *[v.alias(f"_c_{c}") for c, v in carry.items()])
    # equal rows become one; full rows are the key, so a hot group or a hot key is spread
    rows = landed(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies")), "merkle_rows")
    places = placed(rows, "_group", "_key", "leaf", "copies")
    largest = places.agg(F.max("total")).first()[0] or 0
    copies = places.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    kept = ["_key", *[f"_c_{c}" for c in carry]]
    leaves = copies.select("_group", (F.col("place") + F.col("_copy")).alias("place"), F.col("total").alias("n"), F.col("leaf").alias("digest"), *kept)
    tree = _Tree(leaves, largest, fanout, "merkle_level")
    tops = _in_order(tree.tops)
    tops = landed(tops, "merkle_tops")
    n_groups = tops.count()
    last = _Tree(tops.select(F.lit("").alias("_group"), "place", F.lit(n_groups).cast("long").alias("n"), "digest", F.col("_group").alias("_of"), "height"), n_groups, fanout, "merkle_top")
    roots = last.tops.select("_group", "height", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.col("digest").alias("root"))
    subroots = last.leaves(roots).select(F.col("node._of").alias("_group"), F.col("node.height").alias("height"), "path", "root", F.col("node.digest").alias("subroot"))
    out = tree.leaves(landed(subroots, "merkle_subroots"))
    of = F.when(F.col("_group") != "", F.substring("_group", 2, 1 << 30))
    return out.select(F.col("node._key").alias(key), of.alias(group), F.col("node.digest").alias("leaf"), "subroot", "root", "path", *[F.col(f"node._c_{c}").alias(c) for c in carry])
