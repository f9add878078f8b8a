"""N-gram Jaccard self-join by MinHash banding.

1. Each text's set of n-word shingles is hashed; texts with equal sets are one
   node (copies are never paired).  Bands of ``rows`` MinHash values are
   chosen so that a pair at the threshold shares a band with probability
   ``recall`` at least.
2. Nodes that share a band hash are shuffled together as candidates.  A bucket
   yields one row per node (to its least node), not pairs; components of
   these rows are the candidate groups.
3. All nodes of a candidate group are compared on their full sets.  A large
   group is split by set length (sets whose sizes differ by more than the
   threshold allows cannot match) and into chunks; a task compares one pair
   of chunks and returns one row per node: its links and its class in the
   chunk pair.  No pair is emitted and none is skipped.
4. Components of the verified links are the classes.

Null or empty text: no shingles, no links, a class of its own.  A text of
fewer than n words has one shingle, its whole word sequence.  Repeated rows
are copies of each other.  Rows with a null doc_id belong to classes like any
other; the class id is the least non-null doc_id of the class.  A very long
text is one set like any other.  An empty table gives no rows.  Only doc_id
and text are read; ``keep_one`` gives all columns back, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trenchline.llm.common import landed
from trenchline.llm.components import components
from trenchline.llm.words import coded_words, joined, lengths_to_offsets, mix, pieces, tune, window_hashes, word_hashes

CHUNK = 256
COLUMNS = 4096


def choose_bands(threshold: float, recall: float, most: int = 160) -> tuple[int, int]:
    """(bands, rows): the most selective banding within ``most`` hashes that keeps the recall at the threshold."""
    best = None
    for rows in range(1, 33):
        hit = threshold**rows
        bands = 1 if hit >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit)))
        if bands * rows <= most:
            best = bands, rows
    return best or (most, 1)


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Ascending distinct 64-bit shingle hashes of each text."""
    offsets, codes, words = coded_words(texts)
    h = word_hashes(words.to_pylist())[codes] if len(codes) else np.zeros(0, np.uint64)
    wide = window_hashes(h, n)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(wide[a : b - n + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for i in range(a, b):
                whole = joined(whole, h[i : i + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(shingles: np.ndarray) -> str | None:
    return hashlib.blake2b(shingles.astype("<u8").tobytes(), digest_size=16).hexdigest() if len(shingles) else None


def signatures(sets: list[np.ndarray], bands: int, rows: int, seed: int = 1) -> np.ndarray:
    """Band hashes, one row for each set (sets must not be empty)."""
    if not sets:
        return np.zeros((0, bands), np.uint64)
    rng = np.random.default_rng(seed)
    factors = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    masks = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    flat = np.concatenate(sets)
    starts = lengths_to_offsets(np.array([len(s) for s in sets]))[:-1]
    out = np.empty((len(sets), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(sets), band + 1, np.uint64)
        for r in range(rows):
            p = band * rows + r
            key = joined(key, np.minimum.reduceat((flat ^ masks[p]) * factors[p], starts))
        out[:, band] = key
    return out


SIGNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text_hash", T.LongType()),
        T.StructField("node", T.StringType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)
SETS = T.StructType([T.StructField("node", T.StringType()), T.StructField("shingles", T.BinaryType())])
VERIFIED = T.StructType([T.StructField("node", T.StringType()), T.StructField("links", T.LongType()), T.StructField("root", T.StringType())])


def compare(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix: Jaccard of left set i and right set j reaches the threshold."""
    size = np.array([len(s) for s in sets], np.int64)
    _, code, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    shared = df[code] > 1
    column = np.cumsum(df > 1) - 1
    col, row = column[code[shared]], owner[shared]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    common = np.zeros((len(left), len(right)), np.int64)
    total = int(col[-1]) + 1 if len(col) else 0
    for a in range(0, total, COLUMNS):
        x, y = np.searchsorted(col, [a, a + COLUMNS])
        grid = np.zeros((len(sets), min(COLUMNS, total - a)), np.float32)
        grid[row[x:y], col[x:y] - a] = 1
        common += np.rint(grid[left] @ grid[right].T).astype(np.int64)
    union = size[left][:, None] + size[right][None, :] - common
    return common >= threshold * union - 1e-9


def _classes(links: np.ndarray) -> np.ndarray:
    """Least index of each row's component in a symmetric boolean matrix."""
    label = np.arange(len(links))
    while True:
        best = np.minimum(label, np.where(links, label[None, :], len(links)).min(axis=1, initial=len(links)))
        best = np.minimum(best, best[best])
        if (best == label).all():
            return label
        label = best


def _verify(names: list[str], sides: list[int], weights: list[int], blobs: list[bytes], threshold: float) -> pa.RecordBatch:
    """Links within (side 0 alone) or between (sides 0 and 1) the nodes of a chunk pair."""
    sets = [np.frombuffer(b, "<u8") for b in blobs]
    side, weight, n = np.array(sides), np.array(weights), len(names)
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1)
    links = np.zeros((n, n), bool)
    if len(right):
        found = compare(sets, left, right, threshold)
        links[np.ix_(left, right)] = found
        links[np.ix_(right, left)] = found.T
    else:
        links = compare(sets, left, left, threshold)
        np.fill_diagonal(links, False)
    at = np.flatnonzero(links.any(axis=1))
    label = _classes(links)
    return pa.RecordBatch.from_arrays(
        [pa.array([names[i] for i in at], pa.string()), pa.array((links[at] @ weight).astype(np.int64)), pa.array([names[label[i]] for i in at], pa.string())], names=VERIFIED.names
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class: the least doc_id (then least text hash), once.

    Empty texts are classes by doc_id; those without doc_id are one class.
    All columns of ``docs`` come back as they are, whatever their names."""
    of, text, mine, key = (unused(c, docs) for c in ("of", "hash", "doc", "key"))
    found = near_duplicates(docs.select("doc_id", "text"), **options)
    chosen = found.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("one"))
    chosen = chosen.select(F.col("one.doc_id").alias(of), F.col("one.text_hash").alias(text))
    rows = docs.withColumn(key, F.xxhash64(F.col("text").cast("string"))).withColumn(mine, F.col("doc_id").cast("long"))
    kept = rows.join(chosen, F.col(mine).eqNullSafe(F.col(of)) & F.col(key).eqNullSafe(F.col(text)), "left_semi")
    return kept.dropDuplicates([mine, key]).drop(mine, key)


def unused(name: str, df: DataFrame) -> str:
    """A column name that ``df`` does not have."""
    name = f"_{name}"
    while name.lower() in (c.lower() for c in df.columns):
        name = f"_{name}"
    return name


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """(doc_id, text_hash, class_key, class_id, n_links) for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    tune(spark)
    bands, rows = choose_bands(threshold, recall)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    source = source.withColumn("text_hash", F.xxhash64("text"))

    def sign(batches):
        for batch in pieces(batches):
            sets = shingle_sets(batch.column("text"), n)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = signatures([sets[i] for i in full], bands, rows).view(np.int64)
            lists: list = [None] * len(sets)
            for i, k in zip(full, keys.tolist()):
                lists[i] = k
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array([node_of(s) for s in sets], pa.string()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(lists, pa.list_(pa.int64())),
                ],
                names=SIGNED.names,
            )

    signed = landed(source.mapInArrow(sign, SIGNED), "signatures")
    nodes = signed.where("node is not null").groupBy("node").agg(
        F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"), F.min(F.struct("doc_id", "text_hash")).alias("one"), F.min("doc_id").alias("least_id"), F.first("bands").alias("bands")
    )
    nodes = landed(nodes, "nodes")
    banded = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most")
    near = banded.join(buckets.select("band", "key", "least"), ["band", "key"]).where("node <> least")
    groups = components(near.select(F.col("node").alias("a"), F.col("least").alias("b")))
    members = groups.join(nodes.drop("bands"), "node")
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("group_size"))
    members = members.join(sizes, "root")
    # sets that match differ by at most one step in length class
    step = math.log(1 / threshold) if threshold < 1 else math.log(2)
    members = members.withColumn("class", F.when(F.col("group_size") <= CHUNK, F.lit(0)).otherwise(F.floor(F.log("n_shingles") / F.lit(step) + F.lit(1e-9))).cast("int"))
    counts = members.groupBy("root", "class").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).cast("int").alias("chunks"))
    next_counts = counts.select("root", (F.col("class") - 1).alias("class"), F.col("chunks").alias("next_chunks"))
    last_counts = counts.select("root", (F.col("class") + 1).alias("class"), F.col("chunks").alias("last_chunks"))
    members = members.join(counts, ["root", "class"]).join(next_counts, ["root", "class"], "left").join(last_counts, ["root", "class"], "left")
    members = members.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))

    def upto(count: str, x) -> F.Column:
        return F.expr(f"if({count} is null or {count} = 0, array(), transform(sequence(0, {count} - 1), j -> {x}))")

    kind = "named_struct('cell', concat_ws(':', {cell}), 'side', {side})"
    same = upto("chunks", kind.format(cell="class, least(j, chunk), class, greatest(j, chunk)", side="if(chunk <= j, 0, 1)"))
    later = upto("next_chunks", kind.format(cell="class, chunk, class + 1, j", side="0"))
    earlier = upto("last_chunks", kind.format(cell="class - 1, j, class, chunk", side="1"))
    cells = members.select("root", "node", "copies", "one", F.concat(same, later, earlier).alias("cells"))

    # the sets, made anew from one text of each candidate node
    wanted = members.select("node", F.col("one.doc_id").alias("one_id"), F.col("one.text_hash").alias("one_hash"))
    texts = source.join(wanted, F.col("text_hash").eqNullSafe(F.col("one_hash")) & F.col("doc_id").eqNullSafe(F.col("one_id"))).select("node", "text")

    def make_sets(batches):
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.astype("<u8").tobytes() for s in shingle_sets(batch.column("text"), n)], pa.binary())], names=SETS.names)

    sets = texts.mapInArrow(make_sets, SETS)
    dealt = cells.join(sets, "node").select("root", "node", "copies", "shingles", F.explode("cells").alias("at"))
    dealt = dealt.select(F.concat_ws("/", "root", "at.cell").alias("cell"), F.col("at.side").cast("int").alias("side"), "node", "copies", "shingles")
    ordered = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell").sortWithinPartitions("cell", "node")

    def check(batches):
        open_cell, held = None, {}

        def close():
            names = list(held)
            return _verify(names, [held[k][0] for k in names], [held[k][1] for k in names], [held[k][2] for k in names], threshold)

        for batch in batches:
            for cell, side, node, copies, blob in zip(*[batch.column(c).to_pylist() for c in ("cell", "side", "node", "copies", "shingles")]):
                if cell != open_cell:
                    if len(held) > 1:
                        yield close()
                    open_cell, held = cell, {}
                held[node] = (side, copies, blob)  # repeated rows of one text: once
        if len(held) > 1:
            yield close()

    verified = landed(ordered.mapInArrow(check, VERIFIED), "verified")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    # classes are worked out on nodes, whatever the number of their copies; each join reads landed
    # tables on both sides, so that a class or a node with very many rows can be split
    facts = nodes.select("node", "copies", "least_id").join(roots, "node", "left").join(links, "node", "left")
    facts = landed(facts.withColumn("class", F.coalesce("root", "node")).drop("root"), "facts")
    ids = landed(facts.groupBy("class").agg(F.min("least_id").alias("class_id")), "class_ids")
    facts = landed(facts.join(ids, "class").drop("least_id"), "classes")
    out = signed.select("doc_id", "text_hash", "node").join(facts, "node", "left")
    return out.select(
        "doc_id",
        "text_hash",
        F.coalesce("class", F.concat(F.lit("empty "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("class_key"),
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
    )
