"""SpotSigs document fingerprints.

A spot is an occurrence of a common word (antecedent); its signature is the
antecedent with the chain of the next content words.  A text's fingerprint is
the set of its signatures as ascending 32-bit hashes, written in base64 so
that the whole set can be compared.  A text with words but no spot takes every
word as antecedent; a text without words has the empty fingerprint.

Likeness is the Jaccard similarity of two sets; two empty sets are alike (1).
``spot_pairs`` joins all texts whose likeness reaches a threshold: sets are
partitioned by length (matching lengths fall into the same or adjacent
classes) and probed by the rarest signatures, enough of which two alike sets
must share, then compared with length and overlap bounds.

Null text: empty.  Repeated rows and ties in doc_id are documents of their
own, ordered by text after doc_id; null ids come first.  A table of one row:
the next document is the row itself.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trenchline.llm.common import landed
from trenchline.llm.words import coded_words, joined, pieces, tune, word_hashes

# Very common words of English, German, French and Spanish.
ANTECEDENTS = "the a an is of and to in that for it der die das ein eine ist und zu le la les un une est et de que des el los las y es en".split()
# Further common words that chains pass over.
PASSED = "on as was with be by are this from at or not but have von mit den dem im nicht auf für sie pour dans par sur au du pas qui se del con por su al no lo".split()
MARKS = ".,;:!?\"'()[]{}*_~#%$&<>|-"
CHAIN = 2


def spot_sets(texts: pa.Array, chain: int = CHAIN) -> tuple[np.ndarray, np.ndarray]:
    """(document * 2^32 + signature, ascending and distinct; offsets of each document)."""
    n = len(texts)
    offsets, codes, words = coded_words(texts, lower=True)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    bare = pc.utf8_trim(words, MARKS)
    bare = pc.if_else(pc.equal(bare, ""), words, bare)
    h = word_hashes(bare.to_pylist())[codes]
    common = pc.is_in(bare, value_set=pa.array(ANTECEDENTS)).to_numpy(zero_copy_only=False)[codes]
    passed = pc.is_in(bare, value_set=pa.array(ANTECEDENTS + PASSED)).to_numpy(zero_copy_only=False)[codes]
    doc = np.repeat(np.arange(n), np.diff(offsets))
    content = np.flatnonzero(~passed)
    ends = np.searchsorted(content, offsets[1:])  # content words up to the end of each document

    def signatures(at: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
        sig = h[at]
        nth = np.searchsorted(content, at + 1)
        have = np.minimum(ends[doc[at]] - nth, chain)
        for k in range(chain):
            more = have > k
            sig = np.where(more, joined(sig, h[content[np.minimum(nth + k, len(content) - 1)]]) if len(content) else sig, sig)
        ok = have >= need
        return doc[at][ok], sig[ok]

    d, s = signatures(np.flatnonzero(common), chain)
    bare_docs = np.flatnonzero((np.bincount(d, minlength=n) == 0) & (np.diff(offsets) > 0))
    if len(bare_docs):
        lone = np.zeros(n, bool)
        lone[bare_docs] = True
        d2, s2 = signatures(np.flatnonzero(lone[doc]), 0)
        d, s = np.concatenate([d, d2]), np.concatenate([s, s2])
    keys = np.unique((d.astype(np.uint64) << np.uint64(32)) | (s >> np.uint64(32)))
    return keys, np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))


def fingerprints(keys: np.ndarray, offsets: np.ndarray) -> list[str]:
    low = memoryview((keys & np.uint64(0xFFFFFFFF)).astype(">u4").tobytes())
    return [base64.b64encode(low[4 * a : 4 * b]).decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def unpack(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u4")


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Likeness of two signature sets; 0 at once if their lengths rule out ``least``."""
    if not len(a) and not len(b):
        return 1.0
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def likeness(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> np.ndarray:
    """Jaccard of the i-th sets of two families of equal size (keys as from ``spot_sets``)."""
    n = len(a_at) - 1
    same = np.bincount((np.intersect1d(a, b, assume_unique=True) >> np.uint64(32)).astype(np.int64), minlength=n)[:n]
    union = np.diff(a_at) + np.diff(b_at) - same
    return np.where(union > 0, same / np.maximum(union, 1), 1.0)


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """Rows dealt by doc_id range and sorted, each part followed by the first row of the next (``borrowed``).

    The last part is followed by the first row of all.  One shuffle of the
    texts; the bounds come from quantiles of doc_id, and from the text's hash
    where one doc_id (or none) holds more than a part."""
    rows = docs.withColumn("tie", F.xxhash64("text"))
    cuts = []
    if parts > 1:
        low = F.coalesce("doc_id", F.lit(-(1 << 63)))
        cuts = rows.agg(F.percentile_approx(low, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    part = F.lit(0)
    if cuts:  # bounded: fewer than ``parts`` cuts; an id that holds several is cut by the hash of its texts
        bounds = []
        for cut, n in sorted(Counter(cuts).items()):
            known = cut > -(1 << 63)
            bounds += [F.struct(F.lit(known).alias("known"), F.lit(cut if known else None).cast("long").alias("doc_id"), F.lit(-(1 << 63) + (j << 64) // n).cast("long").alias("tie")) for j in range(n)]
        own = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id"), F.col("tie"))
        part = F.size(F.filter(F.array(*bounds), lambda c: c <= own)).cast("int")
    rows = rows.withColumn("part", part)
    firsts = sorted(((r["part"], r["one"]) for r in rows.select("part", "doc_id", "tie").groupBy("part").agg(F.min(F.struct("doc_id", "tie")).alias("one")).collect()), key=lambda r: r[0])
    if not firsts:
        return rows.withColumn("borrowed", F.lit(0)).drop("tie")
    # bounded: at most ``parts`` rows, so a broadcast whatever the input
    heads = docs.sparkSession.createDataFrame([(one["doc_id"], one["tie"], firsts[i - 1][0]) for i, (_, one) in enumerate(firsts)], "head_id long, head_tie long, lent_to int")
    rows = rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie")), "left")
    at = F.col("lent_to")
    copies = F.when(at.isNull(), F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("borrowed")))).otherwise(
        F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("borrowed")), F.struct(at.alias("part"), F.lit(1).alias("borrowed")))
    )
    rows = rows.withColumn("to", copies).drop("part").select("*", F.explode("to").alias("where")).select("doc_id", "text", "tie", "where.part", "where.borrowed")
    return rows.repartition(parts, "part").sortWithinPartitions("part", "borrowed", "doc_id", "tie").drop("tie")


OUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def edited_text(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_with_edits(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to it and to the next document."""
    spark = docs.sparkSession
    tune(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = in_order(source, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def emit(ids: list, texts: list[str]) -> pa.RecordBatch:
        """The last text is the next document of the one before it and gives no row."""
        mine = texts[:-1]
        edits = [edited_text(a, b) for a, b in zip(mine, texts[1:])]
        keys, at = spot_sets(pa.array(texts, pa.large_string()).cast(pa.string()), chain)
        own, own_at = keys[: at[-2]], at[:-1]
        following = keys[at[1] :] - (np.uint64(1) << np.uint64(32))
        edit_keys, edit_at = spot_sets(pa.array(edits, pa.string()), chain)
        cols = [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in mine], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits]),
            pa.array(fingerprints(own, own_at)),
            pa.array(fingerprints(edit_keys, edit_at)),
            pa.array(likeness(own, own_at, edit_keys, edit_at)),
            pa.array(likeness(own, own_at, following, at[1:] - at[1])),
        ]
        return pa.RecordBatch.from_arrays(cols, names=OUT.names)

    def run(batches) -> Iterator[pa.RecordBatch]:
        ids, texts, size, part = [], [], 0, None
        closed = True
        for batch in pieces(batches):
            for doc_id, text, p, borrowed in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "borrowed")]):
                if p != part:
                    part, ids, texts, size, closed = p, [], [], 0, False
                if closed:
                    continue  # a tie of the borrowed row
                texts.append(text)
                size += len(text)
                if borrowed:
                    if ids:
                        yield emit(ids, texts)
                    closed = True
                elif size > 4 << 20 and ids:
                    yield emit(ids, texts)
                    ids, texts, size = [doc_id], [text], len(text)
                else:
                    ids.append(doc_id)

    return ordered.mapInArrow(run, OUT)


SIGS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_spots", T.IntegerType()), T.StructField("spots", T.ArrayType(T.LongType()))])


def _signed(docs: DataFrame, chain: int) -> DataFrame:
    """(doc_id, n_spots, spots, class_id) of every row; rows of equal signature sets share a class_id, a hash of the set."""
    tune(docs.sparkSession)

    def sign(batches):
        for batch in pieces(batches):
            keys, at = spot_sets(pc.fill_null(batch.column("text"), ""), chain)
            low = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(low))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at).astype(np.int32)), lists], names=SIGS.names)

    signed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(sign, SIGS)
    return signed.withColumn("class_id", F.md5(F.array_join(F.col("spots").cast("array<string>"), ",")))


def spot_members(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """(doc_id, class_id) of every row; null for an empty fingerprint."""
    return _signed(docs, chain).select("doc_id", F.when(F.col("n_spots") > 0, F.col("class_id")).alias("class_id"))


def spot_pairs(docs: DataFrame, threshold: float = 0.8, chain: int = CHAIN) -> DataFrame:
    """(a, b, likeness, class_a, class_b) of pairs of classes that reach the threshold.

    A class is all rows of one fingerprint (its rows: ``spot_members``); a and b are
    the least doc_ids of the classes, which may be null or, where ids repeat, equal.
    The smaller set comes first, then the lesser id.  A set's prefix is its rarest
    signatures, as many as two sets at the threshold cannot both miss; prefixes meet
    by (length class, signature).  Empty fingerprints are paired with nothing."""
    signed = _signed(docs, chain).where("n_spots > 0")
    classes = landed(signed.groupBy(F.col("class_id").alias("key")).agg(F.min("doc_id").alias("id"), F.first("n_spots").alias("n"), F.first("spots").alias("spots")), "spot_classes")
    df = classes.select(F.explode("spots").alias("spot")).groupBy("spot").agg(F.count(F.lit(1)).alias("df"))
    ranked = classes.select("key", "n", F.explode("spots").alias("spot")).join(df, "spot")
    rare = ranked.groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("df", "spot"))).alias("order"))
    prefix = rare.select("key", "n", F.explode(F.slice("order", F.lit(1), (F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1).cast("int"))).alias("o"))
    step = math.log(1 / threshold)
    probe = prefix.select("key", "n", F.col("o.spot").alias("spot"), F.floor(F.log("n") / F.lit(step) + 1e-9).cast("int").alias("class"))
    left = probe.select(F.col("key").alias("class_a"), F.col("n").alias("na"), "spot", F.explode(F.array("class", F.col("class") + 1)).alias("class"))
    right = probe.select(F.col("key").alias("class_b"), F.col("n").alias("nb"), "spot", "class")
    fits = (F.col("na") <= F.col("nb")) & (F.col("na") >= threshold * F.col("nb")) & ((F.col("na") < F.col("nb")) | (F.col("class_a") < F.col("class_b")))
    pairs = left.join(right, ["spot", "class"]).where(fits).select("class_a", "class_b").distinct()
    one, two = (classes.select(F.col("key").alias(f"class_{x}"), F.struct("n", F.col("id").isNotNull().alias("known"), "id", "key").alias(x), F.col("spots").alias(f"s{x}")) for x in "ab")
    full = pairs.join(one, "class_a").join(two, "class_b")
    common = F.size(F.array_intersect("sa", "sb"))
    full = full.withColumn("likeness", common / (F.size("sa") + F.size("sb") - common)).where(F.col("likeness") >= threshold - 1e-12)
    full = full.select("likeness", F.sort_array(F.array("a", "b")).alias("ab"))
    a, b = F.col("ab")[0], F.col("ab")[1]
    return full.select(a["id"].alias("a"), b["id"].alias("b"), "likeness", a["key"].alias("class_a"), b["key"].alias("class_b"))
