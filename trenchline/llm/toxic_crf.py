"""Toxic spans by a linear-chain conditional random field.

Two states per word, clean and toxic.  Emission weights belong to features of
the word alone (its form without case and outer marks, its last letters, its
shape); transition weights join neighbours.  Labels mark documents, so tokens
are labelled first: a word form of toxic documents is a toxic token where its
distinct contexts (word before, word, word after) lie in toxic documents far
more often than chance allows (Chernoff bound, corrected for the number of
forms tested).  Copies of a text share their contexts and count once.  The
weights are then fitted by gradient ascent on the exact likelihood.

Contexts are counted by Spark aggregates and texts never reach the driver: it
gets the toxic word forms, at most ``SEGMENTS`` segments of ``SEGMENT`` words
with a toxic token and as many without (least hash first), and two numbers of
each sampled document for the calibration.

Forward-backward marginals give each document's score (a logistic function of
how much toxic mass it holds) and the offending spans.  Long texts are run in
overlapping windows; the overlap is far longer than the chain's memory.

Inputs of a score: the text alone.  Null or empty text: no tokens, no spans,
the score of a text without toxic mass.  No labelled rows, or none toxic:
every score is the prior.  Repeated rows get equal scores.  An empty table
gives no rows.  Input columns named like an output column (toxic_score,
toxic_spans) give way to it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trenchline.llm.common import landed
from trenchline.llm.words import coded_words, joined, lengths_to_offsets, mix, pieces, schema_of, tune, word_hashes

#: most labelled documents that the model is fitted on (least hash of doc_id first)
SAMPLE_DOCS = 12_000
#: words of a training segment, and most segments with a toxic token, and without one
SEGMENT, SEGMENTS = 48, 6_000
#: characters of a word form; a longer word's form is a digest of it
FORM_CHARS = 64
#: words of a scoring window and of the overlap on either side
WINDOW, OVERLAP = 256, 24
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MARKS = ".,;:!?\"'()[]{}*_~#%$&<>|-"


def forms(words: list[str]) -> list[str]:
    out = [w.strip(MARKS).lower() or w for w in words]
    return [f if len(f) <= FORM_CHARS else hashlib.blake2b(f.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() for f in out]


def shape(word: str) -> str:
    core = word.strip(MARKS)
    return "mark" if not core else "digit" if any(c.isdigit() for c in core) else "upper" if len(core) > 1 and core.isupper() else "title" if core[:1].isupper() else "plain"


def word_features(word: str, form: str) -> list[str]:
    return ["w=" + form, "s=" + form[-3:], "k=" + shape(word)]


@dataclass
class Crf:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    calibration: tuple[float, float] = (-3.0, 6.0)  # logit = first + second * toxic mass in (0, 1)

    def emissions(self, words: list[str]) -> np.ndarray:
        get = self.weights.get
        return np.array([self.bias + sum(get(f, 0.0) for f in word_features(w, s)) for w, s in zip(words, forms(words))], float)


def forward_backward(u: np.ndarray, here: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginal of toxic, forward, backward) for segments x positions; ``here``: real positions (a prefix of each row)."""
    a = np.exp(trans)
    e = np.exp(np.clip(u, -30, 30))
    rows, n = u.shape
    fwd, bwd = np.empty((n, rows)), np.empty((n, rows))
    eT, hT = np.ascontiguousarray(e.T), np.ascontiguousarray(here.T)
    p = np.zeros(rows)  # before the first word: clean
    for t in range(n):
        toxic = ((1 - p) * a[0, 1] + p * a[1, 1]) * eT[t]
        p = toxic / (toxic + (1 - p) * a[0, 0] + p * a[1, 0])
        fwd[t] = p
    q = np.full(rows, 0.5)
    for t in range(n - 1, -1, -1):
        q = np.where(hT[t], q, 0.5)
        bwd[t] = q
        toxic = (1 - q) * a[1, 0] + q * a[1, 1] * eT[t]
        clean = (1 - q) * a[0, 0] + q * a[0, 1] * eT[t]
        q = np.where(hT[t], toxic / (toxic + clean), 0.5)
    fwd, bwd = fwd.T, bwd.T
    both = fwd * bwd
    return both / (both + (1 - fwd) * (1 - bwd)), fwd, bwd


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(form, context, toxic) of the distinct contexts of a piece of the sample."""
    for batch in pieces(batches):
        offsets, codes, words = coded_words(batch.column("text"))
        if not len(codes):
            continue
        coded = pa.array(forms(words.to_pylist()), pa.string()).dictionary_encode()
        form = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes]
        f = word_hashes(coded.dictionary.to_pylist())[form]
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        before, after = np.zeros_like(f), np.zeros_like(f)
        before[1:] = np.where(doc[1:] == doc[:-1], f[:-1], 0)
        after[:-1] = np.where(doc[1:] == doc[:-1], f[1:], 0)
        key = joined(joined(before, f), after)
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int32)
        least = np.minimum.reduceat(toxic[doc][order], first)
        yield pa.RecordBatch.from_arrays(
            [coded.dictionary.take(pa.array(form[order[first]])), pa.array(key[order[first]].view(np.int64)), pa.array(least)], names=["form", "context", "toxic"]
        )


def toxic_forms(sample: DataFrame, level: float = 0.01) -> list[str]:
    """The word forms whose contexts lie in toxic documents beyond chance."""
    contexts = sample.select("text", "toxic").mapInArrow(_contexts, "form string, context long, toxic int")
    # a context that a clean text has is clean
    once = contexts.groupBy("form", "context").agg(F.min("toxic").alias("toxic"))
    counts = landed(once.groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("hits")), "toxic_forms")
    n, k, tested = counts.agg(F.sum("n"), F.sum("hits"), F.count_if(F.col("n") >= 3)).first()
    if not k or k == n:
        return []
    base = k / n
    p = F.col("hits") / F.col("n")
    kl = p * F.log(p / base) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - base))).otherwise(0.0)
    found = counts.where((F.col("n") >= 3) & (F.col("hits") > 0) & (p > max(0.5, base)))
    found = found.where(F.col("n") * kl > float(np.log(max(1, tested) / level)))
    return sorted(r["form"] for r in found.select("form").collect())


def _segments(marked: list[str]):
    """Training segments: words, token labels, whether one is toxic, and a hash to choose by."""
    known = set(marked)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            offsets, codes, words = coded_words(batch.column("text"))
            if not len(codes):
                continue
            form = forms(words.to_pylist())
            hit = np.array([f in known for f in form], bool)
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False) > 0
            lengths = np.diff(offsets)
            label = hit[codes] & np.repeat(toxic, lengths)
            count = -(-lengths // SEGMENT)
            doc = np.repeat(np.arange(len(lengths)), count)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = offsets[:-1][doc] + nth * SEGMENT
            held = lengths_to_offsets(label)
            end = np.minimum(start + SEGMENT, offsets[1:][doc])
            bounds = pa.array(np.append(start, len(codes)), pa.int32())
            pick = joined(mix(batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)[doc]), nth.astype(np.uint64))
            # features need the form and the shape of a word; a word beyond FORM_CHARS has its form's digest
            short = pa.array([w if len(w) <= FORM_CHARS else f for w, f in zip(words.to_pylist(), form)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(held[end] > held[start]),
                    pa.array(pick.view(np.int64)),
                    pa.ListArray.from_arrays(bounds, short.take(pa.array(codes))),
                    pa.ListArray.from_arrays(bounds, pa.array(label.astype(np.int8))),
                ],
                names=["has", "pick", "words", "labels"],
            )

    return cut


def training_segments(sample: DataFrame, marked: list[str], most: int = SEGMENTS) -> list:
    """At most ``most`` segments with a toxic token and as many without one, least hash first."""
    every = sample.select("doc_id", "text", "toxic").mapInArrow(_segments(marked), "has boolean, pick long, words array<string>, labels array<tinyint>")
    every = landed(every, "segments")
    out = []
    for has in (True, False):
        out += every.where(F.col("has") == has).orderBy("pick", "words").limit(most).collect()
    return out


def fit(sample: DataFrame, rounds: int = 60, ridge: float = 1e-5, most_segments: int = SEGMENTS) -> Crf:
    """The model of ``sample`` (doc_id, text, toxic)."""
    model = Crf()
    n, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n:
        return model
    rate = min(max(toxic / n, 1e-3), 1 - 1e-3)
    model.calibration = (float(np.log(rate / (1 - rate))), 0.0)
    marked = toxic_forms(sample)
    if not marked:
        return model
    segments = training_segments(sample, marked, most_segments)
    lengths = np.array([len(r["labels"]) for r in segments])
    coded = pa.array([w for r in segments for w in r["words"]], pa.string()).dictionary_encode()
    codes, mine = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
    labels = np.array([y for r in segments for y in r["labels"]], np.int64)
    step = np.arange(SEGMENT)
    here = step < lengths[:, None]
    at = np.minimum(lengths_to_offsets(lengths)[:-1, None] + step, len(codes) - 1)
    code, y = codes[at], np.where(here, labels[at], 0)
    vocabulary: dict[str, int] = {}
    feature_ids = np.array([[vocabulary.setdefault(f, len(vocabulary)) for f in word_features(w, s)] for w, s in zip(mine, forms(mine))])
    w, bias, trans = np.zeros(len(vocabulary)), -4.0, np.zeros((2, 2))
    square = [np.full(len(vocabulary), 1e-6), 1e-6, np.full((2, 2), 1e-6)]
    pair = here[:, 1:]
    seen = np.array([[np.sum(pair & (y[:, :-1] == a) & (y[:, 1:] == b)) for b in (0, 1)] for a in (0, 1)], float)
    for _ in range(rounds):
        u = (bias + w[feature_ids].sum(axis=1))[code]
        grad_u, expected = np.zeros(len(mine)), np.zeros(4)
        for part in np.array_split(np.arange(len(segments)), -(-len(segments) // 2048)):  # a bounded number of segments at once
            marginal, fwd, bwd = forward_backward(u[part], here[part], trans)
            miss = np.where(here[part], y[part] - marginal, 0.0)
            grad_u += np.bincount(code[part].ravel(), miss.ravel(), minlength=len(mine))
            expected += _pair_counts(u[part], pair[part], fwd, bwd, trans)
        grad_w = np.zeros(len(vocabulary))
        for k in range(feature_ids.shape[1]):
            grad_w += np.bincount(feature_ids[:, k], grad_u, minlength=len(vocabulary))
        grads = [grad_w - ridge * len(segments) * w, grad_u.sum(), seen - expected.reshape(2, 2)]
        for s, g in zip(range(3), grads):
            square[s] = square[s] + g**2
        w = w + 1.0 * grads[0] / np.sqrt(square[0])
        bias = bias + 0.5 * grads[1] / np.sqrt(square[1])
        trans = np.clip(trans + 0.2 * grads[2] / np.sqrt(square[2]), -4, 4)
    names = list(vocabulary)
    model.weights = {names[i]: float(w[i]) for i in np.flatnonzero(np.abs(w) > 0.01)}
    model.bias, model.trans = float(bias), trans
    # two numbers of each sampled document
    mass = sample.select("text", "toxic").mapInArrow(_masses(sample.sparkSession.sparkContext.broadcast(model)), "mass double, toxic int")
    rows = np.array(sorted(map(tuple, mass.collect())), float).reshape(-1, 2)
    model.calibration = _logistic(rows[:, 0], rows[:, 1])
    return model


def _pair_counts(u: np.ndarray, pair: np.ndarray, fwd: np.ndarray, bwd: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Expected number of each transition (clean-clean, clean-toxic, toxic-clean, toxic-toxic)."""
    f, e, b = fwd[:, :-1], np.exp(np.clip(u[:, 1:], -30, 30)), bwd[:, 1:]
    a = np.exp(trans)
    joint = [(1 - f) * a[0, 0] * (1 - b), (1 - f) * a[0, 1] * e * b, f * a[1, 0] * (1 - b), f * a[1, 1] * e * b]
    norm = sum(joint)
    return np.array([np.sum(np.where(pair, x / norm, 0.0)) for x in joint])


def _masses(shared):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            offsets, codes, words = coded_words(batch.column("text"))
            u = shared.value.emissions(words.to_pylist())[codes] if len(codes) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(toxic_mass(marginals(shared.value, u, offsets), offsets)), batch.column("toxic").cast(pa.int32())], names=["mass", "toxic"])

    return measure


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> tuple[float, float]:
    """(intercept, slope) by Newton steps with a small ridge; the slope is not negative."""
    z = np.stack([np.ones(len(x)), x], axis=1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), z.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(max(b[1], 0.0))


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word read, words read, first word kept, words kept) of every window of every text."""
    lengths = np.diff(offsets)
    count = -(-lengths // WINDOW)
    doc = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    keep = offsets[:-1][doc] + nth * WINDOW
    kept = np.minimum(WINDOW, offsets[1:][doc] - keep)
    read = np.maximum(offsets[:-1][doc], keep - OVERLAP)
    return read, np.minimum(offsets[1:][doc], keep + kept + OVERLAP) - read, keep, kept


def marginals(model: Crf, u: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marginal probability of the toxic state for every word of a batch of texts."""
    out = np.zeros(len(u))
    read, n, keep, kept = windows(offsets)
    order = np.argsort(n, kind="stable")
    for a in range(0, len(order), 4096):
        mine = order[a : a + 4096]
        width = int(n[mine].max())
        step = np.arange(width)
        here = step < n[mine][:, None]
        at = np.minimum(read[mine][:, None] + step, len(u) - 1)
        m, _, _ = forward_backward(np.where(here, u[at], 0.0), here, model.trans)
        held = here & (at >= keep[mine][:, None]) & (at < (keep + kept)[mine][:, None])
        out[at[held]] = m[held]
    return out


def toxic_mass(p: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text, 1 - product of (1 - p) over words more likely toxic than not, with a small share of the largest other marginal."""
    hard = lengths_to_offsets_float(np.where(p > 0.5, -np.log1p(-np.minimum(p, 1 - 1e-9)), 0.0))
    sure = 1 - np.exp(-(hard[offsets[1:]] - hard[offsets[:-1]]))
    best = np.zeros(len(offsets) - 1)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        best[full] = np.maximum.reduceat(p, offsets[:-1][full])
    return np.maximum(sure, best)


def lengths_to_offsets_float(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(x)])


def training_sample(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """At most ``sample_docs`` labelled texts outside the held-out fold, one for
    each doc_id (the least text hash): (doc_id, text, toxic), landed."""
    tune(docs.sparkSession)
    marked = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marked = marked.where(~held_out("doc_id"))
    # the rows of least hash are known from the labels alone; texts are read for those
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id")  # two numbers of each sampled document
    one = F.min(F.struct(F.xxhash64("text").alias("tie"), "text")).alias("one")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return landed(rows.groupBy("doc_id", "toxic").agg(one).select("doc_id", "one.text", "toxic").repartition(parts, "doc_id"), "toxic_sample")


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def score_documents(docs: DataFrame, model: Crf) -> DataFrame:
    """All rows with toxic_score (0 to 1) and toxic_spans (code-point offsets of words found toxic)."""
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the training sample
    spans = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = schema_of(docs, [("toxic_score", T.DoubleType()), ("toxic_spans", spans)])
    carry = [f.name for f in schema.fields[:-2]]

    def run(batches):
        crf = shared.value
        first, second = crf.calibration
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        for batch in pieces(batches):
            texts = batch.column("text")
            offsets, codes, words = coded_words(texts)
            u = crf.emissions(words.to_pylist())[codes] if len(codes) else np.zeros(0)
            p = marginals(crf, u, offsets)
            score = 1 / (1 + np.exp(-(first + second * toxic_mass(p, offsets))))
            found = []
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                hit = np.flatnonzero(p[a:b] > 0.5)
                if len(hit):
                    places = [m.span() for m in WORD.finditer(texts[i].as_py())]
                    runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
                    found.append([{"begin": places[r[0]][0], "end": places[r[-1]][1]} for r in runs])
                else:
                    found.append([])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], pa.array(score, pa.float64()), pa.array(found, kind)], names=schema.names)

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, fit_docs: DataFrame | None = None, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Fit on labelled rows of ``fit_docs`` (``docs`` by default), score all rows of ``docs``."""
    return score_documents(docs, fit(training_sample(docs if fit_docs is None else fit_docs, labels, sample_docs)))
