"""Quality rules: a decision list learned by sequential covering.

On a bounded sample of labelled documents, rules that reject low quality are grown (threshold conditions
added by FOIL gain on two thirds of the rows) and pruned (last conditions
dropped while that raises (p - n) / (p + n) on the other third).  Rules that
stay precise are kept in order and emitted as one Spark ``when`` chain.

Null text: no words, all statistics 0, rejected by the base rule (n_words <
50).  No labelled rows: no rules, the base alone decides.  Repeated rows get
the same values.  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trenchline.llm.words import coded_words, joined, lengths_to_offsets, pieces, schema_of, tune

#: most labelled rows that the rules are learned from (least hash of doc_id first)
SAMPLE_ROWS = 20_000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_upper", "n_digits", "n_marks", "n_lines", "n_letters"]
# name -> (numerator, denominator); the features that rules may test
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_word_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "n_letters"),
    "digit_share": ("n_digits", "n_chars"),
    "mark_share": ("n_marks", "n_chars"),
    "letter_share": ("n_letters", "n_chars"),
    "words_per_line": ("n_words", "n_lines"),
}


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = lengths_to_offsets(values)
    return total[offsets[1:]] - total[offsets[:-1]]


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    texts = pc.fill_null(texts, "")
    n = len(texts)
    offsets, codes, words = coded_words(texts)
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    out = {"n_words": np.diff(offsets), "word_chars": _sums(length[codes] if len(codes) else np.zeros(0, np.int64), offsets)}
    for name, pattern in (("n_symbols", r"[#*$%&|<>]"), ("n_upper", r"\p{Lu}"), ("n_digits", r"[0-9]"), ("n_marks", r"[!?;:]"), ("n_letters", r"\p{L}")):
        out[name] = pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(np.int64)
    out["n_chars"] = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    # lines with a word that equal an earlier line
    lists = pc.split_pattern(texts, "\n")
    lines, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    full = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]")
    owner = owner[full.to_numpy(zero_copy_only=False)]
    line = lines.filter(full).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key = np.unique(owner.astype(np.int64) * (len(line) + 1) + line)
    out["n_lines"] = np.bincount(owner, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(key // (len(line) + 1), minlength=n)
    # words in three-word windows found twice or more in their text
    repeated = np.zeros(len(codes), np.int64)
    if len(codes) > 2:
        doc = np.repeat(np.arange(n), np.diff(offsets))
        at = np.flatnonzero(doc[2:] == doc[:-2])
        c = codes.astype(np.uint64)
        h = joined(joined(joined(c[at], c[at + 1]), c[at + 2]), doc[at].astype(np.uint64))
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = at[twice]
        for k in range(3):
            repeated[hit + k] = 1
    out["n_repeat_words"] = _sums(repeated, offsets)
    return out


def with_statistics(docs: DataFrame) -> DataFrame:
    """All rows with the counts of their text; input columns named like a count give way to it."""
    tune(docs.sparkSession)
    schema = schema_of(docs, [(c, T.LongType()) for c in COUNTS])
    carry = [f.name for f in schema.fields[: -len(COUNTS)]]

    def run(batches):
        for batch in pieces(batches):
            counts = text_counts(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], *[pa.array(counts[c].astype(np.int64)) for c in COUNTS]], names=schema.names)

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, schema)


def features(df: DataFrame) -> DataFrame:
    return df.withColumns({name: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0)) for name, (a, b) in RATIOS.items()})


@dataclass
class Rule:
    """Rows that meet all (feature, is-at-least, threshold) conditions are rejected."""

    conditions: list[tuple[str, bool, float]]

    def column(self) -> Column:
        out = F.lit(True)
        for name, least, value in self.conditions:
            out = out & ((F.col(name) >= F.lit(value)) if least else (F.col(name) <= F.lit(value)))
        return out

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = None
        for name, least, value in self.conditions:
            mine = x[name] >= value if least else x[name] <= value
            out = mine if out is None else out & mine
        return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int = 4) -> Rule:
    conditions, inside = [], np.ones(len(bad), bool)
    while len(conditions) < most:
        p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
        if not p0 or not n0:
            break
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for name, values in x.items():
            v = values[inside]
            order = np.argsort(v, kind="stable")
            s, b = v[order], bad[inside][order]
            cut = np.flatnonzero(s[1:] > s[:-1]) + 1
            if not len(cut):
                continue
            below = np.cumsum(b)[cut - 1]
            for least, p, total in ((True, p0 - below, len(s) - cut), (False, below, cut)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / total) - base), -np.inf)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = float(gain[i]), (name, least, float((s[cut[i]] + s[cut[i] - 1]) / 2))
        if best[1] is None:
            break
        conditions.append(best[1])
        inside &= Rule([best[1]]).covers(x)
    return Rule(conditions)


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        c = r.covers(x)
        p, n = int(bad[c].sum()), int((~bad[c]).sum())
        return (p - n) / (p + n) if p + n else -1.0

    options = [Rule(rule.conditions[:k]) for k in range(1, len(rule.conditions) + 1)]
    return max(options, key=lambda r: (worth(r), -len(r.conditions)))


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 16, precision: float = 0.95, least_rows: int = 3, seed: int = 7) -> list[Rule]:
    """Ordered rejecting rules; ``precision`` is asked of each on growing and pruning rows."""
    rules: list[Rule] = []
    prune = np.random.default_rng(seed).random(len(bad)) < 1 / 3
    left = np.ones(len(bad), bool)
    while len(rules) < most_rules:
        g, p = left & ~prune, left & prune
        if bad[g].sum() < least_rows:
            break
        rule = _grow({k: v[g] for k, v in x.items()}, bad[g])
        if not rule.conditions:
            break
        if bad[p].any():
            rule = _prune(rule, {k: v[p] for k, v in x.items()}, bad[p])
        covered = rule.covers(x) & left
        good = bad[covered].sum()
        held = covered & prune
        if good < least_rows or good < precision * covered.sum() or (held.any() and bad[held].sum() < (precision - 0.05) * held.sum()):
            break
        rules.append(rule)
        left &= ~covered
    return rules


def rules_column(rules: list[Rule]) -> Column:
    """Number of the first rule that rejects a row, 0 if none: an ordered ``when`` chain."""
    chain = None
    for i, rule in enumerate(rules, 1):
        chain = F.when(rule.column(), F.lit(i)) if chain is None else chain.when(rule.column(), F.lit(i))
    return F.lit(0) if chain is None else chain.otherwise(F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules from at most ``sample_rows`` labelled documents, one row for each doc_id (the least text hash); those that fail the base are not used."""
    marked = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # broadcast: at most sample_rows pairs of numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("tie"), "text")).alias("one")).select("doc_id", "quality", "one.text")
    rows = features(with_statistics(rows)).where(~base_failed()).select("doc_id", "quality", "n_words", *RATIOS).toPandas()
    if not len(rows):
        return []
    rows = rows.sort_values(list(rows.columns), kind="stable")
    return learn_rules({c: rows[c].to_numpy(float) for c in ["n_words", *RATIOS]}, rows["quality"].to_numpy() == 0)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All rows with statistics, base_failed, rule (number of the rejecting rule, 0: none) and kept."""
    rules = fit(docs, labels, sample_rows)
    out = features(with_statistics(docs)).withColumn("base_failed", base_failed()).withColumn("rule", rules_column(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
