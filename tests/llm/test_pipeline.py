"""The pipeline, stage by stage, against plain Python on the small documents table."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def base_failed(text):
    w = words(text)
    places = collections.defaultdict(list)
    for i in range(len(w) - 2):
        places[tuple(w[i : i + 3])].append(i)
    repeated = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)}
    return len(w) < 50 or 100 * len(repeated) > 50 * len(w)


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def classes(rows):
    """Components of rows whose five-word shingles are alike by 0.8; empty texts by doc_id."""
    sets = [shingles(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            alike = len(a & b) >= 0.8 * len(a | b) if a and b else not a and not b and rows[i]["doc_id"] == rows[j]["doc_id"]
            if alike:
                root[find(i)] = find(j)
    out = collections.defaultdict(list)
    for i in range(len(rows)):
        out[find(i)].append(rows[i])
    return list(out.values())


def without_repeats(texts):
    """Texts without the words of 35-word windows that start twice; texts that lose none stay as they are."""
    lists = [words(t) for t in texts]
    seen = collections.defaultdict(list)
    for d, w in enumerate(lists):
        for i in range(len(w) - 34):
            seen[tuple(w[i : i + 35])].append((d, i))
    gone = {(d, i + k) for at in seen.values() if len(at) > 1 for d, i in at for k in range(35)}
    lost = {d for d, _ in gone}
    return [" ".join(x for i, x in enumerate(w) if (d, i) not in gone) if d in lost else texts[d] for d, w in enumerate(lists)]


@pytest.fixture(scope="module")
def stages(spark):
    """Input and result rows of every stage."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = [(10_000 + i, t, "en", "x", 0) for i, t in enumerate([None, "", "one word", "word " * 400, " ".join(f"w{j % 97}x{j}" for j in range(3000))])]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumn("kept", F.lit(7))
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, SF)
        rows = [r.asDict() for r in result.collect()]
        out[name] = ([r.asDict() for r in docs.collect()], rows, result.columns)
        if name != "packing":
            assert result.columns == docs.columns
            docs = spark.createDataFrame([tuple(r.values()) for r in rows], docs.schema)
    return out


def test_toxicity_stage_drops_what_scores_half_or_more(spark, stages):
    from trenchline.llm.toxic_crf import toxicity

    before, after, _ = stages["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in before], "doc_id long, text string")
    scores = {r.doc_id: r.toxic_score for r in toxicity(docs, labels).collect()}
    assert {r["doc_id"] for r in after} == {d for d, s in scores.items() if s < 0.5}
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    kept_clean = sum(r["doc_id"] not in toxic for r in after)
    assert kept_clean >= 0.95 * sum(r["doc_id"] not in toxic for r in before)


def test_quality_stage_drops_base_failures_and_rejected_rows(spark, stages):
    from trenchline.llm.decision_list import quality_verdicts

    before, after, _ = stages["quality_rules"]
    kept = {r["doc_id"] for r in after}
    assert not any(base_failed(r["text"]) for r in after)
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in before], "doc_id long, text string")
    rule = {r.doc_id: r.rule for r in quality_verdicts(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert kept == {r["doc_id"] for r in before if not base_failed(r["text"]) and not rule[r["doc_id"]]}


def test_one_document_of_each_group_stays(stages):
    before, after, _ = stages["ngram_jaccard_join"]
    groups = classes(before)
    assert sorted(r["doc_id"] for r in after) == sorted(min(r["doc_id"] for r in g) for g in groups)
    assert len(after) < len(before)
    by = {r["doc_id"]: r for r in before}
    assert all(r == by[r["doc_id"]] for r in after)


def test_repeated_passages_go(stages):
    before, after, _ = stages["substring_dedup"]
    want = dict(zip((r["doc_id"] for r in before), without_repeats([r["text"] for r in before])))
    assert {r["doc_id"]: r["text"] for r in after} == want
    assert all(r["n_chars"] == len(r["text"] or "") for r in after)


def test_all_tokens_are_packed_once(stages):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    before, pieces, columns = stages["packing"]
    of = collections.defaultdict(list)
    bins = collections.Counter()
    for p in pieces:
        of[p["doc_id"]].append(p)
        bins[p["sequence_id"]] += p["length"]
    for r in before:
        mine = sorted(of[r["doc_id"]], key=lambda p: p["start"])
        ids = np.concatenate([np.frombuffer(p["ids"], "<u4") for p in mine]).tolist()
        assert ids == tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2]
    assert len(of) == len(before) and max(bins.values()) <= 4096


def test_run_writes_every_stage(spark):
    import corpus_pipeline

    assert corpus_pipeline.ORACLE_SQL is None
    got = corpus_pipeline.run(spark, SF)
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0 and got.count() > 0
