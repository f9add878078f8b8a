"""Operators give whole results however the rows fall into blocks, shards and partitions."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def _ngram_scores(rows, order):
    """log10 scores by brute force, by doc_id."""
    train, count, grams, total, kinds = {}, collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter()
    pad = {d: ["<s>"] * (order - 1) + t.split() + ["</s>"] for d, t in rows}
    for d, w in pad.items():
        for i in range(order - 1, len(w) if zlib.crc32(str(d).encode()) % 7 != 2 else 0):
            count[w[i]] += 1
            for k in range(1, order):
                c = tuple(w[i - k : i])
                kinds[c] += not grams[c, w[i]]
                grams[c, w[i]] += 1
                total[c] += 1
    n, v, out = sum(count.values()), len(count), {}
    for d, w in pad.items():
        score = 0.0
        for i in range(order - 1, len(w)):
            p = (count[w[i]] + 1) / (n + v + 1)
            for k in range(1, order):
                c = tuple(w[i - k : i])
                if total[c]:
                    p = (max(grams[c, w[i]] - 0.75, 0) + 0.75 * kinds[c] * p) / total[c]
            score += math.log10(p)
        out[d] = score / (len(w) - order + 1)
    return out


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model_hot_contexts_over_many_shards(spark, order):
    """Contexts split over 64 shards, asked by blocks of one document each."""
    from trenchline.llm.ngram_trie import score_documents

    rng = random.Random(7)
    rows = []
    for i in range(80):  # two words in three are hot, and so are their pairs
        rows.append((i, " ".join(x for _ in range(12) for x in ("of", "the", f"w{min(int(rng.expovariate(0.02)), 200)}"))))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        got = {r.doc_id: r.score / r.n_tokens for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), order=order, block_bytes=4).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = _ngram_scores(rows, order)
    assert set(got) == set(want)
    assert max(abs(got[d] - want[d]) for d in want) < 0.02


def test_registered_language_model_uses_two_words_of_context(spark):
    from trenchline.llm.queries import QUERIES
    from trenchline.session import scratch_path

    # the word after "x" is told by the word before it
    rows = [(i, " ".join(f"{a} x {a}{a}" for a in random.Random(i).choices("pqrstuv", k=20))) for i in range(40)]
    path = scratch_path(spark, "lm_order")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    got = {r.doc_id: r.score / r.n_tokens for r in QUERIES["op2_elias_fano_lm"](spark, path).collect()}
    two, three = _ngram_scores(rows, 2), _ngram_scores(rows, 3)
    assert all(abs(got[d] - three[d]) < 0.02 < 0.1 < abs(got[d] - two[d]) for d in got) and len(got) == 40


def test_short_block_beside_repeats(spark):
    """A block of fewer words than a level's step, beside blocks with repeated passages."""
    from trenchline.llm.doubling_dedup import remove_repeats

    rows = [(n, " ".join(f"s{n}x{i}" for i in range(n))) for n in (1, 4, 5, 8, 9, 16, 17, 34)]
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(100, passage + " a b"), (101, "c d " + passage)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), block_bytes=4).collect()}
    assert got == {n: (n, 0) for n in (1, 4, 5, 8, 9, 16, 17, 34)} | {100: (42, 40), 101: (42, 40)}


def test_silent_elements_end_without_end_tags():
    from trenchline.llm.html_extract import block_text, parse, walk

    def text(html):
        return " ".join(filter(None, (block_text(n) for n in walk(parse(html)) if n.tag == "#text")))

    assert text("<head><title>T</title><article><p>One two.</article>") == "One two."
    assert text("<!doctype html><html><head><meta charset=utf-8><title>T</title><style>p{}</style><p>One <b>two</b>.") == "One two."
    assert text("<head><title>T</title>One two.") == "One two."
    assert text("<head><noscript><img src=x></noscript><title>T</title><body><p>One.") == "One."
    for tag in ("noscript", "object", "video", "canvas"):
        assert text(f"<body><div><{tag}>gone<p>gone</div><p>One.</p>") == "One."
        assert text(f"<body><div><{tag}><div>gone</div><p>gone</p></{tag}>Two.</div><p>One.</p>") == "Two. One."
    assert text("<article><p>If <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then.</p></article>") == "If x=2 then."


def test_spot_pairs_null_and_repeated_ids(spark):
    from trenchline.llm.spotsigs import jaccard, spot_members, spot_pairs, spot_sets

    import pyarrow as pa

    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(6):
        edit = list(base)
        edit[rng.randrange(60)] = f"e{i}"
        texts.append(" ".join(edit))
    rows = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (6, texts[4]), (7, texts[4]), (8, texts[5]), (9, None), (10, "far from all others")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys, at = spot_sets(pa.array([t or "" for _, t in rows]))
    sets = [keys[a:b] & np.uint64(0xFFFFFFFF) for a, b in zip(at[:-1], at[1:])]
    ids = collections.defaultdict(list)  # of each distinct set
    for (d, _), s in zip(rows, sets):
        ids[tuple(s.tolist())].append(d)
    ids.pop(())
    want = collections.Counter()
    names = list(ids)
    for i, x in enumerate(names):
        for y in names[i + 1 :]:
            if jaccard(np.array(x), np.array(y)) >= 0.8:
                want[tuple(sorted((str(sorted(ids[x], key=str)), str(sorted(ids[y], key=str)))))] += 1
    members = collections.defaultdict(list)
    for r in spot_members(docs).collect():
        members[r.class_id].append(r.doc_id)
    got = collections.Counter(tuple(sorted((str(sorted(members[r.class_a], key=str)), str(sorted(members[r.class_b], key=str))))) for r in spot_pairs(docs).collect())
    assert members[None] == [9] and sum(map(len, members.values())) == len(rows)
    assert got == want and sum(want.values()) == 15


def test_copies_of_one_id_do_not_crowd_out_the_sample(spark):
    from trenchline.llm.toxic_crf import held_out, training_sample

    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    ids = [r.doc_id for r in labels.where(~held_out("doc_id")).collect()]
    rows = [(ids[0], f"copy {i}") for i in range(500)] + [(d, f"text {d}") for d in ids[1:]]
    sample = training_sample(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), labels, sample_docs=len(ids)).collect()
    texts = [r.text for r in sample]
    assert len(texts) == len(ids) and all(r.toxic == r.doc_id % 2 for r in sample) and sum(t.startswith("copy") for t in texts) == 1
    assert {t for t in texts if not t.startswith("copy")} == {f"text {d}" for d in ids[1:]}


def test_marginals_equal_enumerated_chains():
    import itertools

    from trenchline.llm.toxic_crf import forward_backward

    rng = np.random.default_rng(3)
    for n in (1, 2, 7):
        u, trans = rng.normal(size=(5, 9)) * 2, rng.normal(size=(2, 2))
        here = np.arange(9) < n
        got, _, _ = forward_backward(u, np.tile(here, (5, 1)), trans)
        for row in range(5):
            total, toxic = 0.0, np.zeros(n)
            for states in itertools.product((0, 1), repeat=n):
                score = sum(u[row, t] * s + trans[p, s] for t, (p, s) in enumerate(zip((0, *states), states)))  # before the first word: clean
                total += np.exp(score)
                toxic += np.exp(score) * np.array(states)
            assert np.allclose(got[row, :n], toxic / total)


def test_toxic_forms_equal_a_count_by_hand(spark):
    import collections
    import math

    from trenchline.llm.toxic_crf import forms, toxic_forms

    rng = __import__("random").Random(4)
    docs = []
    for i in range(300):
        toxic = int(i % 5 == 0)
        words = [f"w{rng.randrange(200)}" for _ in range(40)]
        for _ in range(6 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["Vile!", "nasty", "x" * 100]))
        docs.append((i, " ".join(words), toxic))
    docs.append((999, docs[0][1], 0))  # a clean copy of a toxic text: its contexts are clean
    contexts = {}
    for _, text, toxic in docs:
        f = ["", *forms(text.split()), ""]
        for t in range(1, len(f) - 1):
            key = (f[t - 1], f[t], f[t + 1])
            contexts[key] = min(toxic, contexts.get(key, 1))
    n, hits = collections.Counter(), collections.Counter()
    for (_, form, _), toxic in contexts.items():
        n[form] += 1
        hits[form] += toxic
    base, tested = sum(hits.values()) / sum(n.values()), sum(v >= 3 for v in n.values())
    want = []
    for form in n:
        p = hits[form] / n[form]
        if n[form] >= 3 and hits[form] and p > max(0.5, base):
            kl = p * math.log(p / base) + ((1 - p) * math.log((1 - p) / (1 - base)) if p < 1 else 0)
            want += [form] if n[form] * kl > math.log(tested / 0.01) else []
    got = toxic_forms(spark.createDataFrame(docs, "doc_id long, text string, toxic int").repartition(3))
    assert got == sorted(want) and {"vile", "nasty"} <= set(got) and any(len(f) == 32 for f in got)


def test_ordered_pairs_without_replacement():
    """First and second samples against probabilities that are enumerated from the vocabulary alone."""
    import collections
    import itertools

    import sentencepiece

    from trenchline.llm.gumbel_pieces import default_path, sample_texts, vocabulary

    path = default_path()
    vocab, sp = vocabulary(path, 1.0), sentencepiece.SentencePieceProcessor(model_file=path)
    used = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    weight = {sp.id_to_piece(i): 1.0 / (rank + 2) for rank, i in enumerate(used)}
    coded = "▁the"
    every = {}
    for cuts in itertools.product((0, 1), repeat=len(coded) - 1):
        parts, at = [], 0
        for i, c in enumerate((*cuts, 1), 1):
            if c:
                parts.append(coded[at:i])
                at = i
        if all(x in weight for x in parts):
            every[tuple(sp.piece_to_id(x) for x in parts)] = math.prod(weight[x] for x in parts)
    total = sum(every.values())
    p = {k: v / total for k, v in every.items()}
    n = 40000
    keys = np.random.default_rng(3).integers(0, 1 << 63, n, dtype=np.uint64)
    found = sample_texts(["the"] * n, keys, 2, vocab)
    pairs = collections.Counter((tuple(a[0].tolist()), tuple(b[0].tolist())) for a, b in found)
    assert {k for k, _ in pairs} <= set(p) and all(a != b for a, b in pairs)
    for a, b in itertools.permutations(p, 2):
        want = p[a] * p[b] / (1 - p[a])
        assert abs(pairs[a, b] / n - want) < 5 * math.sqrt(want / n) + 1e-4
    for ids, log_p, _, _ in found[0]:
        assert abs(math.exp(log_p) - p[tuple(ids.tolist())]) < 1e-9


def test_very_long_words_take_linear_time():
    import time

    from trenchline.llm.gumbel_pieces import decode, default_path, piece_ids, sample_texts, vocabulary

    vocab = vocabulary(default_path(), 1.0)
    rng = np.random.default_rng(5)
    word = "".join(map(chr, rng.integers(97, 123, 150_000)))
    began = time.perf_counter()
    found = sample_texts([word, "a b", word[:70_000] + " x"], np.array([1, 2, 3], np.uint64), 2, vocab)
    assert time.perf_counter() - began < 30
    for text, samples in zip([word, "a b", word[:70_000] + " x"], found):
        ids = [piece_ids(s[0], vocab) for s in samples]
        assert all(decode(i, vocab) == text for i in ids) and len({i.tobytes() for i in ids}) == 2
    # decisions far into a word do not repeat those of the next chunk
    assert not np.array_equal(found[2][0][0][:1000], found[2][0][0][1000:2000])


def test_comments_that_never_close_and_decoding_by_enumeration():
    import itertools

    from trenchline.llm.html_extract import Node, block_text, decode, lone_text, parse, walk

    texts = lambda html: [block_text(n) for n in walk(parse(html)) if n.tag == "#text"]
    assert texts("<p>one</p><!-- <p>two</p> <b>") == ["one"]
    assert texts("<p>one</p><!-- x --><p>two</p><!--") == ["one", "two"]
    assert texts("<script>if (a <!--b) {}</script><p>one</p>") == ["one"]
    rng = random.Random(6)
    for _ in range(60):
        nodes = [Node("body", None)]
        for _ in range(rng.randrange(1, 9)):
            parent = rng.choice([n for n in nodes if n.tag != "#text"])
            child = Node(rng.choice(["div", "p", "#text"]), parent)
            parent.children.append(child)
            nodes.append(child)
        order = walk(nodes[0])
        logit = np.array([rng.gauss(0, 2) for _ in order])
        place = {id(n): i for i, n in enumerate(order)}
        score = [logit[place[id(n.parent)]] if lone_text(n) else v for n, v in zip(order, logit)]
        worth = lambda y: sum(-np.logaddexp(0, -s) if k else -np.logaddexp(0, s) for k, s in zip(y, score))
        allowed = [y for y in itertools.product((0, 1), repeat=len(order)) if all(not y[i] or i == 0 or y[place[id(n.parent)]] for i, n in enumerate(order))]
        got = tuple(int(x) for x in decode(order, logit))
        assert got in allowed and abs(worth(got) - max(map(worth, allowed))) < 1e-9


def test_kept_rows_have_all_their_columns(spark):
    from trenchline.llm.jaccard_join import keep_one

    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "a", 1, 2), (2, text, "b", 3, 4), (3, "another text of some words", "c", 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string, _doc int, _of int")
    got = keep_one(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [rows[0], rows[2]]
    assert keep_one(df.where("false")).count() == 0


def test_spot_sets_equal_a_count_by_hand():
    import pyarrow as pa

    from trenchline.llm.spotsigs import ANTECEDENTS, MARKS, PASSED, jaccard, spot_sets

    def by_hand(text):
        words = [w.strip(MARKS) or w for w in text.lower().split()]
        spots = set()
        for need in (2, 0):  # without any spot, every word is one, with what follows
            for i, w in enumerate(words):
                chain = [x for x in words[i + 1 :] if x not in ANTECEDENTS + PASSED][:2]
                if (w in ANTECEDENTS or not need) and len(chain) >= need:
                    spots.add((w, *chain))
            if spots:
                break
        return spots

    rng = random.Random(8)
    vocab = ["the", "a", "is", "to", "on", "Said", "river,", "stone", "green", "tower", "moves", "42", "--"]
    texts = ["", "the", "river stone", "on -- the", *(" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 25))) for _ in range(120))]
    keys, at = spot_sets(pa.array(texts), 2)
    sets = [keys[a:b] & np.uint64(0xFFFFFFFF) for a, b in zip(at[:-1], at[1:])]
    hands = [by_hand(t) for t in texts]
    assert [len(s) for s in sets] == [len(h) for h in hands]
    for i, j in itertools.combinations(range(len(texts)), 2):
        union = len(hands[i] | hands[j])
        want = len(hands[i] & hands[j]) / union if union else 1.0
        assert abs(jaccard(sets[i], sets[j]) - want) < 1e-12


def test_a_hot_id_is_cut_into_several_parts(spark):
    from trenchline.llm.spotsigs import fingerprint_with_edits, in_order

    rows = [(5, f"the text {i} of one id") for i in range(2000)] + [(None, f"the text {i} of no id") for i in range(1000)] + [(i, f"the text {i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sizes = [r["count"] for r in in_order(df, 20).groupBy("part").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 3 * len(rows) / 20
    got = fingerprint_with_edits(df).collect()
    assert len(got) == len(rows)
    # every text is edited with the one behind it, by id and hash, across the parts
    order = df.withColumn("h", F.xxhash64("text")).orderBy(F.asc_nulls_first("doc_id"), "h").collect()
    want = collections.Counter()
    for a, b in zip(order, order[1:] + order[:1]):
        half = len(a.text) // 2
        want[a.doc_id, hashlib.sha256((a.text[: len(a.text) - half] + b.text[:half]).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.edited_sha256) for r in got) == want
