"""The llm operators against brute force, round trips and held-out rows, on small tables with awkward rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and long texts, copies, near copies, repeated rows and a null id."""
    rng = random.Random(5)
    vocab = ["the", "of", "Alpha", "beta,", "gamma.", "é", "日本", "###", "word's"] + [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = text(60)
    long = text(9000)
    near = text(200).split()
    out = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c"), (6, long), (7, long)]
    out += [(10 + i, text(rng.randrange(5, 120)) + " " + passage + "\n" + text(10)) for i in range(4)]
    for i in range(6):
        edit = list(near)
        edit[rng.randrange(200)] = f"edit{i}"
        out.append((20 + i, " ".join(edit)))
    out += [(30, "same text of six words here"), (31, "same text of six words here"), (31, "same text of six words here"), (None, text(50))]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash")).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def whole():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_word_encoder_equals_the_library(whole):
    import pyarrow as pa

    from trenchline.llm.tokens import default_path, encoder

    texts = ["It's 12 o'clock, DON'T!!", "ÀÉ café café İX Σας ß", "<|endoftext|> a<|startoftext|>b", "x y z", "'s 't ,'ll", "a.b,c ## $$$ 日本語", "", "#*$%&|<>= a< ̸"]
    offsets, ids = encoder(default_path()).encode(pa.array(texts), 1)
    got = [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]
    assert got == [whole(t) + [1] for t in texts]


def test_packing(docs, empty, rows, whole):
    from trenchline.llm.packing import pack

    got = pack(docs, capacity=256).collect()
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    for d in {d for d, _ in rows}:
        want = [whole(t) + [2] for i, t in rows if i == d]
        assert sum(r.length for r in pieces[d]) == sum(map(len, want))
        for r in pieces[d]:
            ids = np.frombuffer(r.ids, "<u4").tolist()
            assert any(w[r.start : r.start + r.length] == ids and r.doc_tokens == len(w) for w in want)
    for b in bins.values():
        b.sort(key=lambda r: r.offset)
        assert [r.offset for r in b] == np.concatenate([[0], np.cumsum([r.length for r in b])[:-1]]).tolist()
        total = sum(r.length for r in b)
        assert total <= 256 and total & (total - 1) == 0  # no padding
    assert pack(empty).count() == 0


def test_bins_hold_as_many_rests_as_their_class_says():
    from trenchline.llm.packing import Bins

    rng = random.Random(7)
    for capacity in (1, 2, 64, 1024):
        bins, docs = Bins(capacity, 3), {}
        for d in range(1500):
            n = rng.choice([1, 2, 3, rng.randrange(1, capacity + 1), rng.randrange(1, 4 * capacity + 1)])
            docs[d] = np.arange(n, dtype="<u4") + 1000 * d
            bins.add(d, memoryview(docs[d].tobytes()))
            waiting = {k: sum(len(r[3]) // 4 for r in rests) for k, rests in bins.waiting.items()}
            assert all(len(bins.waiting[k]) < k for k in waiting) and len(bins.open) <= 1
            for k, rests in bins.waiting.items():
                assert all(capacity // (k + 1) * 4 < len(r[3]) <= capacity // k * 4 or capacity * 4 // len(r[3]) == k for r in rests)
        closed = bins.taken()
        sums = collections.Counter()
        for r in closed:
            sums[r[4]] += r[2]
        assert set(sums.values()) <= {capacity}  # nothing is padded before the end
        bins.finish()
        out = closed + bins.taken()
        sums = collections.Counter()
        for doc_id, start, length, total, sequence, offset, ids in sorted(out, key=lambda r: (r[4], r[5])):
            assert sums[sequence] == offset and total == len(docs[doc_id])
            assert (np.frombuffer(ids, "<u4") == docs[doc_id][start : start + length]).all()
            sums[sequence] += length
        assert all(v & (v - 1) == 0 and v <= capacity for v in sums.values()) and sum(v < capacity for v in sums.values()) <= capacity.bit_length()
        assert sum(sums.values()) == sum(map(len, docs.values()))
        assert len(out) <= sum(-(-len(x) // capacity) for x in docs.values()) + len(sums) + 1  # one cut a bin at most


def test_simple8b_round_trip():
    from trenchline.llm.simple8b import decode, encode

    rng = np.random.default_rng(1)
    cases = [[], [0] * 1000, [1], [2**64 - 1, 0, 2**60, 2**60 - 1], rng.integers(0, 2, 5000), rng.integers(0, 49408, 5000)]
    cases.append((rng.integers(0, 1 << 62, 3000, dtype=np.uint64) >> rng.integers(0, 62, 3000, dtype=np.uint64)))
    for case in cases:
        values = np.array(case, dtype=np.uint64)
        words, first, escapes = encode(values)
        assert (decode(words, first, escapes, len(values)) == values).all()
    assert len(encode(np.zeros(1024, np.uint64))[0]) == 9  # 120 to a word


def test_token_files(spark, docs, empty, rows, whole):
    from trenchline.llm.simple8b import read_token_files, write_token_files
    from trenchline.session import scratch_path

    path = scratch_path(spark, "tf")
    write_token_files(docs, path)
    got = sorted(read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    at = 0
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == at and any(ids == whole(t) + [1] for d, t in rows if d == r.doc_id)
        at += r.n_tokens
    write_token_files(empty, path + "-none")
    assert read_token_files(spark, path + "-none").count() == 0


def test_substring_dedup(docs, empty, rows):
    from trenchline.llm.doubling_dedup import remove_repeats

    words = [WORD.findall(t or "") for _, t in rows]
    count = collections.Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = []
    for (d, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        want.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(docs, block_bytes=4000).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(w[2] for w in want) > 9000
    assert remove_repeats(empty).count() == 0


def test_near_duplicates(docs, empty, rows):
    from trenchline.llm.jaccard_join import choose_bands, keep_one, near_duplicates

    bands, per = choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**per) ** bands >= 0.999
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in (WORD.findall(t or "") for _, t in rows)]
    links = [sum(1 for j, b in enumerate(sets) if i != j and a and b and len(a & b) >= 0.8 * len(a | b)) for i, a in enumerate(sets)]
    got = sorted(((r.doc_id, r.n_links) for r in near_duplicates(docs).collect()), key=str)
    assert got == sorted(((d, n) for (d, _), n in zip(rows, links)), key=str)
    kept = keep_one(docs).select("doc_id").collect()
    ids = [r.doc_id for r in kept]
    assert {20, 30, 6}.issubset(ids) and not {7, 21, 25, 31} & set(ids) and len(ids) == len(set(ids))
    assert near_duplicates(empty).count() == 0


def test_large_groups_are_chunked(monkeypatch, spark):
    from trenchline.llm import jaccard_join as J

    monkeypatch.setattr(J, "CHUNK", 8)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(60):  # a drifting group: not all pairs match
        base[rng.randrange(120)] = f"x{i}"
        texts.append(" ".join(base[: 120 - i % 7]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    want = {i: sum(1 for j, b in enumerate(sets) if i != j and len(a & b) >= 0.8 * len(a | b)) for i, a in enumerate(sets)}
    assert {r.doc_id: r.n_links for r in J.near_duplicates(df).collect()} == want


def test_language_model(docs, empty, rows):
    from trenchline.llm.ngram_trie import DISCOUNT, score_documents

    for order in (2, 3):
        texts = [[w.decode() for w in (t or "").encode().lower().split()] + ["\n"] for _, t in rows]
        train = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2 for d, _ in rows]
        count, grams, total, kinds = collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter()
        pad = [["<s>"] * (order - 1) + w for w in texts]
        for w, t in zip(pad, train):
            for i in range(order - 1, len(w) if t else 0):
                count[w[i]] += 1
                for k in range(1, order):
                    c = tuple(w[i - k : i])
                    kinds[c] += not grams[c, w[i]]
                    grams[c, w[i]] += 1
                    total[c] += 1
        n, v = sum(count.values()), len(count)
        got = collections.defaultdict(list)
        for r in score_documents(docs, order=order, block_bytes=3000).collect():
            got[r.doc_id].append(r)
        for (d, _), w in zip(rows, pad):
            base = score = 0.0
            for i in range(order - 1, len(w)):
                p = (count[w[i]] + 1) / (n + v + 1)
                base += math.log10(p)
                for k in range(1, order):
                    c = tuple(w[i - k : i])
                    if total[c]:
                        p = (max(grams[c, w[i]] - DISCOUNT, 0) + DISCOUNT * kinds[c] * p) / total[c]
                score += math.log10(p)
            size = len(w) - order + 1
            assert any(r.n_tokens == size and r.train_tokens == n and abs(r.base_score - base) < 1e-6 and abs(r.score - score) < 0.05 * size + 1e-9 for r in got[d])
        assert score_documents(empty, order=order).count() == 0


def test_elias_fano_search():
    from trenchline.llm.elias_fano import EliasFano

    rng = np.random.default_rng(2)
    for top in (5, 1000, 1 << 40, (1 << 63) + 5):
        values = np.sort(rng.integers(0, top, 500, dtype=np.uint64))
        ef = EliasFano(*EliasFano.encode(values))
        assert (ef.get(np.arange(500)) == values).all()
        probes = np.concatenate([values, rng.integers(0, top, 500, dtype=np.uint64), np.array([0, top], np.uint64)])
        assert (ef.search(probes) == np.searchsorted(values, probes, "left")).all()


def test_text_counts_and_rules(spark, docs, empty, rows):
    import pyarrow as pa

    from trenchline.llm.decision_list import learn_rules, quality_verdicts, text_counts

    texts = [t or "" for _, t in rows] + ["a\n a\na\nb\n\nb", "x y z x y z q #|<", "\x1c a"]
    got = text_counts(pa.array(texts))
    for i, t in enumerate(texts):
        w = WORD.findall(t)
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        hit = set()
        for k in range(len(w) - 2):
            if tri[tuple(w[k : k + 3])] > 1:
                hit |= {k, k + 1, k + 2}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)
        assert tuple(int(got[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert quality_verdicts(docs, labels).count() == len(rows)
    assert quality_verdicts(empty, labels).count() == 0
    rng = np.random.default_rng(4)
    x = {"a": rng.random(2000), "b": rng.random(2000)}
    bad = (x["a"] > 0.7) & (x["b"] < 0.4)
    rules = learn_rules(x, bad)
    found = np.zeros(2000, bool)
    for r in rules:
        found |= r.covers(x)
    assert (found == bad).mean() > 0.98


def test_toxicity(spark, docs, empty, rows):
    from trenchline.llm.toxic_crf import toxicity

    rng = random.Random(9)
    data = []
    for i in range(400):
        words = [f"w{rng.randrange(200)}" for _ in range(60)]
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(60), rng.choice(["vile", "Nasty!", "foul,"]))
        data.append((i, " ".join(words), toxic))
    frame = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    got = {r.doc_id: r for r in toxicity(frame.drop("toxic"), frame.select("doc_id", "toxic")).collect()}
    out = [(t, got[i].toxic_score >= 0.5) for i, _, t in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(bool(t) == p for t, p in out) and len(out) > 40
    for i, text, toxic in data:
        for span in got[i].toxic_spans:
            assert text[span.begin : span.end].strip(",!").lower().split()[0] in ("vile", "nasty", "foul") or toxic
    awkward = toxicity(docs, frame.select("doc_id", "toxic"), fit_docs=frame).collect()
    assert len(awkward) == len(rows) and all(0 <= r.toxic_score < 0.5 for r in awkward)
    assert toxicity(empty, frame.select("doc_id", "toxic")).count() == 0


def test_spotsigs(docs, empty, rows):
    from trenchline.llm.spotsigs import edited_text, fingerprint_with_edits, jaccard, spot_pairs, unpack

    got = fingerprint_with_edits(docs).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    nxt = {d: order[(i + 1) % len(order)][1] or "" for i, (d, _) in enumerate(order)}
    for r in got:
        if r.doc_id != 31:
            text = next(t for d, t in rows if d == r.doc_id) or ""
            assert r.edited_sha256 == hashlib.sha256(edited_text(text, nxt[r.doc_id]).encode()).hexdigest()
        assert abs(r.near_edited - jaccard(unpack(r.fingerprint), unpack(r.edited_fingerprint))) < 1e-12
    by = {r.doc_id: r.fingerprint for r in got}
    assert by[6] == by[7] and by[30] == by[31] and by[2] == ""
    sets = {d: set(unpack(f).tolist()) for d, f in by.items() if f and d is not None}
    first = {}
    for d in sorted(sets):
        first.setdefault(by[d], d)
    ids = sorted(first.values())
    want = {(min((len(sets[a]), a), (len(sets[b]), b))[1], max((len(sets[a]), a), (len(sets[b]), b))[1]) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in spot_pairs(docs.where("doc_id is not null")).collect()} == want
    assert fingerprint_with_edits(empty).count() == 0


def test_html_extraction(spark):
    from trenchline.llm.html_extract import block_text, extract, extract_pages, mark, parse, train, training_page

    model, odds = train(300)
    pages = [training_page(10**9 + i) for i in range(60)]
    want = [" ".join(filter(None, (block_text(n) for n in mark(parse(p)) if n.tag == "#text" and n.label))) for p in pages]
    got = extract(pages, model, odds)
    assert np.mean([a == b for a, b in zip(got, want)]) > 0.85
    awkward = [(1, None), (2, ""), (3, "<<<>&amp;&#x41;"), (4, "<div>" * 3000 + "x"), (5, "<article><h1>T &amp; t</h1><p>One  two<br>three, four and five.<p>Six &lt;b&gt; seven eight nine.</article><script>var p='</p>'</script>")]
    rows = {r.page_id: r for r in extract_pages(spark.createDataFrame(awkward, "page_id long, html string"), 300).collect()}
    assert rows[1].text == rows[2].text == "" and len(rows) == 5
    assert rows[5].text == "T & t One two three, four and five. Six <b> seven eight nine." and rows[5].n_chars == len(rows[5].text)


def test_sampled_segmentations(docs, empty, rows):
    from trenchline.llm.gumbel_pieces import Lattice, chunks, default_path, sample_segmentations, sample_texts, vocabulary

    got = sample_segmentations(docs, k=3).collect()
    assert all(r.decodes for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert len(by[1]) == len(by[2]) == 1 and len({bytes(r.ids) for r in by[6]}) == 3
    vocab = vocabulary(default_path(), 1.0)
    n = 3000
    keys = np.random.default_rng(3).integers(0, 1 << 63, n, dtype=np.uint64)
    lattice = Lattice(chunks("ab"), vocab)
    paths = sample_texts(["ab"] * n, keys, 2, vocab)
    first = collections.Counter(tuple(p[0][0].tolist()) for p in paths)
    for (ids, log_p, _, _) in paths[0]:
        assert abs(first[tuple(ids.tolist())] / n - math.exp(log_p)) < 0.04
    assert abs(np.mean([sum(math.exp(x[1]) / x[3] for x in p) for p in paths]) - 1) < 0.05 and len(lattice.piece)
    assert sample_segmentations(empty).count() == 0


def test_word_encoder_encodes_a_word_with_marks_once(whole, monkeypatch):
    """Marks behind a letter and batches that follow bring no further work of the library."""
    import pyarrow as pa

    from trenchline.llm import tokens

    enc, done = tokens.WordEncoder(tokens.default_path()), []
    encode = enc._encode
    monkeypatch.setattr(enc, "_encode", lambda part: done.append(part) or encode(part))
    texts = ["straße straße, straße. ÉTÉ!! été é, Ab ab*** 12, ,, it's it's, a'. İx, ǆ; " + "x" * 400 + ")", None, "", ", été",
             "é, ͅ! ﬁn. 日本, 1a) ẞ? <|endoftext|>, Σας."]
    for batch in (texts, texts[::-1], [], [None], ["ab"]):
        offsets, ids = enc.encode(pa.array(batch, pa.string()), 1)
        want = [whole(t) + [1] for t in batch]
        assert np.diff(offsets).tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        large = enc.encode(pa.array(["no", *batch, "no"], pa.large_string()).slice(1, len(batch)), 1)
        assert large[0].tolist() == offsets.tolist() and large[1].tolist() == ids.tolist()
    assert len(done) == len(set(done)) and {"straße", "été", "ab"} <= set(done) and not {"straße,", "été!!", "ab***"} & set(done)
    enc.forget()
    assert enc.encode(pa.array(["ab, ab"]), 1)[1].tolist() == whole("ab, ab") + [1]


def test_simple8b_words_are_greedy_in_every_block():
    """Each word takes the most ids that fit from where it begins, and blocks begin words of their own."""
    from trenchline.llm.simple8b import BITS, BLOCK, COUNTS, decode, encode

    rng = np.random.default_rng(3)
    for n, top in ((1, 16), (1023, 8), (1025, 2), (5000, 16), (3000, 33), (2500, 64)):
        values = rng.integers(0, 1 << 63, n, dtype=np.uint64) >> (63 - rng.integers(0, top, n)).astype(np.uint64)
        values[rng.integers(0, n, 3)] = (1 << min(top, 64)) - 1
        words, first, escapes = encode(values)
        assert (decode(words, first, escapes, n) == values).all()
        want, begins = [], []
        for a in range(0, n, BLOCK):
            block = [int(v) for v in values[a : a + BLOCK]]
            begins.append(len(want))
            while block:
                fit = [s for s in range(1, 16) if all(v < 1 << int(BITS[s]) for v in block[: COUNTS[s]])]
                s = fit[0] if fit else 0
                want.append((s << 60) | (sum(v << (k * int(BITS[s])) for k, v in enumerate(block[: COUNTS[s]])) if s else 0))
                block = block[COUNTS[s] :]
        assert words.tolist() == want and first.tolist() == begins
