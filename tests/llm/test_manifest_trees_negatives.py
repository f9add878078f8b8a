"""Merkle manifest, reply trees and hard negatives against brute force, with awkward rows."""

import collections
import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- ranks


def test_bitmap_places_are_sorted_places(spark):
    from trenchline.llm.bitmap_rank import placed

    rng = random.Random(1)
    rows = []
    for g, keys in {"a": range(-40000, 30000, 7), "b": [-(1 << 63), -1, 0, 1, 63, 64, (1 << 63) - 1, None], "c": [5]}.items():
        for k in keys:
            for _ in range(rng.choice([1, 1, 1, 3]) if g != "a" else 1):
                rows.append((g, k, H(f"{k}{rng.random()}"), rng.choice([1, 1, 2])))
    got = placed(spark.createDataFrame(rows, "g string, k long, d string, copies long").repartition(4), "g", "k", "d", "copies").collect()
    want = {}
    for g in "abc":
        at, mine = 0, sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        total = sum(r[3] for r in mine)
        for r in mine:
            want[r[2]] = (at, total)
            at += r[3]
    assert {r.d: (r.place, r.total) for r in got} == want


# ---------------------------------------------------------------- manifest


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, j):
    path = []
    for level in levels[:-1]:
        b = j // 16 * 16
        path.append(("".join(level[b:j]), "".join(level[j + 1 : b + 16])))
        j //= 16
    return path


def brute_manifest(rows):
    coded = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append((r, H("".join(map(coded, r)))))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {g: tree([leaf for _, leaf in groups[g]]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for i, g in enumerate(order):
        for j, (r, leaf) in enumerate(groups[g]):
            path = siblings(trees[g], j) + siblings(top, i)
            out.append((r[0], g, leaf, trees[g][-1][0], top[-1][0], tuple(path)))
    return sorted(out, key=str)


def manifest_rows(df):
    return sorted(((r.doc_id, r.source, r.leaf, r.subroot, r.root, tuple((x.left, x.right) for x in r.path)) for r in df.collect()), key=str)


def test_manifest_equals_brute_force(spark):
    from trenchline.llm.merkle import fold, merkle_manifest, proof

    rows = [(i * 3 - 50, "hot", "en", i, f"text {i} é") for i in range(300)]  # three levels
    rows += [(i, None, None, None, None) for i in range(17)] + [(1, "", "x", 0, ""), (7, "one", "en", 1, "A")]
    rows += [(None, "hot", "en", 1, "a"), (None, "hot", "en", 1, "b"), (10, "hot", "en", 9, "again")] + [(10, "hot", "en", 9, "same")] * 40
    rows += [(i, f"src{i}", "en", i, "t") for i in range(40)]  # more groups than one run holds
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    docs = spark.createDataFrame(rows, schema).withColumn("path", F.lit("clash")).withColumn("leaf", F.lit(1)).repartition(5)
    got = merkle_manifest(docs)
    assert manifest_rows(got) == brute_manifest(rows)
    # every proof leads to the root, and a changed leaf does not
    folded = got.select((fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok"), (fold(F.sha2("leaf", 256), F.col("path")) == F.col("root")).alias("bad"), proof(F.col("path")).alias("p"))
    assert folded.groupBy("ok", "bad").count().collect() == [(True, False, len(rows))]
    assert folded.where("length(p) % 64 <> 0").count() == 0
    one = spark.createDataFrame(rows[:1], schema)
    assert manifest_rows(merkle_manifest(one)) == brute_manifest(rows[:1])
    assert merkle_manifest(spark.createDataFrame([], schema)).count() == 0


# ---------------------------------------------------------------- reply trees


def brute_paths(nodes):
    out = set()
    trees = collections.defaultdict(dict)
    for t, i, parent, score in nodes:
        trees[t][i] = (parent, score)
    for t, tree_ in trees.items():
        inner = {p for p, _ in tree_.values()}
        paths = {}
        for leaf in tree_:
            if leaf in inner:
                continue
            path, at = [leaf], leaf
            while tree_[at][0] in tree_ and len(path) <= len(tree_):
                at = tree_[at][0]
                path.append(at)
            if len(path) <= len(tree_):
                paths[leaf] = path[::-1]
        mean = {leaf: sum(tree_[i][1] for i in p) / len(p) for leaf, p in paths.items()}
        for rank, leaf in enumerate(sorted(paths, key=lambda x: (-round(mean[x], 9), x)), 1):
            out |= {(t, leaf, rank, len(paths[leaf]), k, i) for k, i in enumerate(paths[leaf])}
    return out


def test_paths_equal_brute_force(spark):
    from trenchline.llm.reply_trees import reply_paths

    rng = random.Random(2)
    nodes = []
    for t in range(12):
        n = rng.randrange(1, 30)
        nodes += [(f"t{t}", i, rng.randrange(i) if i and rng.random() < 0.9 else None, float(rng.randrange(4))) for i in range(n)]
    nodes += [("deep", i, i - 1 if i else None, 1.0) for i in range(150)]
    nodes += [("orphans", 1, 99, 1.0), ("orphans", 2, 1, 2.0), ("ring", 1, 3, 1.0), ("ring", 2, 1, 1.0), ("ring", 3, 2, 1.0), ("ring", 4, 3, 1.0)]
    df = spark.createDataFrame(nodes, "tree string, id long, parent long, score double").repartition(4)
    want = brute_paths(nodes)
    assert {tuple(r) for r in reply_paths(df).collect()} == want
    assert {tuple(r) for r in reply_paths(df, branches=2).collect()} == {r for r in want if r[2] <= 2}
    assert reply_paths(df.where("false")).count() == 0


def test_one_message_for_an_id(spark):
    from trenchline.llm.reply_trees import one_each

    rows = [("t", 1, None, "user", "a"), ("t", 1, None, "user", "a"), ("t", 1, None, "user", "b"), ("t", 2, 1, None, None)]
    df = spark.createDataFrame(rows, "tree string, id long, parent long, role string, text string")
    assert one_each(df).count() == 2
    assert one_each(df).collect() == one_each(df.repartition(3)).collect() or one_each(df).exceptAll(one_each(df.repartition(3))).count() == 0


def test_control_strings_come_back(spark):
    from trenchline.llm.reply_trees import CONTROL, escape, escape_role, unescape, unescape_role

    rng = random.Random(3)
    parts = CONTROL + ["<", "[", "\\", "\\\\", "s>", "\n", "x", "|im_end|>", "INST]", "<<", "é"]
    texts = ["", *CONTROL, *["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(3000)]]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"), escape_role(F.col("t")).alias("r")).collect()
    for r in got:
        assert unescape(r.e) == r.t and unescape_role(r.r) == r.t
        assert not any(c in r.e or c in r.r for c in CONTROL) and "\n" not in r.r
        assert r.e == r.t or any(c in r.t.replace("\\", "") for c in CONTROL)


def test_conversations_are_read_back(spark):
    from trenchline.llm.reply_trees import format_paths, read_digests, read_turns, reply_paths, turn_chain

    said = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes\n<|im_end|>\n"), (2, 5, "assistant", None), (2, None, None, "x"), (2, 5, "assistant", None)]
    rows += [(3, 7, "user", "b"), (3, 7, "user", "a"), (None, 0, "a\nb\\n", "t"), (4, 0, "user", "word " * 60000), (-7, 0, "user", said), (-7, 1, "assistant", said)]
    rows += [(9, i, ["user", "assistant"][i % 2], f"turn {i} é") for i in range(200)]  # four parts
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash")).repartition(3)

    def formatted(d):
        nodes, messages = turn_chain(d)
        steps = reply_paths(nodes.select("tree", "id", "parent", "score")).join(nodes.select("tree", "id", "turn", "digest"), ["tree", "id"]).drop("id")
        return format_paths(messages, steps, ["tree", "turn", "digest"])

    out = formatted(df)
    got = {r.tree: tuple(r)[2:] for r in read_digests(out).collect()}
    parts = collections.defaultdict(dict)
    for r in out.collect():
        parts[r.tree][r.part] = r.formatted
        assert all(r.formatted[s.start - 1] == "\n" for s in r.loss)
    groups = collections.defaultdict(list)
    for c, turn, role, text in rows:
        groups["" if c is None else f"={c}"].append((turn is not None, turn or 0, H(f"{len(role or '')}:{role or ''}{text or ''}"), role or "", text or ""))
    assert set(got) == set(groups)
    for key, turns in groups.items():
        turns.sort()
        loss = "".join(t[4] for t in turns if t[3] == "assistant")
        whole = "".join(parts[key][i] for i in sorted(parts[key]))
        said_ = "".join(f"{t[3]}\n{t[4]}\n" for t in turns)
        assert got[key] == (len(turns), H(said_), len(loss), H(loss), len(whole))
        assert read_turns(whole) == [t[3:] for t in turns]
    assert len(parts["=9"]) == 4
    with pytest.raises(ValueError):
        read_turns("loose text")
    assert read_digests(formatted(df.where("false"))).count() == 0


# ---------------------------------------------------------------- hard negatives


def test_index_finds_all_pairs_above_a_threshold():
    from trenchline.llm.hard_negatives import BlockIndex

    rng = np.random.default_rng(4)
    for width, spread in itertools.product((1, 3, 64), (0.0, 2.0)):
        rows = np.floor(rng.normal(size=(500, width)) * 50 * np.exp(-spread * np.arange(width) / width))
        rows[:20] = 0
        anchors = np.floor(rng.normal(size=(300, width)) * 50)
        exact = (anchors @ rows.T).astype(np.int64)
        for share in (0.999, 0.9, 0.2):
            least = np.quantile(exact, share, axis=1)
            i, j, score = BlockIndex(rows).above(anchors, least)
            assert {(a, b): s for a, b, s in zip(i, j, score)} == {(a, b): exact[a, b] for a, b in zip(*np.nonzero(exact >= least[:, None]))}


def brute_negatives(rows):
    ok = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    order = lambda i: (i is not None, i or 0)
    for n, (a, va, la) in enumerate(ok):
        if a is None or a % 50:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(va, v)), order(i), i, lab) for m, (i, v, lab) in enumerate(ok) if m != n), key=lambda x: x[:2])
        for s, _, p, _ in [x for x in scored if x[3] == la][:5]:
            window = [x for x in scored if x[3] != la and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(a, p, rank, x[2], -s, -x[0]) for rank, x in enumerate(window, 1)]
    return sorted(out, key=str)


def test_negatives_equal_brute_force(spark):
    from trenchline.llm.hard_negatives import hard_negatives

    rng = np.random.default_rng(5)
    centre = rng.normal(size=(4, 16))
    rows = [(int(i), (centre[i % 4] * 0.3 + rng.normal(size=16) * 0.2).tolist(), int(rng.integers(4))) for i in range(-100, 900)]
    rows += [(50, rows[150][1], 1), (50, rows[150][1], 1), (None, rows[3][1], 2), (1001, None, 1), (1002, [1.0, float("nan")], 1), (1003, [float("inf")], 1)]
    rows += [(1004, [None, 1.0], 2), (1005, [], 1), (1006, [0.5] * 3, 1), (1007, rows[9][1], None), (1050, [0.0] * 16, 3), (1100, [1.0] * 16, 9)]
    rows += [(2000 + i, rows[200][1], 0) for i in range(400)]  # a large group of copies
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("score", F.lit("clash")).repartition(4)
    got = hard_negatives(df, anchors=F.col("vec_id") % 50 == 0)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_negatives(rows)
    big = [(i * 50, [float(rng.normal()) * 1e9, float(rng.normal()) * 1e7], i % 2) for i in range(30)]
    got = hard_negatives(spark.createDataFrame(big, "vec_id long, embedding array<double>, label int"), anchors=F.col("vec_id") % 50 == 0)
    clip = lambda v: max(min(v, (1 << 63) - 1), 1 - (1 << 63))
    assert all(abs(clip(r[4])) <= 1 << 63 for r in got.collect())
    assert hard_negatives(df.where("false")).count() == 0 and hard_negatives(df, anchors=F.lit(False)).count() == 0
