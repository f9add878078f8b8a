"""Reply trees as training conversations.

A message names its tree and its parent.  Iterated self-joins double the hops
that are known: after k rounds every message knows its ancestor 2^k replies
up, the number of replies between and their scores, so a tree of depth d
takes log2(d) rounds.  The same tables, used from short hops to long ones,
enumerate each chosen path from its leaf to the root.  Branches are ranked by
the mean score of their messages.  All this works on ids; texts are moved
once, to the paths they are on, and once more to be put together.

A path is formatted in parts of ``PART_TURNS`` turns, so no task ever holds a
whole conversation; a reader streams the parts in order.  Marks around a turn
are control strings; where a text holds a control string, a backslash is put
behind its first character (one more if backslashes are there already), and
the reader takes it out again.

Defined results: a message whose parent is not there is a root; messages
whose parents form a ring are on no path; of messages with equal tree and id
``one_each`` keeps the one with the least digest.  A null text or role counts
as empty, a null tree is a tree of its own, a null turn comes first, and rows
of equal turn follow by the digest of role and text; equal rows are turns of
their own.  An empty table gives no rows.  Other columns take no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trenchline.llm.bitmap_rank import placed
from trenchline.llm.common import landed

#: marks of a turn: before the role, between role and text, after the text
OPEN, BETWEEN, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: strings that must not reach a tokenizer from within a text
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]
LOSS_ROLE = "assistant"
PART_TURNS = 64


def _rest(first: str) -> str:
    """A pattern of what follows the first character of the control strings."""
    return "|".join(re.sub(r"([|\[\]])", r"\\\1", c[1:]) for c in CONTROL if c[0] == first)


#: first character with backslashes behind it, then the rest of a control string
ESCAPED = [rf"(<\\*)({_rest('<')})", rf"(\[\\*)({_rest('[')})"]
_UNDO = [re.compile(rf"(?<={re.escape(c)})\\(?=\\*(?:{_rest(c)}))") for c in "<["]


def escape(text: Column) -> Column:
    for pattern in ESCAPED:
        text = F.regexp_replace(text, pattern, r"$1\\$2")
    return text


def unescape(text: str) -> str:
    for pattern in _UNDO:
        text = pattern.sub("", text)
    return text


def escape_role(role: Column) -> Column:
    """A role in one line: backslashes doubled, line feeds as backslash and n."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


# ---------------------------------------------------------------- trees


def one_each(messages: DataFrame) -> DataFrame:
    """One message for each tree and id: the one with the least digest of its other columns."""
    rest = [c for c in messages.columns if c not in ("tree", "id")]
    keyed = F.struct(F.sha2(F.to_json(F.struct(*rest)), 256).alias("_digest"), *rest)
    return messages.groupBy("tree", "id").agg(F.min(keyed).alias("_m")).select("tree", "id", *[F.col(f"_m.{c}").alias(c) for c in rest])


def _hops(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of ancestors 1, 2, 4, ... replies up, and the depth and score of all nodes with a root."""
    there = nodes.select("tree", F.col("id").alias("parent"), F.col("id").alias("up"))
    known = nodes.select("tree", "id", "parent", "score").join(there, ["tree", "parent"], "left")
    known = known.select("tree", "id", "up", F.lit(1).cast("long").alias("steps"), F.col("score").cast("double").alias("sum"))
    # rounds[k]: the nodes that had an ancestor 2^k - 1 replies up, and the one after it, if any
    rounds = [landed(known, "hops")]
    n = rounds[0].count()
    while True:
        still = rounds[-1].where("up is not null")
        if len(rounds) > n.bit_length() or still.isEmpty():  # a ring would go on for ever
            break
        ends = [r.where("up is null") for r in rounds[:-1]]
        every = reduce(DataFrame.unionByName, ends, rounds[-1])
        far = every.select("tree", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("sum").alias("sum2"))
        both = still.join(far, ["tree", "up"])
        rounds.append(landed(both.select("tree", "id", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"), (F.col("sum") + F.col("sum2")).alias("sum")), "hops"))
    rooted = reduce(DataFrame.unionByName, [r.where("up is null") for r in rounds])
    return rounds[:-1], rooted.select("tree", "id", F.col("steps").alias("length"), "sum")


def reply_paths(nodes: DataFrame, branches: int | None = None) -> DataFrame:
    """Root-to-leaf paths of reply trees: (tree, path, rank, length, position, id).

    ``nodes``: tree, id, parent (null: root), score; ids are unique in a tree
    and neither is null.  ``path`` is the leaf's id, ``rank`` (from 1) its
    place among the tree's branches by mean score, ties by leaf id;
    ``branches``: how many of them to take (all by default)."""
    hops, rooted = _hops(nodes)
    parents = nodes.select("tree", F.col("parent").alias("id")).where("id is not null").distinct()
    leaves = rooted.join(parents, ["tree", "id"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc(F.col("sum") / F.col("length")), "id")
    leaves = leaves.withColumn("rank", F.row_number().over(best).cast("long"))
    if branches is not None:
        leaves = leaves.where(F.col("rank") <= branches)
    steps = landed(leaves.select("tree", F.col("id").alias("path"), "rank", "length", F.lit(0).cast("long").alias("back"), "id"), "paths")
    for k, hop in enumerate(hops):
        up = hop.where("up is not null").select("tree", "id", "up")
        further = steps.join(up, ["tree", "id"]).select("tree", "path", "rank", "length", (F.col("back") + (1 << k)).alias("back"), F.col("up").alias("id"))
        steps = landed(steps.unionByName(further), "paths")
    return steps.select("tree", "path", "rank", "length", (F.col("length") - 1 - F.col("back")).alias("position"), "id")


def turn_chain(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Plain conversations as trees with one branch: (nodes, messages).

    Each row replies to the row before it; its place comes from the ranks of
    its conversation's turns (``bitmap_rank``), so a conversation that holds
    a third of all rows is not sorted in one task.  nodes: tree, id (place),
    parent, score, turn, digest.  messages: tree, turn, digest, role, text,
    one row for each distinct turn."""
    name = F.col(conversation).cast("string")
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(
        F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), name)).alias("tree"), F.col(turn).cast("long").alias("turn"), empty(role).alias("role"), empty(text).alias("text")
    )
    rows = rows.withColumn("digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    counted = landed(rows.groupBy("tree", "turn", "digest").agg(F.count(F.lit(1)).alias("copies")), "turns")
    places = placed(counted, "tree", "turn", "digest", "copies")
    each = places.withColumn("id", F.explode(F.sequence(F.col("place"), F.col("place") + F.col("copies") - 1)))
    name = F.coalesce(F.col("turn").cast("string"), F.lit("")).alias("turn")
    nodes = each.select("tree", "id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(0.0).alias("score"), name, "digest")
    messages = rows.groupBy("tree", name, "digest").agg(F.min(F.struct("role", "text")).alias("m"))
    return landed(nodes, "nodes"), messages.select("tree", "turn", "digest", "m.role", "m.text")


# ---------------------------------------------------------------- format


def format_paths(messages: DataFrame, steps: DataFrame, on: list[str]) -> DataFrame:
    """The formatted paths: (tree, path, rank, length, part, formatted, loss).

    ``steps`` (see ``reply_paths``) and ``messages`` (role, text) meet on the
    columns ``on``.  ``formatted`` holds ``PART_TURNS`` turns at most; the
    parts of a path, one after another, are the conversation.  ``loss``: start
    and length (code points of ``formatted``) of each text to learn from."""
    role, text = escape_role(F.col("role")), escape(F.col("text"))
    head = F.concat(F.lit(OPEN), role, F.lit(BETWEEN))
    turns = messages.select(*on, head.alias("_head"), text.alias("_text"), (F.col("role") == LOSS_ROLE).alias("_learn")).join(steps, on)
    turn = F.struct(
        "position",
        F.concat("_head", "_text", F.lit(CLOSE)).alias("all"),
        F.length("_head").cast("long").alias("head"),
        F.length("_text").cast("long").alias("text"),
        F.col("_learn").alias("learn"),
    )
    part = F.floor(F.col("position") / PART_TURNS)
    parts = turns.groupBy("tree", "path", "rank", "length", part.alias("part")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    size = lambda x: x["head"] + x["text"] + len(CLOSE)
    before = lambda i: F.aggregate(F.slice("t", 1, i), F.lit(0).cast("long"), lambda a, y: a + size(y))
    spans = F.transform("t", lambda x, i: F.struct((before(i) + x["head"]).alias("start"), x["text"].alias("length"), x["learn"].alias("learn")))
    loss = F.transform(F.filter(spans, lambda x: x["learn"]), lambda x: F.struct(x["start"], x["length"]))
    return parts.select("tree", "path", "rank", "length", "part", F.array_join(F.transform("t", lambda x: x["all"]), "").alias("formatted"), loss.alias("loss"))


_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE), re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted part; anything else in it is an error."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at character {at}")
    return out


DIGEST = "tree string, path string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Digest:
    """What the parts of one path say, part by part."""

    def __init__(self, key: tuple):
        self.key, self.n, self.loss_chars, self.chars = key, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss: list[dict]) -> None:
        for role, text in read_turns(formatted):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        for span in loss:
            text = unescape(formatted[span["start"] : span["start"] + span["length"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))
        self.chars += len(formatted)

    def row(self) -> tuple:
        return (*self.key, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of paths whose parts come one after another."""
    names = [c.split()[0] for c in DIGEST.split(", ")]
    now: _Digest | None = None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], pa.string() if c in ("tree", "path") or "sha256" in c else pa.int64()) for i, c in enumerate(names)})

    for batch in batches:
        rows = []
        for tree, path, formatted, loss in zip(*(batch[c] for c in ("tree", "path", "formatted", "loss"))):
            key = (tree.as_py(), path.as_py())
            if now is None or now.key != key:
                if now is not None:
                    rows.append(now.row())
                now = _Digest(key)
            now.add(formatted.as_py(), loss.as_py())
        yield out(rows)
    if now is not None:
        yield out([now.row()])


def read_digests(formatted: DataFrame) -> DataFrame:
    """Each path read back from its parts: number and digest of its turns and of the text to learn from.

    Paths of one part are read where they are; the parts of longer ones are
    brought in order and streamed, one part in memory at a time."""
    parts = formatted.select("tree", F.col("path").cast("string").alias("path"), "part", "length", "formatted", "loss")
    short = parts.where(F.col("length") <= PART_TURNS).mapInArrow(_digests, DIGEST)
    long = parts.where(F.col("length") > PART_TURNS).repartition("tree", "path").sortWithinPartitions("tree", "path", "part")
    return short.unionByName(long.mapInArrow(_digests, DIGEST))
