"""Language-model scores from Elias-Fano n-gram tries.

Training.  Words get dense ids and counts by sharded unigram counting.  Every
document is padded with begin symbols of its own for each place; from each
word starts one window of ``order`` words.  A block sends its distinct windows
once, as a trie of its own: a window's beginnings are the shorter n-grams, and
their counts are sums over the windows below them.  A shard owns windows by
their first word's hash.  A context all of whose words are very frequent is
split over all shards by the next word; the totals and numbers of successors
of the split contexts are summed over all shards into one small table that
every block gets.  A shard's trie holds each level as an Elias-Fano sequence
(first words; then successors, written relative to their context's base, so
the level is monotone), chained to the next level by Elias-Fano pointers, and
beside each level the discounted probabilities, (count - D) / context count,
quantised to one byte on a logarithmic scale.  The levels are laid out in a
file that is memory-mapped; an n-gram is found by walking from level to level.

Scoring.  log10 p(w | context) by interpolated absolute discounting, down to
the add-one unigram model.  The answers to a block come back in the order of
its windows, so the model is never gathered in one place and its size is no
limit.

Null text: no words, the end token alone.  Repeated rows are scored alike and
count each time in training.  A null doc_id counts as the empty string in the
fold rule.  With no training rows every token has probability 1 / 1.  A very
long text is a block of its own and is scored whole.  An empty table gives no
rows.  Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trenchline.llm import blocks as B
from trenchline.llm.common import landed
from trenchline.llm.elias_fano import EliasFano
from trenchline.llm.words import joined, lengths_to_offsets, mix, word_hashes

DISCOUNT = 0.75
#: ids of the end of a document and of no word at all; begin symbols follow, then words
END, NONE, BEGIN = 0, 1, 2
#: log10 range of the probability codes 1 to 255
SPAN = 10.0


def held_out(doc_id: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def quantise(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(255 + np.log10(p) * (254 / SPAN)), 1, 255).astype(np.uint8)


def expand(code: np.ndarray) -> np.ndarray:
    """Probabilities of codes; code 0 is an absent n-gram."""
    return np.where(code > 0, 10.0 ** ((code.astype(float) - 255) * (SPAN / 254)), 0.0)


def is_hot(ids: np.ndarray) -> np.ndarray:
    """Ids of very frequent words are odd."""
    return (ids & np.uint64(1)).astype(bool)


def _starts(columns: list[np.ndarray]) -> list[np.ndarray]:
    """For each level, whether a row differs from the row before in the columns up to it."""
    out, new = [], np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new = new.copy()
        new[1:] |= c[1:] != c[:-1]
        out.append(new)
    return out


class Trie:
    """Levels of one shard in a memory-mapped file, each chained to the next by pointers."""

    def __init__(self, columns: list[np.ndarray], counts: np.ndarray):
        """``columns``: the words of distinct windows in ascending order; ``counts``: of each window."""
        self.order = len(columns)
        starts = [np.flatnonzero(x) for x in _starts(columns)]
        levels, self.total, self.kinds, self.split, self.heads = [], [], [], [], []
        codes: list[np.ndarray] = []
        all_hot = np.ones(len(counts), bool)
        self.bases = []
        for k, at in enumerate(starts):
            word = columns[k][at].astype(np.uint64)
            all_hot &= is_hot(columns[k])
            split = all_hot[at] & (k < self.order - 1)
            total = np.add.reduceat(counts, at) if len(at) else np.zeros(0, np.int64)
            base = np.uint64(int(word.max()) + 1 if len(word) else 1)
            if k:
                owner = np.searchsorted(starts[k - 1], at, "right") - 1
                codes.append(quantise((total - DISCOUNT) / self.total[-1][owner]) if len(at) else np.zeros(0, np.uint8))
                # a split successor counts once for all shards: see hot_table
                self.kinds.append(np.bincount(owner, ~(split & self.split[-1][owner]), minlength=len(starts[k - 1])).astype(np.int64))
                levels.append((f"pointers{k - 1}", np.searchsorted(at, np.append(starts[k - 1], len(counts)))))
                word = owner.astype(np.uint64) * base + word
            levels.append((f"words{k}", word))
            self.bases.append(base)
            self.total.append(total)
            self.split.append(split)
            self.heads.append([c[at[split]] for c in columns[: k + 1]])
        parts, places, at = [], {}, 0
        for name, values in levels:
            n, width, low, high = EliasFano.encode(values)
            places[name] = (n, width, at, len(low), len(high))
            parts += [low.tobytes(), high.tobytes()]
            at += len(low) + len(high)
        for k, c in enumerate(codes):
            places[f"codes{k + 1}"] = (len(c), 8, at, len(c), 0)
            parts.append(c.tobytes())
            at += len(c)
        self.file = tempfile.TemporaryFile()  # has no name: gone with the task
        self.file.write(b"".join(parts) + b"\0")
        self.file.flush()
        self.map = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)
        data = np.frombuffer(self.map, np.uint8)
        self.level = {}
        for name, _ in levels:
            n, width, a, x, y = places[name]
            self.level[name] = EliasFano(n, width, data[a : a + x], data[a + x : a + x + y])
        self.codes = {k: data[places[f"codes{k}"][2] :][: places[f"codes{k}"][0]] for k in range(1, self.order)}

    def find_first(self, words: np.ndarray) -> np.ndarray:
        """Node of each first word, -1 if it has none here."""
        level = self.level["words0"]
        if not level.n:
            return np.full(len(words), -1)
        i = level.search(words)
        j = np.minimum(i, level.n - 1)
        return np.where((i < level.n) & (level.get(j) == words), j, -1)

    def find_next(self, k: int, node: np.ndarray, per: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Node on level ``k`` of each word below its (found or -1) node of the level above (``per`` words each), -1 if it has none."""
        out = np.full(len(words), -1)
        last = np.zeros(len(node), np.int64)
        last[node >= 0] = self.level[f"pointers{k - 1}"].get(node[node >= 0] + 1).astype(np.int64)
        node, last = np.repeat(node, per), np.repeat(last, per)
        ok = np.flatnonzero((node >= 0) & (words < self.bases[k]))
        if len(ok):
            key = node[ok].astype(np.uint64) * self.bases[k] + words[ok].astype(np.uint64)
            level = self.level[f"words{k}"]
            i = level.search(key)
            j = np.minimum(i, level.n - 1)
            hit = (i < last[ok]) & (level.get(j) == key)
            out[ok[hit]] = j[hit]
        return out

    def hot_rows(self):
        """(words, share of the total, share of the successors) of each split context."""
        for k in range(self.order - 1):
            at = np.flatnonzero(self.split[k])
            words = np.stack(self.heads[k], axis=1).astype("<u8")
            for context, total, kinds in zip(words, self.total[k][at].tolist(), self.kinds[k][at].tolist()):
                yield context.tobytes(), total, kinds


# --- words: ids and counts -------------------------------------------------

COUNTED = T.StructType([*B.MESSAGES.fields, T.StructField("n_all", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("n_tokens", T.LongType())])


def _word_order(block: B.Block, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the block's words by hash, and the cuts between shards."""
    h = word_hashes(block.words)
    order = np.argsort(h, kind="stable")
    return order, B.shard_cuts(h[order], shards, 64)


def _training(block: B.Block) -> np.ndarray:
    return ~block.rest()["held_out"].to_numpy()


def _ask_words(shards: int):
    def fn(row):
        block = B.Block(row)
        if not block.words:
            return
        weight = np.repeat(_training(block), np.diff(block.ends))
        counts = np.bincount(block.codes, weight, minlength=len(block.words)).astype("<u4")
        order, cuts = _word_order(block, shards)
        parts = []
        for s in range(shards):
            mine = order[cuts[s] : cuts[s + 1]]
            if len(mine):
                parts.append((s, block.id, len(mine).to_bytes(8, "little") + counts[mine].tobytes() + b"\n".join([block.words[i] for i in mine.tolist()])))
        yield B.messages(parts)

    return fn


def _count_words(shard, block_ids, payloads):
    """Ids within the shard and corpus counts of each block's words; one row of totals (block -1)."""
    words, counts, sizes = [], [], []
    for data in payloads:
        n = int.from_bytes(data[:8], "little")
        counts.append(np.frombuffer(data[8 : 8 + 4 * n], "<u4"))
        words.extend(data[8 + 4 * n :].split(b"\n"))
        sizes.append(n)
    ids = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.bincount(ids, np.concatenate(counts)).astype(np.int64)
    cut = lengths_to_offsets(np.array(sizes))
    rows = [(shard, b, ids[cut[i] : cut[i + 1]].astype("<u4").tobytes() + total[ids[cut[i] : cut[i + 1]]].astype("<u8").tobytes(), None, None, None) for i, b in enumerate(block_ids)]
    rows.append((shard, -1, None, len(total), int((total > 0).sum()), int(total.sum())))
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=COUNTED.names)


def _known_words(block: B.Block, answers: list, shards: int, offsets: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(id, corpus count) of each of the block's words."""
    ids, counts = np.zeros(len(block.words), np.uint64), np.zeros(len(block.words), np.int64)
    order, cuts = _word_order(block, shards)
    for a in answers or []:
        mine = order[cuts[a["shard"]] : cuts[a["shard"] + 1]]
        n = len(mine)
        ids[mine] = np.frombuffer(a["payload"][: 4 * n], "<u4").astype(np.uint64) + np.uint64(offsets[a["shard"]])
        counts[mine] = np.frombuffer(a["payload"][4 * n :], "<u8")
    return ids, counts


# --- n-grams ----------------------------------------------------------------


class Model:
    """What scoring needs beside the shards: a few totals, one id offset per shard, and the split contexts' sums."""

    def __init__(self, order: int, shards: int, offsets: dict[int, int], n_docs: int, tokens: int, known: int):
        self.order, self.shards, self.offsets = order, shards, offsets
        self.n_docs, self.tokens, self.kinds = n_docs, tokens + n_docs, known + (n_docs > 0)
        self.hot: dict[bytes, tuple[int, int]] = {}


class Windows:
    """The distinct windows of a block in shard order, as a trie.

    ``columns``: their words; ``starts``: whether a window starts a node, by level; ``nodes``: number of
    nodes up to each window, by level; ``cuts``: first window of each shard; ``at``: the window that starts
    at each place of the padded documents (-1 at their ends); ``token``: places of the tokens."""

    def __init__(self, block: B.Block, words: list, model: Model):
        order, docs = model.order, len(block.ends) - 1
        ids, counts = _known_words(block, words, model.shards, model.offsets)
        # block-wide codes: the specials, then the block's words
        ids = np.concatenate([np.arange(BEGIN + order - 1, dtype=np.uint64), ids])
        counts = np.concatenate([np.full(BEGIN + order - 1, model.n_docs), counts])
        counts[NONE] = 0
        ids = ids * np.uint64(2) + (counts > max(1, model.tokens // model.shards)).astype(np.uint64)
        lengths = np.diff(block.ends) + order  # begin symbols and the end
        self.ends = lengths_to_offsets(lengths)
        padded = np.full(int(self.ends[-1]) + order - 1, NONE, np.int64)
        place = self.ends[:-1]
        is_word = np.ones(int(self.ends[-1]), bool)
        for k in range(order - 1):
            padded[place + k] = BEGIN + order - 2 - k
            is_word[place + k] = False
        padded[self.ends[1:] - 1] = END
        self.token = np.flatnonzero(is_word)
        is_word[self.ends[1:] - 1] = False
        padded[: len(is_word)][is_word] = block.codes + BEGIN + order - 1
        self.count = counts[padded[self.token]]
        begins = np.ones(len(is_word), bool)
        begins[self.ends[1:] - 1] = False
        begins = np.flatnonzero(begins)
        self.doc = np.repeat(np.arange(docs), lengths)[begins]
        columns, over = [padded[begins]], np.zeros(len(begins), bool)
        for k in range(1, order):  # nothing follows the end, not the next document either
            over |= columns[-1] == END
            columns.append(np.where(over, NONE, padded[begins + k]))
        size = len(ids)
        key, top = columns[0], size
        for c in columns[1:]:
            if top * size >= 1 << 63:
                names, key = np.unique(key, return_inverse=True)
                top = len(names)
            key, top = key * size + c, top * size
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        columns = [ids[c[first]] for c in columns]
        h = mix(mix(columns[0]) + np.uint64(1))
        hot = np.ones(len(first), bool)
        self.hot = []  # whether all words up to a level are hot
        for k in range(order - 1):
            hot = hot & is_hot(columns[k])
            self.hot.append(hot)
            h = np.where(hot, joined(h, columns[k + 1]), h)
        shard = (((h >> np.uint64(32)) * np.uint64(model.shards)) >> np.uint64(32)).astype(np.int64)
        by = np.argsort(shard, kind="stable")
        self.columns, self.hot, shard = [c[by] for c in columns], [x[by] for x in self.hot], shard[by]
        self.cuts = np.searchsorted(shard, np.arange(model.shards + 1))
        self.starts = _starts([shard, *self.columns])[1:]
        self.nodes = [lengths_to_offsets(x) for x in self.starts]
        back = np.empty(len(by), np.int64)
        back[by] = np.arange(len(by))
        self.window = back[inverse]  # of each place where one begins
        self.at = np.full(int(self.ends[-1]), -1)
        self.at[begins] = self.window


def _planes(values: np.ndarray) -> bytes:
    """Byte planes of integers, as many as the greatest needs, after their number."""
    keep = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    return bytes([keep]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :keep].T).tobytes()


class Reader:
    """Reads a message part by part."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def octets(self, n: int) -> np.ndarray:
        self.at += n
        return np.frombuffer(self.data[self.at - n : self.at], np.uint8)

    def values(self, n: int) -> np.ndarray:
        keep = int(self.octets(1)[0])
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :keep] = self.octets(n * keep).reshape(keep, n).T
        return wide.view("<u8").ravel()


def _ask_grams(model: Model):
    def fn(row):
        block = B.Block(row)
        w = Windows(block, row["words_known"], model)
        counts = np.bincount(w.window, _training(block)[w.doc].astype(float), minlength=len(w.columns[0])).astype(np.int64)
        levels = []  # (words, successors of each node of the level above)
        for k, new in enumerate(w.starts):
            places = np.flatnonzero(new)
            per = np.diff(w.nodes[k][np.append(np.flatnonzero(w.starts[k - 1]), len(new))]) if k else None
            levels.append((w.columns[k][places], per))
        parts = []
        for s in range(model.shards):
            a, b = int(w.cuts[s]), int(w.cuts[s + 1])
            if a == b:
                continue
            edges = [(int(n[a]), int(n[b])) for n in w.nodes]
            body = [np.array([y - x for x, y in edges], "<u8").tobytes()]
            for k, (words, per) in enumerate(levels):
                if k:
                    body.append(_planes(per[slice(*edges[k - 1])]))
                body.append(_planes(words[slice(*edges[k])]))
            parts.append((s, block.id, b"".join(body) + _planes(counts[a:b])))
        yield B.messages(parts)

    return fn


def _asked(data: bytes, order: int) -> tuple[list, list, np.ndarray]:
    """(words of each level, successors of each node of the level above, counts) of a message."""
    sizes = np.frombuffer(data[: 8 * order], "<u8").astype(int).tolist()
    data = Reader(data, 8 * order)
    words, per = [], []
    for k in range(order):
        per.append(data.values(sizes[k - 1]).astype(np.int64) if k else None)
        words.append(data.values(sizes[k]))
    return words, per, data.values(sizes[-1]).astype(np.int64)


#: a message to a block, or (block -1) a shard's share of a split context
ANSWERS = T.StructType([*B.MESSAGES.fields, T.StructField("context", T.BinaryType()), T.StructField("total", T.LongType()), T.StructField("kinds", T.LongType())])


def _ascending(columns: list[np.ndarray]) -> np.ndarray:
    """Order of rows by their columns, packed into one key (ranks of it where it would not fit)."""
    key, top = np.zeros(len(columns[0]), np.uint64), 1
    for c in columns:
        size = int(c.max()) + 1 if len(c) else 1
        if top * size >= 1 << 63:
            names, key = np.unique(key, return_inverse=True)
            key, top = key.astype(np.uint64), len(names)
        key, top = key * np.uint64(size) + c, top * size
    return np.argsort(key)


def _serve(order: int):
    """Build the shard's trie from all blocks' counts and answer each block from it."""

    def build(payloads) -> Trie:
        columns, counts = [[] for _ in range(order)], []
        for p in payloads:
            words, per, n = _asked(p, order)
            leaf = n > 0
            rows = [words[0]]
            for k in range(1, order):
                rows = [np.repeat(r, per[k]) for r in rows] + [words[k]]
            for c, r in zip(columns, rows):
                c.append(r[leaf])
            counts.append(n[leaf])
        columns, n = [np.concatenate(c) for c in columns], np.concatenate(counts)
        at = _ascending(columns)
        columns, n = [c[at] for c in columns], n[at]
        place = np.flatnonzero(_starts(columns)[-1])
        return Trie([c[place] for c in columns], np.add.reduceat(n, place) if len(place) else n)

    def fn(shard, block_ids, payloads):
        trie = build(payloads)
        rows = []
        for b, p in zip(block_ids, payloads):
            words, per, _ = _asked(p, order)
            out, node = [], trie.find_first(words[0])
            for k in range(order):
                if k:
                    node = trie.find_next(k, node, per[k], words[k])
                    code = np.zeros(len(node), np.uint8)
                    code[node >= 0] = trie.codes[k][node[node >= 0]]
                    out.append(code.tobytes())
                if k < order - 1:
                    for values in (trie.total[k], trie.kinds[k]):
                        known = np.zeros(len(node), np.int64)
                        known[node >= 0] = values[node[node >= 0]]
                        out.append(_planes(known))
            rows.append((shard, b, b"".join(out), None, None, None))
        rows += [(shard, -1, None, *row) for row in trie.hot_rows()]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=ANSWERS.names)

    return fn


def hot_table(answers: DataFrame) -> dict[bytes, tuple[int, int]]:
    """(total, number of successors) of each split context over all shards.

    Bounded: contexts of words that each are more than one of ``shards`` parts of all tokens."""
    rows = answers.where("block_id = -1").groupBy("context").agg(F.sum("total").alias("total"), F.sum("kinds").alias("kinds")).collect()
    out = {bytes(r["context"]): [r["total"], r["kinds"]] for r in rows}
    for context in out:  # a split context is one successor of the context before it
        if len(context) > 8:
            out[context[:-8]][1] += 1
    return {k: tuple(v) for k, v in out.items()}


SCORES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()),
        T.StructField("train_tokens", T.LongType()),
        T.StructField("base_score", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def _score(model: Model):
    def fn(row):
        block = B.Block(row)
        w = Windows(block, row["words_known"], model)
        order, count = model.order, w.count
        unigram = (count + 1) / (model.tokens + model.kinds + 1)
        n_nodes = [int(n[-1]) for n in w.nodes]
        total, kinds = [np.zeros(n) for n in n_nodes], [np.zeros(n) for n in n_nodes]
        code = [np.zeros(n, np.uint8) for n in n_nodes]
        for answer in row["grams_known"] or []:
            s, data = answer["shard"], Reader(answer["payload"])
            for k, n in enumerate(w.nodes):
                a, b = int(n[w.cuts[s]]), int(n[w.cuts[s + 1]])
                if k:
                    code[k][a:b] = data.octets(b - a)
                if k < order - 1:
                    total[k][a:b] = data.values(b - a)
                    kinds[k][a:b] = data.values(b - a)
        p = unigram
        whole = [x.copy() for x in total]
        for k in range(order - 1):  # split contexts: the sums over all shards
            places = np.flatnonzero(w.starts[k])
            for i in np.flatnonzero(w.hot[k][places]).tolist():
                context = np.array([c[places[i]] for c in w.columns[: k + 1]], "<u8").tobytes()
                whole[k][i], kinds[k][i] = model.hot.get(context, (0, 0))
        for k in range(1, order):
            places = np.flatnonzero(w.starts[k])
            above = w.nodes[k - 1][places + 1] - 1
            all_ = np.maximum(whole[k - 1][above], 1)
            alpha = expand(code[k]) * total[k - 1][above] / all_
            if k < order - 1:
                split = w.hot[k][places]
                alpha[split] = np.maximum(whole[k][split] - DISCOUNT, 0) / all_[split]
            back = np.where(whole[k - 1][above] > 0, DISCOUNT * kinds[k - 1][above] / all_, 1.0)
            node = w.nodes[k][w.at[w.token - k] + 1] - 1
            p = alpha[node] + back[node] * p
        ends = block.ends + np.arange(len(block.ends))  # of the documents' tokens
        rest = block.rest()

        def per_doc(x):
            total = np.concatenate([[0.0], np.cumsum(x)])
            return total[ends[1:]] - total[ends[:-1]]

        n = np.diff(ends)
        cols = [
            rest["doc_id"].combine_chunks().cast(pa.int64()),
            rest["held_out"].combine_chunks(),
            pa.array(n),
            pa.array(per_doc(count > 0).astype(np.int64)),
            pa.array(np.full(len(n), model.tokens, np.int64)),
            pa.array(np.add.reduceat(np.log10(unigram), ends[:-1]) if len(n) else np.zeros(0)),
            pa.array(np.add.reduceat(np.log10(p), ends[:-1]) if len(n) else np.zeros(0)),
        ]
        yield from pa.Table.from_arrays([pa.chunked_array([c]) if isinstance(c, pa.Array) else c for c in cols], names=SCORES.names).to_batches()

    return fn


def score_documents(docs: DataFrame, order: int = 3, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """Scores of all rows; rows with ``held_out`` (see the fold rule) are not learned from."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out("doc_id").alias("held_out"))
    blocks = B.build_blocks(source, "lm_blocks", lower=True, carry=["doc_id", "held_out"], block_bytes=block_bytes)
    shards = B.shard_count(spark)
    counted = landed(B.by_shard(B.per_block(blocks, _ask_words(shards), B.MESSAGES), _count_words, COUNTED), "lm_words")
    totals = {r["shard"]: r for r in counted.where("block_id = -1").collect()}  # one row per shard
    offsets, at = {}, BEGIN + order - 1
    for s in sorted(totals):
        offsets[s], at = at, at + totals[s]["n_all"]
    n_docs = source.where("not held_out").count()
    model = Model(order, shards, offsets, n_docs, sum(r["n_tokens"] for r in totals.values()), sum(r["n_known"] for r in totals.values()))
    known = B.with_answers(blocks, counted.where("block_id >= 0").select("shard", "block_id", "payload"), "words_known")
    asked = B.per_block(known, _ask_grams(model), B.MESSAGES)
    grams = landed(B.by_shard(asked, _serve(order), ANSWERS), "lm_grams")
    model.hot = hot_table(grams)
    return B.per_block(B.with_answers(known, grams.where("block_id >= 0").select("shard", "block_id", "payload"), "grams_known"), _score(model), SCORES)
