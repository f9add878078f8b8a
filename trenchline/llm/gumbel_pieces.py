"""Distinct sampled segmentations of whole texts, drawn without replacement.

A text is coded as by SentencePiece (a space in front, spaces as U+2581,
characters without a piece as bytes).  No piece of the vocabulary that is used
crosses from a word into the next space, so the lattice is a chain of the
lattices of chunks (spaces and the word after them).  A piece weighs
(rank + 2) ** -alpha; backward sums give the probability of every edge.

Gumbel top-k without replacement, by perturbed A-star search: the best
perturbed segmentation is sampled edge by edge and carries the text's Gumbel
value; at each of its edges all other edges together get a truncated Gumbel,
the exact upper bound of the segmentations that leave the path there.  The
largest bound is expanded next.  After k segmentations the largest open bound
is the (k+1)-th perturbed value, which gives inclusion scores
1 - exp(-exp(log p - bound)).  Random numbers are hashes of the row key
(doc_id and text), round and decision: results do not depend on partitions.

Null or empty text: one segmentation, the empty one.  A text with fewer than
k segmentations gives all it has; their inclusion score is 1.  Repeated rows
give equal samples.  Spaces other than U+0020 are ordinary characters.  An
empty table gives no rows.  A very long word is sampled step by step, in time
proportional to its length.
"""

from __future__ import annotations

import math
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trenchline.llm.words import gather_ranges, lengths_to_offsets, mix, pieces, tune

SPACE = "▁"
BASE = np.uint64(0x100000001B3 | 1 << 61)
#: bytes of text whose lattices are in memory at once
TEXT_BYTES = 1 << 20
#: edges of lattices that a worker keeps for later texts (about 50 bytes each)
KNOWN_EDGES = 2_000_000
#: chains or characters below which steps are taken one by one, not as arrays (very long words)
FEW = 4


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Table(NamedTuple):
    """Pieces of one length by the hash of their characters."""

    keys: np.ndarray  # ascending, and a last one above all
    ids: np.ndarray
    begin: np.ndarray  # first key by the hash's upper 18 bits
    there: np.ndarray  # whether there is any
    goes_on: np.ndarray  # whether a longer piece may begin so
    most: int  # keys with equal upper bits, at most


class Vocabulary:
    def __init__(self, path: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of: list[bytes] = [b""] * sp.get_piece_size()
        self.byte_id = np.zeros(256, np.int64)
        by_length: dict[int, list[tuple[int, int]]] = {}
        longer: dict[int, list[int]] = {}  # beginnings of longer pieces, by length
        self.weight = np.full(len(self.bytes_of), -np.inf)
        rank = 0
        for i in range(len(self.bytes_of)):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(piece[1:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                rank += 1
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
                if SPACE not in piece.lstrip(SPACE):
                    self.weight[i] = -alpha * np.log(rank + 1)
                    key = 0
                    for length, code in enumerate(mix(np.array([ord(c) for c in piece], np.uint64) + np.uint64(1)).tolist(), 1):
                        key = (key * int(BASE) + code) % (1 << 64)
                        if length < len(piece):
                            longer.setdefault(length, []).append(key)
                    by_length.setdefault(len(piece), []).append((key, i))
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.bytes_size = np.array([len(b) for b in self.bytes_of], np.int64)
        self.bytes_at = lengths_to_offsets(self.bytes_size)[:-1]
        self.byte_weight = -alpha * np.log(len(self.bytes_of) + 1)
        self.tables = {}
        for length in range(1, max(by_length) + 1):
            rows = by_length.get(length, [])
            keys = np.array([k for k, _ in rows], np.uint64)
            order = np.argsort(keys)
            goes_on = np.zeros(1 << 18, bool)
            goes_on[np.array(longer.get(length, []), np.uint64) >> np.uint64(46)] = True
            count = np.bincount((keys >> np.uint64(46)).astype(np.int64), minlength=1 << 18)
            self.tables[length] = Table(
                np.append(keys[order], ~np.uint64(0)), np.array([i for _, i in rows], np.int64)[order], lengths_to_offsets(count)[:-1], count > 0, goes_on, int(count.max(initial=0))
            )


@lru_cache(maxsize=2)
def vocabulary(path: str, alpha: float) -> Vocabulary:
    return Vocabulary(path, alpha)


class Lattice:
    """Lattices of distinct chunks, their characters laid out one after the other.

    Edges are grouped by their first character; ``piece`` is an id, or minus
    the code point of a character that is written as bytes."""

    def __init__(self, chunks: list[str], vocab: Vocabulary):
        text = "".join(chunks)
        code = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        size = np.array([len(c) for c in chunks], np.int64)
        self.first = lengths_to_offsets(size)[:-1]
        self.end = np.repeat(self.first + size, size)  # by character
        n = len(code)
        room = self.end - np.arange(n)
        mixed = mix(code.astype(np.uint64) + np.uint64(1))
        found = []  # (first characters, length, ids), a length at a time
        single = np.zeros(n, bool)
        alive = np.arange(n)  # characters at which a piece of this length or more may begin
        key = np.zeros(n, np.uint64)  # hash of the characters from there
        for length, table in vocab.tables.items():
            inside = room[alive] >= length
            alive, key = alive[inside], key[inside]
            if not len(alive):
                break
            key = key * BASE + mixed[alive + (length - 1)]
            slot = (key >> np.uint64(46)).astype(np.int64)
            maybe = table.there[slot]
            at, wanted, i = alive[maybe], key[maybe], table.begin[slot[maybe]]
            for _ in range(table.most - 1):
                i += table.keys[i] < wanted
            hit = table.keys[i] == wanted
            found.append((at[hit], length, table.ids[i[hit]]))
            if length == 1:
                single[at[hit]] = True
            longer = table.goes_on[slot]
            alive, key = alive[longer], key[longer]
        bare = np.flatnonzero(~single)
        found.append((bare, 1, -code[bare]))
        count = np.zeros(n, np.int64)
        for at, _, _ in found:
            count[at] += 1
        self.begin = lengths_to_offsets(count)  # edges of each character
        start = np.repeat(np.arange(n), count)
        self.alone = np.repeat(count == 1, count)
        length, self.piece = np.empty_like(start), np.empty_like(start)
        place = self.begin[:-1].copy()
        for at, size_, ids in sorted(found, key=lambda x: -x[1]):  # long pieces, the likely ones, first
            length[place[at]], self.piece[place[at]] = size_, ids
            place[at] += 1
        n_bytes = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        weight = np.where(self.piece >= 0, vocab.weight[np.maximum(self.piece, 0)], vocab.byte_weight * n_bytes[start] if n else 0.0)
        self.to = start + length
        # backward sums, from the end of the chunks to their beginning
        beta = np.zeros(n + 1)
        by_room = np.argsort(room.astype(np.min_scalar_type(int(room.max(initial=0)))), kind="stable")
        cuts = lengths_to_offsets(np.bincount(room))[1:]
        done = self.to == self.end[start] if n else np.zeros(0, bool)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            chars = by_room[a:b]
            if not len(chars):
                continue
            if len(chars) <= FEW:  # as many or fewer at every larger distance from the end
                self._backward(by_room[a:], weight, done, beta)
                break
            count = self.begin[chars + 1] - self.begin[chars]
            e = gather_ranges(self.begin[chars], count)
            beta[chars] = np.logaddexp.reduceat(weight[e] + np.where(done[e], 0.0, beta[self.to[e]]), lengths_to_offsets(count)[:-1])
        self.done = done
        self.log_p = weight + np.where(done, 0.0, beta[self.to]) - beta[start]
        p = np.exp(self.log_p)
        total = np.concatenate([[0.0], np.cumsum(p)])
        self.start = start
        self.key = start + np.minimum(total[1:] - total[self.begin[start]], 1.0)
        self.last = np.append(start[1:] != start[:-1], True) if len(start) else np.zeros(0, bool)

    def _backward(self, chars: np.ndarray, weight: np.ndarray, done: np.ndarray, beta: np.ndarray) -> None:
        """Backward sums of the front of a few long chunks, character by character."""
        for end in np.unique(self.end[chars]).tolist():
            mine = chars[self.end[chars] == end]
            low, high = int(mine.min()), int(mine.max())
            first = int(self.begin[low])
            edges = slice(first, int(self.begin[high + 1]))
            w, ends, to, begin = weight[edges].tolist(), done[edges].tolist(), self.to[edges].tolist(), (self.begin[low : high + 2] - first).tolist()
            known = beta[low : end + 1].tolist()
            for c in range(high - low, -1, -1):
                sums = [w[e] if ends[e] else w[e] + known[to[e] - low] for e in range(begin[c], begin[c + 1])]
                most = max(sums)
                known[c] = most + math.log(sum([math.exp(x - most) for x in sums]))
            beta[low : high + 1] = known[: high - low + 1]

    def chain(self, node: int, u: np.ndarray) -> np.ndarray:
        """The edges sampled from ``node`` to the end of its chunk, one by one."""
        end = int(self.end[node])
        first = int(self.begin[node])
        edges = slice(first, int(self.begin[end]))
        key, last, to, done = self.key[edges].tolist(), self.last[edges].tolist(), self.to[edges].tolist(), self.done[edges].tolist()
        begin, numbers = (self.begin[node : end + 1] - first).tolist(), u.tolist()
        out, at = [], node
        while True:
            e, want = begin[at - node], at + numbers[len(out)]
            while key[e] <= want and not last[e]:
                e += 1
            out.append(first + e)
            if done[e]:
                return np.array(out, np.int64)
            at = to[e]

    def rest(self, edges: np.ndarray) -> np.ndarray:
        """Log probability of all other edges of the same character together."""
        out = np.full(len(edges), -np.inf)
        some = np.flatnonzero(~self.alone[edges])
        with np.errstate(divide="ignore"):
            out[some] = np.log(np.maximum(-np.expm1(self.log_p[edges[some]]), 0.0))
        return out

    def sample(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each character, by its probability."""
        e, want = self.begin[node], node + u
        open_ = np.flatnonzero(self.key[e] <= want)
        while len(open_):
            at = e[open_]
            goes_on = ~self.last[at] & (self.key[at] <= want[open_])
            open_ = open_[goes_on]
            e[open_] += 1
        return e


def uniform(seed: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that depend on seed and number alone."""
    h = mix(mix(seed + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(0x632BE59BD9B4E019))
    return ((h >> np.uint64(12)).astype(float) + 0.5) / float(1 << 52)


def noise(u: np.ndarray) -> np.ndarray:
    """Minus a standard Gumbel value from a number in (0, 1)."""
    return np.log(-np.log(u))


def truncated(place: np.ndarray, most: float, lost: np.ndarray) -> np.ndarray:
    """Gumbel values of location ``place``, given that they are at most ``most``, from ``noise``."""
    out = np.full(len(place), -np.inf)
    there = np.flatnonzero(place > -np.inf)  # most edges have no other beside them
    out[there] = -np.logaddexp(-most, lost[there] - place[there])
    return out


def walk(lattice: Lattice, owner: np.ndarray, nodes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sample every chain of nodes (in order, each to the end of its chunk): (owner, edge, order) sorted by owner, then place.

    ``owner`` ascending; ``seeds`` by owner value."""
    place = np.arange(len(nodes))
    nth = place - np.searchsorted(owner, owner)
    edges, where = [], []
    size = np.zeros(len(nodes), np.int64)  # edges of each node's chain
    step, here, node = 0, place, nodes
    while len(here) > FEW:
        u = uniform(seeds[owner[here]], (nth[here] << 32) + step)  # a chunk has fewer characters than that
        e = lattice.sample(node, u)
        edges.append(e), where.append(here)
        size[here] += 1
        more = ~lattice.done[e]
        here, node, step = here[more], lattice.to[e[more]], step + 1
    chains = []
    for i, at in zip(here.tolist(), node.tolist()):
        numbers = (int(nth[i]) << 32) + step + np.arange(int(lattice.end[at]) - at)
        chains.append(lattice.chain(at, uniform(np.full(len(numbers), seeds[owner[i]]), numbers)))
        size[i] += len(chains[-1])
    begin = lengths_to_offsets(size)
    in_order = np.empty(int(begin[-1]), np.int64)
    for t, (e, at) in enumerate(zip(edges, where)):
        in_order[begin[at] + t] = e
    for i, e in zip(here.tolist(), chains):
        in_order[begin[i] + step : begin[i + 1]] = e
    where = np.repeat(place, size)
    return owner[where], in_order, where


class Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Path:
    """A found segmentation: its own decisions follow ``parent``'s up to decision ``at``."""

    __slots__ = ("edges", "chunk", "bound", "before", "g", "log_p", "excluded", "prefix")

    def __init__(self, edges, chunk, bound, before, g, log_p, excluded, prefix):
        self.edges, self.chunk, self.bound, self.before = edges, chunk, bound, before
        self.g, self.log_p, self.excluded, self.prefix = g, log_p, excluded, prefix


class Known:
    """The chunks of a worker's texts with their lattices, which later texts share.

    Lattices stand one after the other in buffers.  Those of a batch's new
    chunks are put behind the known ones; they become known up to
    ``KNOWN_EDGES`` edges, and are written over by the next batch beyond that."""

    def __init__(self):
        self.numbers, self.chars, self.edges = Numbers(), 0, 0
        self.buffers: dict[str, np.ndarray] = {}

    def _put(self, name: str, at: int, values: np.ndarray) -> np.ndarray:
        end = at + len(values)
        held = self.buffers.get(name)
        if held is None or len(held) < end:
            grown = np.empty(end + end // 4, values.dtype)
            if held is not None:
                grown[:at] = held[:at]
            self.buffers[name] = held = grown
        held[at:end] = values
        return held[:end]

    def cover(self, texts: list[str], vocab: Vocabulary) -> tuple[list[np.ndarray], Lattice]:
        """The chunk numbers of each text, and the lattices that the numbers stand for (until the next call)."""
        chunk_of = Numbers(self.numbers)
        lists = [np.fromiter(map(chunk_of.__getitem__, chunks(t)), np.int64) for t in texts]
        n, chars, edges = len(self.numbers), self.chars, self.edges
        new, every = Lattice(list(chunk_of)[n:], vocab), Lattice.__new__(Lattice)
        every.first = self._put("first", n, new.first + chars)
        every.end = self._put("end", chars, new.end + chars)
        every.begin = self._put("begin", chars, new.begin + edges)
        for name in ("to", "start", "key"):
            setattr(every, name, self._put(name, edges, getattr(new, name) + chars))
        for name in ("alone", "piece", "done", "log_p", "last"):
            setattr(every, name, self._put(name, edges, getattr(new, name)))
        if edges + len(new.piece) <= KNOWN_EDGES:
            self.numbers, self.chars, self.edges = chunk_of, chars + len(new.end), edges + len(new.piece)
        return lists, every


def sample_texts(texts: list[str], keys: np.ndarray, k: int, vocab: Vocabulary, known: Known | None = None) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k (edges' pieces, log p, perturbed value, inclusion score), best first."""
    lists, lattice = (known or Known()).cover(texts, vocab)
    n = len(texts)
    sizes = np.array([len(x) for x in lists], np.int64)
    flat = np.concatenate([np.zeros(0, np.int64), *lists])
    chunk_start = lengths_to_offsets(sizes)
    root = -np.log(-np.log(uniform(keys, np.full(n, (1 << 62) + 1))))
    found: list[list[Path]] = [[] for _ in range(n)]

    def extend(docs: np.ndarray, nodes: list[np.ndarray], firsts: list, seeds: np.ndarray) -> None:
        """Finish a path for each of ``docs``; firsts: (g, edge or None, log p before it, excluded, prefix, chunk of the first node)."""
        owner = np.repeat(np.arange(len(docs)), [len(x) for x in nodes])
        who, edges, where = walk(lattice, owner, np.concatenate(nodes) if len(nodes) else np.zeros(0, np.int64), seeds)
        cut = np.searchsorted(who, np.arange(len(docs) + 1))
        base = np.searchsorted(owner, np.arange(len(docs)))
        place = np.arange(len(who)) - cut[who]
        place += np.array([f[1] is not None for f in firsts], np.int64)[who]  # a given first edge counts as well
        all_steps, all_rest = lattice.log_p[edges], lattice.rest(edges)
        all_noise = noise(uniform(seeds[who], place + (1 << 61)))
        for i, d in enumerate(docs.tolist()):
            g, edge, before, excluded, prefix, chunk = firsts[i]
            own = edges[cut[i] : cut[i + 1]]
            at = where[cut[i] : cut[i + 1]] - base[i] + chunk
            steps, rest, lost = all_steps[cut[i] : cut[i + 1]], all_rest[cut[i] : cut[i + 1]], all_noise[cut[i] : cut[i + 1]]
            if edge is not None:
                own = np.concatenate([[edge], own])
                at = np.concatenate([[chunk], at])
                steps = np.concatenate([[lattice.log_p[edge]], steps])
                rest = np.concatenate([lattice.rest(np.array([edge])), rest])
                lost = np.concatenate([noise(uniform(seeds[i : i + 1], np.array([1 << 61]))), lost])
            ahead = before + np.concatenate([[0.0], np.cumsum(steps)])
            if excluded is not None and len(own):
                node = lattice.start[own[0]]
                out = set(excluded) | {int(own[0])}
                left = [e for e in range(int(lattice.begin[node]), int(lattice.begin[node + 1])) if e not in out]
                rest[0] = np.logaddexp.reduce(lattice.log_p[left]) if left else -np.inf
            bound = truncated(ahead[:-1] + rest, g, lost)
            found[d].append(Path(own, at, bound, ahead, g, float(ahead[-1]), excluded, prefix))

    everyone = np.arange(n)
    extend(everyone, [lattice.first[flat[a:b]] for a, b in zip(chunk_start[:-1], chunk_start[1:])], [(root[d], None, 0.0, None, np.zeros(0, np.int64), 0) for d in range(n)], keys)
    for round_ in range(1, k):  # a round finds the next best segmentation of every text
        docs, nodes, firsts = [], [], []
        seeds = mix(keys + np.uint64(round_ * 0xA0761D6478BD642F % (1 << 64)))
        for d in range(n):
            best = max(((float(p.bound.max()), i) for i, p in enumerate(found[d]) if len(p.bound)), default=(-np.inf, 0))
            if best[0] == -np.inf:
                continue
            path = found[d][best[1]]
            j = int(path.bound.argmax())
            path.bound[j] = -np.inf  # taken over by the new path's first decision
            node = int(lattice.start[path.edges[j]])
            excluded = {int(path.edges[j])} | (set(path.excluded) if j == 0 and path.excluded else set())
            left = [e for e in range(int(lattice.begin[node]), int(lattice.begin[node + 1])) if e not in excluded]
            p = np.exp(lattice.log_p[left])
            u = float(uniform(seeds[d : d + 1], np.array([1 << 62]))[0])
            edge = left[min(int(np.searchsorted(np.cumsum(p) / p.sum(), u)), len(left) - 1)]
            chunk = int(path.chunk[j])
            rest = lattice.first[flat[chunk_start[d] + chunk + 1 : chunk_start[d + 1]]]
            inner = bool(~lattice.done[edge])
            docs.append(d)
            nodes.append(np.concatenate([[lattice.to[edge]], rest]).astype(np.int64) if inner else rest)
            firsts.append((best[0], edge, float(path.before[j]), excluded, np.concatenate([path.prefix, path.edges[:j]]), chunk if inner else chunk + 1))
        if not docs:
            break
        extend(np.array(docs), nodes, firsts, seeds[docs])
        for d, first in zip(docs, firsts):
            path = found[d][-1]
            path.chunk[0] = first[5] if not lattice.done[first[1]] else first[5] - 1
    out = []
    for paths in found:
        bound = max((float(p.bound.max()) for p in paths if len(p.bound)), default=-np.inf)
        rows = []
        for p in paths:
            inclusion = 1.0 if bound == -np.inf else float(-np.expm1(-np.exp(min(p.log_p - bound, 700.0))))
            rows.append((lattice.piece[np.concatenate([p.prefix, p.edges]).astype(np.int64)], p.log_p, float(p.g), inclusion))
        out.append(rows)
    return out


def chunks(text: str) -> list[str]:
    """Chunks of the coded text: each begins with its spaces; empty text has none."""
    if not text:
        return []
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return (SPACE + text.replace(" ", " " + SPACE)).split(" ")
    parts = (" " + text).split(" ")[1:]
    out, spaces = [], 0
    for part in parts:
        spaces += 1
        if part:
            out.append(SPACE * spaces + part)
            spaces = 0
    if spaces:
        out.append(SPACE * spaces)
    return out


def piece_ids(piece: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Ids of lattice pieces; characters without a piece become their bytes."""
    return all_ids([piece], vocab)[0]


def all_ids(pieces_: list[np.ndarray], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all segmentations one after another, where each begins)."""
    begin = lengths_to_offsets(np.array([len(p) for p in pieces_], np.int64))
    piece = np.concatenate([np.zeros(0, np.int64), *pieces_])
    bare = np.flatnonzero(piece < 0)
    if not len(bare):
        return piece.astype("<u4"), begin
    size = np.ones(len(piece), np.int64)
    code = -piece[bare]
    size[bare] = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
    start = lengths_to_offsets(size)
    out = np.repeat(piece, size)
    for x in np.unique(code).tolist():
        at = start[:-1][bare[code == x]]
        for k, byte in enumerate(chr(x).encode("utf-8")):
            out[at + k] = vocab.byte_id[byte]
    return out.astype("<u4"), start[begin]


def all_bytes(ids: np.ndarray, begin: np.ndarray, vocab: Vocabulary) -> tuple[bytes, list[int]]:
    """(the UTF-8 text of all segmentations, each with the space in front, and where each begins)."""
    size = vocab.bytes_size[ids]
    at = gather_ranges(vocab.bytes_at[ids], size)
    return vocab.all_bytes[at].tobytes(), lengths_to_offsets(size)[begin].tolist()


def decode(ids: np.ndarray, vocab: Vocabulary) -> str:
    """The text that ids stand for (the space in front taken off)."""
    data, _ = all_bytes(ids, np.array([0, len(ids)]), vocab)
    return data.decode("utf-8", "replace")[1:]


SAMPLES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("sample", T.IntegerType()),
        T.StructField("n_pieces", T.LongType()),
        T.StructField("log_prob", T.DoubleType()),
        T.StructField("perturbed", T.DoubleType()),
        T.StructField("inclusion", T.DoubleType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("decodes", T.BooleanType()),
    ]
)


def sample_segmentations(docs: DataFrame, k: int = 2, alpha: float = 1.0, path: str | None = None) -> DataFrame:
    """k distinct segmentations (little-endian 32-bit ids) of every text, with inclusion scores."""
    path = path or default_path()
    tune(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    source = source.withColumn("row_key", F.xxhash64("doc_id", "text"))

    def run(batches):
        vocab, known = vocabulary(path, alpha), Known()
        for batch in pieces(batches, limit=TEXT_BYTES):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            keys = batch.column("row_key").to_numpy(zero_copy_only=False).view(np.uint64)
            found = sample_texts(texts, keys, k, vocab, known)
            ids, begin = all_ids([x[0] for samples in found for x in samples], vocab)
            data, at = all_bytes(ids, begin, vocab)
            coded, begin = memoryview(ids.tobytes()), begin.tolist()
            rows: list[tuple] = []
            for doc_id, text, samples in zip(batch.column("doc_id").to_pylist(), texts, found):
                said = text.encode()
                for i, (_, log_p, g, inclusion) in enumerate(samples):
                    n = len(rows)
                    rows.append((doc_id, i, begin[n + 1] - begin[n], log_p, g, inclusion, bytes(coded[4 * begin[n] : 4 * begin[n + 1]]), data[at[n] + 1 : at[n + 1]] == said))
            kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.float64()] * 3, pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=SAMPLES.names)

    return source.mapInArrow(run, SAMPLES)
