"""Token ids of whole texts by the ``tokenizers`` library.

The tokenizer file drops white space and its splitting pattern never matches
across it, so a text's ids are the ids of its words in order.  A word that
ends in marks after a letter is cut there, and each distinct part is encoded
once and kept for later batches; a part of plain Latin letters goes straight
to the library's BPE model (its normalised, byte-mapped form is known), and
any other part through the library's whole chain.  ``tests/llm`` compares with
``encode`` on whole texts.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from trenchline.llm.words import coded_words, gather_ranges, lengths_to_offsets

#: parts of words kept encoded between batches of one worker
CACHE_WORDS = 600_000
#: ASCII marks that may follow a word; none of them starts a contraction
TAIL = ",.!?;:%$#*&-()[]"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut_tails(words: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """(words without the marks that follow a letter at their end, places of the words that had some, those marks)."""
    words = words.cast(pa.string())
    bare = pc.ascii_rtrim(words, TAIL)
    full, kept = (pc.binary_length(w).to_numpy().astype(np.int64) for w in (words, bare))
    cut = np.flatnonzero((kept < full) & (kept > 0))
    if not len(cut):
        return words, cut, words.slice(0, 0)
    last = pc.utf8_slice_codeunits(bare.take(pa.array(cut)), -1).dictionary_encode()
    letter = np.array([c.isalpha() for c in last.dictionary.to_pylist()])
    cut = cut[letter[last.indices.to_numpy()]]
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words)]
    length = (full - kept)[cut]
    marks = np.frombuffer(data, np.uint8)[gather_ranges(offsets[cut] + kept[cut], length)]
    tails = pa.StringArray.from_buffers(len(cut), pa.py_buffer(lengths_to_offsets(length).astype(np.int32)), pa.py_buffer(marks))
    where = np.zeros(len(words), bool)
    where[cut] = True
    return pc.if_else(pa.array(where), bare, words), cut, tails


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(visible)]
        self.byte_char = {b: chr(256 + i) for i, b in enumerate(rest)}
        self.forget()

    def forget(self) -> None:
        #: number of each known part; its ids are ``ids[bounds[number] : bounds[number + 1]]``
        self.known: dict[str, int] = {}
        self.bounds, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _encode(self, part: str) -> list[int]:
        if part.isascii():
            if part.isalpha():
                return [t.id for t in self.model.tokenize(part.lower())]
        elif part.isalpha() and max(part) < "ɐ" and "İ" not in part:
            # code points below U+0250 are in NFC, and each has one lower-case form wherever it stands
            return [t.id for t in self.model.tokenize(part.lower().encode().decode("latin-1").translate(self.byte_char))]
        return self.whole.encode(part, add_special_tokens=False).ids

    def numbers(self, parts: list[str]) -> np.ndarray:
        """The number of each part; new ones are encoded."""
        found = np.fromiter(map(self.known.get, parts, repeat(-1)), np.int64, len(parts))
        new = np.flatnonzero(found < 0).tolist()
        if new:
            fresh = list(dict.fromkeys([parts[i] for i in new]))
            first = len(self.known)
            self.known.update(zip(fresh, range(first, first + len(fresh))))
            ids, ends = array("I"), array("q")  # no list of lists, which the garbage collector would walk
            for p in fresh:
                ids.extend(self._encode(p))
                ends.append(len(ids))
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.frombuffer(ends, np.int64)])
            self.ids = np.concatenate([self.ids, np.frombuffer(ids, np.uint32)])
            found[new] = [self.known[parts[i]] for i in new]
        return found

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): every text's ids followed by ``end_id``."""
        # ASCII letter case does not change the ids; special tokens do not hold capitals
        offsets, index, words = coded_words(texts, lower=True)
        if len(self.known) > CACHE_WORDS:
            self.forget()
        bare, cut, tails = cut_tails(words)
        tails = tails.dictionary_encode()
        numbers = self.numbers(bare.to_numpy(zero_copy_only=False).tolist())
        ends = self.numbers(tails.dictionary.to_pylist())[tails.indices.to_numpy()]
        parts = np.insert(numbers, cut + 1, ends)
        size = np.diff(self.bounds)
        table = self.ids[gather_ranges(self.bounds[parts], size[parts])]
        length = size[numbers]
        length[cut] += size[ends]
        start = lengths_to_offsets(length)[:-1]
        per_word = length[index]
        out = lengths_to_offsets(per_word)
        ids = table[gather_ranges(start[index], per_word)]
        bounds = out[offsets]
        n_docs = len(bounds) - 1
        ids = np.insert(ids, bounds[1:], np.uint32(end_id)) if n_docs else ids
        return bounds + np.arange(n_docs + 1), ids.astype("<u4")


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
