"""Token ids of many texts by the tokenizers library, with a bounded cache of words.

A byte-level BPE first cuts a text into words, and a blank before a visible character always opens one.
So a text is cut there, equal pieces are found by hashes in numpy, and each is encoded once as long as a
worker keeps it. The ids are those that the library gives for the whole text with encode_special_tokens,
so that names of special tokens are ordinary text, which is not its default. Tokenizers of other kinds encode
whole texts.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

from tidemark.llm.words import is_blank, ranges, span_hashes, text_bytes

VOCABULARY = "byte_bpe_50k.json"
#: Pieces whose ids a worker keeps, about 40 bytes each; when there are as many, further ones are encoded each time.
CACHED = 1_000_000
_SLOTS_BITS = 21
_PROBES = 8
END = 0
#: First bytes of UTF-8 white space beyond ASCII, and ASCII separators that some call white space.
_UNSURE = [0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def shared_vocabulary(spark: SparkSession, path: str | None = None) -> Broadcast:
    """The tokenizer's file (a few MB, whatever the data) for all executors; they needn't see ``path``."""
    with open(path or vocabulary_path(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


class Pieces:
    """Ids of pieces by the pieces' hashes: an open-addressing table over one array of ids."""

    def __init__(self) -> None:
        self.keys = np.zeros(1 << _SLOTS_BITS, np.uint64)
        self.at = np.zeros(1 << _SLOTS_BITS, np.int32)
        self.begin, self.size, self.n = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), 0
        self.ids, self.held = np.zeros(1 << 18, "<u4"), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's number, -1 if there is none."""
        slot = (hashes >> np.uint64(64 - _SLOTS_BITS)).astype(np.int64)
        out = np.where(self.keys[slot] == hashes, self.at[slot], -1)
        left = np.flatnonzero((out < 0) & (self.keys[slot] != 0))
        for step in range(1, _PROBES):
            if not len(left):
                break
            s = (slot[left] + step) & ((1 << _SLOTS_BITS) - 1)
            key = self.keys[s]
            hit = key == hashes[left]
            out[left[hit]] = self.at[s[hit]]
            left = left[~hit & (key != 0)]
        return out

    def add(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of new pieces; beyond CACHED they are only known until ``forget``."""
        first, n = self.n, len(hashes)
        while first + n > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        while self.held + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.begin[first : first + n] = self.held + np.cumsum(sizes) - sizes
        self.size[first : first + n] = sizes
        self.ids[self.held : self.held + len(ids)] = ids
        numbers = np.arange(first, first + n, dtype=np.int32)
        if first + n <= CACHED:
            slot, left = (hashes >> np.uint64(64 - _SLOTS_BITS)).astype(np.int64), np.arange(n)
            for step in range(_PROBES):
                s = (slot[left] + step) & ((1 << _SLOTS_BITS) - 1)
                free = self.keys[s] == 0
                self.keys[s[free]], self.at[s[free]] = hashes[left[free]], numbers[left[free]]
                left = left[(self.keys[s] != hashes[left])]
                if not len(left):
                    break
            self.n, self.held = first + n, self.held + len(ids)
        return numbers


class Encoder:
    def __init__(self, vocabulary: str):
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
        spec = json.loads(vocabulary)
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex")) and not pre.get("add_prefix_space")
        self.size = self.tokenizer.get_vocab_size()
        self.pieces = Pieces()
        opens = is_blank(np.arange(256))
        opens[_UNSURE] = True
        self.visible = ~opens
        self.blank_first = np.zeros(self.size, bool)  # ids whose text begins with a blank
        for token, i in self.tokenizer.get_vocab().items():
            self.blank_first[i] = token[0] == "Ġ"

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _encode_new(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces in a new order, their ids one after the other, and how many each has. plain: a blank first and no other one."""
        order, sizes, out = np.argsort(~plain, kind="stable"), [], [np.zeros(0, "<u4")]
        n = int(plain.sum())
        for at in range(0, n, 64):  # longer texts take the library more time a word
            some = order[at : min(at + 64, n)]
            ids = self.whole(data[ranges(starts[some], ends[some] - starts[some])].tobytes().decode())
            begin = np.flatnonzero(self.blank_first[ids])
            if len(begin) != len(some):
                raise AssertionError("ids of a piece don't begin with its blank")
            sizes.append(np.diff(begin, append=len(ids)))
            out.append(ids)
        for i in order[n:].tolist():
            out.append(self.whole(data[starts[i] : ends[i]].tobytes().decode()))
            sizes.append([len(out[-1])])
        return order, np.concatenate(out), np.concatenate(sizes)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other (32-bit, little-endian; null: none), and each text's bounds in them."""
        if not self.by_piece:
            ids = [self.whole(t or "") for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, "<u4"), *ids]), np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
        data, bounds = text_bytes(texts)
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(bounds), np.int64)
        cut = np.zeros(len(data), bool)
        blank = data == 32
        np.logical_and(blank[:-1], self.visible[data[1:]], out=cut[:-1])
        cut[bounds[1:-1] - (bounds[1:-1] > 0)] &= False  # a text's last blank is not before its next byte
        cut[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        hashes = span_hashes(data, starts, ends, fold=False)
        number = self.pieces.find(hashes)
        lost = np.flatnonzero(number < 0)
        if len(lost):
            new, which, back = np.unique(hashes[lost], return_index=True, return_inverse=True)
            s, e = starts[lost[which]], ends[lost[which]]
            blanks = np.concatenate([[0], np.cumsum(blank)])
            order, ids, sizes = self._encode_new(data, s, e, blank[s] & (blanks[e] - blanks[s] == 1))
            numbers = np.empty(len(new), np.int32)
            numbers[order] = self.pieces.add(new[order], ids, sizes)
            number[lost] = numbers[back]
        size = self.pieces.size[number].astype(np.int64)
        out = self.pieces.ids[ranges(self.pieces.begin[number].astype(np.int64), size)]
        reach = np.concatenate([[0], np.cumsum(size)])
        return out, reach[np.searchsorted(starts, bounds)]


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    """The worker's encoder: kept, with its cache, from task to task."""
    return Encoder(vocabulary)
