"""Re-Pair grammar compression of token ids, a shard at a time, in numpy.

Frequent pairs of neighbouring ids are replaced by nonterminals, over and over. A round replaces many
pairs at once, the more frequent first where occurrences overlap; rules used only once are dropped.
Pairs never join two documents, so each document is a range of symbols of its own.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from tidemark.llm.words import mix, ranges

#: A pair is worth a rule (two symbols and a length) from so many occurrences on.
LEAST_USES = 4
#: Rounds of replacement go on while each makes the sequence shorter by this share, at most ROUNDS times.
WORTH = 0.02
ROUNDS = 24
#: Symbols, ids and nonterminals together: they fit 16 bits where the vocabulary leaves room.
NARROW = 1 << 16
#: Nonterminals of a shard whose vocabulary leaves no such room.
WIDE_RULES = 1 << 16

_HEAD = struct.Struct("<4sBxxxIIIIQ")
_MAGIC = b"TRP1"


def _chosen(keys: np.ndarray, room: int, least: int) -> np.ndarray:
    """The most frequent keys, at most ``room`` of them, in an order by classes of frequency and at random within one.

    Of overlapping pairs the one that comes first is replaced; an order by exact counts would leave runs of
    pairs, each a little less frequent than the one before it, with a single replacement.
    """
    ordered = np.sort(keys)
    edges = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(ordered)]])
    uses = np.diff(edges)
    often = np.flatnonzero(uses >= least)
    often = often[np.argsort(-uses[often], kind="stable")][:room]
    pairs, classes = ordered[edges[often]], np.log2(uses[often]).astype(np.int64)
    return pairs[np.lexsort((mix(pairs), -classes))]


def compress(ids: np.ndarray, last: np.ndarray, n_ids: int, to_the_end: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (two symbols each, in order), their expansions' lengths, and the symbols left.

    last: marks the last id of each document. to_the_end: until no pair can be replaced twice, whatever that takes.
    """
    symbols, rules, lengths = ids.astype(np.uint32), [np.zeros((0, 2), np.uint32)], [np.zeros(0, np.uint32)]
    size_of = np.ones(n_ids, np.uint32)
    most = 1 << 32 if to_the_end else NARROW if n_ids < NARROW else n_ids + WIDE_RULES
    least, rounds = (2, len(ids)) if to_the_end else (LEAST_USES, ROUNDS)
    for _ in range(rounds):
        room = most - len(size_of)
        if len(symbols) < 2 or room <= 0:
            break
        keys = symbols[:-1].astype(np.uint64) << np.uint64(32) | symbols[1:]
        pairs = _chosen(keys[~last[:-1]], room, least)
        if not len(pairs):
            break
        bits = max(8, int(4 * len(pairs)).bit_length())
        spread, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - bits)
        slots = (pairs * spread) >> shift
        table, rank_at = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64), np.zeros(1 << bits, np.int32)
        table[slots[::-1]], rank_at[slots[::-1]] = pairs[::-1], np.arange(len(pairs), dtype=np.int32)[::-1]
        at = (keys * spread) >> shift
        none = np.int32(len(pairs))
        rank = np.where((table[at] == keys) & ~last[:-1], rank_at[at], none)
        around = np.concatenate([[none], rank, [none]])
        take = (rank < none) & (rank < around[:-2]) & (rank <= around[2:])
        uses = np.bincount(rank[take], minlength=len(pairs))
        useful = uses >= 2
        take &= np.concatenate([useful, [False]])[rank]
        where = np.flatnonzero(take)
        if not len(where):
            break
        number = (np.cumsum(useful) - 1 + len(size_of)).astype(np.uint32)
        symbols[where] = number[rank[where]]
        last[where] = last[where + 1]
        keep = np.ones(len(symbols), bool)
        keep[where + 1] = False
        before = len(symbols)
        symbols, last = symbols[keep], last[keep]
        made = pairs[useful]
        made = np.stack([made >> np.uint64(32), made & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        rules.append(made)
        lengths.append(size_of[made].sum(axis=1, dtype=np.uint32))
        size_of = np.concatenate([size_of, lengths[-1]])
        if not to_the_end and len(symbols) > (1 - WORTH) * before:
            break
    return np.concatenate(rules), np.concatenate(lengths), symbols


def pack(doc_ids: list[int | None], docs: list[np.ndarray], n_ids: int, to_the_end: bool = False) -> bytes:
    """A shard's bytes: rules, expansion lengths, symbols and, for each document, id, symbols and ids."""
    sizes = np.array([len(d) for d in docs], np.int64)
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    last = np.zeros(len(ids), bool)
    ends = np.cumsum(sizes)
    last[ends[sizes > 0] - 1] = True
    rules, lengths, symbols = compress(ids, last, n_ids, to_the_end)
    width = 2 if n_ids + len(rules) <= NARROW else 4
    kind = f"<u{width}"
    size_of = np.concatenate([np.ones(n_ids, np.int64), lengths.astype(np.int64)])
    reach = np.concatenate([[0], np.cumsum(size_of[symbols])])
    symbols_at = np.searchsorted(reach, np.concatenate([[0], ends]))
    head = _HEAD.pack(_MAGIC, width, n_ids, len(rules), len(symbols), len(docs), len(ids))
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([d or 0 for d in doc_ids], "<i8")
    body = [rules.astype(kind), lengths.astype("<u4"), symbols.astype(kind), known, names, symbols_at.astype("<u4"), np.concatenate([[0], ends]).astype("<u8")]
    return head + b"".join(x.tobytes() for x in body)


@dataclass
class Shard:
    """A shard as read back; documents are decoded one by one, whole or in part."""

    rules: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray
    doc_ids: list[int | None]
    symbols_at: np.ndarray
    ids_at: np.ndarray
    n_ids: int
    _flat: np.ndarray | None = None

    @classmethod
    def parse(cls, data: bytes) -> Shard:
        magic, width, n_ids, n_rules, n_symbols, n_docs, _ = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a token shard")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        rules = take(f"<u{width}", 2 * n_rules).reshape(-1, 2)
        lengths, symbols, known, names = take("<u4", n_rules), take(f"<u{width}", n_symbols), take("u1", n_docs), take("<i8", n_docs)
        doc_ids = [int(x) if k else None for x, k in zip(names, known, strict=True)]
        return cls(rules, lengths, symbols, doc_ids, take("<u4", n_docs + 1), take("<u8", n_docs + 1).astype(np.int64), n_ids)

    def _expansions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all symbols one after the other, and where each symbol's begin and how many they are."""
        size_of = np.concatenate([np.ones(self.n_ids, np.int64), self.lengths.astype(np.int64)])
        begin = np.cumsum(size_of) - size_of
        if self._flat is None:
            flat = np.arange(self.n_ids + len(self.rules), dtype=np.int64)
            while len(flat) and flat.max() >= self.n_ids:
                rule = flat >= self.n_ids
                counts = 1 + rule
                ends = np.cumsum(counts)
                out = np.repeat(flat, counts)
                pairs = self.rules[flat[rule] - self.n_ids]
                out[ends[rule] - 2], out[ends[rule] - 1] = pairs[:, 0], pairs[:, 1]
                flat = out
            self._flat = flat.astype("<u4")
        return self._flat, begin, size_of

    def decode(self, doc: int, start: int = 0, length: int | None = None) -> np.ndarray:
        """Ids start, ..., start + length - 1 of the doc-th document; only symbols that cover them are expanded."""
        symbols = self.symbols[self.symbols_at[doc] : self.symbols_at[doc + 1]].astype(np.int64)
        total = int(self.ids_at[doc + 1] - self.ids_at[doc])
        end = total if length is None else min(total, start + length)
        while True:  # what lies wholly outside is left out before each level is expanded
            rule = symbols >= self.n_ids
            reach = np.cumsum(np.where(rule, self.lengths[np.where(rule, symbols - self.n_ids, 0)] if len(self.lengths) else 1, 1).astype(np.int64))
            a, b = int(np.searchsorted(reach, start, "right")), int(np.searchsorted(reach, end, "left")) + 1
            skipped = int(reach[a - 1]) if a else 0
            symbols, rule, start, end = symbols[a:b], rule[a:b], start - skipped, end - skipped
            if not rule.any():
                return symbols[start : max(end, start)].astype("<u4")
            ends = np.cumsum(1 + rule)
            out = np.repeat(symbols, 1 + rule)
            pairs = self.rules[symbols[rule] - self.n_ids]
            out[ends[rule] - 2], out[ends[rule] - 1] = pairs[:, 0], pairs[:, 1]
            symbols = out

    def documents(self) -> list[np.ndarray]:
        """Ids of all documents."""
        flat, begin, size_of = self._expansions()
        ids = flat[ranges(begin[self.symbols], size_of[self.symbols])]
        return np.split(ids, self.ids_at[1:-1]) if self.doc_ids else []
