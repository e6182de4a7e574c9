"""Words and word shingles of many texts at once, as 64-bit hashes in numpy arrays.

Words are runs of bytes other than ASCII white space, A-Z in lower case. A word's hash is a polynomial
over a ring of 64-bit integers, taken from prefix sums over the batch's bytes, so no Python object is
made per word. Equal words have equal hashes; unequal ones share a hash with a chance of about 2**-60.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at a time, so that prefix sums stay in the processor's caches.
PIECE = 1 << 17
_BASE = 0x9E3779B97F4A7C15  # odd; 5 modulo 8, so its powers differ in their low bits for as long as possible


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits each depend on all input bits (splitmix64's)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit integers by rule."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed)) | np.uint64(1)


def is_blank(byte: np.ndarray) -> np.ndarray:
    """Whether a byte is ASCII white space."""
    return (byte == 32) | ((byte >= 9) & (byte <= 13))


@cache
def byte_values(fold: bool) -> np.ndarray:
    """Value of each byte in a hash; fold: that of a small letter for A-Z."""
    byte = np.arange(256)
    return constants(256, 7)[np.where(fold & (byte >= 65) & (byte <= 90), byte + 32, byte)]


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether a byte separates words, powers of the base and of its inverse."""
    separates = is_blank(np.arange(256))
    base = np.uint64(_BASE & ~7 | 5)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    powers = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(PIECE, b)])) for b in (base, inverse)]
    return separates, *powers


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and each text's bounds in them (nulls: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> list[pa.RecordBatch]:
    """The batch in parts with about ``most`` bytes of text each; a longer text has a part of its own."""
    out, at, held = [], 0, 0
    for i, n in enumerate(pc.binary_length(batch[column]).to_pylist()):
        if held and held + (n or 0) > most:
            out.append(batch.slice(at, i - at))
            at, held = i, 0
        held += n or 0
    return out + [batch.slice(at)] * (at < batch.num_rows)


@cache
def _not_alphanumeric() -> np.ndarray:
    byte = np.arange(256)
    return ~((byte >= 128) | (byte >= 48) & (byte <= 57) | (byte >= 65) & (byte <= 90) | (byte >= 97) & (byte <= 122))


def word_bounds(data: np.ndarray, bounds: np.ndarray, bare: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of its first word (one more at the end).

    bare: words are cut at all ASCII characters but letters and digits.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    inside = ~(_not_alphanumeric() if bare else _tables()[0])[data]
    opens = np.empty(len(data) + 1, bool)  # a word begins here, or ended before here
    opens[0], opens[-1] = True, True
    np.not_equal(inside[1:], inside[:-1], out=opens[1:-1])
    opens[bounds] = True
    starts = np.flatnonzero(opens[:-1] & inside)
    closes = opens[1:] & inside
    ends = np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """Hash of data[start:end] for each pair, which are in order and don't overlap."""
    value = byte_values(fold)
    _, power, inverse = _tables()
    out = np.empty(len(starts), np.uint64)
    at, n = 0, len(starts)
    while at < n:
        begin = int(starts[at])
        to = int(np.searchsorted(ends, begin + PIECE, "right"))
        if to <= at:  # longer than a piece
            total, shift = np.uint64(0), np.uint64(1)
            with np.errstate(over="ignore"):
                for i in range(begin, int(ends[at]), PIECE):
                    part = value[data[i : min(i + PIECE, int(ends[at]))]]
                    total += (part * power[: len(part)]).sum(dtype=np.uint64) * shift
                    shift *= power[PIECE]
            out[at] = total
            at += 1
            continue
        part = value[data[begin : int(ends[to - 1])]]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(part * power[: len(part)], out=sums[1:])
        s = starts[at:to] - begin
        out[at:to] = (sums[ends[at:to] - begin] - sums[s]) * inverse[s]
        at = to
    return mix(out)


def words(texts: pa.Array, bare: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and for each text the number of its first word (one more at the end)."""
    data, bounds = text_bytes(texts)
    starts, ends, first = word_bounds(data, bounds, bare)
    return span_hashes(data, starts, ends), first


def shingles(hashes: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``length`` words of each text, and for each text the number of its first run.

    A text with fewer words has one run, of all its words; one without words has none.
    """
    factor = constants(length, 11)
    counts = np.diff(first)
    n = np.where(counts >= length, counts - length + 1, np.minimum(counts, 1))
    begins = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(int(begins[-1]), np.uint64)
    if len(hashes) >= length:
        runs = np.zeros(len(hashes) - length + 1, np.uint64)
        for j in range(length):
            runs += hashes[j : j + len(runs)] * factor[j]
        long = np.flatnonzero(counts >= length)
        where = np.repeat(first[long] - begins[long], n[long]) + ranges(begins[long], n[long])
        out[ranges(begins[long], n[long])] = runs[where]
    for m in range(1, length):
        short = np.flatnonzero(counts == m)
        if len(short):
            total = np.full(len(short), m, np.uint64)
            for j in range(m):
                total += hashes[first[short] + j] * factor[j]
            out[begins[short]] = total
    return mix(out), begins


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All integers start, ..., start + count - 1, one range after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)
