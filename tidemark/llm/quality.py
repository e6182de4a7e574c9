"""Quality classifier: ridge regression on random Fourier features of document statistics, isotonically calibrated.

Statistics of a text (shares of kinds of bytes, lengths of words, repetition) are standardised and mapped
by random cosines whose inner products approximate a Gaussian kernel; the score is linear in these and a
constant, in nothing else. Partitions sum their part of the normal equations; the driver solves them and fits,
on labels kept aside, a monotone map of scores to probabilities by pooling adjacent violators over bins. Between
the middles of the pooled blocks the map is interpolated, so that unequal scores stay apart.

Scale: fitting takes a sample of at most about SAMPLE labelled rows and sums of fixed size, the long ones added
up by executors, so the driver gets one of them; scoring is one pass without a shuffle.

Defined results: a null text is empty, and scores like one. Labels without a document, or null, are left
out; repeated ones count repeatedly. Without any label of either kind every text scores 1: nothing speaks
against it. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, fresh, written
from tidemark.llm.linear import solve_positive
from tidemark.llm.scoring import labelled_texts, long_sums_of, scored, sums_of
from tidemark.llm.words import slices, span_hashes, text_bytes, word_bounds

#: Labelled rows that a model learns from, at most.
SAMPLE = 200_000
FEATURES = 512
#: Width of the kernel in standard deviations of the statistics.
WIDTH = 4.0
RIDGE = 1e-3
CLIP = 5.0
BINS = 2048
THRESHOLD = 0.7
#: Groups of bytes whose shares are statistics.
KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!", b"?", b"|", b"$", b"%", b"&", b"#", b"*", b"'\"`", b":;", b"()[]{}<>", b"/\\", b"@", b"-_=+~^", bytes(range(128, 256))]
#: Statistics of words and lines.
MORE = 13


def _runs(text: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct values each of n texts has, and how often its most frequent one occurs."""
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    edges = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (value[1:] != value[:-1])])) if len(text) else np.zeros(0, np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, text[edges], np.diff(edges, append=len(text)))
    return np.bincount(text[edges], minlength=n), most


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of statistics for each text: shares of kinds of bytes (their roots), then MORE others."""
    data, bounds = text_bytes(texts)
    n, size = len(texts), np.diff(bounds)
    out = np.zeros((n, len(KINDS) + MORE))
    if not len(data):
        return out
    kind_of = np.full(256, len(KINDS))
    for k, kind in enumerate(KINDS):
        kind_of[list(kind)] = k
    kinds = np.bincount(np.repeat(np.arange(n), size) * (len(KINDS) + 1) + kind_of[data], minlength=n * (len(KINDS) + 1)).reshape(n, -1)
    out[:, : len(KINDS)] = np.sqrt(kinds[:, :-1] / np.maximum(size, 1)[:, None])

    starts, ends, first = word_bounds(data, bounds)
    lines = np.zeros(len(data) + 1, bool)
    lines[bounds[:-1][size > 0]] = True
    lines[np.flatnonzero(data == 10) + 1] = True
    line_starts = np.flatnonzero(lines[:-1])
    line_hashes = span_hashes(data, line_starts, np.append(line_starts[1:], len(data)))
    line_text = np.searchsorted(bounds, line_starts, "right") - 1
    n_words, n_lines = np.diff(first), np.bincount(line_text, minlength=n)
    word_text, length = np.repeat(np.arange(n), n_words), ends - starts

    def mean(values: np.ndarray) -> np.ndarray:
        return np.bincount(word_text, values, minlength=n) / np.maximum(n_words, 1)

    more = out[:, len(KINDS) :]
    more[:, 0], more[:, 1], more[:, 2] = np.log1p(size), np.log1p(n_words), np.log1p(n_lines)
    more[:, 3] = mean(length)
    more[:, 4] = np.sqrt(np.maximum(mean(length * length) - more[:, 3] ** 2, 0))
    longest = np.ones(n)
    np.maximum.at(longest, word_text, length)
    more[:, 5] = np.log(longest)
    distinct, most = _runs(word_text, span_hashes(data, starts, ends), n)
    more[:, 6], more[:, 7] = distinct / np.maximum(n_words, 1), most / np.maximum(n_words, 1)
    more[:, 8] = mean(np.isin(data[ends - 1], np.frombuffer(b".,!?;:", np.uint8)))
    more[:, 9] = mean((data[starts] >= 65) & (data[starts] <= 90))
    more[:, 10] = mean(length <= 3)
    more[:, 11] = _runs(line_text, line_hashes, n)[0] / np.maximum(n_lines, 1)
    more[:, 12] = size / np.maximum(n_lines, 1) / 1000
    return out


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence closest to the values, by weighted squares."""
    blocks: list[list[float]] = []  # mean, weight, length
    for v, w in zip(values.tolist(), weights.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


@dataclass
class Model:
    """Mean and spread of the statistics, random waves and phases, weights, and the calibration's knots."""

    mean: np.ndarray
    spread: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray] | None

    def features(self, stats: np.ndarray) -> np.ndarray:
        scaled = np.clip((stats - self.mean) / self.spread, -CLIP, CLIP)
        cosines = np.cos(scaled @ self.waves + self.phases) * np.sqrt(2 / len(self.phases))
        return np.concatenate([cosines, np.ones((len(stats), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.round((self.features(stats) * self.weights).sum(axis=1), 9)  # whatever the rows it is computed with

    def __call__(self, texts: pa.Array) -> np.ndarray:
        if self.knots is None:
            return np.ones(len(texts))
        return np.interp(self.raw(statistics(texts)), *self.knots)


def _rows(batches: Iterator[pa.RecordBatch], aside: bool | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Labels and statistics of a batch: of all rows, of those kept aside or of the others."""
    for batch in batches:
        label = np.asarray(batch["label"].to_numpy(zero_copy_only=False), float)
        stats = np.frombuffer(b"".join(batch["stats"].to_pylist()), "<f8").reshape(len(label), -1)
        chosen = np.ones(len(label), bool) if aside is None else np.asarray(batch["aside"].to_numpy(zero_copy_only=False), bool) == aside
        if chosen.any():
            yield label[chosen], stats[chosen]


def solved(normal: np.ndarray, n: float) -> np.ndarray:
    """Ridge weights from summed normal equations (Z'Z and Z'y) of n rows."""
    m = len(normal)
    return solve_positive(normal[:, :m] + RIDGE * n * np.eye(m) / m + 1e-9 * np.eye(m), normal[:, m])


def calibrated(seen: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the map of scores to probabilities, from counts by bins of scores.

    The middles of the blocks of an isotonic fit, each with the share of good rows (one more row counts half for
    each label, so that no block is certain), and 0 and 1 at the ends.
    """
    used = np.flatnonzero(seen)
    centres = (used + 0.5) / BINS * 2 - 0.5
    if len(used) < 2:  # too few labels to set some aside
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    fitted = pool_adjacent(good[used] / seen[used], seen[used])
    block = np.concatenate([[0], np.cumsum(fitted[1:] != fitted[:-1])])
    weight = np.bincount(block, seen[used])
    middle = np.bincount(block, centres * seen[used]) / weight
    share = (np.bincount(block, good[used]) + 0.5) / (weight + 1)
    return np.concatenate([[-0.5 - 1 / BINS], middle, [1.5 + 1 / BINS]]), np.concatenate([[0], np.maximum.accumulate(share), [1]])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, seed: int = 1) -> Model:
    """Fits a model to the labels for which ``learn`` holds."""
    with bounded_batches(docs.sparkSession):
        return _fitted(labelled_texts(docs, labels, label, learn, sample, id_col, text_col), seed)


def _fitted(known: DataFrame, seed: int) -> Model:
    known = known.withColumn("aside", F.pmod(F.xxhash64(F.lit(seed), "__id"), F.lit(5)) == 0)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                stats = statistics(part["__text"]).astype("<f8")
                yield pa.RecordBatch.from_arrays([part["__label"], part["aside"], pa.array([s.tobytes() for s in stats], pa.binary())], ["label", "aside", "stats"])

    known = written(known.select("__label", "aside", "__text").mapInArrow(measured, "label int, aside boolean, stats binary"), "quality-sample")
    d = len(KINDS) + MORE

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(2 + 2 * d)
        for y, x in _rows(batches):
            out += np.concatenate([[len(y), y.sum()], x.sum(axis=0), (x * x).sum(axis=0)])
        return out

    total = sums_of(known, moments)
    n, positive = total[:2]
    mean = total[2 : 2 + d] / max(n, 1)
    spread = np.sqrt(np.maximum(total[2 + d :] / max(n, 1) - mean**2, 1e-12))
    rng = np.random.default_rng(seed)
    m = FEATURES + 1
    model = Model(mean, spread, rng.normal(0, 1 / WIDTH, (d, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(m), None)
    if not 0 < positive < n:
        return model

    def equations(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((m, m + 1))
        for y, x in _rows(batches, aside=False):
            z = model.features(x)
            out += np.concatenate([z.T @ z, (z.T @ y)[:, None]], axis=1)
        return out.ravel()

    model.weights = solved(long_sums_of(known, equations).reshape(m, m + 1), n)

    def calibration(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((2, BINS))
        for y, x in _rows(batches, aside=True):
            at = np.clip(((model.raw(x) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
            out[0] += np.bincount(at, minlength=BINS)
            out[1] += np.bincount(at, y, minlength=BINS)
        return out.ravel()

    model.knots = calibrated(*sums_of(known, calibration).reshape(2, BINS))
    return model


def score(docs: DataFrame, model: Model, columns: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """``columns`` of each row and its text's score."""
    return scored(docs, columns, text_col, name, model)


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that score at least ``threshold``, with the columns of ``docs``."""
    (name,) = fresh(docs, "score")
    return score(docs, model, docs.columns, text_col, name).filter(F.col(name) >= threshold).drop(name)
