"""Toxicity classifier: logistic regression on words, regularised by counterfactual sentences.

Every word has a weight, in a space of HASHED weights by its hash; terms that name groups of people have weights
of their own beyond it. Logistic regression finds them, under a ridge penalty that is mild for words whose
shares in toxic and in other documents differ beyond chance and strong for the rest; in labelled documents with identity terms these are
swapped for others of their list, and the change of the score is penalised, so that naming a group costs
nothing.

Scale: learning takes a sample of at most about SAMPLE labelled rows, which is read once and written as the
numbers of its words. Each step is one pass over that table, in which partitions sum their parts of the loss
and of its gradient, both of a fixed size; the driver adds these up and moves the weights. Scoring is one pass
over the documents without a shuffle.

Defined results: a null text is empty, and scores like one. Words are runs of letters and digits, A-Z in
lower case. Labels without a document, or null, are left out; repeated ones count repeatedly. Without
any label of either kind every text scores 0. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, written
from tidemark.llm.linear import minimise
from tidemark.llm.scoring import labelled_texts, scored, sums_of
from tidemark.llm.words import slices, words

#: Labelled rows that a model learns from, at most.
SAMPLE = 100_000
#: Weights of words.
HASHED = 1 << 17
#: Penalty on the squares of all weights, and the z-score at which a word's weight is halved against it.
RIDGE = 3e-5
CHANCE = 4.0
#: Penalty on the mean square of a score's change by a swap.
FAIRNESS = 1.0
#: Values of the loss that are computed, at most.
STEPS = 50
#: Partitions of the sample, at most, and rows that are worth one.
PARTS, ROWS = 16, 4096
#: What a toxic document weighs against another one; toxic ones are rare.
WEIGHT = 4.0
THRESHOLD = 0.5
#: Terms that name groups of people, by kind.
IDENTITIES = [
    ["women", "men", "transgender", "nonbinary"],
    ["woman", "man"],
    ["girl", "boy"],
    ["female", "male"],
    ["gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "homosexual"],
    ["christian", "muslim", "jewish", "hindu", "buddhist", "catholic", "protestant", "sikh", "atheist"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "catholics", "protestants", "sikhs", "atheists"],
    ["black", "white", "asian", "latino", "hispanic", "african", "european", "arab", "indigenous"],
    ["american", "chinese", "mexican", "indian", "german", "french", "russian", "turkish", "polish"],
    ["immigrant", "refugee", "foreigner", "native"],
    ["immigrants", "refugees", "foreigners", "natives"],
    ["old", "young", "elderly", "teenage"],
    ["disabled", "deaf", "blind", "autistic"],
]


@cache
def identities() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of all terms and the terms' numbers; by number, a term's first one of its list, its place in it, and the list's length."""
    hashes = np.concatenate([words(pa.array(kind))[0] for kind in IDENTITIES])
    sizes = np.array([len(kind) for kind in IDENTITIES])
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.argsort(hashes)
    return hashes[order], order, first, np.arange(len(hashes)) - first, np.repeat(sizes, sizes)


def n_weights() -> int:
    """Weights of hashed words, of identity terms, and the constant."""
    return HASHED + len(identities()[0]) + 1


def _presence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which text has which word (by the number of its weight): pairs in order of texts, each once."""
    hashes, first = words(texts, bare=True)
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    named, number, *_ = identities()
    at = np.minimum(np.searchsorted(named, hashes), len(named) - 1)
    weight = np.where(named[at] == hashes, HASHED + number[at], (hashes >> np.uint64(20)).astype(np.int64) & (HASHED - 1))
    pairs = np.unique(np.repeat(np.arange(len(texts)), np.diff(first)) * n_weights() + weight)
    return pairs // n_weights(), pairs % n_weights()


@dataclass
class Model:
    """A weight per word, and the constant at the end; None: nothing was learnt."""

    weights: np.ndarray | None

    def __call__(self, texts: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        text, word = _presence(texts)
        z = self.weights[-1] + np.bincount(text, self.weights[word], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def swaps(text: np.ndarray, word: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Counterfactual texts: each swap puts another term of its list for each identity term of one length of list.

    (texts, words taken out, words put in), once for each distance in the list.
    """
    _, _, first, place, size = identities()
    hits = np.flatnonzero((word >= HASHED) & (word < HASHED + len(first)))
    term = word[hits] - HASHED
    out = []
    for n in np.unique(size[term]).tolist():
        own = size[term] == n
        for shift in range(1, n):
            put = first[term[own]] + (place[term[own]] + shift) % n
            out.append((text[hits[own]], word[hits[own]], HASHED + put))
    return out


def loss_of(weights: np.ndarray, y: np.ndarray, text: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Sums over texts: of the loss and its gradient, of the squared changes by swaps and their gradient by identity terms, and how many changes there are."""
    n, size = len(y), len(weights)
    z = weights[-1] + np.bincount(text, weights[word], minlength=n)
    weigh = np.where(y > 0, WEIGHT, 1.0)
    signed = np.where(y > 0, -z, z)
    value = (weigh * np.logaddexp(0, signed)).sum()
    error = weigh * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
    slope = np.bincount(word, error[text], minlength=size)
    slope[-1] += error.sum()
    changes, fair, count = 0.0, np.zeros(len(identities()[0])), 0
    for at, out, put in swaps(text, word):
        change = np.bincount(at, weights[put] - weights[out], minlength=n)
        changes += float((change * change).sum())
        count += len(np.unique(at))
        fair += np.bincount(put - HASHED, 2 * change[at], minlength=len(fair)) - np.bincount(out - HASHED, 2 * change[at], minlength=len(fair))
    return np.concatenate([[value, changes, count], slope, fair])


def scale_of(toxic: np.ndarray, other: np.ndarray, n_toxic: float, n_other: float) -> np.ndarray:
    """Between 0 and 1 for each word: how far beyond chance its numbers of toxic and of other texts differ (identity terms, constant: 1)."""
    share = (toxic + other) / (n_toxic + n_other)
    z = (toxic / n_toxic - other / n_other) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_toxic + 1 / n_other))
    out = z**4 / (z**4 + CHANCE**4)
    out[HASHED:] = 1
    return out


def objective(free: np.ndarray, scale: np.ndarray, sums: np.ndarray, n: float) -> tuple[float, np.ndarray]:
    """The penalised loss and its gradient by ``free`` (weights are scale * free), from sums over n texts at these weights."""
    size = len(free)
    value, changes, count = sums[:3]
    slope, fair = sums[3 : 3 + size], np.zeros(size)
    fair[HASHED:-1] = sums[3 + size :]
    own = free.copy()
    own[-1] = 0  # the constant is
    total = value / n + RIDGE / 2 * float((own * own).sum()) + FAIRNESS * changes / max(count, 1)
    return total, scale * (slope / n + FAIRNESS * fair / max(count, 1)) + RIDGE * own


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fits a model to the labels for which ``learn`` holds."""

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                text, word = _presence(part["__text"])
                each = np.split(word.astype("<i4"), np.searchsorted(text, np.arange(1, part.num_rows)))
                yield pa.RecordBatch.from_arrays([part["__label"], pa.array([w.tobytes() for w in each], pa.binary())], ["label", "words"])

    with bounded_batches(docs.sparkSession):
        known = labelled_texts(docs, labels, label, learn, sample, id_col, text_col)
        known = written(known.select("__label", "__text").mapInArrow(present, "label int, words binary"), "toxicity-sample")
    n, positive = known.agg(F.count(F.lit(1)), F.sum(F.col("label").cast("long"))).first()
    if not 0 < (positive or 0) < n:
        return Model(None)
    known = known.coalesce(max(1, min(PARTS, -(-n // ROWS))))

    def whole(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Labels, and pairs of texts and words, of a partition of the sample."""
        y, sizes, held = [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(0, "<i4")]
        for batch in batches:
            y.append(np.asarray(batch["label"].to_numpy(zero_copy_only=False), float))
            own = [np.frombuffer(w.as_buffer(), "<i4") for w in batch["words"]]
            sizes.append(np.array([len(w) for w in own], np.int64))
            held += own
        sizes = np.concatenate(sizes)
        return np.concatenate(y), np.repeat(np.arange(len(sizes)), sizes), np.concatenate(held).astype(np.int64)

    def counts(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        y, text, word = whole(batches)
        return np.concatenate([np.bincount(word[y[text] == v], minlength=size) for v in (1, 0)]).astype(float)

    size = n_weights()
    scale = scale_of(*sums_of(known, counts, None).reshape(2, size), positive, n - positive)

    def loss(free: np.ndarray) -> tuple[float, np.ndarray]:
        weights = scale * free

        def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            return loss_of(weights, *whole(batches))

        return objective(free, scale, sums_of(known, part, None), n)

    return Model(scale * minimise(loss, np.zeros(size), STEPS))


def score(docs: DataFrame, model: Model, columns: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """``columns`` of each row and its text's score."""
    return scored(docs, columns, text_col, name, model)
