"""Language-model scoring: a Katz backoff model of n-grams, learnt from some documents and applied to all.

Counts of n-grams up to a given order are discounted by Good-Turing estimates, order by order; the mass this
frees goes to unseen successors of a context in proportion to their probabilities after the context less its
first word, by a backoff weight that makes each context's probabilities sum to exactly one over the
vocabulary and one unknown word. A token's probability is that of its longest n-gram if that was seen, else
the context's backoff weight times the token's probability after the shorter context, and so on down to
its unigram's, or that of the unknown word. A context that was never seen weighs one. Before a text stand
start tokens, so that its first token has a context of each length too.

Words are 64-bit hashes. Texts are cut into chunks of about CHUNK tokens, a table of word numbers. Chunks
ask tables of n-grams and of contexts, of each length, dealt over buckets by hash range, for what they
need: each chunk sends its distinct keys with its own counts, the bucket adds up all chunks' counts, keeps
the total as its part of the model's tables and answers each chunk. So no token is shuffled by itself, a
frequent n-gram is one key per chunk, and the number of buckets grows with the data so that a
bucket's size does not.

Defined results: a null text is empty: the end token alone. Null ids are scored and learnt from as any
other. Rows that repeat are learnt from as often. If nothing is learnt, every token is unknown with
probability one. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, quoted, written
from tidemark.llm.words import slices, words

#: Words of the longest n-grams.
ORDER = 2
CHUNK = 3 << 19
#: Keys that a bucket gets, about.
BUCKET = 1 << 21
#: Counts up to this one are discounted by Good-Turing estimates.
CUTOFF = 5
#: What higher counts keep, so that every context has mass for unseen successors.
HIGH = 1 - 1e-5
#: Stand-ins for the tokens that are no words.
START, END = np.uint64(1), np.uint64(2)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, byte plane by byte plane: the high planes compress to nothing."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def pack_numbers(numbers: np.ndarray) -> bytes:
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def pack_counts(counts: np.ndarray) -> bytes:
    """64-bit numbers, byte plane by byte plane."""
    return counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


def unpack_numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where sorted keys go from one bucket's range of hashes to the next."""
    return np.searchsorted((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))


def discounts(n: np.ndarray) -> np.ndarray:
    """Share that counts 0, ..., CUTOFF, more keep; n[r]: kinds with count r, up to CUTOFF + 1.

    Where the estimates are no shares, as on little data, a count r keeps (r - 0.5) / r.
    """
    out = np.array([0.0, *[(r - 0.5) / r for r in range(1, CUTOFF + 1)], HIGH])
    if n[1] > 0:
        common = (CUTOFF + 1) * n[CUTOFF + 1] / n[1]
        for r in range(1, CUTOFF + 1):
            if n[r] > 0 and common < 1:
                d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
                if 0 < d < 1:
                    out[r] = d
    return out


@dataclass
class Grams:
    """The distinct n-grams of a chunk, by sorted keys.

    context: numbers of their first n - 1 words among the shorter n-grams (a text's start: the number after the
    last); suffix: numbers of their last n - 1 words; which: each token's n-gram; counts: uses in learnt texts.
    Words have neither context nor suffix.
    """

    keys: np.ndarray
    context: np.ndarray
    suffix: np.ndarray
    which: np.ndarray
    counts: np.ndarray

    def contexts(self) -> np.ndarray:
        """Keys of the n-grams as contexts of longer ones, and of a text's start."""
        return np.append(self.keys, START)


@dataclass(frozen=True)
class Estimates:
    """What all tasks need of the whole corpus: tokens and kinds learnt from, texts, and what counts keep, by order."""

    tokens: int
    kinds: int
    texts: int
    unknown: float
    kept: tuple[np.ndarray, ...]

    def context_counts(self, counts: np.ndarray) -> np.ndarray:
        """Of n-grams as contexts (all that a learnt text's end is not in have a successor), and of a text's start."""
        return np.append(counts, self.texts)

    def seen(self, grams: list[Grams], counts: list[np.ndarray], n: int) -> np.ndarray:
        """Probability of n-grams that were learnt, after their contexts; of words that were not, that of the unknown one."""
        own = counts[n - 1]
        kept = self.kept[n - 1][np.minimum(own, CUTOFF + 1)] * own
        if n == 1:
            return np.where(own > 0, kept / max(self.tokens, 1), self.unknown)
        return kept / np.maximum(self.context_counts(counts[n - 2])[grams[n - 1].context], 1)

    def chance(self, grams: list[Grams], counts: list[np.ndarray], weights: list[np.ndarray], n: int) -> np.ndarray:
        """Probability of all n-grams; weights: of contexts, by n."""
        own = self.seen(grams, counts, n)
        if n > 1:
            new = counts[n - 1] == 0
            shorter = self.chance(grams, counts, weights, n - 1)[grams[n - 1].suffix]
            own[new] = shorter[new] * weights[n - 2][grams[n - 1].context[new]]
        return own


@dataclass
class Chunk:
    """Texts of a chunk: word numbers of all tokens (indexes into sorted ``words``), bounds and learnt texts."""

    words: np.ndarray
    tokens: np.ndarray
    bounds: np.ndarray
    learnt: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Chunk:
        return cls(unpack_keys(row["words"]), unpack_numbers(row["tokens"]), np.frombuffer(row["bounds"], "<i8"), np.frombuffer(row["learnt"], np.uint8).astype(bool))

    def learnt_tokens(self) -> np.ndarray:
        return np.repeat(self.learnt, np.diff(self.bounds))

    def grams(self, order: int) -> list[Grams]:
        """The n-grams of all lengths up to ``order``."""
        learnt, none = self.learnt_tokens(), np.zeros(0, np.int64)
        out = [Grams(self.words, none, none, self.tokens, np.bincount(self.tokens[learnt], minlength=len(self.words)))]
        while len(out) < order:
            low = out[-1]
            context = np.empty(len(self.tokens), np.int64)
            context[1:] = low.which[:-1]
            context[self.bounds[:-1]] = len(low.keys)
            both, which = np.unique(context << 32 | self.tokens, return_inverse=True)
            context, word = both >> 32, both & 0xFFFFFFFF
            keys = low.contexts()[context] * np.uint64(0x9E3779B97F4A7C15) ^ self.words[word]
            keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            keys ^= keys >> np.uint64(32)
            at = np.argsort(keys)
            place = np.empty(len(at), np.int64)
            place[at] = np.arange(len(at))
            which = place[which]
            suffix = np.empty(len(at), np.int64)
            suffix[which] = low.which
            out.append(Grams(keys[at], context[at], suffix, which, np.bincount(which[learnt], minlength=len(at))))
        return out


def _chunks(docs: DataFrame) -> DataFrame:
    """The chunks of documents ``id, text, learn``, with their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, number = [], 0, TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            named, tokens = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            sizes = np.concatenate([h[1] for h in held])
            ids = pa.concat_arrays([h[2] for h in held])
            learnt = np.concatenate([h[3] for h in held])
            row = {"chunk": pa.array([number], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "words": [pack_keys(named)], "tokens": [pack_numbers(tokens)], "bounds": [np.concatenate([[0], np.cumsum(sizes)]).astype("<i8").tobytes()], "learnt": [learnt.astype(np.uint8).tobytes()], "texts": pa.array([int(learnt.sum())], pa.int64())}
            return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, pa.binary()) for v in row.values()], list(row))

        for batch in batches:
            for part in slices(batch, "text"):
                hashes, first = words(part["text"])
                held.append((np.insert(hashes, first[1:], END), np.diff(first) + 1, part["id"], np.asarray(part["learn"].to_numpy(zero_copy_only=False), bool)))
                n += len(held[-1][0])
                if n >= CHUNK:
                    yield flush()
                    held, n, number = [], 0, number + 1
        if held:
            yield flush()

    return docs.mapInArrow(run, "chunk long, ids array<long>, words binary, tokens binary, bounds binary, learnt binary, texts long")


def _ask(chunks: DataFrame, answers: DataFrame | None, keys_of: Callable[[Chunk, dict], tuple[np.ndarray, list[bytes]]], buckets: int, parts: int) -> DataFrame:
    """Each chunk's sorted keys and columns of numbers, cut by buckets: ``bucket, chunk, keys, v0, v1, ...``."""
    names = ["bucket", "chunk", "keys", *(f"v{i}" for i in range(parts))]

    def rows(row: dict, known: dict) -> Iterator[pa.RecordBatch]:
        keys, columns = keys_of(Chunk.of(row), known)
        edges = bucket_edges(keys, buckets)
        out: list[tuple] = []
        for b in np.flatnonzero(np.diff(edges)).tolist():
            s = slice(edges[b], edges[b + 1])
            out.append((b, row["chunk"], pack_keys(keys[s]), *(c[s].astype("<f8").view(np.uint8).reshape(-1, 8).T.tobytes() if c.dtype.kind == "f" else pack_numbers(c[s]) for c in columns)))
        kinds = [pa.int32(), pa.int64()] + [pa.binary()] * (1 + parts)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(names), kinds, strict=True)], names)

    kind = "bucket int, chunk long, keys binary" + "".join(f", v{i} binary" for i in range(parts))
    return _with_answers(chunks, answers, rows, kind)


def _with_answers(chunks: DataFrame, answers: DataFrame | None, rows: Callable[[dict, dict], Iterator[pa.RecordBatch]], kind: str) -> DataFrame:
    """Runs ``rows`` for each chunk and what it was answered: by kind of question, the parts in order of buckets."""
    if answers is None:

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield from rows(batch.slice(i, 1).to_pylist()[0], {})

        return chunks.mapInArrow(alone, kind)

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        known: dict[str, list] = {}
        for answer in sorted(right.to_pylist(), key=lambda r: r["bucket"]):
            known.setdefault(answer["kind"], []).append(answer["answer"])
        return pa.Table.from_batches([b for row in left.to_pylist() for b in rows(row, known)])

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(both, kind)


def _answer(asked: DataFrame, kind: str, merge: Callable[[list[np.ndarray], np.ndarray, list[dict]], tuple[list[bytes], dict]]) -> DataFrame:
    """Merges each bucket's keys over chunks. Rows with a chunk answer it; one row with none is the bucket's part of the model."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [unpack_keys(r["keys"]) for r in rows]
        kinds, which = np.unique(np.concatenate(keys), return_inverse=True)
        answers, part = merge(kinds, which, rows)
        n = len(rows)
        return pa.table([[rows[0]["bucket"]] * (n + 1), [*(r["chunk"] for r in rows), None], [kind] * (n + 1), [*answers, None], [None] * n + [pack_keys(kinds)], [None] * n + [part["values"]], [None] * n + [part.get("stats")]], names=["bucket", "chunk", "kind", "answer", "keys", "values", "stats"]).cast(schema)

    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.string()), ("answer", pa.binary()), ("keys", pa.binary()), ("values", pa.binary()), ("stats", pa.list_(pa.int64()))])
    return asked.groupBy("bucket").applyInArrow(run, "bucket int, chunk long, kind string, answer binary, keys binary, values binary, stats array<long>")


def _split(values: np.ndarray, rows: list[dict], pack: Callable[[np.ndarray], bytes]) -> list[bytes]:
    return [pack(v) for v in np.split(values, np.cumsum([len(r["keys"]) // 8 for r in rows])[:-1])]


def _merge_counts(kinds: np.ndarray, which: np.ndarray, rows: list[dict]) -> tuple[list[bytes], dict]:
    """Total count of each key, doubled, plus one for the one chunk that is to account for it."""
    counts = np.concatenate([unpack_numbers(r["v0"]) for r in rows])
    total = np.bincount(which, counts, minlength=len(kinds)).astype(np.int64)
    first = np.zeros(len(which), np.int64)
    first[np.unique(which, return_index=True)[1]] = 1
    stats = [int(total.sum()), int((total > 0).sum()), *np.bincount(np.minimum(total, CUTOFF + 2), minlength=CUTOFF + 3).tolist()]
    return _split(total[which] * 2 + first, rows, pack_counts), {"values": pack_counts(total), "stats": stats}


def _counts(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts and who accounts, from all buckets' answers."""
    both = np.concatenate([np.zeros(0, np.int64), *map(unpack_counts, parts)])
    return both >> 1, (both & 1).astype(bool)


def _doubles(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<f8").ravel()


def _told(parts: list[bytes], contexts: np.ndarray) -> np.ndarray:
    """Weights of contexts from all buckets' answers, one where none was told."""
    halves = [(np.frombuffer(p[: len(p) // 2], "<u8"), np.frombuffer(p[len(p) // 2 :], "<f8")) for p in parts]
    named, weights = (np.concatenate([np.zeros(0, t), *(h[i] for h in halves)]) for i, t in ((0, np.uint64), (1, float)))
    order = np.argsort(named)
    named, weights = np.append(named[order], np.uint64(2**64 - 1)), np.append(weights[order], 1.0)
    at = np.searchsorted(named, contexts)
    return np.where(named[at] == contexts, weights[at], 1.0)


def _totals(answers: DataFrame) -> np.ndarray:
    """Sum of the buckets' statistics: tokens, kinds, then kinds by count."""
    sums = answers.filter("chunk is null").agg(*(F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(CUTOFF + 5))).first()
    return np.array([x or 0 for x in sums], np.int64)


@dataclass
class Scored:
    """Scores of all documents, and the model's tables: a row per bucket of sorted ``keys`` and their ``values``.

    counts: of n-grams, by n from 1, as ``unpack_counts`` reads them; contexts: backoff weights of contexts of
    n words, by n from 1, as doubles.
    """

    scores: DataFrame
    counts: list[DataFrame]
    contexts: list[DataFrame]


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> Scored:
    """Learns from the documents for which ``learn`` holds and scores all.

    scores: id, learnt, n_tokens, n_known, train_tokens, base_score (unigrams with one added) and score,
    both the text's log10 probability. order: words of the longest n-grams, 1 or more.
    """
    if order < 1:
        raise ValueError(f"an order of {order}")
    bounded_batches(docs.sparkSession)
    rows = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"), F.coalesce(learn, F.lit(True)).alias("learn"))
    chunks = written(_chunks(rows), "lm-chunks", "zstd")
    size = chunks.agg(F.sum(F.octet_length("tokens")) / 4).first()[0] or 0
    buckets = max(4, -(-int(size) // BUCKET))

    def count(n: int) -> DataFrame:
        """Counts of all n-grams."""

        def ask(chunk: Chunk, _: dict) -> tuple[np.ndarray, list[np.ndarray]]:
            grams = chunk.grams(n)[-1]
            return grams.keys, [grams.counts]

        return written(_answer(_ask(chunks, None, ask, buckets, 1), f"count {n}", _merge_counts), f"lm-counts-{n}", "zstd")

    counted = [count(n) for n in range(1, order + 1)]
    totals = [_totals(c) for c in counted]
    texts = int(chunks.agg(F.sum("texts")).first()[0] or 0)
    n, kept = totals[0], tuple(discounts(t[2:]) for t in totals)
    seen = sum(kept[0][r] * r * n[2 + r] for r in range(1, CUTOFF + 1)) + HIGH * (n[0] - sum(r * n[2 + r] for r in range(1, CUTOFF + 1)))
    known = Estimates(int(n[0]), int(n[1]), texts, float(1 - seen / n[0]) if n[0] else 1.0, kept)

    def answered(frames: list[DataFrame]) -> DataFrame:
        out = [f.filter("chunk is not null").select("chunk", "kind", "bucket", "answer") for f in frames]
        return reduce(DataFrame.union, out)

    def weigh(n: int) -> DataFrame:
        """Backoff weights of the contexts of n-grams, told to those chunks that have an unseen n-gram after them."""
        keeps = kept[n - 1]

        def ask(chunk: Chunk, answers: dict) -> tuple[np.ndarray, list[np.ndarray]]:
            grams = chunk.grams(n)
            counts = [_counts(answers[f"count {i}"])[0] for i in range(1, n + 1)]
            total, mine = _counts(answers[f"count {n}"])
            context, mine = grams[-1].context, mine & (total > 0)
            named = grams[-2].contexts()
            columns = [np.bincount(context[mine & (total == r)], minlength=len(named)) for r in range(1, CUTOFF + 1)]
            shorter = known.seen(grams, counts, n - 1)[grams[-1].suffix[mine]]  # whose n-gram was seen, was seen itself
            mass = np.bincount(context[mine], shorter, minlength=len(named)).astype(float)
            wanted = np.bincount(context[total == 0], minlength=len(named)) > 0
            chosen = (mass > 0) | wanted
            at = np.argsort(named, kind="stable")
            at = at[chosen[at]]
            return named[at], [c[at] for c in (*columns, wanted.astype(np.int64), known.context_counts(counts[-2]).astype(float), mass)]

        def merge(kinds: np.ndarray, which: np.ndarray, rows: list[dict]) -> tuple[list[bytes], dict]:
            numbers = [np.concatenate([unpack_numbers(r[f"v{i}"]) for r in rows]) for i in range(CUTOFF + 1)]
            counts, masses = (np.concatenate([_doubles(r[f"v{i}"]) for r in rows]) for i in (CUTOFF + 1, CUTOFF + 2))
            mass, count = np.bincount(which, masses, minlength=len(kinds)), np.zeros(len(kinds))
            count[which] = counts
            by_count = [np.bincount(which, numbers[r - 1], minlength=len(kinds)) for r in range(1, CUTOFF + 1)]
            low = sum(r * k for r, k in zip(range(1, CUTOFF + 1), by_count, strict=True))
            left = sum(keeps[r] * r * k for r, k in zip(range(1, CUTOFF + 1), by_count, strict=True)) + HIGH * (count - low)
            weight = np.where(count > 0, (1 - left / np.maximum(count, 1)) / np.maximum(1 - mass, 1e-15), 1.0)
            wanted = numbers[CUTOFF] > 0
            parts = np.split(weight[which], np.cumsum([len(r["keys"]) // 8 for r in rows])[:-1])
            flags = np.split(wanted, np.cumsum([len(r["keys"]) // 8 for r in rows])[:-1])
            answers = [unpack_keys(r["keys"])[f].astype("<u8").tobytes() + p[f].astype("<f8").tobytes() for r, p, f in zip(rows, parts, flags, strict=True)]
            return answers, {"values": weight.astype("<f8").tobytes()}

        return written(_answer(_ask(chunks, answered(counted[:n]), ask, buckets, CUTOFF + 3), f"context {n}", merge), f"lm-contexts-{n}", "zstd")

    weighed = [weigh(n) for n in range(2, order + 1)]
    schema = pa.schema([("id", pa.int64()), ("learnt", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def evaluate(row: dict, answers: dict) -> Iterator[pa.RecordBatch]:
        chunk = Chunk.of(row)
        grams = chunk.grams(order)
        counts = [_counts(answers[f"count {n}"])[0] for n in range(1, order + 1)]
        weights = [_told(answers.get(f"context {n}", []), grams[n - 2].contexts()) for n in range(2, order + 1)]
        chance = known.chance(grams, counts, weights, order)
        base = np.log10((counts[0] + 1) / (known.tokens + known.kinds + 1))

        def by_text(values: np.ndarray) -> np.ndarray:
            return np.add.reduceat(values, chunk.bounds[:-1])

        n = np.diff(chunk.bounds)
        columns = [row["ids"], chunk.learnt, n, by_text((counts[0] > 0)[chunk.tokens].astype(np.int64)), np.full(len(n), known.tokens), by_text(base[chunk.tokens]), by_text(np.log10(np.maximum(chance, 1e-300))[grams[-1].which])]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    scores = _with_answers(chunks, answered([*counted, *weighed]), evaluate, "id long, learnt boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

    def tables(frames: list[DataFrame]) -> list[DataFrame]:
        return [f.filter("chunk is null").select("bucket", "keys", "values") for f in frames]

    return Scored(scores.withColumnRenamed("id", id_col), tables(counted), tables(weighed))
