"""Packing documents into token sequences by cutting stock with column generation.

A document's ids, its end id included, are cut into full sequences and a rest. Lengths are rounded up to
CLASSES steps of the capacity and counted; the linear program over filling patterns (at least so many
pieces of each class, as few sequences as possible) is solved by column generation: a knapsack by dynamic
programming prices new patterns until none improves. Whole multiples of the patterns are kept and the few
pieces left over are packed first-fit decreasing. Pieces are ranked within their class, and ranges of
ranks are dealt to patterns, so each piece finds its sequence by itself.

Scale: the driver sees CLASSES counts, whatever the data. Ranks come from counts of hash buckets within
a class, so no task holds a class. The plan has some hundred rows, at most a few for each class and
pattern, and is broadcast.

Defined results: a null or empty text is its end id alone. Rows that repeat an id are packed as often.
An empty table gives no piece. Within a sequence pieces lie gaplessly, larger classes first.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, quoted, written
from tidemark.llm.linear import inverse as inverse_of
from tidemark.llm.tokens import END, encoder, shared_vocabulary
from tidemark.llm.words import ranges, slices

CAPACITY = 1024
CLASSES = 128
BUCKETS = 1024


def knapsack(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of items within the capacity: its value and how often it has each item."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(size, kind="stable")
    value_in, size_in = value[order], size[order]
    fit = np.searchsorted(size_in, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if n := fit[room]:
            with_item = best[room - size_in[:n]] + value_in[:n]
            i = int(with_item.argmax())
            if with_item[i] > best[room] + 1e-12:
                best[room], taken[room] = with_item[i], i
    counts, room = np.zeros(len(size), np.int64), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            counts[order[taken[room]]] += 1
            room -= int(size_in[taken[room]])
    return float(best[capacity]), counts


def cutting_stock(demand: np.ndarray, size: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns (pieces of each class) and how often each is cut; together they meet the demand exactly."""
    m = len(demand)
    if not m:
        return []
    basis = np.diag((capacity // size).astype(float))
    inverse, x = np.diag(1 / np.diag(basis)), demand / np.diag(basis)
    for step in range(50 * m):
        price, column = knapsack(inverse.sum(axis=0), size, capacity)
        if price <= 1 + 1e-7:
            break
        direction = inverse @ column
        up = direction > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, direction, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * direction, 0)
        x[out] = ratio[out]
        basis[:, out] = column
        if step % 64 == 63:
            inverse = inverse_of(basis)
        else:
            row = inverse[out] / direction[out]
            inverse = inverse - np.outer(direction, row)
            inverse[out] = row
    left, cut = demand.astype(np.int64).copy(), []
    for p in range(m):
        pattern = basis[:, p].round().astype(np.int64)
        times = int(x[p] + 1e-6)
        times = min([times, *(left[pattern > 0] // pattern[pattern > 0]).tolist()])
        if times > 0:
            cut.append((pattern, times))
            left -= times * pattern
    room, bins = np.zeros(0, np.int64), []
    for c in np.argsort(-size):  # what is left: a few patterns' pieces
        for _ in range(int(left[c])):
            at = np.flatnonzero(room >= size[c])
            if not len(at):
                room, at = np.append(room, capacity), [len(bins)]
                bins.append(np.zeros(m, np.int64))
            room[at[0]] -= size[c]
            bins[at[0]][c] += 1
    rest = Counter(tuple(b.tolist()) for b in bins)
    return cut + [(np.array(b), n) for b, n in sorted(rest.items())]


def plan(counts: dict[int, int], capacity: int = CLASSES) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (class, first rank, end of ranks, pieces of the class in a sequence, first sequence, slot)."""
    size = np.array(sorted(counts), np.int64)
    demand = np.array([counts[int(c)] for c in size], np.int64)
    used, rows, sequence = np.zeros(len(size), np.int64), [], 0
    for pattern, times in cutting_stock(demand, size, capacity):
        slot = 0
        for c in np.flatnonzero(pattern)[::-1]:
            n = int(pattern[c])
            rows.append((int(size[c]), int(used[c]), int(used[c]) + n * times, n, sequence, slot))
            used[c] += n * times
            slot += n
        sequence += times
    return rows


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents: id, start, length, ids_crc32, doc_tokens and, if asked for, ids (32-bit, little-endian)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = shared_vocabulary(spark, vocabulary)
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, bounds = enc.encode(part["text"])
                n = np.diff(bounds) + 1
                ids = np.insert(ids, bounds[1:], END)
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), pieces)
                start = ranges(np.zeros(len(n), np.int64), pieces) * capacity
                length = np.minimum(n[doc] - start, capacity)
                at = (np.cumsum(n) - n)[doc] + start
                data = memoryview(ids.astype("<u4").tobytes())
                spans = [data[4 * a : 4 * (a + k)] for a, k in zip(at.tolist(), length.tolist(), strict=True)]
                columns = [part["id"].take(pa.array(doc)), start, length, [zlib.crc32(s) for s in spans], n[doc]]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
                columns = [columns[0], *(pa.array(c, pa.int64()) for c in columns[1:])]
                if with_ids:
                    columns, names = [*columns, pa.array([bytes(s) for s in spans], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids."""
    spark = docs.sparkSession
    step = -(-capacity // CLASSES)
    pieces = written(cut(docs, id_col, text_col, capacity, vocabulary, with_ids), "pack-pieces")
    pieces = pieces.withColumn("__class", F.ceil(F.col("length") / step).cast("int")).withColumn("__bucket", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(BUCKETS)).cast("int"))
    counts = pieces.groupBy("__class", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__class").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))), "pack-counts")
    total = {r[0]: r[1] for r in starts.groupBy("__class").agg(F.sum("__n")).collect()}
    columns = np.array(plan(total, capacity // step), np.int64).reshape(-1, 6).T
    # an Arrow table: rows from a list would start more Python workers on the executors
    rows = spark.createDataFrame(pa.table([columns[0].astype(np.int32), *columns[1:]], ["__c", "__lo", "__hi", "__per", "__first", "__slot"]))
    within = Window.partitionBy("__class", "__bucket").orderBy(F.xxhash64("start", "id"), "id", "start")
    ranked = pieces.withColumn("__rank", F.row_number().over(within) - 1)
    # at most CLASSES * BUCKETS rows
    ranked = ranked.join(F.broadcast(starts.drop("__n")), ["__class", "__bucket"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    dealt = ranked.join(F.broadcast(rows), (F.col("__class") == F.col("__c")) & (F.col("__rank") >= F.col("__lo")) & (F.col("__rank") < F.col("__hi")))
    nth = F.col("__rank") - F.col("__lo")
    dealt = dealt.withColumn("sequence_id", F.col("__first") + F.floor(nth / F.col("__per"))).withColumn("__slot", F.col("__slot") + nth % F.col("__per"))
    earlier = Window.partitionBy("sequence_id").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)))
    return dealt.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids (32-bit, little-endian, unpadded), from ``pack(..., with_ids=True)``."""
    pieces = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return pieces.select("sequence_id", F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))
