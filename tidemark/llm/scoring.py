"""What the classifiers share: a bounded sample of labelled rows, and scoring of whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded_batches, quoted
from tidemark.llm.words import slices

#: Numbers of a long array that are added up together.
BLOCK = 1 << 14


def id_hash(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (0 for a null id)."""
    return F.coalesce(F.crc32(quoted(id_col).cast("string")) % n, F.lit(0))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, id_col: str, text_col: str) -> DataFrame:
    """``__id, __label, __text`` of labelled documents: of at most about ``rows`` labels, chosen by a hash of the id.

    The chosen labels are broadcast; ``rows`` bounds them whatever the data.
    """
    known = labels.filter(learn & quoted(label).isNotNull() & quoted(id_col).isNotNull()).select(quoted(id_col).alias("__id"), quoted(label).cast("int").alias("__label"))
    share = min(1.0, rows / max(known.count(), 1))
    known = known.filter(F.pmod(F.xxhash64("__id"), F.lit(1_000_003)) < share * 1_000_003)
    texts = docs.select(quoted(id_col).alias("__id"), quoted(text_col).alias("__text"))
    return texts.join(F.broadcast(known), "__id")


def scored(docs: DataFrame, columns: list[str], text_col: str, name: str, score: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """``columns`` of each row and the score of its text, a double."""
    bounded_batches(docs.sparkSession)
    held = [f"__column_{i}" for i in range(len(columns))]
    rows = docs.select(*(quoted(c).alias(h) for c, h in zip(columns, held, strict=True)), quoted(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                yield pa.RecordBatch.from_arrays([*(part[h] for h in held), pa.array(score(part["__text"]), pa.float64())], [*held, "__score"])

    schema = T.StructType([*(T.StructField(h, rows.schema[h].dataType) for h in held), T.StructField("__score", T.DoubleType())])
    out = rows.mapInArrow(run, schema)
    return out.select(*(F.col(h).alias(c) for c, h in zip(columns, held, strict=True)), F.col("__score").alias(name))


def sums_of(rows: DataFrame, add: Callable[[Iterator[pa.RecordBatch]], np.ndarray], partitions: int | None = 16) -> np.ndarray:
    """Sum of the arrays that ``add`` makes of each of a few partitions of bounded ``rows`` (None: as they are)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([add(batches).astype("<f8").tobytes()], pa.binary())], ["sum"])

    parts = (rows.repartition(partitions) if partitions else rows).mapInArrow(run, "sum binary").collect()
    return sum(np.frombuffer(r[0], "<f8") for r in parts)


def long_sums_of(rows: DataFrame, add: Callable[[Iterator[pa.RecordBatch]], np.ndarray], partitions: int = 16) -> np.ndarray:
    """As ``sums_of``, for long arrays: executors add them up block by block, so the driver gets one, not one of each partition."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = add(batches).astype("<f8"), TaskContext.get().partitionId()
        for at in range(0, len(own), BLOCK):
            yield pa.RecordBatch.from_pydict({"at": [at], "part": [part], "sum": [own[at : at + BLOCK].tobytes()]})

    def added(table: pa.Table) -> pa.Table:
        parts = sorted(table.to_pylist(), key=lambda r: r["part"])
        return pa.table({"at": [parts[0]["at"]], "sum": [sum(np.frombuffer(r["sum"], "<f8") for r in parts).tobytes()]})

    parts = rows.repartition(partitions).mapInArrow(blocks, "at long, part long, sum binary")
    sums = parts.groupBy("at").applyInArrow(added, "at long, sum binary").collect()
    return np.concatenate([np.frombuffer(r["sum"], "<f8") for r in sorted(sums, key=lambda r: r["at"])])
