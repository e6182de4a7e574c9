"""Streams into a library: each micro-batch is staged, and finalized with the others or at once.

A batch's token is made of its stream's checkpoint and its number, and under a token rows are staged once and
become part of a version once. So a batch that runs again after a failure, wherever that was, adds nothing twice.
"""

from __future__ import annotations

import hashlib
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.operators.aggregate import BUCKET_OPS, lowered, parse
from tidemark.operators.resample import Resample
from tidemark.sources.library import Library
from tidemark.sources.manifest import safe


def staging_sink(stream: DataFrame, library: Library, symbol: str, checkpoint: str, index: str | None = None, finalize: bool = False) -> DataStreamWriter:
    """A writer that stages each micro-batch, sorted by its index; finalize: and appends it at once."""
    name = hashlib.sha1(checkpoint.encode()).hexdigest()[:16]

    def put(batch: DataFrame, number: int) -> None:
        token = f"{name}-{number:012d}"
        if library.folder.exists(_mark(symbol, token)) or library.is_adopted(symbol, token) or batch.isEmpty():
            return
        library.stage(symbol, batch, index=index, sort_on_index=index is not None, token=token)
        if finalize:
            library.sort_and_finalize_staged_data(symbol, "append", [token]) if index else library.finalize_staged_data(symbol, "append", [token])
        library.folder.put(_mark(symbol, token), "{}")  # by itself this would not do: it comes after the rest

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)


def _mark(symbol: str, token: str) -> str:
    return f"streams/{safe(symbol)}/{token}"


def resample_stream(stream: DataFrame, index: str, rule: Any, aggregations: dict, watermark: str, closed: str | None = None, label: str | None = None, offset: Any = None) -> DataFrame:
    """An extension: resampling of a stream, with late rows up to the watermark.

    Buckets are those of ``Query.resample`` with a fixed origin; first and last go by time.
    """
    spec = Resample.of(rule, closed, label, offset)
    shift = spec.offset % spec.rule + (1 if spec.right_closed else 0)
    rows = stream.withColumn("__t", F.col(f"`{index}`").cast("timestamp")).withWatermark("__t", watermark)
    window = F.window("__t", f"{spec.rule} microseconds", startTime=f"{shift} microseconds")
    grouped = rows.groupBy(window.alias("__w")).agg(*(lowered(a, stream.schema, F.struct("__t")) for a in parse(aggregations, BUCKET_OPS)))
    start = F.unix_micros(F.col("__w.start")) - (1 if spec.right_closed else 0) + (spec.rule if spec.right_label else 0)
    return grouped.select(F.timestamp_micros(start).alias(index), *(F.col(f"`{a}`") for a in aggregations))
