"""Token-ID output: whole texts as token ids in Re-Pair compressed binary files, and reading them back.

Documents are range-partitioned and sorted by id; each task encodes its texts and writes one file, shard
after shard of about SHARD_TOKENS ids, so memory doesn't grow with a partition. A file has its name only
once it is whole, and only files that a finished task reported are read, so lost or repeated tasks do no
harm. The manifest (a table, a row per file) says where each shard lies and how many ids come before it;
shards are read in parallel, and within one any document is decoded by itself (``repair.Shard.decode``).

Defined results: a null text is empty, and has the end id alone. Null ids come first. Rows that repeat an
id stay next to each other, in any order. An empty table gives no file and no row.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import repair
from tidemark.llm.common import bounded_batches, new_path, quoted, spread_out, written
from tidemark.llm.files import read_range, write_once
from tidemark.llm.tokens import END, encoder, shared_vocabulary
from tidemark.llm.words import slices

SHARD_TOKENS = 1 << 20
MANIFEST = "part int, path string, tokens long, shards array<struct<offset: long, size: long, before: long>>"


def write(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, to_the_end: bool = False) -> DataFrame:
    """Writes the ids of all texts, END after each, in ascending order of id; returns the manifest.

    folder: a new one in the shared folder, if None. vocabulary: path of the tokenizer's file. to_the_end: replace
    pairs until none repeats (smaller files, more work).
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = folder or new_path(spark, "token-files")
    shared = shared_vocabulary(spark, vocabulary)
    rows = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id")
    return written(rows.mapInArrow(_writer(shared, folder, to_the_end), MANIFEST), "token-manifest")


def _writer(shared, folder: str, to_the_end: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(shared.value), np.uint32(END)
        shards: list[dict] = []
        offset = before = 0

        def packed() -> Iterator[bytes]:
            nonlocal offset, before
            ids: list[int | None] = []
            docs: list[np.ndarray] = []
            held = 0

            def flush() -> bytes:
                nonlocal offset, before, held
                data = repair.pack(ids, docs, enc.size, to_the_end)
                shards.append({"offset": offset, "size": len(data), "before": before})
                offset, before, held = offset + len(data), before + held, 0
                ids.clear()
                docs.clear()
                return data

            for batch in batches:
                for part in slices(batch, "text"):
                    tokens, bounds = enc.encode(part["text"])
                    for doc_id, a, b in zip(part["id"].to_pylist(), bounds.tolist(), bounds[1:].tolist(), strict=False):
                        ids.append(doc_id)
                        docs.append(np.append(tokens[a:b], end))
                        held += b - a + 1
                        if held >= SHARD_TOKENS:
                            yield flush()
            if ids:
                yield flush()

        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.tokens"
        parts = packed()
        if (first := next(parts, None)) is not None:
            write_once(path, _chain(first, parts))
            yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "tokens": before, "shards": shards}], _manifest_schema())

    return run


def _chain(first: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    yield first
    yield from rest


def _manifest_schema() -> pa.Schema:
    shard = pa.struct([("offset", pa.int64()), ("size", pa.int64()), ("before", pa.int64())])
    return pa.schema([("part", pa.int32()), ("path", pa.string()), ("tokens", pa.int64()), ("shards", pa.list_(shard))])


def read(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """The documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids.

    The manifest's rows are one per file; their running sum is taken in one task.
    """
    files = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("start", F.coalesce(F.sum("tokens").over(files), F.lit(0)))
    shards = shards.select("path", "start", F.explode("shards").alias("shard"))
    shards = shards.select("path", F.col("shard.offset").alias("offset"), F.col("shard.size").alias("size"), (F.col("start") + F.col("shard.before")).alias("start"))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = repair.Shard.parse(read_range(row["path"], row["offset"], row["size"]))
                docs = shard.documents()
                columns = [shard.doc_ids, row["start"] + shard.ids_at[:-1], np.diff(shard.ids_at), [zlib.crc32(d.tobytes()) for d in docs]]
                if with_ids:
                    columns.append([d.astype(np.int32) for d in docs])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return spread_out(shards, "path", "offset").mapInArrow(run, kind)
