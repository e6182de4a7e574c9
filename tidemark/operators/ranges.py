"""Ranges of rows by position and by time, heads and tails.

Position is that in the order of given columns, rows that are equal there as they came. A short range of
leading rows is a top-k (each task keeps its own first ones); one from the end is the same from the other side.
For any other the rows are written once, in ranges of their order, ties split as well, so that no task has to
order all rows whatever their keys; a row's position is its file's first one plus its place in the file, and
only files that hold some of the range are read again.
"""

from __future__ import annotations

import re
from typing import Any
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import SchemaError, UserInputError

#: Rows that a top-k of one task may hold.
MOST = 100_000


def _order(columns: list[str], descending: bool = False) -> list[Column]:
    cols = [F.col("`" + c.replace("`", "``") + "`") for c in columns]
    return [c.desc_nulls_last() if descending else c.asc_nulls_first() for c in cols]


def head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows, or all but the last -n."""
    if n >= 0:
        return rows_between(df, 0, n, order)
    return rows_between(df, None, n, order)


def tail(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last n rows, or all but the first -n."""
    if n > MOST or n < 0:
        return rows_between(df, -n if n > 0 else -n, None, order)
    placed = df.withColumn("__tie", F.monotonically_increasing_id())
    out = placed.orderBy(*_order(order, True), F.col("__tie").desc()).limit(n)
    return out.orderBy(*_order(order), "__tie").drop("__tie")


def rows_between(df: DataFrame, start: int | None, end: int | None, order: list[str]) -> DataFrame:
    """Rows start, ..., end - 1 in the order of ``order``; negative numbers count from the end, None is open."""
    if start in (None, 0) and end is None:
        return df
    if (start or 0) >= 0 and end is not None and 0 <= end <= MOST:
        first = df.withColumn("__tie", F.monotonically_increasing_id()).orderBy(*_order(order), "__tie")
        start = min(start or 0, end)
        return (first.offset(start) if start else first).limit(end - start).drop("__tie")
    files, total = _in_files(df, order)
    start, end = (x if x is None or x >= 0 else max(0, total + x) for x in (start or 0, end))
    end = total if end is None else min(end, total)
    placed = _placed(df, [(path, first) for path, first, n in files if first < end and first + n > start], "__position")
    c = F.col("__position")
    return placed.filter((c >= F.lit(start)) & (c < F.lit(end))).drop("__position")


def positions(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds each row's position."""
    files, _ = _in_files(df, order)
    return _placed(df, [(path, first) for path, first, _ in files], name)


def file_order(path: str) -> tuple[int, int]:
    """Number of the task that wrote a file, and of the file among the task's."""
    task, part = re.search(r"part-(\d+)-.*?[-.]c(\d+)[.]", path.rpartition("/")[2]).groups()
    return int(task), int(part)


def file_key(path: str) -> str:
    """A file's name with its folder's, which no two files of a store share."""
    return "/".join(path.rsplit("/", 2)[1:])


def file_key_column() -> Column:
    return F.substring_index(F.col("_metadata.file_path"), "/", -2)


def in_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows in ranges of an order, sorted within each; rows that are equal in it stay as they came, and may be in several."""
    rows = df.withColumn("__tie", F.monotonically_increasing_id())
    return rows.repartitionByRange(*order, F.col("__tie")).sortWithinPartitions(*order, F.col("__tie")).drop("__tie")


def _in_files(df: DataFrame, order: list[str]) -> tuple[list[tuple[str, int, int]], int]:
    """Writes the rows in their order; each file's path, first position and rows, and the rows of all."""
    from tidemark.sources.files import own_folder

    spark = df.sparkSession
    path = own_folder(spark, "tidemark-rows-") + "/rows"
    stored = df.drop(*_void(df))
    in_ranges(stored, _order(order)).write.parquet(path)
    rows = spark.read.schema(stored.schema).parquet(path)
    found = rows.groupBy(F.col("_metadata.file_path").alias("f")).count().collect()  # a row per file
    out, total = [], 0
    for file, n in sorted(((r[0], r[1]) for r in found), key=lambda r: file_order(r[0])):
        out.append((unquote(file), total, n))
        total += n
    return out, total


def _void(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)]


def _placed(df: DataFrame, files: list[tuple[str, int]], name: str) -> DataFrame:
    """The rows of files, with the columns of ``df`` and positions counted from each file's first."""
    spark, void = df.sparkSession, _void(df)
    schema = T.StructType([f for f in df.schema.fields if f.name not in void])
    if not files:
        out = spark.createDataFrame([], T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))
        return out
    out = placed_rows(spark, schema, files, name)
    return out.select(*(F.lit(None).alias(f.name) if f.name in void else F.col("`" + f.name.replace("`", "``") + "`") for f in df.schema.fields), name)


def placed_rows(spark, schema: T.StructType, files: list[tuple[str, int]], name: str) -> DataFrame:
    """Rows of Parquet files with positions: a file's first one, plus a row's place in it."""
    rows = spark.read.schema(schema).parquet(*(path for path, _ in files))
    if len(files) == 1:
        return rows.withColumn(name, F.col("_metadata.row_index") + F.lit(files[0][1]))
    table = spark.createDataFrame([(file_key(path), first) for path, first in files], "__f string, __first long")  # a row per file
    rows = rows.select("*", file_key_column().alias("__file"), F.col("_metadata.row_index").alias("__at"))
    rows = rows.join(F.broadcast(table), F.col("__file") == F.col("__f"))
    return rows.withColumn(name, F.col("__first") + F.col("__at")).drop("__f", "__file", "__first", "__at")


def dates_between(df: DataFrame, index: str | None, start: Any, end: Any) -> DataFrame:
    """Rows whose time is in [start, end]; None is open."""
    fields = {f.name: f for f in df.schema.fields}
    if index not in fields or not isinstance(fields[index].dataType, (T.TimestampType, T.TimestampNTZType)):
        raise SchemaError("a date range needs an index of times")
    if start is not None and end is not None and pd.Timestamp(start) > pd.Timestamp(end):
        raise UserInputError("a date range must not end before it starts")
    kind = fields[index].dataType
    c = F.col("`" + index.replace("`", "``") + "`")
    for bound, keeps in ((start, c.__ge__), (end, c.__le__)):
        if bound is not None:
            df = df.filter(keeps(time_literal(bound, kind)))
    return df


def time_literal(value: Any, kind: T.DataType) -> Column:
    """A time as a constant of a column's type; times without a zone are UTC."""
    t = pd.Timestamp(value)
    t = t.tz_convert("UTC").tz_localize(None) if t.tzinfo else t
    return F.lit(str(t)).cast("timestamp_ntz") if isinstance(kind, T.TimestampNTZType) else F.lit(f"{t}+00:00").cast("timestamp")
