"""Writing frames as Parquet segments with a row position, and what a manifest says of them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from typing import Any
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import SchemaError, UnsortedDataError, UserInputError
from tidemark.functions import types as K
from tidemark.operators.ranges import file_order, in_ranges, placed_rows
from tidemark.plans.query import ROW
from tidemark.sources.files import Folder

#: Rows of a segment, as a library's option says.
SEGMENT_ROWS = 100_000


@dataclass(frozen=True)
class Segment:
    """A Parquet file: its rows, where they come in the version, and its first and last time (microseconds).

    form: number of its schema in the manifest, where schemas change over time. stats: least and greatest value of
    columns. digest: names the rows, in libraries that look for segments they have.
    """

    path: str
    rows: int
    first_row: int
    start: int | None = None
    end: int | None = None
    form: int = 0
    stats: dict[str, list] = field(default_factory=dict)
    digest: str | None = None

    @property
    def folder(self) -> str:
        return self.path.rpartition("/")[0]


#: Functions that turn objects of other types into frames, or return None; the latest registered is asked first.
_NORMALIZERS: list[Callable[[Any], Any]] = []


def register_normalizer(function: Callable[[Any], Any]) -> None:
    """Lets writes accept further types: ``function`` makes a pandas, Arrow or Spark frame of an object, or returns None."""
    _NORMALIZERS.insert(0, function)


def as_frame(spark: SparkSession, data: Any, index: str | None) -> tuple[DataFrame, str | None]:
    """A Spark DataFrame of the input, and its index of times.

    Accepts Spark, pandas (a DatetimeIndex becomes the index column) and Arrow data. Spark rows without a
    given index have no position of their own but that of their partitions.
    """
    if isinstance(data, DataFrame):
        return K.without_nan(data), index
    if hasattr(data, "to_pandas") and not isinstance(data, (pd.DataFrame, pd.Series)):
        data = data.to_pandas()
    if not isinstance(data, (pd.DataFrame, pd.Series)):
        for normalize in _NORMALIZERS:
            made = normalize(data)
            if made is not None:
                return as_frame(spark, made, index)
    if isinstance(data, np.ndarray) and data.ndim <= 2:
        data = pd.DataFrame(data).add_prefix("c") if data.ndim == 2 else pd.Series(data, name="value")
    if isinstance(data, pd.Series):
        data = data.to_frame(data.name or "value")
    if not isinstance(data, pd.DataFrame):
        raise UserInputError(f"data of type {type(data).__name__}; write_pickle takes any object")
    data = data.copy()
    if isinstance(data.index, pd.MultiIndex):
        names = [n or ("index" if i == 0 else f"__fkidx__{i}") for i, n in enumerate(data.index.names)]
        data.index = data.index.set_names(names)
        if isinstance(data.index.levels[0], pd.DatetimeIndex):
            index = names[0]
        data = data.reset_index()
    elif isinstance(data.index, pd.DatetimeIndex):
        index = data.index.name or "index"
        data.index.name = index
        data = data.reset_index()
    else:
        data = data.reset_index(drop=True)
    data.columns = [str(c) for c in data.columns]
    fields, columns = [], {}
    for name in data.columns:
        column, kind = data[name], _pandas_kind(data[name])
        if isinstance(column.dtype, pd.CategoricalDtype):
            column = column.astype(object)
        if kind == K.TIME:
            column = column.dt.tz_convert("UTC") if column.dt.tz is not None else column.dt.tz_localize("UTC")
            column = column.dt.floor("us")
        tag = {K.KEY: str(kind)} if kind.kind == "u" else {}
        fields.append(T.StructField(name, T.NullType() if kind == K.NULL else K.spark_type(kind), True, tag))
        columns[name] = column
    schema = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.NullType) else f.dataType, True, f.metadata) for f in fields])
    rows = pd.DataFrame(columns)
    ready = [[None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else _plain(v, f.dataType) for v in rows[f.name].tolist()] for f in schema.fields]
    frame = spark.createDataFrame(list(zip(*ready, range(len(rows)), strict=True)), T.StructType([*schema.fields, T.StructField(ROW, T.LongType())]))
    return frame, index


def _plain(value: Any, kind: T.DataType) -> Any:
    if isinstance(kind, T.DecimalType):
        import decimal

        return decimal.Decimal(int(value))
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return int(value)
    if isinstance(kind, T.BooleanType):
        return bool(value)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return float(value)
    return value.to_pydatetime() if isinstance(value, pd.Timestamp) else value


def _pandas_kind(column: pd.Series) -> K.Kind:
    t = column.dtype
    if isinstance(t, pd.DatetimeTZDtype) or t.kind == "M":
        return K.TIME
    if t.kind in "ui":
        return (K.UINTS if t.kind == "u" else K.INTS)[8 * t.itemsize]
    if t.kind == "f":
        return K.F64 if t.itemsize == 8 else K.F32
    if t.kind == "b":
        return K.BOOL
    known = column.dropna()
    if isinstance(t, pd.CategoricalDtype):
        known = known.astype(object)
    if not len(known):
        return K.STRING
    if known.map(lambda v: isinstance(v, bool)).all():
        return K.BOOL
    if known.map(lambda v: isinstance(v, str)).all():
        return K.STRING
    if known.map(lambda v: isinstance(v, bytes)).all():
        return K.BYTES
    raise SchemaError(f"column {column.name}: objects of several types; write_pickle takes any object")


def micros_of(index: str, df: DataFrame) -> Column:
    return F.unix_micros(F.col(f"`{index}`").cast("timestamp"))


def check_sorted(df: DataFrame, index: str) -> None:
    """Raises unless times ascend with positions; partitions are compared by their ends, not row by row across them."""
    from pyspark.sql import Window

    t = micros_of(index, df)
    width = 100_000
    near = Window.partitionBy((F.col(ROW) / width).cast("long")).orderBy(ROW)
    rows = df.select(ROW, t.alias("t"))
    inside = rows.withColumn("p", F.lag("t").over(near)).filter("t < p or t is null")
    ends = rows.groupBy((F.col(ROW) / width).cast("long").alias("b")).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    across = ends.withColumn("p", F.lag("hi").over(Window.orderBy("b"))).filter("lo < p")
    if not inside.isEmpty() or not across.isEmpty():
        raise UnsortedDataError(f"rows are not in the order of {index}")


def write_segments(df: DataFrame, folder: str, index: str | None, rows_per_segment: int, codec: str, order: list[str] | None = None, digests: bool = False) -> list[Segment]:
    """Writes rows as segments and describes them from the files.

    Rows go in the given order, else in that of their positions, else in that of the index, else as they come.
    Positions are not stored: they are those in the files. With digests, segments are cut at multiples of
    ``rows_per_segment``, so that equal rows written again make equal segments.
    """
    path = f"{folder}/{uuid.uuid4().hex}"
    stored = [f for f in df.schema.fields if f.name != ROW and f.name not in (order or []) or f.name == index]
    if order:
        out = in_ranges(df, _ascending(order))
    elif ROW in df.columns:
        out = df.withColumn("__seg", F.floor(F.col(ROW) / rows_per_segment)).repartitionByRange("__seg").sortWithinPartitions(ROW)
    elif index:
        out = in_ranges(df, _ascending([index]))
    else:
        out = df
    out = out.select(*(_col(f.name) for f in stored))
    out.write.option("maxRecordsPerFile", rows_per_segment).option("compression", codec).parquet(path)
    if digests:
        path = _evenly_cut(df.sparkSession, path, T.StructType(stored), rows_per_segment, codec)
    return described(df.sparkSession, path, index, T.StructType(stored), digests)


def _evenly_cut(spark: SparkSession, path: str, schema: T.StructType, rows_per_segment: int, codec: str) -> str:
    """A folder with the rows of a folder of files in their order, all files but the last of ``rows_per_segment`` rows.

    Ranges begin where a sample says, another one each time, and each begins a file. Unless the files happen to be
    even, their rows are dealt to tasks by whole segments and written once more.
    """
    found = described(spark, path, None, schema)
    if not any(s.first_row % rows_per_segment for s in found):
        return path
    even = f"{path.rpartition('/')[0]}/{uuid.uuid4().hex}"
    count = -(-sum(s.rows for s in found) // rows_per_segment)
    tasks = min(count, int(spark.conf.get("spark.sql.shuffle.partitions")))
    task = F.floor(F.floor(F.col(ROW) / rows_per_segment) * tasks / count).cast("int")
    try:
        rows = read_segments(spark, found, schema).repartitionById(tasks, task)
        out = rows.sortWithinPartitions(ROW).select(*(_col(f.name) for f in schema.fields))
        out.write.option("maxRecordsPerFile", rows_per_segment).option("compression", codec).parquet(even)
    finally:
        Folder(spark, path).delete("")
    return even


def write_pieces(df: DataFrame, folder: str, piece: str, order: list[str], index: str | None, rows_per_segment: int, codec: str, schema: T.StructType) -> dict[int, list[Segment]]:
    """Writes rows in one pass as segments of several pieces (a column of numbers); each piece's segments, in order."""
    path = f"{folder}/{uuid.uuid4().hex}"
    out = df.withColumn("__tie", F.monotonically_increasing_id())
    keys = [*_ascending([piece, *order]), F.col("__tie")]
    out = out.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*(_col(f.name) for f in schema.fields), piece)
    out.write.partitionBy(piece).option("maxRecordsPerFile", rows_per_segment).option("compression", codec).parquet(path)
    found: dict[int, list[Segment]] = {}
    for s in described(df.sparkSession, path, index, schema, below=True):
        found.setdefault(int(s.folder.rpartition("=")[2]), []).append(s)
    return {n: numbered(own) for n, own in found.items()}


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _ascending(names: list[str]) -> list[Column]:
    return [_col(n).asc_nulls_first() for n in names]


def described(spark: SparkSession, path: str, index: str | None, schema: T.StructType, digests: bool = False, below: bool = False) -> list[Segment]:
    """The segments of a folder of Parquet files; of their columns only the index is read, unless digests are asked for."""
    rows = spark.read.schema(schema)
    rows = rows.option("recursiveFileLookup", "true").parquet(path) if below else rows.parquet(path)
    measures = [F.count(F.lit(1)).alias("n")]
    if index:
        t = micros_of(index, rows)
        measures += [F.min(t).alias("t0"), F.max(t).alias("t1"), F.count(t).alias("timed")]
    if digests:
        named = F.xxhash64(F.col("_metadata.row_index"), *(_col(f.name) for f in schema.fields))
        measures += [F.sum(named.cast("decimal(38,0)")).alias("d0"), F.bit_xor(F.xxhash64(named, F.lit(1))).alias("d1")]
    found = rows.groupBy(F.col("_metadata.file_path").alias("f")).agg(*measures).collect()  # a row per file
    first, out = 0, []
    for r in sorted(found, key=lambda r: file_order(r["f"])):
        if index and r["timed"] != r["n"]:
            raise UnsortedDataError(f"rows without a time in {index}")
        out.append(Segment(unquote(r["f"]), r["n"], first, r["t0"] if index else None, r["t1"] if index else None, digest=f"{r['d0']}:{r['d1']}" if digests else None))
        first += r["n"]
    return out


def numbered(segments: list[Segment]) -> list[Segment]:
    """The segments one after the other."""
    first, out = 0, []
    for s in segments:
        out.append(replace(s, first_row=first))
        first += s.rows
    return out


def read_segments(spark: SparkSession, segments: list[Segment], schema: T.StructType, positions: bool = True) -> DataFrame:
    """The segments' rows, with their positions in the version if asked for."""
    if not segments:
        return spark.createDataFrame([], T.StructType([*schema.fields, *([T.StructField(ROW, T.LongType())] if positions else [])]))
    if not positions:
        return spark.read.schema(schema).parquet(*(s.path for s in segments))
    return placed_rows(spark, schema, [(s.path, s.first_row) for s in segments], ROW)


def to_json(segments: list[Segment]) -> list[dict]:
    return [asdict(s) for s in segments]


def from_json(rows: list[dict]) -> list[Segment]:
    return [Segment(**r) for r in rows]
