"""Aggregation by one key, and what aggregation by key and by time share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import SchemaError, UserInputError
from tidemark.functions import types as K
from tidemark.functions.types import BOOL, F64, I64, TIME, U64, Kind

GROUP_OPS = ("sum", "mean", "min", "max", "count")
BUCKET_OPS = (*GROUP_OPS, "first", "last")


@dataclass(frozen=True)
class Aggregation:
    """``op`` over ``column``, as column ``name``."""

    name: str
    column: str
    op: str


def parse(aggregations: dict, allowed: tuple[str, ...]) -> tuple[Aggregation, ...]:
    """From {name: op} or {name: (column, op)}."""
    if not aggregations:
        raise UserInputError("no aggregation is asked for")
    out = []
    for name, spec in aggregations.items():
        column, op = (name, spec) if isinstance(spec, str) else spec
        op = op.lower()
        if op not in allowed:
            raise UserInputError(f"{op} is none of {', '.join(allowed)}")
        out.append(Aggregation(name, column, op))
    return tuple(out)


def lowered(a: Aggregation, schema: T.StructType, order: Column | None = None) -> Column:
    """The aggregate; missing values are skipped. order: says which value is first (for first and last)."""
    fields = {f.name: f for f in schema.fields}
    if a.column not in fields:
        raise SchemaError(f"there is no column {a.column}")
    field, c = fields[a.column], F.col("`" + a.column.replace("`", "``") + "`")
    kind = K.kind_of(field)
    if a.op == "count":
        return F.count(c).alias(a.name)
    if a.op in ("first", "last"):
        place = F.when(c.isNotNull(), order)  # min_by and max_by skip missing places
        return K.tagged((F.min_by if a.op == "first" else F.max_by)(c, place), a.name, kind)
    if not (kind.numeric or kind in (BOOL, TIME)) or (kind == TIME and a.op == "sum"):
        raise SchemaError(f"{a.op} of {kind} is not supported")
    if a.op in ("min", "max"):
        return K.tagged((F.min if a.op == "min" else F.max)(c), a.name, kind)
    if a.op == "sum":
        to: Kind = F64 if kind.kind == "f" else (U64 if kind.kind == "u" or kind == BOOL else I64)
        if kind.kind == "u" and kind.bits == 64:
            total = F.sum(c).cast("decimal(20,0)")
        elif kind.kind == "f":
            total = F.sum(c.cast("double"))
        else:
            total = F.sum(c.cast("long"))
        out = F.coalesce(total, F.lit(0).cast(total_type(kind)))
        return K.tagged(out, a.name, to) if kind.kind == "u" else out.alias(a.name)
    if kind == TIME:
        return time_mean(c, field.dataType).alias(a.name)
    return F.avg(c.cast("int") if kind == BOOL else c.cast("double")).alias(a.name)


def total_type(kind: Kind) -> str:
    return "double" if kind.kind == "f" else ("decimal(20,0)" if kind.kind == "u" and kind.bits == 64 else "long")


def time_mean(c: Column, data_type: T.DataType) -> Column:
    """Mean of times to the microsecond: sums of microseconds are exact in decimals."""
    micros = F.unix_micros(c.cast("timestamp"))
    mean = F.floor(F.sum(micros.cast("decimal(20,0)")) / F.count(c)).cast("long")
    return F.timestamp_micros(mean).cast(data_type)


def group_by(df: DataFrame, key: str, aggregations: tuple[Aggregation, ...]) -> DataFrame:
    """One row per key; rows whose key is missing belong to no group."""
    c = F.col("`" + key.replace("`", "``") + "`")
    if key not in df.columns:
        raise SchemaError(f"there is no column {key}")
    return df.filter(c.isNotNull()).groupBy(c).agg(*(lowered(a, df.schema) for a in aggregations))
