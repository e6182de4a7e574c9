"""Logical types, unsigned ones included, and the rules by which they combine.

Spark has no unsigned types: they are kept in the next wider one, and a field's metadata says so.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import SchemaError

KEY = "logical_type"


@dataclass(frozen=True)
class Kind:
    """A logical type: kind is u, i or f (with bits), bool, str, time, null, bytes or array."""

    kind: str
    bits: int = 0

    def __str__(self) -> str:
        return {"u": "uint", "i": "int", "f": "float"}.get(self.kind, self.kind) + (str(self.bits) if self.bits else "")

    @property
    def numeric(self) -> bool:
        return self.kind in ("u", "i", "f")

    @property
    def integral(self) -> bool:
        return self.kind in ("u", "i")


BOOL, STRING, TIME, NULL, BYTES, ARRAY = (Kind(k) for k in ("bool", "str", "time", "null", "bytes", "array"))
F32, F64 = Kind("f", 32), Kind("f", 64)
INTS = {b: Kind("i", b) for b in (8, 16, 32, 64)}
UINTS = {b: Kind("u", b) for b in (8, 16, 32, 64)}
I64, U64 = INTS[64], UINTS[64]

_SPARK = {
    INTS[8]: T.ByteType(),
    INTS[16]: T.ShortType(),
    INTS[32]: T.IntegerType(),
    INTS[64]: T.LongType(),
    UINTS[8]: T.ShortType(),
    UINTS[16]: T.IntegerType(),
    UINTS[32]: T.LongType(),
    UINTS[64]: T.DecimalType(20, 0),
    F32: T.FloatType(),
    F64: T.DoubleType(),
    BOOL: T.BooleanType(),
    STRING: T.StringType(),
    TIME: T.TimestampType(),
    BYTES: T.BinaryType(),
}
_BY_NAME = {str(k): k for k in _SPARK}


def spark_type(kind: Kind) -> T.DataType:
    return _SPARK[kind]


def kind_of(field: T.StructField) -> Kind:
    """The logical type of a column."""
    named = (field.metadata or {}).get(KEY)
    if named in _BY_NAME:
        return _BY_NAME[named]
    t = field.dataType
    if isinstance(t, T.TimestampNTZType):
        return TIME
    if isinstance(t, T.NullType):
        return NULL
    if isinstance(t, T.DecimalType):
        if t.scale == 0 and t.precision <= 20:
            return U64
        raise SchemaError(f"column {field.name}: no decimal columns but unsigned 64-bit integers")
    if isinstance(t, T.ArrayType):
        return ARRAY
    if isinstance(t, (T.VarcharType, T.CharType)):
        return STRING
    for kind, own in _SPARK.items():
        if kind.kind != "u" and type(own) is type(t):
            return kind
    raise SchemaError(f"column {field.name}: type {t.simpleString()} is not supported")


def kinds_of(df: DataFrame) -> dict[str, Kind]:
    return {f.name: kind_of(f) for f in df.schema.fields}


def tagged(column: Column, name: str, kind: Kind) -> Column:
    """The column under a name, marked with its logical type if Spark's doesn't tell."""
    return column.alias(name, metadata={KEY: str(kind)}) if kind.kind == "u" else column.alias(name)


def signed_in(kind: Kind) -> int:
    """Bits of the smallest signed type that holds the type's values."""
    return min(kind.bits * 2, 64) if kind.kind == "u" else kind.bits


def arithmetic(op: str, left: Kind, right: Kind) -> Kind:
    """Result type of + - * / and **."""
    for side in (left, right):
        if not (side.numeric or side.kind == "time"):
            raise SchemaError(f"{op} of {left} and {right}: only numbers and times")
    left, right = (I64 if k.kind == "time" else k for k in (left, right))
    if op == "/":
        return F64
    if op == "**":
        if right.kind == "f":
            raise SchemaError("a floating point exponent is not supported")
        if left.kind == "f" or (left.kind == "i" and right.kind == "i"):
            return F64
        return U64 if left.kind == "u" and right.kind == "u" else (I64 if left.kind == "i" else F64)
    if left.kind == "f" or right.kind == "f":
        return F32 if left == right == F32 else F64
    bits = min(2 * max(left.bits, right.bits), 64)
    return UINTS[bits] if op != "-" and left.kind == right.kind == "u" else INTS[bits]


def absolute(kind: Kind) -> Kind:
    if not kind.numeric:
        raise SchemaError(f"abs of {kind}: only numbers")
    return INTS[min(2 * kind.bits, 64)] if kind.kind == "i" else kind


def negated(kind: Kind) -> Kind:
    if not kind.numeric:
        raise SchemaError(f"minus {kind}: only numbers")
    return kind if kind.kind == "f" else INTS[min(2 * kind.bits, 64)]


def exact_common(left: Kind, right: Kind) -> Kind | None:
    """A type that holds both types' values, as appends and dynamic reads ask for; None if there is none."""
    if left == right:
        return left
    if NULL in (left, right):
        return right if left == NULL else left
    if not (left.numeric and right.numeric):
        return None
    if "f" in (left.kind, right.kind):
        if left.kind == right.kind:
            return F64
        whole, real = (left, right) if right.kind == "f" else (right, left)
        return F64 if real == F64 or whole.bits >= 32 else F32
    if left.kind == right.kind:
        return left if left.bits >= right.bits else right
    unsigned, signed = (left, right) if left.kind == "u" else (right, left)
    if signed.bits > unsigned.bits:
        return signed
    return INTS[unsigned.bits * 2] if unsigned.bits < 64 else None


def common(left: Kind, right: Kind) -> Kind | None:
    """As exact_common, but unsigned 64-bit and signed integers meet as 64-bit floats."""
    found = exact_common(left, right)
    return F64 if found is None and left.integral and right.integral else found


def choice(left: Kind, right: Kind) -> Kind:
    """Result type of a choice between two columns."""
    if left.numeric and right.numeric:
        return common(left, right)
    if left == right or NULL in (left, right):
        return exact_common(left, right)
    raise SchemaError(f"a choice between {left} and {right}: types must fit")


def to_kind(column: Column, kind: Kind) -> Column:
    return column.cast(spark_type(kind)) if kind in _SPARK else column


def without_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null, the one missing value."""
    real = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not real:
        return df

    def clean(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        return F.when(~F.isnan(c), c).alias(f.name, metadata=f.metadata) if f.name in real else c

    return df.select(*(clean(f) for f in df.schema.fields))
