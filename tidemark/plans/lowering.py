"""From expression trees to Spark columns.

Predicates are two-valued: a comparison with a missing value is false, and != and isnotin are true.
Spark's are three-valued, but a filter drops null and false alike. So where only truth counts (at the top and
below & and |) a comparison is lowered to Spark's own, which Parquet scans can push down; where falsity
counts too (below ~ and ^, in conditions) it is wrapped to be false when null.

Columns of floats may hold NaN, which is a missing value but which Spark takes for equal to itself and greater
than all numbers. A comparison that NaN would pass gets a second condition against it; the first stays as it
is, for the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import SchemaError, UserInputError
from tidemark.functions import types as K
from tidemark.functions.expressions import Binary, Choice, Constant, Expression, In, Literal, Match, Named, Unary
from tidemark.functions.types import BOOL, F32, F64, I64, STRING, TIME, U64, Kind

COMPARISONS = ("==", "!=", "<", "<=", ">", ">=")
_FLIPPED = {"==": "==", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


@dataclass(frozen=True)
class Lowered:
    """A column with its logical type; a predicate is true or false, never missing (or null as false, if ``bare``)."""

    column: Column
    kind: Kind
    predicate: bool = False


class Lowering:
    """Lowers expressions over columns of a given schema. raw: columns of floats may hold NaN."""

    def __init__(self, schema: T.StructType, raw: bool = False):
        self.fields, self.raw = {f.name: f for f in schema.fields}, raw

    def _real(self, x: Lowered) -> Column | None:
        """That a float is a number, if it may not be."""
        return ~F.isnan(x.column) if self.raw and x.kind.kind == "f" else None

    def _named(self, name: str) -> Lowered:
        if name not in self.fields:
            raise SchemaError(f"there is no column {name}")
        field = self.fields[name]
        c = F.col("`" + name.replace("`", "``") + "`")
        return Lowered(c, K.kind_of(field))

    def _time(self, ns: int, like: T.DataType) -> Column:
        """A time, as the column it meets has it: with or without a zone."""
        text = str(pd.Timestamp(ns))
        return F.lit(text).cast("timestamp_ntz") if isinstance(like, T.TimestampNTZType) else F.lit(text + "+00:00").cast("timestamp")

    def _literal(self, x: Literal) -> Lowered:
        return Lowered(_constant(x.value).cast(K.spark_type(x.kind)) if x.kind != TIME else self._time(x.value, T.TimestampType()), x.kind)

    # predicates

    def predicate(self, e: Expression, bare: bool = True) -> Column:
        """A boolean column. bare: null may stand for false."""
        if isinstance(e, Constant):
            raise UserInputError("the query is trivially true or false")
        if isinstance(e, Binary) and e.op in ("&", "|"):
            a, b = self.predicate(e.left, bare), self.predicate(e.right, bare)
            return a & b if e.op == "&" else a | b
        if isinstance(e, Binary) and e.op == "^":
            return self.predicate(e.left, False) != self.predicate(e.right, False)
        if isinstance(e, Unary) and e.op == "not":
            return ~self.predicate(e.operand, False)
        if isinstance(e, Choice):
            return F.when(self.predicate(e.condition, False), self.predicate(e.left, bare)).otherwise(self.predicate(e.right, bare))
        if isinstance(e, Unary) and e.op in ("isnull", "notnull"):
            own = self.value(e.operand)
            real = self._real(own)
            there = own.column.isNotNull() if real is None else own.column.isNotNull() & real
            return own.column.isNull() if real is None and e.op == "isnull" else there if e.op == "notnull" else ~F.coalesce(there, F.lit(False))
        if isinstance(e, Binary) and e.op in COMPARISONS:
            return self._comparison(e, bare)
        if isinstance(e, In):
            return self._membership(e, bare)
        if isinstance(e, Match):
            own = self.value(e.operand)
            if own.kind != STRING:
                raise SchemaError(f"a pattern is for strings, not for {own.kind}")
            found = own.column.rlike(e.pattern)
            return found if bare else F.coalesce(found, F.lit(False))
        own = self.value(e)
        if own.kind != BOOL:
            raise SchemaError(f"a filter needs a condition, not a column of {own.kind}")
        return own.column if bare else F.coalesce(own.column, F.lit(False))

    def _comparison(self, e: Binary, bare: bool) -> Column:
        a, b = self._pair(e.left, e.right)
        kinds = {"number" if k.kind in ("u", "i", "f") else k.kind for k in (a.kind, b.kind)}
        if len(kinds) > 1:
            raise SchemaError(f"{e.op} of {a.kind} and {b.kind}: types must fit")
        if "str" in kinds and e.op not in ("==", "!="):
            raise SchemaError("strings can only be compared by == and !=")
        if a.kind.numeric and {a.kind, b.kind} & {U64} and "f" not in (a.kind.kind, b.kind.kind):
            a, b = (Lowered(x.column.cast("decimal(20,0)"), x.kind) for x in (a, b))  # exact
        if any(isinstance(side, Constant) and side.literal.value != side.literal.value for side in (e.left, e.right)):
            return F.lit(e.op == "!=")  # no number: a missing value
        narrow = self._narrow(e, a, b)
        if narrow is not None:
            out = narrow
        else:
            x, y = a.column, b.column
            out = {"==": x == y, "!=": x == y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[e.op]
        sides = [None if isinstance(side, Constant) else self._real(own) for side, own in ((e.left, a), (e.right, b))]
        both = sides[0] is not None and sides[1] is not None
        # NaN passes as the greater side, and as equal to another NaN
        passes = (both or e.op in (">", ">="), both or e.op in ("<", "<=")) if e.op not in ("==", "!=") else (both, both)
        for real, wanted in zip(sides, passes, strict=True):
            if real is not None and wanted:
                out = out & real
        if e.op == "!=":
            return ~F.coalesce(out, F.lit(False))
        return out if bare else F.coalesce(out, F.lit(False))

    def _narrow(self, e: Binary, a: Lowered, b: Lowered) -> Column | None:
        """A comparison of 32-bit floats with a 64-bit constant, by the nearest 32-bit constants, so that the scan can use it."""
        flipped = isinstance(e.left, Constant)
        column, constant, op = (b, e.left, _FLIPPED[e.op]) if flipped else (a, e.right, e.op)
        if column.kind != F32 or not isinstance(constant, Constant) or constant.literal.kind.kind not in ("f", "i", "u"):
            return None
        value = constant.literal.value
        with np.errstate(over="ignore"):
            near = np.float32(value)
        if not np.isfinite(near):
            return None
        if float(near) != value:  # no such 32-bit float
            if op in ("==", "!="):
                return column.column.isNull() & F.lit(False)
            below = near if float(near) < value else np.nextafter(near, np.float32("-inf"))
            near, op = (below, "<=") if op in ("<", "<=") else (np.nextafter(below, np.float32("inf")), ">=")
            if not np.isfinite(near):
                return None
        x, y = column.column, F.lit(float(near)).cast("float")
        return {"==": x == y, "!=": x == y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    def _pair(self, left: Expression, right: Expression) -> tuple[Lowered, Lowered]:
        """Both sides of a comparison; a constant takes the other side's width, so that the scan can use it."""
        sides = [left, right]
        out: list[Lowered | None] = [None if isinstance(s, Constant) else self.value(s) for s in sides]
        for i in (0, 1):
            if out[i] is None:
                other, x = out[1 - i], sides[i].literal
                if other.kind == TIME and x.kind == TIME:
                    column_type = self.fields[sides[1 - i].name].dataType if isinstance(sides[1 - i], Named) else T.TimestampType()
                    out[i] = Lowered(self._time(x.value, column_type), TIME)
                elif x.kind == TIME and other.kind.numeric:
                    out[i] = Lowered(F.lit(x.value), I64)
                elif other.kind.integral and x.kind.integral and _fits(x.value, other.kind):
                    out[i] = Lowered(_constant(x.value).cast(K.spark_type(other.kind)), x.kind)
                else:
                    out[i] = self._literal(x)
        for i in (0, 1):  # times meet numbers as nanoseconds
            if out[i].kind == TIME and out[1 - i].kind.numeric:
                out[i] = self._nanoseconds(out[i])
        return out[0], out[1]

    def _membership(self, e: In, bare: bool) -> Column:
        own, m = self.value(e.operand), e.members
        if m.kind is None:
            return F.lit(not e.inside)
        same = own.kind.numeric and m.kind.numeric or own.kind == m.kind and own.kind in (STRING, TIME)
        if not same:
            raise SchemaError(f"membership of {own.kind} in a set of {m.kind}: types must fit")
        if own.kind == TIME:
            like = self.fields[e.operand.name].dataType if isinstance(e.operand, Named) else T.TimestampType()
            found = own.column.isin(*(self._time(v, like) for v in m.values))
        elif own.kind.integral and m.kind.integral:
            values = [v for v in m.values if _fits(v, own.kind)]  # others are in no such column
            found = own.column.isin(*(_constant(v).cast(K.spark_type(own.kind)) for v in values)) if values else own.column.isNull() & F.lit(False)
        elif own.kind == F32:
            with np.errstate(over="ignore"):
                values = [float(np.float32(v)) for v in m.values if float(np.float32(v)) == v]  # others are in no such column
            found = own.column.isin(*(F.lit(v).cast("float") for v in values)) if values else own.column.isNull() & F.lit(False)
        else:
            values = [v for v in m.values if v == v]
            found = own.column.isin(*map(_constant, values)) if values else own.column.isNull() & F.lit(False)
        if not e.inside:
            return ~F.coalesce(found, F.lit(False))
        return found if bare else F.coalesce(found, F.lit(False))

    # values

    def value(self, e: Expression) -> Lowered:
        if isinstance(e, Named):
            return self._named(e.name)
        if isinstance(e, Constant):
            return self._literal(e.literal)
        if isinstance(e, Unary) and e.op in ("abs", "neg"):
            own = self.value(e.operand)
            kind = K.absolute(own.kind) if e.op == "abs" else K.negated(own.kind)
            c = K.to_kind(own.column, kind)
            return Lowered(F.abs(c) if e.op == "abs" else -c, kind)
        if isinstance(e, Binary) and e.op in ("+", "-", "*", "/", "**"):
            return self._arithmetic(e)
        if isinstance(e, Choice):
            a, b = self.value(e.left), self.value(e.right)
            kind = K.choice(a.kind, b.kind)
            condition = self.predicate(e.condition, bare=False)
            return Lowered(F.when(condition, K.to_kind(a.column, kind)).otherwise(K.to_kind(b.column, kind)), kind)
        return Lowered(self.predicate(e, bare=False), BOOL, predicate=True)

    def _nanoseconds(self, x: Lowered) -> Lowered:
        return Lowered(F.unix_micros(x.column.cast("timestamp")) * 1000, I64)

    def _arithmetic(self, e: Binary) -> Lowered:
        sides = [self.value(s) for s in (e.left, e.right)]
        kind = K.arithmetic(e.op, sides[0].kind, sides[1].kind)
        sides = [self._nanoseconds(s) if s.kind == TIME else s for s in sides]
        if e.op == "**":
            return Lowered(_power(e, *sides, kind), kind)
        a, b = (K.to_kind(s.column, kind) for s in sides)
        if e.op == "/":
            return Lowered(quotient(a, b), F64)
        return Lowered({"+": a + b, "-": a - b, "*": a * b}[e.op], kind)


def _constant(value) -> Column:
    """A literal; integers beyond 64 signed bits go by their digits."""
    return F.lit(str(value)).cast("decimal(20,0)") if isinstance(value, int) and not isinstance(value, bool) and value >= 1 << 63 else F.lit(value)


def _fits(value: int, kind: Kind) -> bool:
    low, high = (0, 1 << kind.bits) if kind.kind == "u" else (-(1 << kind.bits - 1), 1 << kind.bits - 1)
    return low <= value < high


def quotient(a: Column, b: Column) -> Column:
    """Division of doubles that yields infinities; 0 / 0, no number, is missing."""
    infinity = F.when((a > 0) & ~F.isnan(a), F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
    return F.when(b == 0, infinity).otherwise(a / b)


def _power(e: Binary, a: Lowered, b: Lowered, kind: Kind) -> Column:
    """Powers; those of integers by multiplication, which is exact (and fails if a result does not fit)."""
    if not kind.integral:
        return K.to_kind(F.pow(a.column.cast("double"), b.column.cast("double")), kind)
    whole = K.spark_type(kind)
    base = K.to_kind(a.column, kind)
    if isinstance(e.right, Constant) and 0 <= e.right.literal.value <= 16:
        out = F.lit(1).cast(whole)
        for _ in range(e.right.literal.value):
            out = (out * base).cast(whole)
        return F.when(a.column.isNotNull(), out)
    # beyond 64 factors only powers of 0, 1 and -1 fit
    exponent = b.column.cast("decimal(20,0)")
    odd = F.pmod(exponent, F.lit(2).cast("decimal(20,0)")) == 1
    factors = F.least(exponent, F.lit(64).cast("decimal(20,0)")).cast("int")
    times = F.when(factors > 0, F.sequence(F.lit(1), factors)).otherwise(F.array().cast("array<int>"))
    power = F.aggregate(times, F.lit(1).cast(whole), lambda so_far, _: (so_far * base).cast(whole))
    out = F.when(exponent == 0, F.lit(1).cast(whole)).when((base == 0) | (base == 1), base)
    if kind.kind == "i":
        out = out.when(base == -1, F.when(odd, base).otherwise(F.lit(1).cast(whole)))
    return F.when(a.column.isNotNull() & b.column.isNotNull(), out.otherwise(power))
