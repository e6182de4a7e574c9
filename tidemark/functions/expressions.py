"""Expressions over columns: a tree of frozen nodes that Python's operators build.

Nothing is computed here; ``tidemark.plans.lowering`` turns a tree into a Spark column.
"""

from __future__ import annotations

import datetime
import math
import re
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd

from tidemark.errors import UserInputError
from tidemark.functions.types import BOOL, F32, F64, I64, INTS, STRING, TIME, U64, UINTS, Kind

TIMES = (datetime.datetime, pd.Timestamp, np.datetime64)
SPANS = (datetime.timedelta, pd.Timedelta, np.timedelta64)


@dataclass(frozen=True)
class Literal:
    """A constant and its type; times and spans are nanoseconds."""

    value: Any
    kind: Kind
    span: bool = False


def literal(value: Any) -> Literal:
    if isinstance(value, (bool, np.bool_)):
        return Literal(bool(value), BOOL)
    if isinstance(value, TIMES):
        return Literal(int(pd.Timestamp(value).value), TIME)
    if isinstance(value, SPANS):
        return Literal(int(pd.Timedelta(value).value), I64, span=True)
    if isinstance(value, np.floating):
        kind, value = (F64 if value.dtype.itemsize == 8 else F32), float(value)
    elif isinstance(value, np.integer):
        return Literal(int(value), _smallest(int(value), signed=value.dtype.kind == "i"))
    elif isinstance(value, int):
        return Literal(value, I64 if value < 1 << 63 else U64)
    elif isinstance(value, float):
        kind = F64
    elif isinstance(value, str):
        return Literal(value, STRING)
    else:
        raise UserInputError(f"a constant of type {type(value).__name__} is not supported")
    if math.isinf(value):
        raise UserInputError("infinite constants are not supported")
    return Literal(value, kind)


def _smallest(value: int, signed: bool) -> Kind:
    kinds = INTS if signed and value != 0 or value < 0 else UINTS
    for bits, kind in kinds.items():
        if (value < 1 << bits) if kind.kind == "u" else -(1 << bits - 1) <= value < 1 << bits - 1:
            return kind
    raise UserInputError(f"{value} does not fit 64 bits")


@dataclass(frozen=True)
class Members:
    """A set of constants of one kind: numbers, strings or times."""

    values: tuple
    kind: Kind | None


def members(args: tuple) -> Members:
    values = args[0] if len(args) == 1 and isinstance(args[0], (list, tuple, set, frozenset, np.ndarray)) else args
    found = [literal(v) for v in dict.fromkeys(v.item() if isinstance(v, np.generic) and not isinstance(v, np.datetime64) else v for v in values)]
    kinds = {x.kind for x in found}
    if not found:
        return Members((), None)
    if any(k == BOOL for k in kinds):
        raise UserInputError("membership of booleans is not supported")
    if len({k.kind in ("u", "i", "f") or k.kind for k in kinds}) > 1:
        raise UserInputError("a set must hold constants of one kind")
    if any(k.integral for k in kinds) and any(k.kind == "f" for k in kinds):
        raise UserInputError("a set of integers and floats would lose precision")
    if U64 in kinds and any(x.value < 0 for x in found):
        raise UserInputError("a set of negative and of very large integers would lose precision")
    return Members(tuple(x.value for x in found), max(kinds, key=lambda k: (k.kind == "u" and k.bits == 64, k.bits)))


class Expression:
    """Base of all nodes."""

    def __bool__(self):
        raise UserInputError("use & | ~ and where() in place of and, or, not and if; chained comparisons don't work")

    def _binary(self, op: str, other: Any, swapped: bool = False) -> Expression:
        other = other if isinstance(other, Expression) else Constant(literal(other))
        return Binary(op, other, self) if swapped else Binary(op, self, other)

    def __add__(self, o):
        return self._binary("+", o)

    def __radd__(self, o):
        return self._binary("+", o, True)

    def __sub__(self, o):
        return self._binary("-", o)

    def __rsub__(self, o):
        return self._binary("-", o, True)

    def __mul__(self, o):
        return self._binary("*", o)

    def __rmul__(self, o):
        return self._binary("*", o, True)

    def __truediv__(self, o):
        return self._binary("/", o)

    def __rtruediv__(self, o):
        return self._binary("/", o, True)

    def __pow__(self, o):
        return self._binary("**", o)

    def __rpow__(self, o):
        return self._binary("**", o, True)

    def __abs__(self):
        return Unary("abs", self)

    def __neg__(self):
        return Unary("neg", self)

    def __invert__(self):
        return Unary("not", self)

    def __eq__(self, o):  # type: ignore[override]
        return self.isin(o) if _is_set(o) else self._binary("==", o)

    def __ne__(self, o):  # type: ignore[override]
        return self.isnotin(o) if _is_set(o) else self._binary("!=", o)

    def __lt__(self, o):
        return self._binary("<", o)

    def __le__(self, o):
        return self._binary("<=", o)

    def __gt__(self, o):
        return self._binary(">", o)

    def __ge__(self, o):
        return self._binary(">=", o)

    def _logical(self, op: str, other: Any) -> Expression:
        if isinstance(other, (bool, np.bool_)):
            keeps = {"&": True, "|": False, "^": False}[op]
            if bool(other) == keeps:
                return self
            return Unary("not", self) if op == "^" else Constant(literal(bool(other)))
        return self._binary(op, other)

    def __and__(self, o):
        return self._logical("&", o)

    __rand__ = __and__

    def __or__(self, o):
        return self._logical("|", o)

    __ror__ = __or__

    def __xor__(self, o):
        return self._logical("^", o)

    __rxor__ = __xor__

    def isin(self, *values: Any) -> Expression:
        """True for values in the set; false for missing ones."""
        return In(self, members(values), True)

    def isnotin(self, *values: Any) -> Expression:
        """True for values not in the set, missing ones included."""
        return In(self, members(values), False)

    def isna(self) -> Expression:
        return Unary("isnull", self)

    isnull = isna

    def notna(self) -> Expression:
        return Unary("notnull", self)

    notnull = notna

    def regex_match(self, pattern: str) -> Expression:
        """True where the pattern is found in the string."""
        if not isinstance(pattern, str):
            raise UserInputError("a pattern must be a string")
        try:
            re.compile(pattern)
        except re.error as e:
            raise UserInputError(f"pattern {pattern!r}: {e}") from None
        return Match(self, pattern)

    def same_as(self, other: Expression) -> bool:
        """Whether two trees are equal (== builds a comparison)."""
        return repr(self) == repr(other)

    def __hash__(self):
        return hash(repr(self))


def _is_set(value: Any) -> bool:
    return isinstance(value, (list, tuple, set, frozenset, np.ndarray))


@dataclass(frozen=True, eq=False)
class Named(Expression):
    """A column."""

    name: str


@dataclass(frozen=True, eq=False)
class Constant(Expression):
    literal: Literal


@dataclass(frozen=True, eq=False)
class Unary(Expression):
    """abs, neg, not, isnull or notnull."""

    op: str
    operand: Expression


@dataclass(frozen=True, eq=False)
class Binary(Expression):
    """+ - * / **, a comparison, or & | ^."""

    op: str
    left: Expression
    right: Expression

    def __post_init__(self):
        if isinstance(self.left, Constant) and isinstance(self.right, Constant):
            raise UserInputError("an operation on two constants is not supported")


@dataclass(frozen=True, eq=False)
class In(Expression):
    operand: Expression
    members: Members
    inside: bool


@dataclass(frozen=True, eq=False)
class Match(Expression):
    operand: Expression
    pattern: str


@dataclass(frozen=True, eq=False)
class Choice(Expression):
    condition: Expression
    left: Expression
    right: Expression


def col(name: str) -> Named:
    """A column by its name."""
    return Named(name)


def as_expression(value: Any) -> Expression:
    if isinstance(value, Expression):
        return value
    if _is_set(value):
        raise UserInputError("a column cannot be made of a set of values")
    return Constant(literal(value))


def where(condition: Expression, left: Any, right: Any) -> Choice:
    """left where the condition holds, else right."""
    return Choice(as_expression(condition), as_expression(left), as_expression(right))


def columns_in(e: Expression) -> set[str]:
    """Names of all columns of an expression."""
    if isinstance(e, Named):
        return {e.name}
    parts = [getattr(e, n) for n in getattr(e, "__dataclass_fields__", {})]
    return set().union(*(columns_in(p) for p in parts if isinstance(p, Expression)))
