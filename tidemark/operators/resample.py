"""Resampling: aggregation over buckets of time.

A bucket is found by integer arithmetic on microseconds, so resampling is one hash aggregation with partial
sums before the shuffle; no bucket is built but those that have rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import SchemaError, UserInputError
from tidemark.operators.aggregate import Aggregation, lowered

_UNITS = {"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "min": 60 * 10**9, "h": 3600 * 10**9, "D": 86400 * 10**9}
_RULE = re.compile(r"(\d*)(ns|us|ms|s|min|h|D)")
ORIGINS = ("epoch", "start", "start_day", "end", "end_day")
DAY = 86400 * 10**6


def micros(rule: Any, what: str = "rule") -> int:
    """Microseconds of a rule like 1h30min."""
    if isinstance(rule, str):
        text = rule.strip()
        sign = -1 if text.startswith("-") and what == "offset" else 1
        text = text.lstrip("-") if sign < 0 else text
        parts = _RULE.findall(text)
        if not parts or "".join(n + u for n, u in parts) != text:
            raise UserInputError(f"{what} {rule!r}: only ns, us, ms, s, min, h and D, and their combinations")
        ns = sign * sum(int(n or 1) * _UNITS[u] for n, u in parts)
    else:
        ns = int(pd.Timedelta(rule).value)
    if ns % 1000:
        raise UserInputError(f"{what} {rule!r}: times have microseconds")
    return ns // 1000


@dataclass(frozen=True)
class Resample:
    """Parameters of a resampling, checked; times are microseconds."""

    rule: int
    right_closed: bool
    right_label: bool
    offset: int
    origin: str | int

    @classmethod
    def of(cls, rule: Any, closed: str | None = None, label: str | None = None, offset: Any = None, origin: Any = "epoch") -> Resample:
        width = micros(rule)
        if width <= 0:
            raise UserInputError("a rule must be longer than nothing")
        for value, name in ((closed, "closed"), (label, "label")):
            if value not in (None, "left", "right"):
                raise UserInputError(f"{name} is left or right")
        if isinstance(origin, str) and origin not in ORIGINS:
            try:
                origin = pd.Timestamp(origin)
            except ValueError:
                raise UserInputError(f"origin is one of {', '.join(ORIGINS)} or a time") from None
        if isinstance(origin, str):
            right = origin in ("end", "end_day")
        else:
            origin, right = int(pd.Timestamp(origin).value // 1000), False
        return cls(width, right if closed is None else closed == "right", right if label is None else label == "right", 0 if offset is None else micros(offset, "offset"), origin)

    @property
    def of_data(self) -> bool:
        """Whether the grid depends on the data's first or last time."""
        return isinstance(self.origin, str) and self.origin != "epoch"

    def grid(self, first: int, last: int) -> tuple[int, int | None]:
        """A point of the grid, and a time up to which rows belong to no bucket (or None)."""
        if not isinstance(self.origin, str):
            return self.origin + self.offset, None
        if self.origin == "epoch":
            return self.offset, None
        if self.origin == "start":
            return first + self.offset, None
        if self.origin == "start_day":
            return first - first % DAY + self.offset, None
        end = last if self.origin == "end" else -(-last // DAY) * DAY
        n = (end - first) // self.rule + (0 if self.right_closed else 1)
        anchor = end - n * self.rule
        if self.right_closed and self.offset % self.rule:
            return anchor + self.offset, anchor - (-self.offset) % self.rule
        return anchor + self.offset, None


def resample(df: DataFrame, index: str, spec: Resample, aggregations: tuple[Aggregation, ...], order: list[str]) -> DataFrame:
    """One row per bucket that has rows: its label under the index's name, and the aggregates.

    order: columns that order rows of the same time (for first and last).
    """
    fields = {f.name: f for f in df.schema.fields}
    if index not in fields or not isinstance(fields[index].dataType, (T.TimestampType, T.TimestampNTZType)):
        raise SchemaError("resampling needs an index of times")
    name = "`" + index.replace("`", "``") + "`"
    t = F.unix_micros(F.col(name).cast("timestamp"))
    df = df.filter(F.col(name).isNotNull())
    first = last = 0
    if spec.of_data:
        first, last = df.agg(F.min(t), F.max(t)).first()
        if first is None:
            first = last = 0
    anchor, none_before = spec.grid(first, last)
    if none_before is not None:
        df = df.filter(t > none_before)
    inside = t - anchor - (1 if spec.right_closed else 0)
    label = t - (1 if spec.right_closed else 0) - F.pmod(inside, F.lit(spec.rule)) + (spec.rule if spec.right_label else 0)
    at: Column = F.struct(F.col(name), *(F.col(f"`{c}`") for c in order))
    grouped = df.groupBy(label.alias("__label")).agg(*(lowered(a, df.schema, at) for a in aggregations))
    return grouped.select(F.timestamp_micros("__label").cast(fields[index].dataType).alias(index), *(F.col(f"`{a.name}`") for a in aggregations))
