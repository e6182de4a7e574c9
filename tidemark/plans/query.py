"""The query builder: a list of clauses over one frame, applied in order."""

from __future__ import annotations

import copy
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import UserInputError
from tidemark.functions import types as K
from tidemark.functions.expressions import Expression, Named, as_expression, col
from tidemark.operators import aggregate, ranges
from tidemark.operators.aggregate import BUCKET_OPS, GROUP_OPS, Aggregation
from tidemark.operators.concat import concat
from tidemark.operators.resample import Resample, resample
from tidemark.plans.lowering import Lowering

#: Hidden columns of positioned frames: the row's position, and the input it came from.
ROW, SOURCE = "__row_id", "__source"


@dataclass(frozen=True)
class Frame:
    """A DataFrame with its index of times, if it has one, and the columns that order its rows.

    raw: columns of floats may hold NaN, which filters mind themselves so that scans can use their comparisons;
    before any other clause, and in the result, it is null.
    """

    df: DataFrame
    index: str | None = None
    order: tuple[str, ...] = ()
    raw: bool = False

    def clean(self) -> Frame:
        return replace(self, df=K.without_nan(self.df), raw=False) if self.raw else self

    def visible(self) -> DataFrame:
        hidden = [c for c in (ROW, SOURCE) if c in self.df.columns]
        return self.clean().df.drop(*hidden)

    def sorted(self) -> DataFrame:
        """The visible rows in their order."""
        order = [c for c in self.order if c in self.df.columns]
        df = self.clean().df
        return Frame(df.orderBy(*(F.col(f"`{c}`").asc_nulls_first() for c in order)) if order else df).visible()


class Clause:
    #: Whether rows must have positions (or an order) for it.
    ordered = False

    def apply(self, frame: Frame) -> Frame:
        raise NotImplementedError


@dataclass(frozen=True)
class Filter(Clause):
    condition: Expression

    def apply(self, frame: Frame) -> Frame:
        return replace(frame, df=frame.df.filter(Lowering(frame.df.schema, frame.raw).predicate(self.condition)))


@dataclass(frozen=True)
class Project(Clause):
    name: str
    expression: Expression

    def apply(self, frame: Frame) -> Frame:
        out = Lowering(frame.df.schema, frame.raw).value(self.expression)
        if out.predicate:
            raise UserInputError("a column cannot be made of a condition; use where(condition, True, False)")
        c = out.column
        if out.kind.kind == "f":  # no number is a missing value
            c = F.when(~F.isnan(c), c)
        tag = {K.KEY: str(out.kind)} if out.kind.kind == "u" else {}
        return replace(frame, df=frame.df.withColumn(self.name, c).withMetadata(self.name, tag))


@dataclass(frozen=True)
class GroupBy(Clause):
    key: str
    aggregations: tuple[Aggregation, ...] = ()

    def apply(self, frame: Frame) -> Frame:
        if not self.aggregations:
            raise UserInputError("groupby needs agg")
        return Frame(aggregate.group_by(frame.clean().df, self.key, self.aggregations), None, (self.key,))


@dataclass(frozen=True)
class ResampleBy(Clause):
    spec: Resample
    aggregations: tuple[Aggregation, ...] = ()

    @property
    def ordered(self) -> bool:  # type: ignore[override]
        return any(a.op in ("first", "last") for a in self.aggregations)

    def apply(self, frame: Frame) -> Frame:
        if not self.aggregations:
            raise UserInputError("resample needs agg")
        if frame.index is None:
            raise UserInputError("resampling needs an index of times")
        order = [c for c in frame.order if c != frame.index]
        return Frame(resample(frame.clean().df, frame.index, self.spec, self.aggregations, order), frame.index, (frame.index,))


@dataclass(frozen=True)
class Head(Clause):
    n: int
    ordered = True

    def apply(self, frame: Frame) -> Frame:
        return replace(frame.clean(), df=ranges.head(frame.clean().df, self.n, _ordered(frame)))


@dataclass(frozen=True)
class Tail(Clause):
    n: int
    ordered = True

    def apply(self, frame: Frame) -> Frame:
        return replace(frame.clean(), df=ranges.tail(frame.clean().df, self.n, _ordered(frame)))


@dataclass(frozen=True)
class RowRange(Clause):
    start: int | None
    end: int | None
    ordered = True

    def apply(self, frame: Frame) -> Frame:
        return replace(frame.clean(), df=ranges.rows_between(frame.clean().df, self.start, self.end, _ordered(frame)))


@dataclass(frozen=True)
class DateRange(Clause):
    start: Any
    end: Any

    def apply(self, frame: Frame) -> Frame:
        return replace(frame, df=ranges.dates_between(frame.df, frame.index, self.start, self.end))


@dataclass(frozen=True)
class Concat(Clause):
    join: str

    def apply(self, frame: Frame) -> Frame:
        raise UserInputError("concat joins several symbols and must come first")


def _ordered(frame: Frame) -> list[str]:
    order = [c for c in frame.order if c in frame.df.columns]
    if not order:
        raise UserInputError("rows have no order here; positions are undefined")
    return order


class Query:
    """Builds a query: ``q = q[q["a"] > 1].groupby("b").agg({"c": "sum"})``."""

    def __init__(self, clauses: tuple[Clause, ...] = ()):
        self.clauses = clauses
        self.optimised_for = "speed"

    def _with(self, clause: Clause) -> Query:
        if isinstance(clause, Concat) and self.clauses:
            raise UserInputError("concat must be the first clause")
        out = Query((*self.clauses, clause))
        out.optimised_for = self.optimised_for
        return out

    def __getitem__(self, item: Any) -> Any:
        """A column, by name, or the query filtered by a condition."""
        return col(item) if isinstance(item, str) else self.filter(item)

    def __setitem__(self, name: str, expression: Any) -> None:
        self.clauses = self.apply(name, expression).clauses

    def filter(self, condition: Any) -> Query:
        if isinstance(condition, bool):
            raise UserInputError(f"the query is trivially {condition}")
        return self._with(Filter(as_expression(condition)))

    def apply(self, name: str, expression: Any) -> Query:
        """Adds or replaces a column."""
        return self._with(Project(name, as_expression(expression)))

    def groupby(self, name: str) -> Query:
        return self._with(GroupBy(name))

    def resample(self, rule: Any, closed: str | None = None, label: str | None = None, offset: Any = None, origin: Any = "epoch") -> Query:
        spec = Resample.of(rule, closed, label, offset, origin)
        if spec.of_data and any(isinstance(c, DateRange) for c in self.clauses):
            raise UserInputError("an origin from the data does not go with a date range")
        return self._with(ResampleBy(spec))

    def agg(self, aggregations: dict) -> Query:
        last = self.clauses[-1] if self.clauses else None
        if not isinstance(last, (GroupBy, ResampleBy)) or last.aggregations:
            raise UserInputError("agg must follow groupby or resample")
        ops = GROUP_OPS if isinstance(last, GroupBy) else BUCKET_OPS
        out = Query((*self.clauses[:-1], replace(last, aggregations=aggregate.parse(aggregations, ops))))
        return out

    def head(self, n: int = 5) -> Query:
        return self._with(Head(n))

    def tail(self, n: int = 5) -> Query:
        return self._with(Tail(n))

    def row_range(self, bounds: tuple[int | None, int | None]) -> Query:
        return self._with(RowRange(*bounds))

    def date_range(self, bounds: tuple[Any, Any]) -> Query:
        return self._with(DateRange(*bounds))

    def concat(self, join: str = "outer") -> Query:
        return self._with(Concat(join))

    def then(self, other: Query) -> Query:
        """This query's clauses, then the other's."""
        if any(isinstance(c, Concat) for c in other.clauses) and self.clauses:
            raise UserInputError("concat must be the first clause")
        return Query((*self.clauses, *other.clauses))

    def prepend(self, other: Query) -> Query:
        return other.then(self)

    def optimise_for_speed(self) -> Query:
        """Kept for callers; Spark plans alike either way."""
        return self

    def optimise_for_memory(self) -> Query:
        """Kept for callers; Spark plans alike either way."""
        return self

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Query) and repr(self.clauses) == repr(other.clauses)

    def __hash__(self) -> int:
        return hash(repr(self.clauses))

    def __copy__(self) -> Query:
        return Query(self.clauses)

    def __deepcopy__(self, memo: dict) -> Query:
        return Query(copy.copy(self.clauses))

    def __str__(self) -> str:
        return " | ".join(map(str, self.clauses))

    def run(self, frame: Frame) -> Frame:
        """Applies all clauses to one frame."""
        for clause in self.clauses:
            frame = clause.apply(frame)
        return frame

    def run_many(self, frames: list[Frame]) -> Frame:
        """Applies the clauses to several frames; the first must be concat."""
        if not self.clauses or not isinstance(self.clauses[0], Concat):
            raise UserInputError("several symbols need concat as the first clause")
        rest = self.clauses[1:]
        return Query(rest).run(concat_frames(frames, self.clauses[0].join, needs_order(rest)))


def needs_order(clauses: tuple[Clause, ...]) -> bool:
    """Whether a clause goes by the order of rows as they are, before any aggregation."""
    for clause in clauses:
        if clause.ordered:
            return True
        if isinstance(clause, (GroupBy, ResampleBy)):
            return False
    return False


def concat_frames(frames: list[Frame], join: str = "outer", ordered: bool = True) -> Frame:
    """The frames' rows one after the other. ordered: with positions, by input and by position there."""
    if not frames:
        raise UserInputError("nothing to concatenate")
    kinds = {bool(f.index) for f in frames}
    if len(kinds) > 1:
        raise UserInputError("frames with and without an index of times cannot be concatenated")
    index = frames[0].index
    if index and any(f.index != index for f in frames):
        frames = [replace(f, df=f.df.withColumnRenamed(f.index, "index"), index="index", order=tuple("index" if c == f.index else c for c in f.order)) for f in frames]
        index = "index"
    rows = []
    for f in frames:
        order = [c for c in f.order if c in f.df.columns]
        df = f.clean().df if SOURCE not in f.df.columns else f.clean().df.drop(SOURCE)
        if ordered and ROW not in df.columns and order:
            df = ranges.positions(df, order, ROW)
        rows.append(df)
    out = concat(rows, join, SOURCE)
    return Frame(out, index, (SOURCE, ROW) if ROW in out.columns else (SOURCE,))


def query_on(df: DataFrame, query: Query, index: str | None = None, order: list[str] | None = None) -> DataFrame:
    """Runs a query on any DataFrame. index: its column of times; order: columns that order its rows."""
    frame = Frame(df, index, tuple(order or ([index] if index else [])), raw=True)
    return query.run(frame).visible()


__all__ = ["Frame", "Named", "Query", "concat_frames", "query_on"]
