"""The store: libraries of named symbols, each a chain of immutable versions.

A version is a manifest of Parquet segments; verbs write new segments first and the manifest last, so readers
see whole versions only. Segments that a verb does not touch are shared between versions. Staged rows are
segments that an entry names and no manifest yet; finalizing writes a manifest that has them and notes their
tokens, then removes the entries, so a crash in between neither loses rows nor adds them twice.
"""

from __future__ import annotations

import json
import pickle
import re
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import LibraryNotFoundError, NoSuchVersionError, SchemaError, TidemarkError, UnsortedDataError, UserInputError
from tidemark.functions import types as K
from tidemark.operators import ranges
from tidemark.operators.concat import aligned
from tidemark.operators.merge import check_strategy, merge
from tidemark.plans.query import DateRange, Filter, Frame, Query, ResampleBy, ROW, RowRange, concat_frames, needs_order
from tidemark.sources import segments as S
from tidemark.sources.files import Folder, own_folder
from tidemark.sources.manifest import Catalog, Manifest, VersionInfo, safe
from tidemark.sources.pruning import may_match
from tidemark.sources.segments import Segment

#: Items of a batch that are worked on at a time.
THREADS = 8
#: Tokens of staged rows that a manifest remembers.
TOKENS = 1000
#: Schemes of the places where libraries can be.
SCHEMES = {"s3": "s3a", "s3s": "s3a", "gcpxml": "gs", "gcpxmls": "gs", "azure": "abfss", "local": "file", "lmdb": "file"}


@dataclass(frozen=True)
class LibraryOptions:
    dynamic_schema: bool = False
    rows_per_segment: int = S.SEGMENT_ROWS
    codec: str = "lz4_raw"
    #: Writes keep segments of the version before that hold the same rows: cut alike (rows in several ranges are
    #: written once more for it) and found by digests, from one more pass.
    dedup: bool = False


@dataclass
class VersionedItem:
    """A symbol's data as of a version. ``data`` is lazy and in no order; ``in_order`` has the rows in theirs."""

    symbol: str
    data: Any
    version: int
    metadata: Any = None
    timestamp: int = 0
    _sorted: Callable[[], DataFrame] | None = field(default=None, repr=False, compare=False)

    @property
    def in_order(self) -> DataFrame:
        """The rows in their order: segments are in it already, but Spark reads them side by side, so they are sorted."""
        return self._sorted() if self._sorted else self.data

    def to_pandas(self) -> pd.DataFrame:
        return self.in_order.toPandas()

    def to_arrow(self):
        return self.in_order.toArrow()


@dataclass
class JoinedItem:
    """Data of several symbols, in no order and ``in_order``, and the versions that it came from."""

    data: DataFrame
    versions: list[VersionedItem]
    _sorted: Callable[[], DataFrame] | None = field(default=None, repr=False, compare=False)

    @property
    def in_order(self) -> DataFrame:
        return self._sorted() if self._sorted else self.data


@dataclass(frozen=True)
class DataError:
    """What went wrong with one item of a batch."""

    symbol: str
    error: str
    kind: str


@dataclass(frozen=True)
class SymbolDescription:
    columns: tuple[tuple[str, str], ...]
    index: str | None
    rows: int
    date_range: tuple[pd.Timestamp | None, pd.Timestamp | None]
    sorted: bool
    last_update: pd.Timestamp


@dataclass(frozen=True)
class Request:
    """An item of a batch read."""

    symbol: str
    as_of: Any = None
    date_range: tuple | None = None
    row_range: tuple | None = None
    columns: list[str] | None = None
    query: Query | None = None
    staged: bool = False


class LazyFrame(Query):
    """A read that is not run yet, and a query on it."""

    def __init__(self, library: Library, request: Request, clauses: tuple = ()):
        super().__init__(clauses)
        self.library, self.request = library, request

    def _with(self, clause) -> LazyFrame:
        return LazyFrame(self.library, self.request, Query(self.clauses)._with(clause).clauses)

    def agg(self, aggregations: dict) -> LazyFrame:
        return LazyFrame(self.library, self.request, Query(self.clauses).agg(aggregations).clauses)

    def frame(self, positions: bool = False) -> tuple[Frame, Manifest]:
        own = Query((*(self.request.query.clauses if self.request.query else ()), *self.clauses))
        return self.library._frame(replace(self.request, query=own), positions)

    def collect(self) -> VersionedItem:
        frame, m = self.frame()
        return VersionedItem(self.request.symbol, frame.visible(), m.version, m.metadata, m.created, lambda: self.frame(True)[0].sorted())

    def schema(self) -> T.StructType:
        """The result's schema; nothing is read."""
        return self.frame()[0].visible().schema


class LazyFrames:
    """Several lazy reads, to which a query applies alike."""

    def __init__(self, frames: list[LazyFrame]):
        self.frames = frames

    def __getattr__(self, name: str):
        if name not in ("filter", "apply", "groupby", "resample", "agg", "head", "tail", "row_range", "date_range"):
            raise AttributeError(name)
        return lambda *a, **k: LazyFrames([getattr(f, name)(*a, **k) for f in self.frames])

    def split(self) -> list[LazyFrame]:
        return list(self.frames)

    def collect(self) -> list[VersionedItem | DataError]:
        return _each([(f.request.symbol, f.collect) for f in self.frames])


class LazyJoined(Query):
    """A concatenation of lazy reads, and a query on it."""

    def __init__(self, frames: list[LazyFrame], join: str, clauses: tuple = ()):
        super().__init__(clauses)
        self.frames, self.join = frames, join

    def _with(self, clause) -> LazyJoined:
        return LazyJoined(self.frames, self.join, Query(self.clauses)._with(clause).clauses)

    def agg(self, aggregations: dict) -> LazyJoined:
        return LazyJoined(self.frames, self.join, Query(self.clauses).agg(aggregations).clauses)

    def _run(self, ordered: bool) -> tuple[Frame, list[tuple[Frame, Manifest]]]:
        parts = [f.frame(ordered) for f in self.frames]
        if any(m.pickled for _, m in parts):
            raise SchemaError("pickled data cannot be concatenated")
        return Query(self.clauses).run(concat_frames([p for p, _ in parts], self.join, ordered)), parts

    def collect(self) -> JoinedItem:
        out, parts = self._run(needs_order(self.clauses))
        versions = [VersionedItem(f.request.symbol, None, m.version, m.metadata, m.created) for f, (_, m) in zip(self.frames, parts, strict=True)]
        return JoinedItem(out.visible(), versions, lambda: self._run(True)[0].sorted())


def concat(frames: LazyFrames | Iterable[LazyFrame], join: str = "outer") -> LazyJoined:
    """The rows of several lazy reads one after the other."""
    return LazyJoined(frames.split() if isinstance(frames, LazyFrames) else list(frames), join)


def _or_error(symbol: str, f) -> Any:
    try:
        return f()
    except TidemarkError as e:
        return DataError(symbol, str(e), type(e).__name__)


def _each(items: list[tuple[str, Callable[[], Any]]]) -> list[Any]:
    """Results or errors of several items, a few of which are worked on at a time."""
    if len(items) < 2:
        return [_or_error(*item) for item in items]
    with ThreadPoolExecutor(THREADS) as pool:
        return list(pool.map(lambda item: _or_error(*item), items))


class Store:
    """Libraries below a root: a path or URI of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, uri: str):
        scheme, sep, rest = uri.partition("://")
        if sep and scheme == "mem":
            uri = own_folder(spark, "tidemark-store-")
        elif sep and scheme in SCHEMES:
            uri = f"{SCHEMES[scheme]}://{'/' if SCHEMES[scheme] == 'file' and not rest.startswith('/') else ''}{rest.partition('?')[0]}"
        elif sep and scheme == "mongodb":
            raise UserInputError("MongoDB holds no Parquet files; use a file system or object store")
        self.spark, self.folder = spark, Folder(spark, uri)

    def create_library(self, name: str, options: LibraryOptions | None = None) -> Library:
        if not self.folder.create(f"{safe(name)}/library.json", json.dumps(asdict(options or LibraryOptions()))):
            raise UserInputError(f"there is a library {name}")
        return self.get_library(name)

    def get_library(self, name: str, create_if_missing: bool = False, options: LibraryOptions | None = None) -> Library:
        if not self.has_library(name):
            if create_if_missing:
                return self.create_library(name, options)
            raise LibraryNotFoundError(f"there is no library {name}")
        found = LibraryOptions(**json.loads(self.folder.read(f"{safe(name)}/library.json")))
        return Library(self.spark, name, self.folder.full(safe(name)), found)

    __getitem__ = get_library

    def has_library(self, name: str) -> bool:
        return self.folder.exists(f"{safe(name)}/library.json")

    __contains__ = has_library

    def list_libraries(self) -> list[str]:
        from urllib.parse import unquote

        return [unquote(n) for n in self.folder.names() if self.folder.exists(f"{n}/library.json")]

    def delete_library(self, name: str) -> None:
        self.folder.delete(safe(name))

    def modify_library_option(self, library: Library, **options: Any) -> Library:
        changed = replace(library.options, **options)
        self.folder.put(f"{safe(library.name)}/library.json", json.dumps(asdict(changed)))
        return self.get_library(library.name)


class Library:
    """A library's symbols and the verbs on them."""

    def __init__(self, spark: SparkSession, name: str, root: str, options: LibraryOptions):
        self.spark, self.name, self.options = spark, name, options
        self.folder = Folder(spark, root)
        self.catalog = Catalog(self.folder)

    # reading

    def _rows(self, m: Manifest, segments: list[Segment] | None = None, positions: bool = True) -> DataFrame:
        """Rows of (some of) a version's segments, with positions if asked for."""
        segments = m.segments if segments is None else segments
        kinds = {f.name: K.kind_of(f) for f in m.struct().fields} | ({ROW: K.I64} if positions else {})
        parts = []
        for i, form in enumerate(m.forms):
            own = [s for s in segments if s.form == i]
            if own or not segments and not parts:
                rows = S.read_segments(self.spark, own, T.StructType.fromJson(form), positions)
                parts.append(rows if len(m.forms) == 1 else aligned(rows, kinds))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _frame(self, r: Request, positions: bool = False) -> tuple[Frame, Manifest]:
        """What a request asks for; with positions if asked for, or if a clause needs them."""
        m = self.catalog.resolve(r.symbol, r.as_of) if not r.staged or self.has_symbol(r.symbol, r.as_of) else None
        if r.staged:
            m = self._with_staged(r.symbol, m)
        clauses = r.query.clauses if r.query else ()
        if m.pickled and (clauses or r.date_range or r.row_range or r.columns):
            raise SchemaError(f"{r.symbol} is pickled: it can only be read whole")
        if r.date_range is not None and r.row_range is not None:
            raise UserInputError("either a date range or a row range")
        first: tuple = ()
        if r.date_range is not None:
            first = (DateRange(*r.date_range),)
            if any(isinstance(c, ResampleBy) and c.spec.of_data for c in clauses):
                raise UserInputError("an origin from the data does not go with a date range")
        positions = positions or r.row_range is not None or needs_order(clauses)
        keep = m.segments
        for clause in (*first, *clauses):
            if isinstance(clause, DateRange):
                if m.index is None:
                    raise SchemaError(f"{r.symbol} has no index of times")
                if not m.sorted:
                    raise UnsortedDataError(f"{r.symbol} is not sorted")
                lo, hi = (None if b is None else _micros(b) for b in (clause.start, clause.end))
                keep = [s for s in keep if (lo is None or s.end is None or s.end >= lo) and (hi is None or s.start is None or s.start <= hi)]
            elif isinstance(clause, Filter):
                keep = [s for s in keep if may_match(clause.condition, s)]
            else:
                break
        if r.row_range is not None:
            n = m.rows
            a, b = (x if x is None else max(0, min(n, n + x if x < 0 else x)) for x in r.row_range)
            a, b = a or 0, n if b is None else b
            keep = [s for s in keep if s.first_row < b and s.first_row + s.rows > a]
        rows = self._rows(m, keep, positions)
        if r.row_range is not None:
            rows = rows.filter((F.col(ROW) >= a) & (F.col(ROW) < b))
        frame = Frame(rows, m.index, (ROW,) if positions else ())
        for clause in first:
            frame = clause.apply(frame)
        for i, clause in enumerate(clauses):
            if i == 0 and r.row_range is None and isinstance(clause, RowRange) and frame.df is rows and (clause.start or 0) >= 0 and (clause.end is None or clause.end >= 0):
                c = F.col(ROW)
                df = frame.df.filter(c >= (clause.start or 0))
                frame = replace(frame, df=df if clause.end is None else df.filter(c < clause.end))
            else:
                frame = clause.apply(frame)
        if r.columns is not None:
            wanted = [c for c in frame.df.columns if c in r.columns or c == m.index or c == ROW]
            missing = set(r.columns) - set(frame.df.columns)
            if missing and not self.options.dynamic_schema:
                raise SchemaError(f"there is no column {', '.join(sorted(missing))}")
            frame = replace(frame, df=frame.df.select(*(F.col(f"`{c}`") for c in wanted)))
        return frame, m

    def read(self, symbol: str, as_of: Any = None, date_range: tuple | None = None, row_range: tuple | None = None, columns: list[str] | None = None, query: Query | None = None, lazy: bool = False, staged: bool = False) -> Any:
        """The symbol's data, or a lazy read. staged: rows that are staged come after them."""
        request = Request(symbol, as_of, date_range, row_range, columns, query, staged)
        if lazy:
            return LazyFrame(self, request)
        frame, m = self._frame(request)
        if m.pickled:
            return VersionedItem(symbol, pickle.loads(frame.df.first()["object"]), m.version, m.metadata, m.created)
        return VersionedItem(symbol, frame.visible(), m.version, m.metadata, m.created, lambda: self._frame(request, True)[0].sorted())

    def read_batch(self, requests: list[str | Request], query: Query | None = None, lazy: bool = False) -> Any:
        requests = [Request(r) if isinstance(r, str) else r for r in requests]
        if query is not None:
            requests = [replace(r, query=r.query or query) for r in requests]
        if lazy:
            return LazyFrames([LazyFrame(self, r) for r in requests])
        return _each([(r.symbol, lambda r=r: self.read(r.symbol, r.as_of, r.date_range, r.row_range, r.columns, r.query)) for r in requests])

    def read_batch_and_join(self, requests: list[str | Request], query: Query) -> JoinedItem:
        """Reads several symbols and runs a query on them that begins with concat."""
        lazy = self.read_batch(requests, lazy=True).split()
        if not query.clauses or not hasattr(query.clauses[0], "join"):
            raise UserInputError("the query must begin with concat")
        return LazyJoined(lazy, query.clauses[0].join, query.clauses[1:]).collect()

    def head(self, symbol: str, n: int = 5, as_of: Any = None, columns: list[str] | None = None) -> VersionedItem:
        """The first n rows, or all but the last -n."""
        rows = (0, n) if n >= 0 else (None, n)
        return self.read(symbol, as_of, row_range=rows, columns=columns)

    def tail(self, symbol: str, n: int = 5, as_of: Any = None, columns: list[str] | None = None) -> VersionedItem:
        """The last n rows, or all but the first -n."""
        total = self.catalog.resolve(symbol, as_of).rows
        return self.read(symbol, as_of, row_range=(max(0, total - n) if n >= 0 else min(total, -n), None), columns=columns)

    def read_metadata(self, symbol: str, as_of: Any = None) -> VersionedItem:
        m = self.catalog.resolve(symbol, as_of)
        return VersionedItem(symbol, None, m.version, m.metadata, m.created)

    def read_metadata_batch(self, symbols: list[str]) -> list[VersionedItem | DataError]:
        return _each([(s, lambda s=s: self.read_metadata(s)) for s in symbols])

    def get_description(self, symbol: str, as_of: Any = None) -> SymbolDescription:
        m = self.catalog.resolve(symbol, as_of)
        times = [(s.start, s.end) for s in m.segments if s.start is not None]
        span = tuple(pd.Timestamp(t, unit="us", tz="UTC") for t in (min(t[0] for t in times), max(t[1] for t in times))) if times else (None, None)
        columns = tuple((f.name, str(K.kind_of(f))) for f in m.struct().fields)
        return SymbolDescription(columns, m.index, m.rows, span, m.sorted, pd.Timestamp(m.created, tz="UTC"))

    def get_description_batch(self, symbols: list[str]) -> list[SymbolDescription | DataError]:
        return _each([(s, lambda s=s: self.get_description(s)) for s in symbols])

    def read_index(self, symbol: str, as_of: Any = None) -> pd.DataFrame:
        """The version's segments: paths, rows and times."""
        return pd.DataFrame(S.to_json(self.catalog.resolve(symbol, as_of).segments))

    # listing

    def list_symbols(self, regex: str | None = None, snapshot: str | None = None) -> list[str]:
        names = sorted(self.catalog.snapshot(snapshot)["versions"]) if snapshot else self.catalog.symbols()
        return [n for n in names if regex is None or re.search(regex, n)]

    def has_symbol(self, symbol: str, as_of: Any = None) -> bool:
        try:
            self.catalog.resolve(symbol, as_of)
        except NoSuchVersionError:
            return False
        return True

    def list_versions(self, symbol: str | None = None, snapshot: str | None = None, latest_only: bool = False) -> dict[tuple[str, int], VersionInfo]:
        pins: dict[tuple[str, int], list[str]] = {}
        for name, content in self.catalog.snapshots().items():
            for s, v in content["versions"].items():
                pins.setdefault((s, v), []).append(name)
        out = {}
        for s in [symbol] if symbol else self.list_symbols():
            alive = self.catalog.numbers(s)
            held = [v for x, v in pins if x == s and v not in alive]
            for v in sorted({*(alive[-1:] if latest_only else alive), *([] if latest_only else held)}, reverse=True):
                if snapshot is None or snapshot in pins.get((s, v), []):
                    out[(s, v)] = VersionInfo(v, pd.Timestamp(self.catalog.load(s, v).created, tz="UTC"), v not in alive, sorted(pins.get((s, v), [])))
        return out

    # writing

    def _commit(self, symbol: str, m: Manifest, prune: bool = False) -> VersionedItem:
        m.segments = S.numbered(m.segments)
        if not m.adopted and self.folder.names(f"{self.catalog.symbol(symbol)}/staging") and self.has_symbol(symbol):  # a crash may have left entries
            m.adopted = self.catalog.resolve(symbol).adopted
        m = self.catalog.commit(symbol, m)
        if prune:
            self.prune_previous_versions(symbol)
        return VersionedItem(symbol, None, m.version, m.metadata, m.created)

    def _data(self, symbol: str) -> str:
        return self.folder.full(f"{self.catalog.symbol(symbol)}/data")

    def _write(self, symbol: str, df: DataFrame, index: str | None, order: list[str] | None = None) -> list[Segment]:
        return S.write_segments(df, self._data(symbol), index, self.options.rows_per_segment, self.options.codec, order, self.options.dedup)

    def _kept(self, symbol: str, segments: list[Segment], m: Manifest) -> list[Segment]:
        """The segments, but where the newest version has one with the same rows, that one; its copy is deleted."""
        if not self.options.dedup or not self.has_symbol(symbol):
            return segments
        old = self.catalog.resolve(symbol)
        if old.index != m.index:
            return segments
        known: dict[tuple, list[Segment]] = {}
        for s in old.segments:
            if s.digest:
                known.setdefault((s.digest, s.rows, json.dumps(old.forms[s.form])), []).append(s)
        out = []
        for s in segments:
            alike = known.get((s.digest, s.rows, json.dumps(m.forms[s.form])))
            same = alike.pop(0) if alike else None  # each once: positions go by files
            if same:
                self.folder.delete_path(s.path)
            out.append(replace(same, form=s.form, stats={}) if same else s)
        return out

    @staticmethod
    def _schema(df: DataFrame) -> dict:
        return T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in df.schema.fields if f.name != ROW]).jsonValue()

    def _input(self, data: Any, index: str | None, validate_index: bool) -> tuple[DataFrame, str | None]:
        df, index = S.as_frame(self.spark, data, index)
        if index is not None and (index not in df.columns or K.kind_of(df.schema[index]) != K.TIME):
            raise SchemaError(f"the index {index} must be a column of times")
        for f in df.schema.fields:
            if f.name != ROW:
                K.kind_of(f)
        if index and validate_index and ROW in df.columns:  # else they will be put in the index's order
            S.check_sorted(df, index)
        return df, index

    def write(self, symbol: str, data: Any, metadata: Any = None, index: str | None = None, prune_previous_versions: bool = False, validate_index: bool = True) -> VersionedItem:
        """Writes a new version. index: the column of times, if rows are indexed by one (pandas: its DatetimeIndex)."""
        df, index = self._input(data, index, validate_index)
        return self._new(symbol, df, index, metadata, index is not None and validate_index, None, prune_previous_versions)

    def _new(self, symbol: str, df: DataFrame, index: str | None, metadata: Any, is_sorted: bool, order: list[str] | None = None, prune: bool = False) -> VersionedItem:
        """Writes rows, in the given order, as a new version."""
        schema = self._schema(df.drop(*(c for c in order or [] if c != index)))
        m = Manifest(0, 0, index, [schema], schema, self._write(symbol, df, index, order), metadata, sorted=is_sorted)
        m.segments = self._kept(symbol, m.segments, m)
        return self._commit(symbol, m, prune)

    def write_pickle(self, symbol: str, data: Any, metadata: Any = None) -> VersionedItem:
        """Writes any object, to be read whole."""
        df = self.spark.createDataFrame([(bytearray(pickle.dumps(data)), 0)], f"object binary, {ROW} long")
        schema = self._schema(df)
        return self._commit(symbol, Manifest(0, 0, None, [schema], schema, self._write(symbol, df, None), metadata, pickled=True))

    def _fitting(self, symbol: str, m: Manifest, df: DataFrame, index: str | None) -> tuple[dict, list[dict], int]:
        """The schema after rows of ``df`` are added, the forms, and the number of the rows' form."""
        if m.pickled:
            raise SchemaError(f"{symbol} is pickled")
        if index != m.index:
            raise SchemaError(f"{symbol} has the index {m.index}, the rows have {index}")
        own = self._schema(df)
        if own == m.schema:
            return m.schema, m.forms, m.forms.index(own) if own in m.forms else len(m.forms)
        old, new = ({f.name: K.kind_of(f) for f in T.StructType.fromJson(s).fields} for s in (m.schema, own))
        if old == new and list(old) == list(new):  # times with and without a zone
            return m.schema, [*m.forms, own], len(m.forms)
        if not self.options.dynamic_schema:
            raise SchemaError(f"{symbol} has columns {_told(old)}, the rows have {_told(new)}")
        fields = []
        for name in dict.fromkeys((*old, *new)):
            kind = K.exact_common(old[name], new[name]) if name in old and name in new else old.get(name, new.get(name))
            if kind is None:
                raise SchemaError(f"column {name}: no common type of {old[name]} and {new[name]}")
            fields.append(T.StructField(name, K.spark_type(kind), True, {K.KEY: str(kind)} if kind.kind == "u" else {}))
        return T.StructType(fields).jsonValue(), [*m.forms, own], len(m.forms)

    def _forms(self, m: Manifest, forms: list[dict], own: dict, form: int) -> list[dict]:
        return forms if form < len(forms) else [*forms, own]

    def append(self, symbol: str, data: Any, metadata: Any = None, index: str | None = None, prune_previous_versions: bool = False, validate_index: bool = True) -> VersionedItem:
        """Adds rows after the last; their first time must not be before it. Creates the symbol if there is none."""
        if not self.has_symbol(symbol):
            return self.write(symbol, data, metadata, index, prune_previous_versions, validate_index)
        m = self.catalog.resolve(symbol)
        df, index = self._input(data, index if index is not None or not isinstance(data, DataFrame) else m.index, validate_index)
        schema, forms, form = self._fitting(symbol, m, df, index)
        new = [replace(s, form=form) for s in self._write(symbol, df, index)]
        if index and validate_index and new and m.segments and min(s.start for s in new) < max(s.end for s in m.segments):
            raise UnsortedDataError(f"rows to append to {symbol} begin before its last time")
        out = replace_manifest(m, schema=schema, forms=self._forms(m, forms, self._schema(df), form), segments=[*m.segments, *new], metadata=metadata)
        return self._commit(symbol, out, prune_previous_versions) if new else VersionedItem(symbol, None, m.version, m.metadata, m.created)

    def _outside(self, symbol: str, m: Manifest, lo: int, hi: int) -> tuple[list[Segment], list[Segment]]:
        """Segments before and after [lo, hi]; those that reach into it are cut."""
        if m.index is None:
            raise SchemaError(f"{symbol} has no index of times")
        if not m.sorted:
            raise UnsortedDataError(f"{symbol} is not sorted")
        before = [s for s in m.segments if s.end < lo]
        after = [s for s in m.segments if s.start > hi]
        cut = [s for s in m.segments if s.end >= lo and s.start <= hi]
        for side, keep in ((before, lambda t: t < lo), (after, lambda t: t > hi)):
            parts: list[Segment] = []
            for s in cut:  # as they ascend, one reaches out on a side, or a few that share its time
                if s.start < lo if side is before else s.end > hi:
                    rows = S.read_segments(self.spark, [s], T.StructType.fromJson(m.forms[s.form]))
                    rows = rows.filter(keep(S.micros_of(m.index, rows)))
                    parts += [replace(x, form=s.form) for x in self._write(symbol, rows, m.index, [ROW])]
            if side is before:
                before += parts
            else:
                after[:0] = parts
        return before, after

    def update(self, symbol: str, data: Any, metadata: Any = None, index: str | None = None, date_range: tuple | None = None, upsert: bool = False, prune_previous_versions: bool = False) -> VersionedItem:
        """Replaces all rows between the first and last time of the data (or in the date range) by the data."""
        if not self.has_symbol(symbol):
            if upsert:
                return self.write(symbol, data, metadata, index)
            raise NoSuchVersionError(f"there is no symbol {symbol}")
        m = self.catalog.resolve(symbol)
        df, index = self._input(data, index if index is not None or not isinstance(data, DataFrame) else m.index, True)
        if m.index is None or index is None:
            raise SchemaError("an update needs an index of times")
        if date_range is not None:
            df = ranges.dates_between(df, index, *date_range)
        schema, forms, form = self._fitting(symbol, m, df, index)
        new = [replace(s, form=form) for s in self._write(symbol, df, index)]
        if not new and date_range is None:
            return VersionedItem(symbol, None, m.version, m.metadata, m.created)
        lo, hi = (min(s.start for s in new), max(s.end for s in new)) if new else (None, None)
        if date_range is not None:
            lo, hi = (-(1 << 62) if date_range[0] is None else _micros(date_range[0])), (1 << 62 if date_range[1] is None else _micros(date_range[1]))
        before, after = self._outside(symbol, m, lo, hi)
        out = replace_manifest(m, schema=schema, forms=self._forms(m, forms, self._schema(df), form), segments=[*before, *new, *after], metadata=metadata)
        return self._commit(symbol, out, prune_previous_versions)

    def delete_data_in_range(self, symbol: str, date_range: tuple) -> VersionedItem:
        """Removes all rows in the closed range."""
        m = self.catalog.resolve(symbol)
        lo, hi = (-(1 << 62) if date_range[0] is None else _micros(date_range[0])), (1 << 62 if date_range[1] is None else _micros(date_range[1]))
        before, after = self._outside(symbol, m, lo, hi)
        return self._commit(symbol, replace_manifest(m, segments=[*before, *after]))

    def merge(self, symbol: str, source: Any, strategy: tuple[str, str] = ("update", "do_nothing"), on: list[str] | None = None, index: str | None = None, metadata: Any = None) -> VersionedItem:
        """Updates rows that match the source on its index and ``on``, inserts those that don't, or both."""
        check_strategy(*strategy)
        m = self.catalog.resolve(symbol)
        df, index = self._input(source, index if index is not None or not isinstance(source, DataFrame) else m.index, True)
        if self._schema(df) != m.schema:
            raise SchemaError(f"the source's columns differ from those of {symbol}")
        keys = ([m.index] if m.index else []) + list(on or [])
        if not keys:
            raise UserInputError("a merge needs columns to match on")
        src = df.drop(ROW)
        if src.isEmpty():
            return VersionedItem(symbol, None, m.version, m.metadata, m.created)
        touched = m.segments
        if m.index:
            lo, hi = src.agg(F.min(S.micros_of(m.index, src)), F.max(S.micros_of(m.index, src))).first()
            at = [i for i, s in enumerate(m.segments) if s.end >= lo and s.start <= hi]
            touched = m.segments[min(at) : max(at) + 1] if at else []
        rows, added = merge(self._rows(m, touched), src, keys, *strategy, keep=(ROW,))
        first = m.segments.index(touched[0]) if touched else (sum(1 for s in m.segments if m.index and s.end < lo) if m.index else len(m.segments))
        order, rows = [ROW], rows.select(*m.struct().names, ROW)
        if added is not None:
            order = [*([m.index] if m.index else []), "__new", ROW]
            rows = rows.withColumn("__new", F.lit(0)).unionByName(added.withColumn(ROW, F.lit(None).cast("long")).withColumn("__new", F.lit(1)))
        form = m.forms.index(m.schema) if m.schema in m.forms else len(m.forms)
        new = [replace(s, form=form) for s in self._write(symbol, rows, m.index, order)]
        segments = [*m.segments[:first], *new, *m.segments[first + len(touched) :]]
        return self._commit(symbol, replace_manifest(m, forms=self._forms(m, m.forms, m.schema, form), segments=segments, metadata=metadata))

    def write_metadata(self, symbol: str, metadata: Any) -> VersionedItem:
        """A new version of the same data."""
        return self._commit(symbol, replace_manifest(self.catalog.resolve(symbol), metadata=metadata))

    def restore_version(self, symbol: str, as_of: Any) -> VersionedItem:
        """An old version's data and metadata as the newest version."""
        return self._commit(symbol, self.catalog.resolve(symbol, as_of))

    def restore_version_batch(self, items: dict[str, Any]) -> list[VersionedItem | DataError]:
        return self._batch(self.restore_version, items)

    def read_modify_write(self, symbol: str, query: Query, target: str | None = None, as_of: Any = None) -> VersionedItem:
        """Writes the result of a query."""
        frame, m = self._frame(Request(symbol, as_of, query=query), True)
        index = frame.index if frame.index in frame.df.columns else None
        if ROW not in frame.df.columns:
            return self.write(target or symbol, frame.visible(), m.metadata, index)
        return self._new(target or symbol, frame.df, index, m.metadata, index is not None and m.sorted, [ROW])

    def _batch(self, verb, items: dict[str, Any], **options: Any) -> list[VersionedItem | DataError]:
        return _each([(s, lambda s=s, d=d: verb(s, d, **options)) for s, d in items.items()])

    def write_batch(self, items: dict[str, Any], **options: Any) -> list[VersionedItem | DataError]:
        return self._batch(self.write, items, **options)

    def append_batch(self, items: dict[str, Any], **options: Any) -> list[VersionedItem | DataError]:
        return self._batch(self.append, items, **options)

    def update_batch(self, items: dict[str, Any], **options: Any) -> list[VersionedItem | DataError]:
        return self._batch(self.update, items, **options)

    def write_metadata_batch(self, items: dict[str, Any]) -> list[VersionedItem | DataError]:
        return self._batch(self.write_metadata, items)

    def write_pickle_batch(self, items: dict[str, Any]) -> list[VersionedItem | DataError]:
        return self._batch(self.write_pickle, items)

    # deleting

    def _sweep(self, symbol: str, gone: Iterable[int]) -> None:
        """Removes folders of segments that versions which are gone had, and no other version, snapshot or staged entry has."""
        held = {*self.catalog.numbers(symbol), *self.catalog.pinned(symbol)}
        lost = {s.folder for v in set(gone) - held for s in self.catalog.load(symbol, v).segments}
        if lost:
            lost -= {s.folder for v in held for s in self.catalog.load(symbol, v).segments}
            lost -= {s.folder for _, e in self._entries(symbol) for s in S.from_json(e["segments"])}
        for path in lost:
            self.folder.delete_path(path)

    def delete(self, symbol: str, versions: int | Iterable[int] | None = None) -> None:
        """Deletes versions, or all; what a snapshot holds can still be read through it."""
        gone = self.catalog.numbers(symbol) if versions is None else [versions] if isinstance(versions, int) else list(versions)
        missing = set(gone) - set(self.catalog.numbers(symbol))
        if missing or not gone:
            raise NoSuchVersionError(f"{symbol} has no version {', '.join(map(str, missing)) or 'at all'}")
        for v in gone:
            self.catalog.mark_deleted(symbol, v)
        self._sweep(symbol, gone)

    def delete_batch(self, symbols: list[str]) -> list[None | DataError]:
        return _each([(s, lambda s=s: self.delete(s)) for s in symbols])

    def prune_previous_versions(self, symbol: str) -> None:
        """Deletes all versions but the newest and those in snapshots."""
        gone = self.catalog.numbers(symbol)[:-1]
        for v in gone:
            self.catalog.mark_deleted(symbol, v)
        self._sweep(symbol, gone)

    # snapshots

    def snapshot(self, name: str, metadata: Any = None, skip_symbols: Iterable[str] = (), versions: dict[str, int] | None = None) -> None:
        """Names the newest (or given) version of each symbol."""
        if name in self.catalog.snapshots():
            raise UserInputError(f"there is a snapshot {name}")
        skipped = set(skip_symbols)
        if versions is None:
            chosen = {s: self.catalog.latest(s) for s in self.list_symbols() if s not in skipped}
        else:
            chosen = {s: self.catalog.resolve(s, v).version for s, v in versions.items()}
        self.catalog.put_snapshot(name, {"versions": chosen, "metadata": metadata})

    def add_to_snapshot(self, name: str, symbols: list[str], versions: list[Any] | None = None) -> None:
        content = self.catalog.snapshot(name)
        for i, s in enumerate(symbols):
            content["versions"][s] = self.catalog.resolve(s, versions[i] if versions else None).version
        self.catalog.put_snapshot(name, content)

    def remove_from_snapshot(self, name: str, symbols: list[str]) -> None:
        content = self.catalog.snapshot(name)
        content["versions"] = {s: v for s, v in content["versions"].items() if s not in set(symbols)}
        self.catalog.put_snapshot(name, content)

    def delete_snapshot(self, name: str) -> None:
        held = self.catalog.snapshot(name)["versions"]
        self.catalog.drop_snapshot(name)
        for s, v in held.items():
            self._sweep(s, [v])

    def list_snapshots(self) -> dict[str, Any]:
        return {n: c["metadata"] for n, c in self.catalog.snapshots().items()}

    # staging

    def stage(self, symbol: str, data: Any, index: str | None = None, sort_on_index: bool = False, sort_columns: list[str] | None = None, validate_index: bool = True, token: str | None = None) -> str:
        """Writes rows that cannot be read until they are finalized; returns their token. Under a given token, rows are staged once."""
        token = safe(token) if token else uuid.uuid4().hex
        entry = f"{self.catalog.symbol(symbol)}/staging/{token}.json"
        if self.folder.exists(entry) or self.is_adopted(symbol, token):
            return token
        order = list(sort_columns or [])
        df, index = S.as_frame(self.spark, data, index)
        if sort_on_index and index:
            order = [index]
        df, index = self._input(df, index, validate_index and not order)
        schema = self._schema(df)
        if order:  # columns that order rows are kept: those given to the writer are left out
            names = [f"__order_{i}" for i in range(len(order))]
            for n, c in zip(names, order, strict=True):
                df = df.withColumn(n, F.col(f"`{c}`"))
            order = [*names, *([ROW] if ROW in df.columns else [])]
        found = self._write(symbol, df, index, order or None)
        self.folder.put(entry, json.dumps({"segments": S.to_json(found), "schema": schema, "index": index}))
        return token

    def _entries(self, symbol: str) -> list[tuple[str, dict]]:
        """Tokens and entries of staged rows, but those that a version has."""
        base = f"{self.catalog.symbol(symbol)}/staging"
        there = [n.removesuffix(".json") for n in self.folder.names(base) if n.endswith(".json")]
        if not there:
            return []
        adopted = set(self.catalog.resolve(symbol).adopted) if self.has_symbol(symbol) else set()
        return [(t, json.loads(self.folder.read(f"{base}/{t}.json"))) for t in there if t not in adopted]

    def is_adopted(self, symbol: str, token: str) -> bool:
        """Whether the newest version has the staged rows of a token (or one of the last TOKENS before it had)."""
        return self.has_symbol(symbol) and token in self.catalog.resolve(symbol).adopted

    def get_staged_symbols(self) -> list[str]:
        from urllib.parse import unquote

        return [s for s in map(unquote, self.folder.names("symbols")) if self._entries(s)]

    def delete_staged_data(self, symbol: str) -> None:
        self._unstage(symbol, [t for t, _ in self._entries(symbol)], delete=True)

    def _unstage(self, symbol: str, tokens: list[str], delete: bool = False) -> None:
        """Removes entries, and their rows."""
        for t, e in self._entries(symbol):
            if delete and t in tokens:
                for path in {s.folder for s in S.from_json(e["segments"])}:
                    self.folder.delete_path(path)
        for t in tokens:
            self.folder.delete(f"{self.catalog.symbol(symbol)}/staging/{t}.json")

    def _staged(self, symbol: str, tokens: list[str] | None) -> list[tuple[str, dict]]:
        there = self._entries(symbol)
        missing = set(tokens or []) - {t for t, _ in there}
        if missing:
            raise NoSuchVersionError(f"nothing is staged for {symbol} under {', '.join(sorted(missing))}")
        found = [(t, e) for t, e in there if tokens is None or t in tokens]
        if not found:
            raise NoSuchVersionError(f"nothing is staged for {symbol}")
        return found

    def finalize_staged_data(self, symbol: str, mode: str = "write", tokens: list[str] | None = None, metadata: Any = None, validate_index: bool = True, delete_staged_data_on_failure: bool = False, prune_previous_versions: bool = False) -> VersionedItem:
        """Makes staged rows a version (or appends them): their blocks must not overlap in time, and go in order of time."""
        return self._finalize(symbol, mode, tokens, metadata, delete_staged_data_on_failure, False, prune_previous_versions, validate_index)

    def sort_and_finalize_staged_data(self, symbol: str, mode: str = "write", tokens: list[str] | None = None, metadata: Any = None, delete_staged_data_on_failure: bool = False, prune_previous_versions: bool = False) -> VersionedItem:
        """As finalize_staged_data, but all staged rows are sorted together."""
        return self._finalize(symbol, mode, tokens, metadata, delete_staged_data_on_failure, True, prune_previous_versions, True)

    def _finalize(self, symbol: str, mode: str, tokens: list[str] | None, metadata: Any, clear: bool, sort: bool, prune: bool, validate: bool) -> VersionedItem:
        if mode not in ("write", "append"):
            raise UserInputError("mode is write or append")
        staged = self._staged(symbol, tokens)
        try:
            item = self._finalized(symbol, mode, staged, metadata, sort, prune, validate)
        except TidemarkError:
            if clear:
                self._unstage(symbol, [t for t, _ in staged], delete=True)
            raise
        self._unstage(symbol, [t for t, _ in staged])
        if sort:  # its rows were written anew
            for path in {s.folder for _, e in staged for s in S.from_json(e["segments"])}:
                self.folder.delete_path(path)
        return item

    def _finalized(self, symbol: str, mode: str, staged: list[tuple[str, dict]], metadata: Any, sort: bool, prune: bool, validate: bool) -> VersionedItem:
        index = staged[0][1]["index"]
        old = self.catalog.resolve(symbol) if mode == "append" and self.has_symbol(symbol) else None
        base = staged[0][1]["schema"]
        m = old or Manifest(0, 0, index, [base], base, [], sorted=index is not None)
        blocks, forms, schema = [], list(m.forms), m.schema
        for _, block in staged:
            empty = self.spark.createDataFrame([], T.StructType.fromJson(block["schema"]))
            schema, forms, form = self._fitting(symbol, replace_manifest(m, schema=schema, forms=forms), empty, block["index"])
            forms = self._forms(m, forms, block["schema"], form)
            blocks.append([replace(s, form=form) for s in S.from_json(block["segments"])])
        blocks = [b for b in blocks if b]
        if sort:
            if index is None:
                raise SchemaError("sorting needs an index of times")
            whole = replace_manifest(m, schema=schema, forms=forms, segments=[s for b in blocks for s in S.numbered(b)])
            segments = self._write(symbol, self._rows(whole), index, [index, ROW])
            form = forms.index(schema) if schema in forms else len(forms)
            forms = forms if form < len(forms) else [*forms, schema]
            segments = [replace(s, form=form) for s in segments]
        else:
            if index is not None:
                blocks.sort(key=lambda b: (min(s.start for s in b), max(s.end for s in b)))
                for a, b in zip(blocks, blocks[1:], strict=False):
                    if validate and min(s.start for s in b) < max(s.end for s in a):
                        raise UnsortedDataError(f"staged blocks of {symbol} overlap in time")
            segments = [s for b in blocks for s in b]
        if old and index and segments and old.segments and min(s.start for s in segments) < max(s.end for s in old.segments):
            raise UnsortedDataError(f"staged rows of {symbol} begin before its last time")
        adopted = [*(self.catalog.resolve(symbol).adopted if self.has_symbol(symbol) else []), *(t for t, _ in staged)][-TOKENS:]
        out = replace_manifest(m, schema=schema, forms=forms, segments=[*m.segments, *segments], metadata=metadata, adopted=adopted)
        return self._commit(symbol, out, prune)

    def _with_staged(self, symbol: str, m: Manifest | None) -> Manifest:
        """The version with staged blocks after it, in order of time."""
        try:
            staged = self._staged(symbol, None)
        except NoSuchVersionError:
            if m is None:
                raise
            return m
        base = staged[0][1]["schema"]
        m = m or Manifest(-1, 0, staged[0][1]["index"], [base], base, [], sorted=staged[0][1]["index"] is not None)
        blocks, forms, schema = [], list(m.forms), m.schema
        for _, block in staged:
            empty = self.spark.createDataFrame([], T.StructType.fromJson(block["schema"]))
            schema, forms, form = self._fitting(symbol, replace_manifest(m, schema=schema, forms=forms), empty, block["index"])
            forms = self._forms(m, forms, block["schema"], form)
            blocks.append([replace(s, form=form) for s in S.from_json(block["segments"])])
        blocks = sorted((b for b in blocks if b), key=lambda b: (b[0].start is None, b[0].start))
        return replace_manifest(m, schema=schema, forms=forms, segments=S.numbered([*m.segments, *(s for b in blocks for s in b)]))

    def write_partitioned(self, symbol: str, data: Any, by: str, index: str | None = None) -> dict[Any, VersionedItem]:
        """A symbol ``symbol/value`` for each distinct value of a column, without that column; all rows are written in one pass."""
        df, index = S.as_frame(self.spark, data, index)
        key = F.col(f"`{by}`")
        values = [r[0] for r in df.select(key).distinct().orderBy(by).collect()]  # a symbol each
        kind = T.StructType([T.StructField("__value", df.schema[by].dataType), T.StructField("__piece", T.LongType())])
        numbers = self.spark.createDataFrame([(v, i) for i, v in enumerate(values)], kind)
        rows = df.join(numbers, key.eqNullSafe(F.col("__value"))).drop(by, "__value")
        stored = T.StructType.fromJson(self._schema(rows.drop("__piece")))
        order = [ROW] if ROW in rows.columns else [index] if index else []
        pieces = S.write_pieces(rows, self._data(symbol), "__piece", order, index, self.options.rows_per_segment, self.options.codec, stored)

        def commit(number: int, value: Any) -> VersionedItem:
            schema = stored.jsonValue()
            return self._commit(f"{symbol}/{value}", Manifest(0, 0, index, [schema], schema, pieces.get(number, []), sorted=index is not None))

        with ThreadPoolExecutor(THREADS) as pool:
            return dict(zip(values, pool.map(commit, range(len(values)), values), strict=True))

    def export_file(self, symbol: str, uri: str, as_of: Any = None) -> None:
        """A version as one Parquet file and its manifest, in a folder of their own."""
        frame, m = self._frame(Request(symbol, as_of), True)
        target = Folder(self.spark, uri)
        frame.sorted().coalesce(1).write.mode("overwrite").parquet(target.full("data"))
        target.put("manifest.json", m.to_json())

    def import_file(self, symbol: str, uri: str) -> VersionedItem:
        """Writes what ``export_file`` has written as a new version."""
        source = Folder(self.spark, uri)
        m = Manifest.from_json(source.read("manifest.json"))
        rows = self.spark.read.schema(m.struct()).parquet(source.full("data")).withColumn(ROW, F.col("_metadata.row_index"))
        new = Manifest(0, 0, m.index, [m.schema], m.schema, self._write(symbol, rows, m.index), m.metadata, m.pickled, m.sorted)
        return self._commit(symbol, new)

    def explain_read(self, symbol: str, **options: Any) -> dict[str, Any]:
        """What a read would open: segments and rows of the version and of the read, and its plan."""
        request = Request(symbol, **options)
        frame, m = self._frame(request)
        opened = set(frame.df.inputFiles())
        names = {ranges.file_key(f) for f in opened}
        own = [s for s in m.segments if ranges.file_key(s.path) in names]
        plan = frame.df._jdf.queryExecution().simpleString()
        return {"segments": len(m.segments), "opened": len(own), "rows": m.rows, "opened_rows": sum(s.rows for s in own), "plan": plan}

    # compaction and statistics

    def explain_compaction(self, symbol: str, rows_per_segment: int | None = None) -> list[list[int]]:
        """Numbers of the neighbouring segments that compaction would rewrite, group by group."""
        m, target = self.catalog.resolve(symbol), rows_per_segment or self.options.rows_per_segment
        groups, run, held = [], [], 0
        for i, s in enumerate(m.segments):
            good = 0.67 * target <= s.rows <= 1.33 * target
            if run and (good and held >= 0.67 * target or m.segments[run[-1]].form != s.form):
                groups.append(run)
                run, held = [], 0
            if good and not run:
                continue
            run.append(i)
            held += s.rows
            if held >= target:
                groups.append(run)
                run, held = [], 0
        groups.append(run)
        return [g for g in groups if len(g) > 1 or g and m.segments[g[0]].rows > 1.33 * target]

    def compact_data(self, symbol: str, rows_per_segment: int | None = None, prune_previous_versions: bool = False) -> VersionedItem:
        """Rewrites segments that are far from the size they should have; no new version if all are near it."""
        m, target = self.catalog.resolve(symbol), rows_per_segment or self.options.rows_per_segment
        groups = self.explain_compaction(symbol, rows_per_segment)
        if not groups:
            return VersionedItem(symbol, None, m.version, m.metadata, m.created)
        made: dict[int, list[Segment]] = {}
        for form in {m.segments[g[0]].form for g in groups}:  # all groups of a form in one pass
            own = [(n, g) for n, g in enumerate(groups) if m.segments[g[0]].form == form]
            schema = T.StructType.fromJson(m.forms[form])
            table, pieces = [], {}
            for n, g in own:
                held = sum(m.segments[i].rows for i in g)
                size = -(-held // max(1, round(held / target)))
                table += [(m.segments[i].path, m.segments[i].first_row - m.segments[g[0]].first_row, size, len(pieces)) for i in g]
                pieces |= {len(pieces) + i: n for i in range(-(-held // size))}
            files = self.spark.createDataFrame([(ranges.file_key(path), *rest) for path, *rest in table], "__f string, __shift long, __size long, __base long")  # a row per segment
            rows = self.spark.read.schema(schema).parquet(*(path for path, *_ in table)).select("*", ranges.file_key_column().alias("__file"), F.col("_metadata.row_index").alias("__at"))
            rows = rows.join(F.broadcast(files), F.col("__file") == F.col("__f")).withColumn("__old", F.col("__shift") + F.col("__at"))
            rows = rows.withColumn("__piece", F.col("__base") + F.floor(F.col("__old") / F.col("__size")))
            found = S.write_pieces(rows, self._data(symbol), "__piece", ["__old"], m.index, 1 << 40, self.options.codec, schema)
            for piece in sorted(found):
                made.setdefault(pieces[piece], []).extend(replace(s, form=form) for s in found[piece])
        out, at = [], 0
        for n, g in enumerate(groups):
            out += m.segments[at : g[0]] + made.get(n, [])
            at = g[-1] + 1
        out += m.segments[at:]
        return self._commit(symbol, replace_manifest(m, segments=out), prune_previous_versions)

    def is_symbol_fragmented(self, symbol: str, segments: int = 100) -> bool:
        return sum(map(len, self.explain_compaction(symbol))) >= segments

    defragment_symbol_data = compact_data

    def create_column_stats(self, symbol: str, columns: list[str], as_of: Any = None) -> None:
        """Keeps the least and greatest value per segment of columns of numbers, booleans or times."""
        m = self.catalog.resolve(symbol, as_of)
        fields = {f.name: f for f in m.struct().fields}
        for c in columns:
            if c not in fields or not (K.kind_of(fields[c]).numeric or K.kind_of(fields[c]) in (K.BOOL, K.TIME)):
                raise SchemaError(f"no statistics of column {c}")
        found: dict[str, dict] = {}
        for form, schema in enumerate(m.forms):
            paths = [s.path for s in m.segments if s.form == form]
            if not paths:
                continue
            rows = self.spark.read.schema(T.StructType.fromJson(schema)).parquet(*paths)
            own = [c for c in columns if c in rows.columns]
            value = {c: F.unix_micros(F.col(f"`{c}`").cast("timestamp")) if K.kind_of(fields[c]) == K.TIME else F.col(f"`{c}`").cast("double") if K.kind_of(fields[c]) == K.BOOL else F.col(f"`{c}`") for c in own}
            measures = [f(value[c]).alias(f"{n}{i}") for i, c in enumerate(own) for n, f in (("lo", F.min), ("hi", F.max))]
            for r in rows.groupBy(ranges.file_key_column().alias("f")).agg(*(measures or [F.count(F.lit(1))])).collect():  # a row per file
                found[r["f"]] = {c: [_number(r[f"lo{i}"]), _number(r[f"hi{i}"])] for i, c in enumerate(own)} | {c: [None, None] for c in columns if c not in own}
        m.segments = [replace(s, stats={**s.stats, **found.get(ranges.file_key(s.path), {})}) for s in m.segments]
        self.catalog.replace(symbol, m)

    def drop_column_stats(self, symbol: str, columns: list[str] | None = None, as_of: Any = None) -> None:
        m = self.catalog.resolve(symbol, as_of)
        m.segments = [replace(s, stats={} if columns is None else {c: v for c, v in s.stats.items() if c not in columns}) for s in m.segments]
        self.catalog.replace(symbol, m)

    def read_column_stats(self, symbol: str, as_of: Any = None) -> pd.DataFrame:
        m = self.catalog.resolve(symbol, as_of)
        rows = [{"first_row": s.first_row, "end_row": s.first_row + s.rows, **{f"{n}({c})": v[i] for c, v in s.stats.items() for i, n in enumerate(("min", "max"))}} for s in m.segments]
        return pd.DataFrame(rows)

    def get_column_stats_info(self, symbol: str, as_of: Any = None) -> list[str]:
        m = self.catalog.resolve(symbol, as_of)
        return sorted({c for s in m.segments for c in s.stats})

    # diagnostics

    def sizes(self, symbol: str | None = None) -> dict[str, int]:
        """Bytes of data by symbol."""
        from urllib.parse import unquote

        out = {}
        for s in [safe(symbol)] if symbol else self.folder.names("symbols"):
            base = f"symbols/{s}/data"
            out[unquote(s)] = sum(n for d in self.folder.names(base) for f, n in self.folder.sizes(f"{base}/{d}").items() if f.endswith(".parquet"))
        return out

    def reload_symbol_list(self) -> list[str]:
        """Kept for callers: symbols are always listed from the files."""
        return self.list_symbols()

    def compact_symbol_list(self) -> int:
        """Kept for callers: there is no list to compact."""
        return 0


def replace_manifest(m: Manifest, **changes: Any) -> Manifest:
    return replace(m, **changes)


def _told(kinds: dict[str, K.Kind]) -> str:
    return ", ".join(f"{n} {k}" for n, k in kinds.items())


def _micros(value: Any) -> int:
    return int(pd.Timestamp(value).value // 1000)


def _number(value: Any) -> Any:
    """As JSON has it: whole numbers stay whole, whatever their size."""
    return int(value) if isinstance(value, Decimal) else value if value is None or isinstance(value, (int, float)) else float(value)
