"""A PySpark-native engine for versioned, time-indexed DataFrames."""

from tidemark.functions.expressions import col, where
from tidemark.plans.query import Query, query_on
from tidemark.sources.library import DataError, JoinedItem, Library, LibraryOptions, Request, Store, VersionedItem, concat
from tidemark.sources.segments import register_normalizer

__all__ = ["DataError", "JoinedItem", "Library", "LibraryOptions", "Query", "Request", "Store", "VersionedItem", "col", "concat", "query_on", "register_normalizer", "where"]
