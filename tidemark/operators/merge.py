"""Merging source rows into a target by keys: update rows that match, insert those that don't, or both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import DuplicateKeyError, SchemaError, UserInputError

STRATEGIES = {("update", "do_nothing"), ("update", "insert"), ("do_nothing", "insert")}


def check_strategy(matched: str, not_matched: str) -> None:
    if (matched, not_matched) not in STRATEGIES:
        raise UserInputError(f"a merge either updates or inserts or both, not {matched}, {not_matched}")


def merge(target: DataFrame, source: DataFrame, on: list[str], matched: str = "update", not_matched: str = "do_nothing", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame | None]:
    """The target's rows, updated, and the rows to insert (or None).

    Missing values match each other. Two source rows that match one target row are an error; a source row may
    match many. keep: columns of the target alone, such as positions.
    """
    check_strategy(matched, not_matched)
    values = [c for c in target.columns if c not in keep]
    if sorted(values) != sorted(source.columns):
        raise SchemaError(f"columns of the source differ: {sorted(set(values) ^ set(source.columns))}")
    own = source.select(*(F.col(f"`{c}`").alias(f"__s_{c}") for c in source.columns)).withColumn("__found", F.lit(True))
    hit = [F.col(f"`{c}`").eqNullSafe(F.col(f"`__s_{c}`")) for c in on]
    condition = hit[0]
    for h in hit[1:]:
        condition &= h
    rows = target
    if matched == "update":
        twice = source.groupBy(*(F.col(f"`{c}`") for c in on)).count().filter("count > 1").drop("count")
        key = [F.col(f"t.`{c}`").eqNullSafe(F.col(f"d.`{c}`")) for c in on]
        both = key[0]
        for k in key[1:]:
            both &= k
        if not target.alias("t").join(twice.alias("d"), both, "left_semi").isEmpty():
            raise DuplicateKeyError(f"several source rows match one target row on {', '.join(on)}")
        joined = target.join(own, condition, "left")
        found = F.col("__found").isNotNull()
        rows = joined.select(*(F.when(found, F.col(f"`__s_{c}`").cast(target.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c, metadata=target.schema[c].metadata) if c in values and c not in on else F.col(f"`{c}`") for c in target.columns))
    added = None
    if not_matched == "insert":
        added = own.join(target.select(*(F.col(f"`{c}`") for c in on)), condition, "left_anti")
        added = added.select(*(F.col(f"`__s_{c}`").cast(target.schema[c].dataType).alias(c, metadata=target.schema[c].metadata) for c in values))
    return rows, added
