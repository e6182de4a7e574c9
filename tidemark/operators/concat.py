"""Concatenation: the rows of several frames one after the other, with their columns joined outer or inner."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import SchemaError, UserInputError
from tidemark.functions import types as K
from tidemark.functions.types import NULL, TIME, Kind


def joined_kinds(kinds: list[dict[str, Kind]], join: str) -> dict[str, Kind]:
    """Names and types of the result: all columns in order of appearance, or those that all inputs have."""
    if join not in ("outer", "inner"):
        raise UserInputError("join is outer or inner")
    names = list(dict.fromkeys(n for own in kinds for n in own))
    if join == "inner":
        names = [n for n in names if all(n in own for own in kinds)]
    out = {}
    for name in names:
        found = [own[name] for own in kinds if name in own]
        kind: Kind | None = found[0]
        for k in found[1:]:
            kind = K.common(kind, k) if kind is not None else None
        if kind is None:
            raise SchemaError(f"column {name}: no common type of {', '.join(map(str, found))}")
        out[name] = kind
    return out


def aligned(df: DataFrame, kinds: dict[str, Kind]) -> DataFrame:
    """The columns and types asked for; those that are not there are missing values."""
    own = {f.name: f for f in df.schema.fields}
    out = []
    for name, kind in kinds.items():
        c = F.col("`" + name.replace("`", "``") + "`") if name in own else F.lit(None)
        if kind == TIME and name in own:  # with or without a zone, as it is
            out.append(c)
        elif kind == NULL:
            out.append(c.alias(name))
        else:
            out.append(K.tagged(K.to_kind(c, kind), name, kind))
    return df.select(*out)


def concat(frames: list[DataFrame], join: str = "outer", source: str | None = None) -> DataFrame:
    """All rows; source: name of a column for the number of the input."""
    if not frames:
        raise UserInputError("nothing to concatenate")
    kinds = joined_kinds([K.kinds_of(f) for f in frames], join)
    rows = [aligned(f, kinds) for f in frames]
    if source:
        rows = [r.withColumn(source, F.lit(i)) for i, r in enumerate(rows)]
    return reduce(DataFrame.unionByName, rows)
