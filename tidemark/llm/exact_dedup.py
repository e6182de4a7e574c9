"""Exact dedup: group by 128-bit content hash, compare bytes inside groups, keep one row of each group.

Native: DataFrame functions only. Rows are grouped by MD5; a first pass keeps only hashes with several
rows, a second groups those rows by hash and bytes and so finds hashes that different texts share
(collisions), a third gives each row its verdict. Before the second pass a bitmap of fixed size sieves out
nearly all rows whose hash does not repeat, so few other texts are shuffled.

Defined results: a null text equals the empty text. The row with the largest id stays; a null id is the
smallest. Rows with the same id and text are one document and share the verdict; ``deduplicate`` keeps
exactly one row of each group, of such rows too. An empty table gives an empty result. Other columns are
left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import attach, fresh, hot_groups, quoted, written


#: 64-bit words of the bitmap of repeated hashes; its broadcast is as large whatever the data.
SIEVE_WORDS = 1 << 18


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def sieved(rows: DataFrame, groups: DataFrame, inside: bool = True) -> DataFrame:
    """The rows whose hash may be one of ``groups`` (among them all whose hash is one), or else the other rows."""

    def place(df: DataFrame) -> DataFrame:
        return df.withColumn("__word", F.expr(f"pmod(xxhash64(__hash), {SIEVE_WORDS})")).withColumn("__bit", F.expr("cast(shiftrightunsigned(xxhash64(__hash), 40) & 63 as int)"))

    words = place(groups.select("__hash")).groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__bits"))
    out = place(rows).join(F.broadcast(words), "__word", "left")
    bit = F.expr("coalesce(shiftrightunsigned(__bits, __bit) & 1, 0)")
    return out.filter(bit == F.lit(int(inside))).drop("__word", "__bit", "__bits")


def in_groups(rows: DataFrame, groups: DataFrame, spread: Column) -> DataFrame:
    """Left join of ``rows`` with ``groups`` (``__hash, __size, ...``); rows that the sieve leaves out aren't shuffled."""
    values = [F.lit(None).cast(groups.schema[c].dataType).alias(c) for c in groups.columns if c != "__hash"]
    alone = sieved(rows, groups, inside=False).select(*rows.columns, *values)
    return attach(sieved(rows, groups), groups, "__hash", "__size", spread).select(*alone.columns).unionByName(alone)


def row_name(row_id: Column, text: Column) -> Column:
    """256 bits that name an id and a text together; rows share it if both are equal, a null id with a null id."""
    own = F.sha2(F.coalesce(F.concat(F.lit("="), row_id.cast("string")), F.lit("")), 256)
    return F.unhex(F.sha2(F.encode(F.concat(own, F.coalesce(text, F.lit(""))), "UTF-8"), 256))


def without(rows: DataFrame, gone: DataFrame, hash_of: Column) -> DataFrame:
    """The rows whose ``hash_of`` is not in ``gone`` (``__hash, __size``); neither rows that the sieve leaves out nor those of hot groups are shuffled."""
    keyed = rows.withColumn("__hash", hash_of)
    hot = gone.filter(hot_groups(gone, "__size")).select("__hash")
    some = sieved(keyed, gone).join(F.broadcast(hot), "__hash", "left_anti").join(gone, "__hash", "left_anti")
    return sieved(keyed, gone, inside=False).unionByName(some).select(*rows.columns)


def one_of_each(rows: DataFrame, repeated: DataFrame, hash_of: Column) -> DataFrame:
    """The rows, but one only of those that share a ``hash_of`` of ``repeated`` (``__hash, __size``): the first by all its columns."""
    row = F.struct(*(quoted(c) for c in rows.columns))
    some = sieved(rows.withColumn("__hash", hash_of), repeated)
    ones = some.groupBy("__hash").agg(F.min_by(row, F.to_json(row)).alias("__row")).join(repeated, "__hash", "left_semi")
    return without(rows, repeated, hash_of).unionByName(ones.select("__row.*"))


def verdicts(docs: DataFrame, columns: list[Column], id_col: str = "doc_id", text_col: str = "text", hash_of=content_hash) -> DataFrame:
    """``columns`` of each row, then ``__keep`` (id that stays), ``__size`` (rows of the group), ``__id``.

    ``hash_of`` gives a text's binary content hash (other ones are for tests of collisions).
    """
    text = F.coalesce(quoted(text_col), F.lit(""))
    keyed = docs.select(quoted(id_col).alias("__id"), text.alias("__text")).withColumn("__hash", hash_of(F.col("__text")))
    groups = keyed.groupBy("__hash").agg(F.max("__id").alias("__keep"), F.count(F.lit(1)).alias("__size"))
    groups = written(groups.filter("__size > 1"), "dedup-groups")

    def spread(row_id: Column) -> Column:
        return F.encode(F.concat(F.lit("row "), F.coalesce(F.sha2(row_id.cast("string"), 256), F.lit(""))), "UTF-8")

    members = attach(sieved(keyed, groups), groups.select("__hash", "__size"), "__hash", "__size", spread(F.col("__id"))).filter("__size is not null")
    texts = members.groupBy("__hash", "__text").agg(F.max("__id").alias("__keep"), F.count(F.lit(1)).alias("__size"))
    shared = written(texts.groupBy("__hash").count().filter("count > 1").select("__hash"), "dedup-collisions")

    rows = docs.select(*columns, quoted(id_col).alias("__id"), text.alias("__text")).withColumn("__hash", hash_of(F.col("__text")))
    if shared.isEmpty():
        out = in_groups(rows.drop("__text"), groups, spread(F.col("__id")))
    else:  # texts that share a hash are grouped by their bytes
        apart = written(texts.join(shared, "__hash", "left_semi"), "dedup-apart").withColumnsRenamed({"__keep": "__own_keep", "__size": "__own_size"})
        out = in_groups(rows.join(apart, ["__hash", "__text"], "left").drop("__text"), groups, spread(F.col("__id")))
        apart_row = F.col("__own_size").isNotNull()
        out = out.withColumn("__keep", F.when(apart_row, F.col("__own_keep")).otherwise(F.col("__keep")))
        out = out.withColumn("__size", F.coalesce("__own_size", "__size")).drop("__own_keep", "__own_size")
    single = F.col("__size").isNull()
    out = out.withColumn("__keep", F.when(single, F.col("__id")).otherwise(F.col("__keep")))
    return out.withColumn("__size", F.coalesce("__size", F.lit(1).cast("long"))).drop("__hash")


def groups_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    sha = F.sha2(F.encode(F.coalesce(quoted(text_col), F.lit("")), "UTF-8"), 256)
    out = verdicts(docs, [sha.alias("text_sha256")], id_col, text_col)
    kept = F.col("__id").eqNullSafe(F.col("__keep"))
    return out.select(F.col("__id").alias(id_col), F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"), kept.alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, with the columns of ``docs``; of rows that share id and text the first by all columns."""
    names = fresh(docs, *(f"__column_{i}" for i in range(len(docs.columns))))
    repeated = docs.select(row_name(quoted(id_col), quoted(text_col)).alias("__hash")).groupBy("__hash").agg(F.count(F.lit(1)).alias("__size"))
    repeated = written(repeated.filter("__size > 1"), "dedup-repeated", light=True)
    out = verdicts(docs, [quoted(c).alias(n) for c, n in zip(docs.columns, names, strict=True)], id_col, text_col)
    out = out.filter(F.col("__id").eqNullSafe(F.col("__keep"))).select(*names)
    if not repeated.isEmpty():
        out = one_of_each(out, repeated, row_name(*(F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))))
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))
