"""Near-duplicate documents by min-max hashing of word shingles, banding and confirmed links.

A document's set is that of its distinct word shingles. Each of PERMUTATIONS hash functions gives two
components of its signature, the minimum and the maximum, so 2 * PERMUTATIONS components cost half as
many evaluations. BANDS bands of ROWS components each find candidates. A minimum and a maximum match together
with a chance of i(i - 1) / (u(u - 1)) for i of u shingles in common, so at a similarity of 0.8 a pair is missed
with (1 - (i(i - 1) / (u(u - 1)))**(ROWS / 2))**BANDS: 8.5e-6 for 4 of 5, 1.8e-6 for 8 of 10, below 1e-6 from 16
of 20 on. Every link is confirmed on full sets.

Documents with equal sets are one node. Within a band's bucket each node is compared with a centre, which
links large groups without making all their pairs. Nodes of buckets that then still hold several
components are joined on shingles of their prefixes, rare ones first: only pairs in different components that
share one can be similar, and are compared. So no link between components is lost.

Defined results: a null text is empty; documents without words have the empty set, which is linked with
nothing. With fewer words than a shingle the whole sequence is the one shingle. Null ids are never a
component's id unless it has no other. Rows that repeat an id are taken each for itself. An empty table
gives an empty result. Of a component ``deduplicate`` keeps exactly one row, whatever ids are null or repeat:
one with the component's id, among these the least by a hash of id and text, then by all columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import attach, bounded_batches, fresh, hot_groups, quoted, spread_out, written
from tidemark.llm.exact_dedup import one_of_each, row_name, sieved, without
from tidemark.llm.graph import components
from tidemark.llm.words import constants, mix, shingles, slices, words

SHINGLE = 5
SIMILARITY = 0.8
PERMUTATIONS = 144
ROWS = 6
BANDS = 2 * PERMUTATIONS // ROWS
#: Bytes of a band's hash; bands that share one by chance cost a comparison.
BAND_BYTES = 6
#: Frequent shingles that are looked for before pairs are compared one by one, at most.
FREQUENT = 1 << 16
#: Rows that a much-linked node, or a shingle that many sets have, keeps together; with more it is dealt over parts, at most PARTS.
SHARE = 1 << 13
PARTS = 32


def sets(texts: pa.Array, length: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted hashes."""
    runs, first = shingles(*words(texts), length)
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        own = np.sort(runs[a:b])
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if b - a > 1 else own)
    return out


def set_key(own: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


class Signer:
    def __init__(self) -> None:
        self.low, self.high = (constants(PERMUTATIONS, s).astype(np.uint32)[:, None] | np.uint32(1) for s in (101, 202))
        self.factor, self.salt = constants(ROWS, 303), constants(BANDS, 404)

    def bands(self, own: np.ndarray) -> bytes:
        """A hash of BAND_BYTES for each band of a non-empty set's signature."""
        low, high = own.astype(np.uint32), (own >> np.uint64(32)).astype(np.uint32)
        least, most = None, None
        for at in range(0, len(own), 2048):
            values = low[at : at + 2048] * self.low + high[at : at + 2048] * self.high
            a, b = values.min(axis=1), values.max(axis=1)
            least, most = (a, b) if least is None else (np.minimum(least, a), np.maximum(most, b))
        signature = np.stack([least, most], axis=1).reshape(BANDS, ROWS).astype(np.uint64)
        hashes = mix((signature * self.factor).sum(axis=1, dtype=np.uint64) + self.salt)
        return hashes.astype("<u8").view(np.uint8).reshape(BANDS, 8)[:, :BAND_BYTES].tobytes()


def _signed(docs: DataFrame, length: int) -> DataFrame:
    """``__id, __n, __key, __bands`` of documents ``__id, __text``, and ``__name`` if they have it."""
    names = [c for c in docs.columns if c == "__name"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer()
        for batch in batches:
            for part in slices(batch, "__text"):
                own = sets(part["__text"], length)
                keys, n = [set_key(s) if len(s) else None for s in own], [len(s) for s in own]
                bands = [signer.bands(s) if len(s) else None for s in own]
                yield pa.RecordBatch.from_arrays([part["__id"], pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.binary()), *(part[c] for c in names)], ["__id", "__n", "__key", "__bands", *names])

    kind = docs.schema["__id"].dataType
    schema = T.StructType([T.StructField("__id", kind), T.StructField("__n", T.LongType()), T.StructField("__key", T.BinaryType()), T.StructField("__bands", T.BinaryType()), *(T.StructField(c, T.BinaryType()) for c in names)])
    return docs.select("__id", "__text", *names).mapInArrow(run, schema)


def _buckets(nodes: DataFrame) -> DataFrame:
    """``__hash`` (a band's) and ``__key, __n`` of each node and band."""
    band = F.expr(f"explode(transform(sequence(0, {BANDS - 1}), i -> substring(__bands, {BAND_BYTES} * i + 1, {BAND_BYTES})))")
    return nodes.select(band.alias("__hash"), "__key", "__n")


def _stored_sets(docs: DataFrame, nodes: DataFrame, length: int) -> DataFrame:
    """``__key, __set`` of the nodes ``__key, __rep``, whose texts are read again: more than once where ids repeat."""
    wanted = nodes.select(F.xxhash64("__rep").alias("__hash")).distinct()
    near = sieved(docs.select("__id", "__text").withColumn("__hash", F.xxhash64("__id")), wanted)
    near = near.join(wanted.hint("merge"), "__hash", "left_semi").select("__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text", 1 << 20):
                own = [s for s in sets(part["__text"], length) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in own], pa.binary()), pa.array([s.tobytes() for s in own], pa.binary())], ["__key", "__set"])

    return written(near.mapInArrow(run, "__key binary, __set binary"), "near-sets")


def _needed(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """The stored sets but those that are surely not of ``keys`` (a column of keys)."""
    wanted = keys.toDF("__hash").distinct()
    return sieved(stored.withColumn("__hash", F.col("__key")), wanted).select("__key", "__set")


def _parts() -> Column:
    """Number of parts for ``__load`` rows: one copy of the other side for SHARE of them."""
    return F.least(F.lit(PARTS), F.ceil(F.col("__load") / SHARE)).cast("int")


def _hot(rows: DataFrame, key: str) -> DataFrame:
    """``__hot, __parts``: the keys that hold many of the rows, at most HOT, with more than one part."""
    loads = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__load"))
    return loads.filter(hot_groups(loads, "__load") & (_parts() > 1)).select(F.col(key).alias("__hot"), _parts().alias("__parts"))


def _salted(rows: DataFrame, hot: DataFrame, key: str, by: str, part: str) -> DataFrame:
    """The rows with a number of a part: 0, but for hot keys one of theirs by a hash of ``by``."""
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    return out.withColumn(part, F.expr(f"coalesce(cast(pmod(xxhash64({by}), __parts) as int), 0)")).drop("__hot", "__parts")


def _copied(rows: DataFrame, hot: DataFrame, key: str, part: str) -> DataFrame:
    """The rows with the number of a part: once with 0, but for hot keys once with each of theirs."""
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    return out.withColumn(part, F.explode(F.expr("sequence(0, coalesce(__parts, 1) - 1)"))).drop("__hot", "__parts")


def _confirmed(pairs: DataFrame, stored: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` of nodes whose sets are similar: 100 * intersection >= percent * union."""
    dealt, sides = pairs, {}
    for side, other in (("a", "b"), ("b", "a")):  # the pairs of a much-linked node are dealt over parts, each with a copy of its set
        hot = _hot(pairs, side)
        dealt = _salted(dealt, hot, side, other, f"__part_{side}")
        sides[side] = _copied(_needed(stored, pairs.select(side)).select(F.col("__key").alias(side), F.col("__set").alias(f"__{side}")), hot, side, f"__part_{side}")
    both = dealt.join(sides["a"].hint("merge"), ["a", "__part_a"]).join(sides["b"].hint("merge"), ["b", "__part_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch["__a"], batch["__b"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = np.searchsorted(y, x, "right") - np.searchsorted(y, x, "left")
                same = int(shared.sum())
                good.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(good)), batch["b"].filter(pa.array(good))], ["a", "b"])

    return both.select("a", "b", "__a", "__b").mapInArrow(run, "a binary, b binary")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``__root`` of each row's ``__key``, itself if it has no link."""
    out = rows.join(roots.select(F.col("node").alias("__key"), "root"), "__key", "left")
    return out.withColumn("__root", F.coalesce("root", "__key")).drop("root")


def _sharing_prefix(nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of nodes ``__key, __root, __n, __set`` in different components that may be similar.

    Let all shingles be in one order. Similar sets of n and m shingles share at least
    least = ceil(percent * (n + m) / (100 + percent)) of them, so one that is among the first n - least + 1 of the
    one set and the first m - least + 1 of the other. Shingles known to be frequent come last, so that sets
    which have a common passage, but are not similar, share none there. Any order gives all similar pairs;
    the frequent shingles that are looked for only save work.
    """

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in batch["__set"]]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found[n > 1].view(np.int64)), pa.array(n[n > 1])], ["shingle", "n"])

    counts = nodes.select("__set").mapInArrow(often, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    counts = counts.orderBy(F.desc("n"), "shingle").limit(FREQUENT).toPandas()
    order = np.argsort(counts["shingle"].to_numpy(np.int64).view(np.uint64))
    frequent, often_n = counts["shingle"].to_numpy(np.int64).view(np.uint64)[order], counts["n"].to_numpy(np.int64)[order]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, counts, places = [], [], []
            for x in batch["__set"]:
                own = np.frombuffer(x.as_buffer(), np.uint64)
                first = len(own) - -(-percent * len(own) // 100) + 1
                known = np.zeros(len(own), np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
                    known = np.where(frequent[at] == own, often_n[at], 0)
                out.append(own[np.lexsort((own, known))[:first]])
                counts.append(first)
                places.append(np.arange(first))
            row = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            shingle = pa.array(np.concatenate([np.zeros(0, np.uint64), *out]).view(np.int64))
            place = pa.array(np.concatenate([np.zeros(0, np.int64), *places]))
            yield pa.RecordBatch.from_arrays([shingle, place, *(batch[c].take(row) for c in ("__key", "__root", "__n"))], ["shingle", "__place", "__key", "__root", "__n"])

    rows = nodes.select("__key", "__root", "__n", "__set").mapInArrow(prefixes, "shingle long, __place long, __key binary, __root binary, __n long")
    rows = written(rows.withColumn("__hash", F.col("shingle")).drop("shingle"), "near-prefixes")
    shared = rows.groupBy("__hash").agg(F.min("__root").alias("__r1"), F.max("__root").alias("__r2"), F.count(F.lit(1)).alias("__load"))
    shared = written(shared.filter("__r1 <> __r2").select("__hash", _parts().alias("__parts")), "near-shared", light=True)
    rows = written(sieved(rows, shared).join(shared, "__hash"), "near-sharing", light=True)
    # a passage that many documents share: its pairs are compared by several tasks
    other = rows.withColumn("__part", F.explode(F.expr("sequence(0, __parts - 1)"))).select("__part", "__hash", F.col("__key").alias("b"), F.col("__root").alias("__other"), F.col("__n").alias("__m"), F.col("__place").alias("__at"))
    least = f"cast(ceil({percent} * (__n + __m) / {100 + percent}) as long)"
    fit = F.expr(f"__key < b and __root <> __other and __place <= __n - {least} and __at <= __m - {least} and least(__n - __place, __m - __at) >= {least}")
    pairs = rows.withColumn("__part", F.expr("cast(pmod(xxhash64(__key), __parts) as int)")).join(other, ["__hash", "__part"]).filter(fit)
    return pairs.select(F.col("__key").alias("a"), "b").distinct()


def _owned(docs: DataFrame, length: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Documents as signed, and the nodes ``__key, __rep, __size`` with the ``__root`` of their component."""
    with bounded_batches(docs.sparkSession, 128):  # a row may hold two long documents' sets
        return _owners(docs, length, round(100 * similarity))


def _owners(docs: DataFrame, length: int, percent: int) -> tuple[DataFrame, DataFrame]:
    signed = written(_signed(docs, length), "near-signed")
    nodes = signed.filter("__n > 0").groupBy("__key").agg(F.min("__id").alias("__rep"), F.first("__n").alias("__n"), F.first("__bands").alias("__bands"), F.count(F.lit(1)).alias("__size"))
    nodes = written(spread_out(nodes, "__key"), "near-nodes")
    buckets = _buckets(nodes)
    full = written(buckets.groupBy("__hash").agg(F.count(F.lit(1)).alias("__load")).filter("__load > 1"), "near-buckets")
    spread = F.concat(F.encode(F.lit("row "), "UTF-8"), F.col("__key"))
    members = attach(sieved(buckets, full), full, "__hash", "__load", spread, merge=True).filter("__load is not null").select("__hash", "__key", "__n", "__load")
    members = written(members, "near-members")
    stored = _stored_sets(docs, nodes.join(members.select("__key").distinct(), "__key", "left_semi"), length)

    # each node with its bucket's centre
    # the one that shares most buckets with most others: of edited copies, the one that was edited least
    weights = members.groupBy("__key").agg(F.sum("__load").alias("__weight"))
    mixed = members.join(weights.hint("merge"), "__key").groupBy("__hash").agg(F.max("__load").alias("__load"), F.max(F.struct("__weight", "__key", "__n")).alias("__c"))
    mixed = written(mixed.select("__hash", "__load", F.col("__c.__key").alias("__centre"), F.col("__c.__n").alias("__m")), "near-centres", light=True)
    pairs = attach(members.drop("__load"), mixed, "__hash", "__load", spread, merge=True).filter("__key <> __centre")
    pairs = pairs.filter(F.least("__n", "__m") * 100 >= F.greatest("__n", "__m") * percent)
    pairs = written(pairs.select(F.col("__key").alias("a"), F.col("__centre").alias("b")).distinct(), "near-pairs")
    links = written(_confirmed(pairs, stored, percent), "near-links")
    roots = components(links)
    # what lies in one bucket but in several components
    rooted = written(_rooted(members.drop("__load"), roots), "near-rooted")
    mixed = rooted.groupBy("__hash").agg(F.min("__root").alias("__r1"), F.max("__root").alias("__r2"), F.count(F.lit(1)).alias("__load"))
    mixed = written(mixed.filter("__r1 <> __r2 and __load > 2").select("__hash", "__load"), "near-mixed", light=True)  # of two, the pair was compared
    left = attach(sieved(rooted, mixed), mixed, "__hash", "__load", spread).filter("__load is not null")
    left = written(left.select("__key", "__root", "__n").distinct(), "near-left", light=True)
    left = written(left.join(_needed(stored, left.select("__key")).hint("merge"), "__key"), "near-left-sets")
    pairs = written(_sharing_prefix(left, percent), "near-more-pairs", light=True)
    more = written(_confirmed(pairs, stored, percent), "near-more-links")
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))

    return signed, _rooted(nodes.select("__key", "__rep", "__size"), roots)


def linked(docs: DataFrame, length: int, similarity: float) -> DataFrame:
    """``__id, __n, __component`` of documents ``__id, __text``."""
    signed, owned = _owned(docs, length, similarity)
    least = owned.groupBy("__root").agg(F.min("__rep").alias("__component"), F.sum("__size").alias("__all")).filter("__all > 1")
    named = owned.join(least, "__root").select("__key", "__size", "__component")
    named = written(named.select("__key", "__size", "__component"), "near-named", light=True)
    spread = F.encode(F.concat(F.lit("row "), F.sha2(F.concat_ws(" ", "__id", F.hex("__key")), 256)), "UTF-8")
    out = attach(signed.drop("__bands"), named, "__key", "__size", spread, merge=True)
    return out.select("__id", "__n", F.when(F.col("__size").isNull(), F.col("__id")).otherwise(F.col("__component")).alias("__component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: id, n_shingles, component_id and kept."""
    rows = docs.select(quoted(id_col).alias("__id"), quoted(text_col).alias("__text"))
    out = linked(rows, length, similarity)
    return out.select(F.col("__id").alias(id_col), F.col("__n").alias("n_shingles"), F.col("__component").alias("component_id"), F.col("__id").eqNullSafe(F.col("__component")).alias("kept"))


def _dropped(docs: DataFrame, length: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Of documents ``__id, __text, __name``: the names (``__hash, __size``) of which no row stays, and those of which one of several stays.

    Rows that share a name are one from the start, so none of this depends on how often a row repeats.
    """
    signed, owned = _owned(docs, length, similarity)
    several = owned.groupBy("__root").agg(F.sum("__size").alias("__all")).filter("__all > 1").select("__root")
    named = written(owned.join(several, "__root").select("__key", "__root", "__size"), "near-named", light=True)
    rows = sieved(signed.filter("__n > 0").withColumn("__hash", F.col("__key")), named.select(F.col("__key").alias("__hash")))
    rows = rows.groupBy("__name").agg(F.first("__id").alias("__id"), F.first("__key").alias("__key"), F.count(F.lit(1)).alias("__copies"))
    spread = F.concat(F.encode(F.lit("row "), "UTF-8"), F.col("__name"))
    rows = attach(rows, named, "__key", "__size", spread, merge=True).filter("__root is not null")
    rows = written(rows.select("__name", "__id", "__root", "__copies"), "near-rows", light=True)
    best = rows.groupBy("__root").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__name")).alias("__best"))
    best = written(best.select(F.col("__best.__name").alias("__hash")), "near-best", light=True)
    rows = rows.select(F.col("__name").alias("__hash"), F.col("__copies").alias("__size"))
    gone = written(rows.join(best, "__hash", "left_anti"), "near-dropped", light=True)
    return gone, written(rows.filter("__size > 1").join(best, "__hash", "left_semi"), "near-repeated", light=True)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group, with the smallest id, and all other rows, with the columns of ``docs``."""
    names = fresh(docs, *(f"__column_{i}" for i in range(len(docs.columns))))
    name = row_name(quoted(id_col), quoted(text_col))
    gone, repeated = _dropped(docs.select(quoted(id_col).alias("__id"), quoted(text_col).alias("__text"), name.alias("__name")), length, similarity)
    held = docs.select(*(quoted(c).alias(n) for c, n in zip(docs.columns, names, strict=True)))
    name = row_name(*(F.col(names[docs.columns.index(c)]) for c in (id_col, text_col)))
    held = without(held, gone, name)
    if not repeated.isEmpty():
        held = one_of_each(held, repeated, name)
    return held.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))
