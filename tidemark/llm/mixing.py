"""Mixing sources to target weights by weighted fair queueing.

Native: DataFrame functions only. Each source's documents are shuffled (by a hash of the id) and queued,
``epochs`` times over. A copy's virtual finish time is the source's cumulative tokens, this copy included,
divided by the source's weight. All copies in order of finish time, cut where the token budget is spent,
are the mix. A source that runs out after ``epochs`` rounds leaves its share to the others by weight.

Scale: cumulative sums go over three levels of hash buckets (source, bucket, bucket within it), so a
source with a third of all rows is spread over many tasks; what is known of a source goes along with the buckets'
sums, so documents are joined by bucket, never by source. The table of sources is one row per source and is
ordered in one task. The copies (sizes, no texts) are range-sorted by finish time once and written; from the sums
of the ranges follows the one that the budget ends in, and within it the last copy that the budget holds.

Defined results: a null text has no tokens; a null source is a source of its own, ordered last. Copies
with equal finish times go by source, epoch, hash and id. Documents without tokens take part with 0.
Rows that repeat an id queue one after the other. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import quoted, written

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
EPOCHS = 2
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Mix:
    """A planned mix: ``queue`` has a row per document, ``stream`` the documents as mixed.

    queue: __id, __size, __source_size, __target, __finish (virtual finish time of the first copy),
    __lap (virtual time of a whole epoch) and __copies (how many the mix takes), in no order.
    """

    queue: DataFrame
    carried: DataFrame
    columns: list[str]

    def stream(self) -> DataFrame:
        """The mixed documents with their own columns, repeats as repeated rows, range-sorted by finish time."""
        out = self.carried.filter("__copies > 0").withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
        out = out.withColumn("__at", _at(F.col("__epoch")))
        out = out.repartitionByRange("__at", "__hash").sortWithinPartitions("__at", "__rank", "__epoch", "__hash")
        return out.select(*(F.col(f"__column_{i}").alias(c) for i, c in enumerate(self.columns)))


def _at(epoch: Column) -> Column:
    """Virtual finish time of a copy."""
    return (epoch * F.col("__source_size") + F.col("__tokens")) / F.col("__weight")


def targets(sources: DataFrame, weights: tuple[float, ...], budget: float, epochs: int) -> DataFrame:
    """``__source, __source_size`` (a null source is the greatest name) with __rank, __weight and __target: water-filling of the budget.

    In order of the virtual time at which a source runs out, the level is the first at which the rest,
    by weight, spend what is left before the next source runs out.
    """
    out = sources.withColumn("__rank", F.row_number().over(Window.orderBy("__source")))
    out = out.withColumn("__weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("__rank") - 1) % len(weights) + 1))
    out = out.withColumn("__limit", F.lit(epochs) * F.col("__source_size")).withColumn("__ends", F.col("__limit") / F.col("__weight"))
    order = Window.orderBy("__ends", "__rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = out.withColumn("__spent", F.coalesce(F.sum("__limit").over(before), F.lit(0)))
    out = out.withColumn("__level", (F.lit(budget) * F.sum("__source_size").over(everything) - F.col("__spent")) / F.sum("__weight").over(after))
    # no source ends later than the level while an earlier row's level is still beyond its end
    out = out.withColumn("__level", F.min(F.when(F.col("__level") <= F.col("__ends"), F.struct("__ends", "__rank", "__level"))).over(everything)["__level"])
    full = F.col("__level").isNull() | (F.col("__ends") <= F.col("__level"))
    return out.withColumn("__target", F.when(full, F.col("__limit").cast("double")).otherwise(F.col("__weight") * F.col("__level")))


def _digits(first: int) -> Column:
    """Two of the hash's hexadecimal digits as a bucket number."""
    return F.conv(F.substring("__hash", first, 2), 16, 10).cast("int")


def _cut(queue: DataFrame, epochs: int, budget: float) -> tuple[float, int, int] | None:
    """Finish time, source rank and epoch of the last copy that the budget holds; None if it holds none.

    A global range sort of all copies, truncated at the budget: ranges before the one where it is spent are
    taken whole, those after it not at all.
    """
    copies = queue.filter("__size > 0").withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("__at", _at(F.col("__epoch")))
    copies = copies.select("__at", "__rank", "__epoch", "__size").repartitionByRange("__at", "__rank", "__epoch")
    copies = written(copies.withColumn("__range", F.spark_partition_id()), "mix-copies")
    order = F.struct("__at", "__rank", "__epoch")
    ranges = copies.groupBy("__range").agg(F.sum("__size").alias("__sum"), F.max(order).alias("__last")).orderBy("__range").collect()  # a row per range
    left, last = budget * sum(r["__sum"] for r in ranges) / epochs, None
    for r in ranges:
        if r["__sum"] > left:
            so_far = Window.orderBy("__at", "__rank", "__epoch").rowsBetween(Window.unboundedPreceding, 0)  # within one range
            within = copies.filter(F.col("__range") == r["__range"]).withColumn("__spent", F.sum("__size").over(so_far)).filter(F.col("__spent") <= left)
            found = within.agg(F.max(order)).first()[0]
            return tuple(found) if found else last
        left, last = left - r["__sum"], tuple(r["__last"])
    return last


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> Mix:
    """Plans the mix of ``docs``.

    weights: of the sources in order of name, repeating. budget: tokens of the mix as a share of all
    tokens. epochs: how often a document may be taken at most.
    """
    rows = docs.select(*(quoted(c).alias(f"__column_{i}") for i, c in enumerate(docs.columns)), quoted(id_col).alias("__id"), F.coalesce(F.concat(F.lit("s"), quoted(source_col).cast("string")), F.lit("t")).alias("__source"), word_count(quoted(text_col)).alias("__size"))
    rows = rows.withColumn("__hash", F.md5(F.concat_ws(" ", F.col("__id").cast("string"), F.col("__size").cast("string"))))
    light = written(rows.select("__id", "__source", "__size", "__hash"), "mix-sizes")
    sources = written(targets(light.groupBy("__source").agg(F.sum("__size").alias("__source_size")), weights, budget, epochs), "mix-sources")

    inner = light.groupBy("__source", _digits(1).alias("__b1"), _digits(3).alias("__b2")).agg(F.sum("__size").alias("__sum"))
    outer = inner.groupBy("__source", "__b1").agg(F.sum("__sum").alias("__sum"))
    earlier = Window.partitionBy("__source").orderBy("__b1").rowsBetween(Window.unboundedPreceding, -1)
    outer = outer.select(F.col("__source").alias("__s"), F.col("__b1").alias("__c1"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__outer"))
    earlier = Window.partitionBy("__source", "__b1").orderBy("__b2").rowsBetween(Window.unboundedPreceding, -1)
    inner = inner.withColumn("__inner", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)))
    starts = inner.join(outer, (F.col("__source") == F.col("__s")) & (F.col("__b1") == F.col("__c1")))
    about = sources.withColumnRenamed("__source", "__of").drop("__level", "__limit", "__ends", "__spent")
    starts = starts.join(about, F.col("__s") == F.col("__of"))  # a row per source and bucket
    starts = written(starts.select("__s", "__c1", F.col("__b2").alias("__c2"), (F.col("__outer") + F.col("__inner")).alias("__before"), *(c for c in about.columns if c != "__of")), "mix-starts")

    def queued(rows: DataFrame) -> DataFrame:
        so_far = Window.partitionBy("__source", "__b1", "__b2").orderBy("__hash", "__id", "__size").rowsBetween(Window.unboundedPreceding, 0)
        out = rows.withColumns({"__b1": _digits(1), "__b2": _digits(3)}).withColumn("__within", F.sum("__size").over(so_far))
        out = out.join(starts, (F.col("__source") == F.col("__s")) & (F.col("__b1") == F.col("__c1")) & (F.col("__b2") == F.col("__c2"))).drop("__s", "__c1", "__c2", "__b1", "__b2")
        out = out.withColumn("__tokens", F.col("__before") + F.col("__within")).drop("__before", "__within")
        return out.withColumns({"__finish": _at(F.lit(0)), "__lap": F.col("__source_size") / F.col("__weight")})

    queue = written(queued(light), "mix-queue")
    at, rank, epoch = _cut(queue, epochs, budget) or (-1.0, 0, 0)
    last = F.struct(F.lit(at).alias("a"), F.lit(rank).alias("b"), F.lit(epoch).alias("c"))
    taken = [(F.struct(_at(F.lit(e)).alias("a"), F.col("__rank").alias("b"), F.lit(e).alias("c")) <= last).cast("int") for e in range(epochs)]
    copies = sum(taken[1:], taken[0])
    return Mix(queue.withColumn("__copies", copies), queued(rows).withColumn("__copies", copies), docs.columns)


def mixed_sizes(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: id, size, source_size, target and taken (tokens that the mix takes, repeats counted)."""
    queue = plan(docs, id_col=id_col, **options).queue
    return queue.select(F.col("__id").alias(id_col), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))
