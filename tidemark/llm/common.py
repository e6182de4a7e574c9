"""What the operators share: the shared folder, written tables, safe names, joins with hot keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents handed to Python at a time; bounds a worker's memory where documents are long.
BATCH_ROWS = 512
#: Partitions whose light rows go to one file.
FILES = 16
#: A group is hot if it holds at least one in HOT of the rows of all groups, so there are at most HOT.
HOT = 1000

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session without that setting gets a folder of its own, removed at exit.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/tidemark/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, codec: str = "snappy", light: bool = False) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    Spark knows its size from the files, so a join broadcasts it only under the session's threshold.
    light: few rows for the work that the session's partitions are meant for; FILES partitions share a file.
    """
    if light:
        df = df.coalesce(max(6, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // FILES))
    path = new_path(df.sparkSession, what)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class bounded_batches:
    """Lowers the session's Arrow batch length to ``rows``; it is never raised.

    As a context it is what it was afterwards. Where the result is lazy and runs Python, it stays lowered: the result
    will need it.
    """

    KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def __init__(self, spark: SparkSession, rows: int = BATCH_ROWS):
        self.spark, self.before = spark, spark.conf.get(self.KEY)
        if not 0 < int(self.before) <= rows:
            spark.conf.set(self.KEY, str(rows))

    def __enter__(self) -> bounded_batches:
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.conf.set(self.KEY, self.before)


def spread_out(df: DataFrame, *keys: str) -> DataFrame:
    """Repartitions rows that each stand for much work: adaptive execution, which sees few bytes, leaves them apart."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that clash with none of ``df`` (nor, by case, with each other)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def hot_groups(groups: DataFrame, size: str, least: int = 1000) -> Column:
    """True for a group with at least one in HOT of the rows of all ``groups``: at most HOT groups."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    return F.col(size) >= max(least, total / HOT)


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: Column, merge: bool = False) -> DataFrame:
    """Left join of ``rows`` with ``groups`` (one row per key) on ``key``, where few keys may hold most rows.

    At most HOT hot groups are broadcast. Their rows go through the other join under ``spread``,
    which is even and equals no key, so no task gets a hot group. merge: the other join shuffles both sides
    even if one is small now, for the same plan at every size.
    """
    values = [c for c in groups.columns if c != key]
    hot = hot_groups(groups, size)
    few = groups.filter(hot).select(F.col(key), *(F.col(c).alias(f"__hot_{c}") for c in values))
    many = groups.filter(~hot).select(F.col(key).alias("__cold_key"), *(F.col(c).alias(f"__cold_{c}") for c in values))
    is_hot = F.col(f"__hot_{size}").isNotNull()
    out = rows.join(F.broadcast(few), key, "left").withColumn("__dealt", F.when(is_hot, spread).otherwise(F.col(key)))
    out = out.join(many.hint("merge") if merge else many, F.col("__dealt") == F.col("__cold_key"), "left")
    for c in values:
        out = out.withColumn(c, F.when(is_hot, F.col(f"__hot_{c}")).otherwise(F.col(f"__cold_{c}")))
    return out.drop("__dealt", "__cold_key", *(f"__{t}_{c}" for c in values for t in ("hot", "cold")))
