"""A query per operator over the driver's tables, and the same in SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expressions import where
from tidemark.plans.query import Frame, Query, concat_frames, query_on
from tidemark.sources.files import own_folder
from tidemark.sources.library import Library, LibraryOptions, Request, Store, concat
from tidemark.streaming.ingest import staging_sink

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def simple(name: str, source: str, build: Callable[[Query], Query], sql: str, columns: list[str] | None = None, index: str | None = None, order: list[str] | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """A query over one table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        out = query_on(prepare(df) if prepare else df, build(Query()), index, order)
        return out.select(*columns) if columns else out

    register(name, sql)(run)


# filters


def _nulled(df: DataFrame) -> DataFrame:
    return df.withColumn("event_type", F.expr("nullif(event_type, 'click')")).withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))


NULLED = "(SELECT event_id, ts, user_id, nullif(event_type, 'click') AS event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)"
LINE = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice"]
L = ", ".join(LINE)
EV = ["event_id", "ts", "event_type", "value"]
E = ", ".join(EV)

simple("filter_compare", "lineitem", lambda q: q[(q["l_quantity"] > 10) & (q["l_quantity"] <= 30) & (q["l_discount"] >= 0.05) & (q["l_tax"] < 0.06)], f"SELECT {L} FROM lineitem WHERE l_quantity > 10 AND l_quantity <= 30 AND l_discount >= 0.05 AND l_tax < 0.06", LINE)
simple("filter_arithmetic", "lineitem", lambda q: q[(q["l_quantity"] * q["l_extendedprice"]) / 5 < 70000], f"SELECT {L} FROM lineitem WHERE (l_quantity * l_extendedprice) / 5 < 70000", LINE)
simple("filter_equal", "lineitem", lambda q: q[q["l_returnflag"] == "R"], f"SELECT {L} FROM lineitem WHERE l_returnflag = 'R'", LINE)
simple("filter_column_column", "lineitem", lambda q: q[q["l_discount"] > q["l_tax"]], f"SELECT {L} FROM lineitem WHERE l_discount > l_tax", LINE)
simple("filter_or", "orders", lambda q: q[(q["o_orderstatus"] == "F") | (q["o_totalprice"] > 200000)], "SELECT * FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 200000")
simple("filter_xor", "lineitem", lambda q: q[(q["l_quantity"] > 25) ^ (q["l_returnflag"] == "A")], f"SELECT {L} FROM lineitem WHERE (l_quantity > 25) <> (l_returnflag = 'A')", LINE)
simple("filter_not", "events", lambda q: q[~(q["value"] < 50)], f"SELECT {E} FROM {NULLED} WHERE (value < 50) IS NOT TRUE", EV, prepare=_nulled)
simple("filter_not_equal_missing", "events", lambda q: q[q["event_type"] != "view"], f"SELECT {E} FROM {NULLED} WHERE (event_type = 'view') IS NOT TRUE", EV, prepare=_nulled)
simple("filter_isin", "orders", lambda q: q[q["o_orderpriority"].isin(["1-URGENT", "2-HIGH"])], "SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
simple("filter_isin_numbers", "lineitem", lambda q: q[q["l_linenumber"] == [1, 3, 5000000000]], f"SELECT {L} FROM lineitem WHERE l_linenumber IN (1, 3)", LINE)
simple("filter_isnotin_missing", "events", lambda q: q[q["event_type"].isnotin("view", "purchase")], f"SELECT {E} FROM {NULLED} WHERE (event_type IN ('view', 'purchase')) IS NOT TRUE", EV, prepare=_nulled)
simple("filter_empty_set", "nation", lambda q: q[q["n_nationkey"].isnotin([])], "SELECT * FROM nation")
simple("filter_empty_isin", "nation", lambda q: q[q["n_nationkey"].isin([])], "SELECT * FROM nation WHERE false")
simple("filter_isnull", "events", lambda q: q[q["value"].isnull()], f"SELECT {E} FROM {NULLED} WHERE value IS NULL", EV, prepare=_nulled)
simple("filter_notnull", "events", lambda q: q[q["event_type"].notnull()], f"SELECT {E} FROM {NULLED} WHERE event_type IS NOT NULL", EV, prepare=_nulled)
simple("filter_regex", "part", lambda q: q[q["p_type"].regex_match("^[EPL].*(Y|GE)$|TAND")], "SELECT * FROM part WHERE regexp_matches(p_type, '^[EPL].*(Y|GE)$|TAND')")
simple("filter_not_regex", "events", lambda q: q[~q["event_type"].regex_match("^p")], f"SELECT {E} FROM {NULLED} WHERE regexp_matches(event_type, '^p') IS NOT TRUE", EV, prepare=_nulled)
simple("filter_time", "orders", lambda q: q[(q["o_orderdate"] >= dt.datetime(1995, 1, 1)) & (q["o_orderdate"] < dt.datetime(1996, 1, 1))], "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
simple("filter_time_span", "lineitem", lambda q: q[(q["l_shipdate"] - q["l_shipdate"]) < dt.timedelta(days=1)], f"SELECT {L} FROM lineitem WHERE l_shipdate - l_shipdate < INTERVAL 1 DAY", LINE)
simple("filter_choice", "lineitem", lambda q: q[where(q["l_returnflag"] == "A", q["l_quantity"] > 40, q["l_quantity"] < 5)], f"SELECT {L} FROM lineitem WHERE CASE WHEN l_returnflag = 'A' THEN l_quantity > 40 ELSE l_quantity < 5 END", LINE)
simple("filter_boolean_column", "orders", lambda q: q.apply("big", where(q["o_totalprice"] > 100000, True, False)).filter(q["big"]), "SELECT *, true AS big FROM orders WHERE o_totalprice > 100000")
simple("filter_twice", "lineitem", lambda q: q[q["l_quantity"] > 10][q["l_tax"] < 0.03], f"SELECT {L} FROM lineitem WHERE l_quantity > 10 AND l_tax < 0.03", LINE)

# projections

simple("project_arithmetic", "lineitem", lambda q: q.apply("a", q["l_extendedprice"] * (1 - q["l_discount"])).apply("b", q["a"] * (q["l_tax"] + 1)), f"SELECT {L}, l_extendedprice * (1 - l_discount) AS a, (l_extendedprice * (1 - l_discount)) * (l_tax + 1) AS b FROM lineitem", [*LINE, "a", "b"])
simple("project_integers", "lineitem", lambda q: q.apply("a", q["l_linenumber"] + q["l_linenumber"]).apply("b", q["l_partkey"] * 3).apply("c", q["l_partkey"] - q["l_suppkey"]), f"SELECT {L}, l_linenumber::BIGINT + l_linenumber AS a, l_partkey * 3 AS b, l_partkey - l_suppkey AS c FROM lineitem", [*LINE, "a", "b", "c"])
simple("project_divide", "lineitem", lambda q: q.apply("d", q["l_partkey"] / (q["l_linenumber"] - 3)), f"SELECT {L}, CASE WHEN l_linenumber = 3 THEN CASE WHEN l_partkey > 0 THEN 'inf'::DOUBLE END ELSE l_partkey::DOUBLE / (l_linenumber - 3)::DOUBLE END AS d FROM lineitem", [*LINE, "d"])
simple("project_abs_neg", "customer", lambda q: q.apply("a", abs(q["c_acctbal"])).apply("n", -q["c_acctbal"]).apply("k", -q["c_nationkey"]), "SELECT *, abs(c_acctbal) AS a, -c_acctbal AS n, -(c_nationkey::BIGINT) AS k FROM customer")
simple("project_power", "part", lambda q: q.apply("p", q["p_size"] ** np.uint8(2)).apply("f", q["p_size"] ** 2), "SELECT *, p_size::BIGINT * p_size AS p, (p_size::DOUBLE * p_size) AS f FROM part")
simple("project_literal", "region", lambda q: q.apply("one", 1).apply("name", "x").apply("half", 0.5), "SELECT *, 1::BIGINT AS one, 'x' AS name, 0.5::DOUBLE AS half FROM region")
simple("project_choice", "orders", lambda q: q.apply("c", where(q["o_orderstatus"] == "O", q["o_totalprice"], 0)), "SELECT *, CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END AS c FROM orders")
simple("project_missing", "events", lambda q: q.apply("v", q["value"] * 2).apply("w", where(q["value"] > 50, "high", "low")), f"SELECT {E}, value * 2 AS v, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS w FROM {NULLED}", [*EV, "v", "w"], prepare=_nulled)

# groups

for _op, _sql in (("sum", "round(sum(l_extendedprice), 2)"), ("mean", "round(avg(l_extendedprice), 4)"), ("min", "min(l_extendedprice)"), ("max", "max(l_extendedprice)"), ("count", "count(l_extendedprice)")):

    def _group(spark: SparkSession, sf_dir: str, op: str = _op) -> DataFrame:
        q = Query()
        out = query_on(table(spark, sf_dir, "lineitem"), q.groupby("l_suppkey").agg({"x": ("l_extendedprice", op)}))
        digits = {"sum": 2, "mean": 4}.get(op)
        return out.withColumn("x", F.round("x", digits)) if digits else out

    register(f"groupby_{_op}", f"SELECT l_suppkey, {_sql} AS x FROM lineitem GROUP BY l_suppkey")(_group)

simple("groupby_named", "lineitem", lambda q: q.groupby("l_returnflag").agg({"n": ("l_quantity", "count"), "least": ("l_quantity", "MIN"), "most": ("l_quantity", "max"), "lines": ("l_linenumber", "sum")}), "SELECT l_returnflag, count(l_quantity) AS n, min(l_quantity) AS least, max(l_quantity) AS most, sum(l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY 1")
simple("groupby_missing_key", "events", lambda q: q.groupby("event_type").agg({"n": ("event_id", "count"), "m": ("value", "count")}), f"SELECT event_type, count(event_id) AS n, count(value) AS m FROM {NULLED} WHERE event_type IS NOT NULL GROUP BY 1", prepare=_nulled)
simple("groupby_all_missing", "events", lambda q: q.groupby("event_type").agg({"s": ("v", "sum"), "m": ("v", "max"), "n": ("v", "count")}), "SELECT event_type, 0.0::DOUBLE AS s, NULL::DOUBLE AS m, 0::BIGINT AS n FROM events GROUP BY 1", prepare=lambda df: df.withColumn("v", F.lit(None).cast("double")))
simple("groupby_boolean_sum", "orders", lambda q: q.apply("b", where(q["o_totalprice"] > 100000, True, False)).groupby("o_orderpriority").agg({"n": ("b", "sum"), "share": ("b", "max")}), "SELECT o_orderpriority, count(*) FILTER (WHERE o_totalprice > 100000) AS n, bool_or(o_totalprice > 100000) AS share FROM orders GROUP BY 1")
simple("groupby_time", "orders", lambda q: q.groupby("o_orderstatus").agg({"first": ("o_orderdate", "min"), "last": ("o_orderdate", "max"), "mean": ("o_orderdate", "mean")}), "SELECT o_orderstatus, min(o_orderdate) AS first, max(o_orderdate) AS last, make_timestamp((sum(epoch_us(o_orderdate)) // count(*))::BIGINT) AS mean FROM orders GROUP BY 1")
simple("groupby_then_filter", "orders", lambda q: q.groupby("o_custkey").agg({"n": ("o_orderkey", "count")}).filter(q["n"] > 12), "SELECT o_custkey, count(o_orderkey) AS n FROM orders GROUP BY 1 HAVING count(o_orderkey) > 12")
simple("pipeline_filter_project_group", "lineitem", lambda q: q[q["l_quantity"] > 20].apply("net", q["l_extendedprice"] * (1 - q["l_discount"])).groupby("l_returnflag").agg({"net": "max", "l_orderkey": "count"}), "SELECT l_returnflag, max(l_extendedprice * (1 - l_discount)) AS net, count(l_orderkey) AS l_orderkey FROM lineitem WHERE l_quantity > 20 GROUP BY 1")

# resampling

AGGS = {"n": ("value", "count"), "lo": ("value", "min"), "hi": ("value", "max"), "first": ("event_type", "first"), "last": ("value", "last"), "ids": ("event_id", "sum")}
AGG_SQL = "count(value) AS n, min(value) AS lo, max(value) AS hi, arg_min(event_type, ts) FILTER (WHERE event_type IS NOT NULL) AS first, arg_max(value, ts) FILTER (WHERE value IS NOT NULL) AS last, sum(event_id)::BIGINT AS ids"


def _resampled(name: str, rule: str, bucket: str, **options) -> None:
    simple(f"resample_{name}", "events", lambda q: q.resample(rule, **options).agg(AGGS), f"WITH e AS (SELECT *, epoch_us(ts) AS t, min(epoch_us(ts)) OVER () AS t0, max(epoch_us(ts)) OVER () AS t1 FROM {NULLED}) SELECT make_timestamp(({bucket})::BIGINT) AS ts, {AGG_SQL} FROM e GROUP BY {bucket}", index="ts", order=["ts", "event_id"], prepare=_nulled)


H, D_US = 3600 * 10**6, 86400 * 10**6
_resampled("left", "1h30min", f"t - t % {H * 3 // 2}")
_resampled("right", "2h", f"(t - 1) - (t - 1) % {2 * H} + {2 * H}", closed="right", label="right")
_resampled("right_closed_left_label", "2h", f"(t - 1) - (t - 1) % {2 * H}", closed="right", label="left")
_resampled("left_right_label", "45min", f"t - t % {H * 3 // 4} + {H * 3 // 4}", label="right")
_resampled("offset", "1D", f"(t - {6 * H}) - (t - {6 * H}) % {D_US} + {6 * H}", offset="6h")
_resampled("origin_start", "5h", f"t0 + (t - t0) - (t - t0) % {5 * H}", origin="start")
_resampled("origin_start_day", "7h", f"t - (t - (t0 - t0 % {D_US})) % {7 * H}", origin="start_day")
_resampled("origin_time", "11h", f"t - (t - epoch_us(TIMESTAMP '2023-12-31 01:00:00')) % {11 * H}", origin="2023-12-31 01:00:00")
_resampled("origin_end", "7h", f"t1 - ((t1 - t) // {7 * H}) * {7 * H}", origin="end")
_resampled("origin_end_day", "7h", f"(t1 - t1 % {D_US} + {D_US}) - (((t1 - t1 % {D_US} + {D_US}) - t) // {7 * H}) * {7 * H}", origin="end_day")
_resampled("sparse", "1min", f"t - t % {60 * 10**6}")
simple("resample_mean", "events", lambda q: q.resample("6h").agg({"m": ("user_id", "mean"), "t": ("ts", "mean"), "s": ("user_id", "sum")}), f"SELECT make_timestamp((epoch_us(ts) - epoch_us(ts) % {6 * H})::BIGINT) AS ts, avg(user_id) AS m, make_timestamp((sum(epoch_us(ts)) // count(*))::BIGINT) AS t, sum(user_id)::BIGINT AS s FROM events GROUP BY epoch_us(events.ts) - epoch_us(events.ts) % {6 * H}", index="ts", order=["ts", "event_id"])
simple("resample_after_filter", "events", lambda q: q.date_range((dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20)))[q["event_type"] == "purchase"].resample("1D").agg({"n": ("event_id", "count"), "hi": ("value", "max")}), f"SELECT make_timestamp((epoch_us(ts) - epoch_us(ts) % {D_US})::BIGINT) AS ts, count(event_id) AS n, max(value) AS hi FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND event_type = 'purchase' GROUP BY epoch_us(events.ts) - epoch_us(events.ts) % {D_US}", index="ts", order=["ts", "event_id"])

# positions and ranges of time

ORDERED = {"index": "ts", "order": ["ts", "event_id"]}
simple("head", "events", lambda q: q.head(20), "SELECT * FROM events ORDER BY ts, event_id LIMIT 20", **ORDERED)
simple("head_negative", "events", lambda q: q.head(-9000), "SELECT * FROM events ORDER BY ts, event_id LIMIT (SELECT greatest(count(*) - 9000, 0) FROM events)", **ORDERED)
simple("tail", "events", lambda q: q.tail(20), "SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 20", **ORDERED)
simple("tail_negative", "events", lambda q: q.tail(-50), "SELECT * FROM events ORDER BY ts, event_id OFFSET 50", **ORDERED)
simple("row_range", "events", lambda q: q.row_range((100, 150)), "SELECT * FROM events ORDER BY ts, event_id LIMIT 50 OFFSET 100", **ORDERED)
simple("row_range_negative", "events", lambda q: q.row_range((-30, -10)), "SELECT * FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 10)", **ORDERED)
simple("row_range_open", "events", lambda q: q.row_range((500, None)), "SELECT * FROM events ORDER BY ts, event_id OFFSET 500", **ORDERED)
simple("filter_then_head", "events", lambda q: q[q["value"] > 50].head(10), "SELECT * FROM events WHERE value > 50 ORDER BY ts, event_id LIMIT 10", **ORDERED)
simple("date_range", "events", lambda q: q.date_range((dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 12))), "SELECT * FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'", **ORDERED)
simple("date_range_open", "events", lambda q: q.date_range((None, dt.datetime(2024, 1, 3))), "SELECT * FROM events WHERE ts <= TIMESTAMP '2024-01-03'", **ORDERED)
simple("then_prepend", "events", lambda q: Query().head(1000).then(q[q["value"] > 50]).prepend(Query().date_range((dt.datetime(2024, 1, 2), None))), "SELECT * FROM (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-02' ORDER BY ts, event_id LIMIT 1000) WHERE value > 50", **ORDERED)

# concatenation


def _parties(spark: SparkSession, sf_dir: str) -> list[Frame]:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("nation"), F.col("s_acctbal").cast("float").alias("balance"))
    return [Frame(c, None, ("key",)), Frame(s, None, ("key",))]


@register("concat_outer", "SELECT c_custkey AS key, c_name AS name, c_nationkey::BIGINT AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal::FLOAT, NULL FROM supplier")
def concat_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concat_frames(_parties(spark, sf_dir), "outer").visible()


@register("concat_inner", "SELECT c_custkey AS key, c_name AS name, c_nationkey::BIGINT AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal::FLOAT FROM supplier")
def concat_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concat_frames(_parties(spark, sf_dir), "inner").visible()


@register("concat_then_groupby", "WITH p AS (SELECT c_nationkey AS nation, c_custkey AS key FROM customer UNION ALL SELECT s_nationkey, s_suppkey FROM supplier) SELECT nation::BIGINT AS nation, count(key) AS n FROM p GROUP BY 1")
def concat_then_groupby(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query().concat("inner").groupby("nation").agg({"n": ("key", "count")})
    return q.run_many(_parties(spark, sf_dir)).visible()


@register("concat_then_head", "SELECT key, name FROM (SELECT c_custkey AS key, c_name AS name, 0 AS s FROM customer UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier ORDER BY s, key LIMIT 1510)")
def concat_then_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Query().concat("outer").head(1510).run_many(_parties(spark, sf_dir)).visible().select("key", "name")


# the store


def _library(spark: SparkSession, **options) -> Library:
    """A library for one query, in the shared folder if one is named."""
    return Store(spark, own_folder(spark, "tidemark-query-")).create_library("lib", LibraryOptions(rows_per_segment=2000, **options))


def _days(spark: SparkSession, sf_dir: str, first: int, last: int) -> DataFrame:
    """Events of some days of January 2024, in order of time."""
    return table(spark, sf_dir, "events").filter(F.dayofmonth("ts").between(first, last))


def _between(spark: SparkSession, sf_dir: str, first: int | None, last: int | None) -> DataFrame:
    """Events from the start of a day of January 2024 to the end of another, in order of time; None: without that end."""
    df = table(spark, sf_dir, "events")
    df = df if first is None else df.filter(F.col("ts") >= F.lit(dt.date(2024, 1, first)))
    return df if last is None else df.filter(F.col("ts") < F.lit(dt.date(2024, 1, last + 1)))


def _history(spark: SparkSession, sf_dir: str, verbs: int = 4) -> Library:
    """Events to day 10 written, all later ones appended, day 5 updated with every other row, days 8-9 deleted: the first of these verbs."""
    lib = _library(spark)
    lib.write("e", _between(spark, sf_dir, None, 10), {"step": "write"}, index="ts")
    lib.append("e", _between(spark, sf_dir, 11, None), {"step": "append"})
    if verbs == 2:
        return lib
    lib.update("e", _days(spark, sf_dir, 5, 5).withColumn("value", F.col("value") + 1000).filter("event_id % 2 = 0"), date_range=(dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 5, 23, 59, 59, 999999)))
    if verbs == 3:
        return lib
    lib.delete_data_in_range("e", (dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 9, 23, 59, 59, 999999)))
    return lib


DAY = "extract(day FROM ts)"


@register("store_append", "SELECT * FROM events")
def store_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir, 2).read("e", as_of=1).data


UPDATED = f"SELECT event_id, ts, user_id, event_type, CASE WHEN {DAY} = 5 THEN value + 1000 ELSE value END AS value, props FROM events WHERE ({DAY} <> 5 OR event_id % 2 = 0)"


@register("store_update", UPDATED)
def store_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir, 3).read("e", as_of=2).data


@register("store_delete_range", f"{UPDATED} AND {DAY} NOT IN (8, 9)")
def store_delete_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).read("e").data


@register("store_as_of", "SELECT event_id, value FROM events")
def store_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).read("e", as_of=-3, columns=["event_id", "value"]).data.select("event_id", "value")


@register("store_snapshot", "SELECT * FROM events")
def store_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = _history(spark, sf_dir, 2)
    lib.snapshot("then", versions={"e": 1})
    lib.delete("e")
    return lib.read("e", as_of="then").data


@register("store_compact", "SELECT * FROM events")
def store_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = _library(spark)
    for first, last in ((None, 4), (5, 8), (9, 12), (13, 16), (17, 20), (21, None)):
        lib.append("e", _between(spark, sf_dir, first, last), index="ts")
    lib.compact_data("e", 100000)
    return lib.read("e").data


@register("store_row_range", "SELECT * FROM events ORDER BY ts, event_id OFFSET 500")
def store_row_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir, 2).read("e", as_of=1, row_range=(500, None)).data


@register("store_head_tail", "SELECT * FROM (SELECT * FROM events ORDER BY ts, event_id LIMIT 7) UNION ALL SELECT * FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 9)")
def store_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = _history(spark, sf_dir, 2)
    return lib.head("e", 7, as_of=1).data.unionByName(lib.tail("e", 9, as_of=1).data)


@register("store_query", "SELECT event_type, count(event_id) AS n, max(value) AS hi FROM events WHERE value > 20 GROUP BY 1")
def store_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib, q = _history(spark, sf_dir, 2), Query()
    lib.create_column_stats("e", ["value"], as_of=1)
    q = q[q["value"] > 20].groupby("event_type").agg({"n": ("event_id", "count"), "hi": ("value", "max")})
    return lib.read("e", as_of=1, query=q).data


@register("store_date_range", f"SELECT * FROM events WHERE {DAY} BETWEEN 3 AND 12")
def store_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir, 2).read("e", as_of=1, date_range=(dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 12, 23, 59, 59, 999999))).data


@register("store_merge_update", f"SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 3 = 0 AND {DAY} BETWEEN 2 AND 4 THEN -value ELSE value END AS value, props FROM events")
def store_merge_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = _library(spark)
    lib.write("e", table(spark, sf_dir, "events"), index="ts")
    lib.merge("e", _days(spark, sf_dir, 2, 4).filter("event_id % 3 = 0").withColumn("value", -F.col("value")), ("update", "do_nothing"), on=["event_id"])
    return lib.read("e").data


def _merged(spark: SparkSession, sf_dir: str, strategy: tuple[str, str]) -> DataFrame:
    """Day 4 merged, its values negated, into events that lack every fifth of that day."""
    lib = _library(spark)
    lib.write("e", table(spark, sf_dir, "events").filter("event_id % 5 <> 0 or dayofmonth(ts) <> 4"), index="ts")
    lib.merge("e", _days(spark, sf_dir, 4, 4).withColumn("value", -F.col("value")), strategy, on=["event_id"])
    return lib.read("e").data


@register("store_merge_insert", f"SELECT event_id, ts, user_id, event_type, CASE WHEN {DAY} = 4 THEN -value ELSE value END AS value, props FROM events")
def store_merge_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, ("update", "insert"))


@register("store_merge_only_insert", f"SELECT event_id, ts, user_id, event_type, CASE WHEN {DAY} = 4 AND event_id % 5 = 0 THEN -value ELSE value END AS value, props FROM events")
def store_merge_only_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, ("do_nothing", "insert"))


@register("store_dynamic_schema", f"SELECT event_id::DOUBLE AS event_id, ts, value, CASE WHEN {DAY} > 10 THEN event_type END AS event_type, CASE WHEN {DAY} <= 10 THEN user_id END AS user_id FROM events")
def store_dynamic_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = _library(spark, dynamic_schema=True)
    lib.write("e", _between(spark, sf_dir, None, 10).select("event_id", "ts", "value", "user_id"), index="ts")
    lib.append("e", _between(spark, sf_dir, 11, None).select(F.col("event_id").cast("double").alias("event_id"), "ts", "value", "event_type"), index="ts")
    return lib.read("e").data


@register("store_stage_finalize", "SELECT * FROM events")
def store_stage_finalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = _library(spark)
    lib.write("e", _between(spark, sf_dir, None, 3), index="ts")
    for first, last in ((10, 12), (13, None), (4, 6), (7, 9)):
        lib.stage("e", _between(spark, sf_dir, first, last), index="ts")
    lib.finalize_staged_data("e", "append")
    return lib.read("e").data


@register("store_read_staged", f"SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def store_read_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib, q = _library(spark), Query()
    lib.write("e", _between(spark, sf_dir, None, 10), index="ts")
    lib.stage("e", _between(spark, sf_dir, 21, None), index="ts")
    lib.stage("e", _between(spark, sf_dir, 11, 20), index="ts")
    return lib.read("e", staged=True, query=q.groupby("event_type").agg({"n": ("event_id", "count"), "ids": ("event_id", "sum")})).data


@register("store_sort_finalize", "SELECT * FROM events")
def store_sort_finalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = _library(spark)
    for rest in (2, 0, 1):
        lib.stage("e", table(spark, sf_dir, "events").filter(f"event_id % 3 = {rest}"), index="ts", sort_on_index=True)
    lib.sort_and_finalize_staged_data("e")
    return lib.read("e").data


@register("store_batch_join", f"WITH e AS (SELECT *, epoch_us(ts) AS t FROM events) SELECT make_timestamp((t - t % {D_US})::BIGINT) AS ts, count(event_id) AS n, arg_min(event_type, t) AS f FROM e GROUP BY t - t % {D_US}")
def store_batch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = _library(spark)
    parts = {"s1": (None, 4), "s5": (5, 8), "s9": (9, 12), "s13": (13, None)}
    lib.write_batch({s: _between(spark, sf_dir, *days) for s, days in parts.items()}, index="ts")
    lazy = concat(lib.read_batch(list(parts), lazy=True))
    return lazy.resample("1D").agg({"n": ("event_id", "count"), "f": ("event_type", "first")}).collect().data


@register("store_read_modify_write", "SELECT event_id, ts, value * 2 AS twice FROM events WHERE event_type = 'view'")
def store_read_modify_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib, q = _library(spark), Query()
    lib.write("e", table(spark, sf_dir, "events"), index="ts")
    lib.read_modify_write("e", q[q["event_type"] == "view"].apply("twice", q["value"] * 2), "f")
    return lib.read("f", columns=["event_id", "twice"]).data.select("event_id", "ts", "twice")


@register("store_restore", f"SELECT * FROM events WHERE {DAY} <= 10")
def store_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 0, before anything was appended, is the newest one again; it is all that is left."""
    lib = _history(spark, sf_dir)
    lib.restore_version("e", 0)
    lib.prune_previous_versions("e")
    return lib.read("e").data


@register("store_partitioned", "SELECT * FROM events")
def store_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = _library(spark)
    made = lib.write_partitioned("e", table(spark, sf_dir, "events"), "event_type", index="ts")
    parts = [lib.read(f"e/{v}").data.withColumn("event_type", F.lit(v)) for v in made]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@register("store_single_file", "SELECT * FROM events")
def store_single_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = _library(spark)
    lib.write("e", table(spark, sf_dir, "events"), index="ts")
    lib.export_file("e", lib.folder.full("exported"))
    lib.import_file("f", lib.folder.full("exported"))
    return lib.read("f").data


@register("pickled_objects", "SELECT r_regionkey, r_name FROM region")
def pickled_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = _library(spark)
    lib.write_pickle("r", [tuple(r) for r in table(spark, sf_dir, "region").select("r_regionkey", "r_name").collect()])
    return spark.createDataFrame(lib.read("r").data, "r_regionkey int, r_name string")


@register("store_versions", "SELECT * FROM (VALUES (3::BIGINT, 'append', false), (2, 'append', false), (1, 'append', true), (0, 'write', false)) AS v(version, step, deleted)")
def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and metadata of all versions: one deleted but held by a snapshot, a later one of new metadata, one restored."""
    lib = _history(spark, sf_dir, 2)
    lib.snapshot("held", versions={"e": 1})
    lib.write_metadata("e", {"step": "append", "when": dt.datetime(2024, 2, 1)})
    lib.delete("e", 1)
    lib.restore_version_batch({"e": 2})
    rows = [(v, lib.read_metadata("e", v).metadata["step"], info.deleted) for (_, v), info in lib.list_versions("e").items()]
    return spark.createDataFrame(rows, "version long, step string, deleted boolean")


@register("store_description", "SELECT 'ts' AS name, 'time' AS kind, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events UNION ALL SELECT name, kind, count(*), min(ts), max(ts) FROM events, (VALUES ('event_id', 'int64'), ('user_id', 'int64'), ('event_type', 'str'), ('value', 'float64'), ('props', 'str')) AS c(name, kind) GROUP BY 1, 2")
def store_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _history(spark, sf_dir, 2).get_description("e", as_of=1)
    first, last = (t.tz_localize(None).to_pydatetime() for t in d.date_range)
    return spark.createDataFrame([(name, kind, d.rows, first, last) for name, kind in d.columns], "name string, kind string, n long, first timestamp_ntz, last timestamp_ntz")


@register("store_dedup", "SELECT * FROM events")
def store_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written twice: the second version has the first one's files."""
    lib = _library(spark, dedup=True)
    for _ in range(2):
        lib.write("e", table(spark, sf_dir, "events"), index="ts")
    if [s.path for s in lib.catalog.load("e", 0).segments] != [s.path for s in lib.catalog.load("e", 1).segments]:
        raise AssertionError("segments were written anew")
    return lib.read("e").data


@register("stream_staging", "SELECT * FROM events")
def stream_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = _library(spark)
    source = lib.folder.full("incoming")
    for first, last in ((None, 10), (11, 20), (21, None)):
        _between(spark, sf_dir, first, last).write.mode("append").parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 2).parquet(source)
    staging_sink(stream, lib, "e", lib.folder.full("progress"), index="ts").trigger(availableNow=True).start().awaitTermination()
    lib.sort_and_finalize_staged_data("e")
    return lib.read("e").data


simple("float_filter", "lineitem", lambda q: q[(q["d"] >= 0.05) & (q["d"] < 0.08)], f"SELECT l_orderkey, l_discount::FLOAT AS d FROM lineitem WHERE l_discount::FLOAT::DOUBLE >= 0.05::DOUBLE AND l_discount::FLOAT::DOUBLE < 0.08::DOUBLE", ["l_orderkey", "d"], prepare=lambda df: df.select("l_orderkey", F.col("l_discount").cast("float").alias("d")))
simple("float_promotion", "lineitem", lambda q: q.apply("e", q["d"] + q["d"]).apply("f", q["d"] * q["l_quantity"]), "SELECT l_discount::FLOAT AS d, l_quantity, l_discount::FLOAT + l_discount::FLOAT AS e, l_discount::FLOAT::DOUBLE * l_quantity AS f FROM lineitem", ["d", "l_quantity", "e", "f"], prepare=lambda df: df.select(F.col("l_discount").cast("float").alias("d"), "l_quantity"))
simple("project_power_column", "lineitem", lambda q: q.apply("p", q["l_linenumber"] ** q["u"]).apply("c", q["l_linenumber"] ** np.uint8(20)), "SELECT l_linenumber, (l_linenumber % 4 + 17)::SMALLINT AS u, CASE l_linenumber % 4 WHEN 0 THEN pow17 WHEN 1 THEN pow17 * l_linenumber WHEN 2 THEN pow17 * l_linenumber * l_linenumber ELSE pow17 * l_linenumber * l_linenumber * l_linenumber END::BIGINT AS p, (pow17 * l_linenumber * l_linenumber * l_linenumber)::BIGINT AS c FROM (SELECT l_linenumber, list_reduce(list_transform(range(17), lambda i: l_linenumber::HUGEINT), lambda a, b: a * b) AS pow17 FROM lineitem)", ["l_linenumber", "u", "p", "c"], prepare=lambda df: df.select("l_linenumber", (F.col("l_linenumber") % 4 + 17).cast("short").alias("u", metadata={"logical_type": "uint8"})))


FLAGSHIP = "resample_after_filter"
