"""Types, expressions and clauses, against rules and pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark import Query, query_on, where
from tidemark.errors import SchemaError, UserInputError
from tidemark.functions import types as K
from tidemark.functions.expressions import col, literal
from tidemark.operators.concat import concat
from tidemark.operators.resample import Resample, micros
from tidemark.plans.query import Frame, concat_frames


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(1, 1.0, "a", True), (2, None, "b", False), (3, float("nan"), None, None), (4, -2.5, "ab", True), (5, 0.0, "a", False)]
    return spark.createDataFrame(rows, "i int, x double, s string, b boolean").cache()


def ids(df):
    return sorted(r["i"] for r in df.collect())


Q = Query()


@pytest.mark.parametrize(
    ("condition", "want"),
    [
        (Q["x"] > 0, [1]),
        (~(Q["x"] > 0), [2, 3, 4, 5]),
        (Q["x"] != 1.0, [2, 3, 4, 5]),
        (~(Q["x"] != 1.0), [1]),
        (Q["s"] == "a", [1, 5]),
        (Q["s"] != "a", [2, 3, 4]),
        (Q["s"].isin("a", "b"), [1, 2, 5]),
        (Q["s"].isnotin(["a", "b"]), [3, 4]),
        (Q["s"] == ["a"], [1, 5]),
        (Q["s"].isin([]), []),
        (Q["x"].isnotin([]), [1, 2, 3, 4, 5]),
        (Q["x"].isnull(), [2, 3]),
        (Q["s"].notna(), [1, 2, 4, 5]),
        (Q["s"].regex_match("^a"), [1, 4, 5]),
        (~Q["s"].regex_match("^a"), [2, 3]),
        (Q["b"], [1, 4]),
        (~Q["b"], [2, 3, 5]),
        ((Q["x"] > 0) ^ (Q["b"]), [4]),
        ((Q["x"] > 0) | (Q["s"] == "b"), [1, 2]),
        ((Q["x"] > 0) & True, [1]),
        (where(Q["x"] > 0, Q["b"], Q["s"] == "b"), [1, 2]),
        (Q["x"] == Q["x"], [1, 4, 5]),
        (Q["x"] != Q["x"], [2, 3]),
        (Q["i"] == 3000000000, []),
        (Q["i"].isin([1, 3000000000]), [1]),
        (Q["i"] < 2.5, [1, 2]),
    ],
)
def test_two_valued_filters(frame, condition, want):
    assert ids(query_on(frame, Q[condition])) == want


@pytest.mark.parametrize("build", [lambda: Q["s"] > "a", lambda: Q["s"] == 1, lambda: Q["b"] == 1, lambda: Q["i"].regex_match("a"), lambda: Q["x"].isin("a"), lambda: Q["x"] + Q["s"] > 1, lambda: Q["nowhere"] == 1, lambda: Q["i"]])
def test_types_must_fit(frame, build):
    with pytest.raises(SchemaError):
        query_on(frame, Q[build()])


@pytest.mark.parametrize("build", [lambda: literal(float("inf")), lambda: col("x") and col("s"), lambda: Q["x"].isin([True]), lambda: Q["x"].isin([1, 2.5]), lambda: Q["x"].isin(["a", 1]), lambda: Q["s"].regex_match("("), lambda: Q.filter(True), lambda: Q.agg({"a": "sum"}), lambda: Q.groupby("a").agg({"b": "first"}), lambda: Q.resample("1fortnight"), lambda: Q.head(1).concat(), lambda: where(True, [1], 2)])
def test_bad_queries(build):
    with pytest.raises(UserInputError):
        build()


def test_pushdown(spark, tmp_path):
    spark.range(10).selectExpr("id", "cast(id as double) v").write.parquet(str(tmp_path / "t"))
    df = query_on(spark.read.parquet(str(tmp_path / "t")), Q[(Q["id"] > 3) & (Q["id"] != 5)])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,3)" in plan


@pytest.mark.parametrize(
    ("op", "left", "right", "want"),
    [("+", "int32", "int32", "int64"), ("*", "uint8", "uint8", "uint16"), ("-", "uint8", "uint8", "int16"), ("+", "uint32", "int8", "int64"), ("/", "int8", "int8", "float64"), ("+", "float32", "float32", "float32"), ("+", "float32", "int8", "float64"), ("**", "uint8", "uint8", "uint64"), ("**", "int8", "uint8", "int64"), ("**", "int8", "int8", "float64"), ("-", "time", "time", "int64")],
)
def test_arithmetic_types(op, left, right, want):
    named = {str(k): k for k in (*K.INTS.values(), *K.UINTS.values(), K.F32, K.F64, K.TIME)}
    assert str(K.arithmetic(op, named[left], named[right])) == want


@pytest.mark.parametrize(("left", "right", "want"), [("uint32", "int32", "int64"), ("uint64", "int8", None), ("int16", "float32", "float32"), ("int32", "float32", "float64"), ("uint8", "uint16", "uint16"), ("bool", "int8", None), ("time", "int64", None), ("str", "str", "str"), ("null", "time", "time")])
def test_common_types(left, right, want):
    named = {str(k): k for k in (*K.INTS.values(), *K.UINTS.values(), K.F32, K.F64, K.TIME, K.BOOL, K.STRING, K.NULL)}
    found = K.exact_common(named[left], named[right])
    assert (str(found) if found else None) == want


def test_projection(frame):
    out = query_on(frame, Q.apply("d", Q["i"] / Q["x"]).apply("t", where(Q["b"], Q["i"], -1)).apply("p", Q["i"] ** np.uint8(3)))
    rows = {r["i"]: r for r in out.collect()}
    assert rows[5]["d"] == float("inf") and rows[2]["d"] is None and rows[4]["p"] == 64 and rows[3]["t"] == -1
    zero = query_on(frame, Q.apply("z", (Q["x"] * 0) / (Q["x"] * 0)))
    assert all(r["z"] is None for r in zero.collect())


def test_setitem_equality_and_copy():
    import copy
    import pickle

    q = Query()
    q["y"] = q["x"] + 1
    assert q == Query().apply("y", col("x") + 1) and q != Query() and copy.deepcopy(q) == q and pickle.loads(pickle.dumps(q)) == q


def test_overflow_is_an_error(spark):
    df = spark.createDataFrame([(2**62,)], "i long")
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        query_on(df, Q.apply("j", Q["i"] * 4)).collect()


def test_groupby_skips_missing(frame):
    out = {r["s"]: (r["x"], r["n"], r["b"]) for r in query_on(frame, Q.groupby("s").agg({"x": "sum", "n": ("x", "count"), "b": "sum"})).collect()}
    assert out == {"a": (1.0, 2, 1), "b": (0.0, 0, 0), "ab": (-2.5, 1, 1)}


def test_groupby_types(spark):
    df = spark.createDataFrame([(1, 1, 2)], "k int, a byte, u long")
    df = df.select("k", "a", F.col("u").alias("u", metadata={K.KEY: "uint32"}))
    out = query_on(df, Q.groupby("k").agg({"a": "sum", "u": "sum", "m": ("u", "max")}))
    assert {n: str(k) for n, k in K.kinds_of(out).items()} == {"k": "int32", "a": "int64", "u": "uint64", "m": "uint32"}
    with pytest.raises(SchemaError):
        query_on(df.withColumn("t", F.current_timestamp()), Q.groupby("k").agg({"t": "sum"}))


def test_micros():
    assert micros("1h30min") == 5400 * 10**6 and micros("500ms") == 500000
    with pytest.raises(UserInputError):
        micros("1W")


RULES = st.sampled_from(["7min", "1h", "90min", "1D", "13s"])
TIMES = st.lists(st.integers(0, 4 * 86400), min_size=1, max_size=30)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rule=RULES, closed=st.sampled_from(["left", "right"]), label=st.sampled_from(["left", "right"]), origin=st.sampled_from(["epoch", "start", "start_day", "end", "end_day", "2023-12-30 05:07:11"]), offset=st.sampled_from([None, "3min", "5h"]), seconds=TIMES)
def test_resample_like_pandas(spark, rule, closed, label, origin, offset, seconds):
    if origin in ("end", "end_day") and offset:
        offset = None
    stamps = sorted(pd.Timestamp("2024-01-01 03:04:05") + pd.Timedelta(seconds=s) for s in seconds)
    data = pd.DataFrame({"v": range(len(stamps))}, index=pd.DatetimeIndex(stamps, name="t"))
    own = origin if origin in ("epoch", "start", "start_day", "end", "end_day") else pd.Timestamp(origin)
    want = data.resample(rule, closed=closed, label=label, origin=own, offset=offset).agg(n=("v", "count"), f=("v", "first"), l=("v", "last"))
    want = want[want["n"] > 0]
    df = spark.createDataFrame([(t.to_pydatetime(), i) for i, t in enumerate(stamps)], "t timestamp_ntz, v long")
    out = query_on(df, Q.resample(rule, closed, label, offset, origin).agg({"n": ("v", "count"), "f": ("v", "first"), "l": ("v", "last")}), "t", ["t", "v"])
    got = sorted(tuple(r) for r in out.collect())
    assert got == [(t.to_pydatetime(), n, int(f), int(last)) for t, n, f, last in want.itertuples()]


def test_resample_needs_times(frame):
    with pytest.raises((SchemaError, UserInputError)):
        query_on(frame, Q.resample("1h").agg({"x": "sum"}), "i")


def test_first_and_last_skip_missing(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(t, 0, None), (t, 1, "a"), (t + dt.timedelta(minutes=1), 2, "b"), (t + dt.timedelta(minutes=2), 3, None)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, i int, s string")
    out = query_on(df, Q.resample("1h").agg({"f": ("s", "first"), "l": ("s", "last"), "n": ("s", "count")}), "t", ["t", "i"]).collect()
    assert [tuple(r)[1:] for r in out] == [("a", "b", 2)]


@pytest.mark.parametrize(("start", "end"), [(0, 5), (3, 7), (-4, None), (None, -3), (-6, -2), (2, None), (5, 5), (8, 100), (0, 0), (-100, 2)])
def test_rows_like_a_list(spark, start, end):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), i) for i in range(12)], "t timestamp_ntz, i int").repartition(3)
    out = query_on(df, Q.row_range((start, end)), "t", ["t"])
    assert ids(out) == list(range(12))[start:end]


@pytest.mark.parametrize("n", [0, 3, 20, -3, -20])
def test_head_and_tail(spark, n):
    df = spark.createDataFrame([(i,) for i in range(12)], "i int").repartition(3)
    assert ids(query_on(df, Q.head(n), order=["i"])) == list(range(12))[:n]
    want = list(range(12))[-n:] if n > 0 else list(range(12))[-n:] if n < 0 else []
    assert ids(query_on(df, Q.tail(n), order=["i"])) == want


def test_order_is_needed(frame):
    with pytest.raises(UserInputError):
        query_on(frame, Q.head(2))


def test_concat_types_and_order(spark):
    a = spark.createDataFrame([(1, 1.0)], "k int, v float")
    b = spark.createDataFrame([(2, 3, "x")], "k long, v int, s string")
    out = concat([a, b])
    assert {n: str(k) for n, k in K.kinds_of(out).items()} == {"k": "int64", "v": "float64", "s": "str"}
    assert concat([a, b], "inner").columns == ["k", "v"]
    with pytest.raises(SchemaError):
        concat([a, spark.createDataFrame([("x",)], "v string")])
    both = concat_frames([Frame(b.select("k"), None, ("k",)), Frame(a.select("k"), None, ("k",))])
    assert [r["k"] for r in both.sorted().collect()] == [2, 1]


def test_resample_spec_checks():
    with pytest.raises(UserInputError):
        Resample.of("1h", closed="both")
    with pytest.raises(UserInputError):
        Query().date_range((None, None)).resample("1h", origin="end")


def pushed(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("PushedFilters: ") :].split("\n")[0]


def test_pushdown_of_floats(spark, tmp_path):
    rows = [(float(i), float(i) / 10, i) for i in range(10)] + [(float("nan"), float("nan"), 10), (None, None, 11)]
    spark.createDataFrame(rows, "d double, f float, i int").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for condition, told, want in [
        (Q["d"] > 7.5, "GreaterThan(d,7.5)", [8, 9]),
        (8 < Q["d"], "GreaterThan(d,8.0)", [9]),
        (Q["d"] <= 1, "LessThanOrEqual(d,1.0)", [0, 1]),
        (Q["d"] == 3, "EqualTo(d,3.0)", [3]),
        (Q["d"].isin([1.0, 2.0]), "In(d, [1.0,2.0])", [1, 2]),
        (Q["f"] >= 0.8, "GreaterThanOrEqual(f,0.8)", [8, 9]),
        (Q["f"] < 0.25, "LessThanOrEqual(f,0.25)|LessThan(f,0.25)", [0, 1, 2]),
        (Q["f"] > 0.2, "GreaterThanOrEqual(f,0.2)", [2, 3, 4, 5, 6, 7, 8, 9]),
        (Q["f"] == 0.5, "EqualTo(f,0.5)", [5]),
        (Q["f"].isin([0.5, 0.1]), "EqualTo(f,0.5)|In(f", [5]),
    ]:
        out = query_on(df, Q[condition])
        assert any(t in pushed(out) for t in told.split("|")), (told, pushed(out))
        assert ids(out) == want, told
    for condition, want in [(Q["f"] == 0.1, []), (Q["f"] != 0.1, list(range(12))), (Q["d"] == Q["d"], list(range(10))), (Q["d"] >= Q["f"], list(range(10))), (Q["f"] < Q["d"], list(range(1, 10))), (Q["d"] > float("nan"), []), (Q["d"] != float("nan"), list(range(12))), (Q["d"].isin([float("nan")]), []), (Q["d"] + 1 > 9, [9]), (~(Q["d"] > 1), [0, 1, 10, 11]), (Q["d"].isnull(), [10, 11]), (Q["d"].notnull(), list(range(10))), (~Q["d"].isnull(), list(range(10)))]:
        assert ids(query_on(df, Q[condition])) == want
    out = query_on(df, Q[Q["i"] > 8])
    assert [r["d"] for r in sorted(out.collect(), key=lambda r: r["i"])] == [9.0, None, None]


def test_pushdown_of_registered_queries(spark):
    from tidemark.queries import QUERIES

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    told = pushed(QUERIES["filter_compare"](spark, "/root/testdata/sf0.001"))
    for part in ("GreaterThan(l_quantity,10.0)", "LessThanOrEqual(l_quantity,30.0)", "GreaterThanOrEqual(l_discount,0.05)", "LessThan(l_tax,0.06)"):
        assert part in told
    assert "GreaterThan(l_quantity,20.0)" in pushed(QUERIES["pipeline_filter_project_group"](spark, "/root/testdata/sf0.001"))


def test_powers_are_exact(spark):
    df = spark.createDataFrame([(3, 39), (-2, 63), (2, 62), (-1, 255), (0, 0), (0, 200), (1, 255), (None, 3), (5, None), (-3, 2)], "a long, u short")
    df = df.select("a", F.col("u").alias("u", metadata={K.KEY: "uint8"}))
    got = [r["p"] for r in query_on(df, Q.apply("p", Q["a"] ** Q["u"])).collect()]
    assert got == [3**39, -(2**63), 2**62, -1, 1, 0, 1, None, None, 9]
    one = df.filter("a = 3")
    assert query_on(one, Q.apply("p", Q["a"] ** np.uint8(39))).first()["p"] == 3**39
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        query_on(one, Q.apply("p", Q["a"] ** np.uint8(40))).collect()


@pytest.mark.parametrize("keys", ["strings", "one time", "two times"])
def test_positions_without_a_hot_task(spark, tmp_path, keys):
    """Ranges of rows are written by several tasks even where all keys are equal."""
    from tidemark.operators import ranges

    n = 40_000
    key = {"strings": F.format_string("k%06d", "id"), "one time": F.lit(dt.datetime(2024, 1, 1)), "two times": F.timestamp_seconds(F.col("id") % 2)}[keys]
    df = spark.range(0, n, 1, 4).select(key.alias("k"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files, total = ranges._in_files(df, ["k"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert total == n and max(rows for _, _, rows in files) < n / 2
    got = query_on(df, Q.row_range((n // 2, n // 2 + 3)), order=["k"]).collect()
    want = {"strings": [n // 2 + i for i in range(3)], "one time": [n // 2 + i for i in range(3)], "two times": [2 * i + 1 for i in range(3)]}[keys]
    assert sorted(r["v"] for r in got) == want


def test_concat_is_not_ordered_for_nothing(spark):
    df = spark.range(10).select(F.col("id").alias("k"))
    out = Q.concat().groupby("k").agg({"n": ("k", "count")}).run_many([Frame(df, None, ("k",)), Frame(df, None, ("k",))])
    assert {r["n"] for r in out.df.collect()} == {2} and "row_index" not in out.df._jdf.queryExecution().analyzed().toString()
