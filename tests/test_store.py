"""The store, against a list of pandas frames and its own rules."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import DataError, LibraryOptions, Query, Request, Store, concat
from tidemark.errors import DuplicateKeyError, LibraryNotFoundError, NoSuchVersionError, SchemaError, UnsortedDataError, UserInputError

DAY = pd.Timestamp("2024-01-01")


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path))


@pytest.fixture
def lib(store):
    return store.create_library("l", LibraryOptions(rows_per_segment=3))


def days(first, last, value=0, name="v"):
    index = pd.date_range(DAY + pd.Timedelta(days=first), DAY + pd.Timedelta(days=last), name="t")
    return pd.DataFrame({name: np.arange(len(index)) + value}, index=index)


def rows(item):
    return [((r["t"].replace(tzinfo=None) - DAY.to_pydatetime()).days, r["v"]) for r in item.in_order.collect()]


def test_libraries(store):
    store.create_library("a/b")
    assert store.list_libraries() == ["a/b"] and "a/b" in store
    with pytest.raises(UserInputError):
        store.create_library("a/b")
    assert store.modify_library_option(store["a/b"], dynamic_schema=True).options.dynamic_schema
    store.delete_library("a/b")
    with pytest.raises(LibraryNotFoundError):
        store["a/b"]


def test_types_round_trip(lib):
    data = pd.DataFrame({f"c{t}": np.array([0, 1, np.iinfo(t).max], t) for t in ("u1", "u2", "u4", "u8", "i1", "i2", "i4", "i8")} | {"f": np.array([1.5, np.nan, -1], "f4"), "d": [1.0, np.nan, 2.0], "s": ["a", None, "ü"], "b": [True, False, True], "t": pd.to_datetime(["2024-01-01", None, "1969-12-31"])})
    lib.write("x", data)
    out = lib.read("x").in_order.collect()
    assert [int(r["cu8"]) for r in out] == [0, 1, 2**64 - 1] and [r["d"] for r in out] == [1.0, None, 2.0] and [r["s"] for r in out] == ["a", None, "ü"]
    assert dict(lib.get_description("x").columns)["cu4"] == "uint32"
    assert [r["cu8"] for r in lib.read("x", query=Query()[Query()["cu8"] == 2**64 - 1]).in_order.collect()] == [2**64 - 1]


def test_versions_and_snapshots(lib):
    for i in range(3):
        assert lib.write("s", days(0, 3, i), {"i": i}).version == i
    assert lib.read("s", as_of=0).metadata == {"i": 0} and rows(lib.read("s", as_of=-2))[0][1] == 1
    between = lib.catalog.load("s", 1).created
    assert lib.read("s", as_of=pd.Timestamp(between, tz="UTC")).version == 1
    lib.snapshot("snap", {"why": 1}, versions={"s": 1})
    lib.delete("s", [0, 1])
    assert sorted(v for _, v in lib.list_versions("s")) == [1, 2] and lib.list_versions("s")[("s", 1)].deleted
    assert rows(lib.read("s", as_of="snap"))[0][1] == 1 and rows(lib.read("s", as_of=1))[0][1] == 1
    with pytest.raises(NoSuchVersionError):
        lib.read("s", as_of=0)
    lib.delete_snapshot("snap")
    with pytest.raises(NoSuchVersionError):
        lib.read("s", as_of=1)
    lib.write("u", days(0, 1))
    lib.snapshot("all", skip_symbols=["u"])
    assert lib.list_symbols(snapshot="all") == ["s"] and lib.list_snapshots() == {"all": None}
    lib.add_to_snapshot("all", ["u"])
    lib.remove_from_snapshot("all", ["s"])
    assert lib.list_symbols(snapshot="all") == ["u"]
    lib.delete("u")
    assert lib.list_symbols() == ["s"] and not lib.has_symbol("u") and lib.has_symbol("u", "all")
    assert lib.list_symbols("^x") == []


def test_restore_and_metadata(lib):
    lib.write("s", days(0, 1, 5), {"a": 1})
    lib.write("s", days(0, 1, 9))
    assert lib.restore_version("s", 0).metadata == {"a": 1} and rows(lib.read("s")) == [(0, 5), (1, 6)]
    lib.write_metadata("s", {"b": 2})
    assert lib.read_metadata("s").metadata == {"b": 2} and lib.read("s").version == 3
    lib.prune_previous_versions("s")
    assert [v for _, v in lib.list_versions("s")] == [3] and rows(lib.read("s")) == [(0, 5), (1, 6)]


def test_update_and_delete_like_pandas(lib):
    rng = random.Random(1)
    model = days(0, 30)
    lib.write("s", model)
    for step in range(8):
        a = rng.randrange(0, 28)
        b = min(30, a + rng.randrange(0, 8))
        lo, hi = DAY + pd.Timedelta(days=a), DAY + pd.Timedelta(days=b)
        outside = model[(model.index < lo) | (model.index > hi)]
        if step % 2:
            model = outside
            lib.delete_data_in_range("s", (lo, hi))
        else:
            new = days(a, b, 1000 * (step + 1))
            new = new[[i % 2 == 0 or i == len(new) - 1 for i in range(len(new))]]
            model = pd.concat([outside, new]).sort_index()
            lib.update("s", new)
        assert rows(lib.read("s")) == [((t - DAY).days, v) for t, v in model["v"].items()]
        n = len(model)
        assert rows(lib.read("s", row_range=(n // 3, n // 2))) == [((t - DAY).days, v) for t, v in model["v"].iloc[n // 3 : n // 2].items()]
        assert rows(lib.tail("s", 4)) == [((t - DAY).days, v) for t, v in model["v"].iloc[-4:].items()]


def test_update_rules(lib):
    lib.write("s", days(0, 5))
    with pytest.raises(UnsortedDataError):
        lib.update("s", days(1, 3).iloc[::-1])
    with pytest.raises(SchemaError):
        lib.update("s", days(1, 3, name="w"))
    with pytest.raises(NoSuchVersionError):
        lib.update("none", days(1, 3))
    assert lib.update("none", days(1, 3), upsert=True).version == 0
    assert lib.update("s", days(1, 3).iloc[:0]).version == 0
    lib.update("s", days(2, 2, 77), date_range=(DAY + pd.Timedelta(days=1), None))
    assert rows(lib.read("s")) == [(0, 0), (2, 77)]


def test_append_rules(lib):
    lib.append("s", days(0, 2))
    lib.append("s", days(2, 4, 10))
    assert rows(lib.read("s")) == [(0, 0), (1, 1), (2, 2), (2, 10), (3, 11), (4, 12)]
    with pytest.raises(UnsortedDataError):
        lib.append("s", days(3, 5))
    with pytest.raises(SchemaError):
        lib.append("s", days(8, 9, name="w"))
    with pytest.raises(SchemaError):
        lib.append("s", days(8, 9).astype("float64"))
    with pytest.raises(UnsortedDataError):
        lib.write("u", days(0, 3).iloc[::-1])
    lib.write("u", days(0, 3).iloc[::-1], validate_index=False)
    with pytest.raises(UnsortedDataError):
        lib.read("u", date_range=(DAY, DAY))


def test_dynamic_schema(store):
    lib = store.create_library("d", LibraryOptions(dynamic_schema=True, rows_per_segment=2))
    lib.write("s", days(0, 2).astype("int16"))
    lib.append("s", days(3, 4, 0.5).assign(w="x"))
    out = [(r["v"], r["w"]) for r in lib.read("s").in_order.collect()]
    assert out == [(0.0, None), (1.0, None), (2.0, None), (0.5, "x"), (1.5, "x")]
    lib.update("s", days(1, 1, 9))
    assert [r["v"] for r in lib.read("s").in_order.collect()] == [0.0, 9.0, 2.0, 0.5, 1.5]
    with pytest.raises(SchemaError):
        lib.append("s", days(8, 9).astype(str))
    assert lib.read("s", columns=["w", "nowhere"]).data.columns == ["t", "w"]


def test_merge(lib):
    lib.write("s", days(0, 5))
    lib.merge("s", days(2, 3, 100))
    assert rows(lib.read("s")) == [(0, 0), (1, 1), (2, 100), (3, 101), (4, 4), (5, 5)]
    lib.merge("s", days(5, 7, 200), ("update", "insert"))
    assert rows(lib.read("s"))[-3:] == [(5, 200), (6, 201), (7, 202)]
    lib.merge("s", days(7, 8, 300), ("do_nothing", "insert"))
    assert rows(lib.read("s"))[-2:] == [(7, 202), (8, 301)]
    with pytest.raises(DuplicateKeyError):
        lib.merge("s", pd.concat([days(2, 2), days(2, 2)]))
    with pytest.raises(UserInputError):
        lib.merge("s", days(2, 2), ("do_nothing", "do_nothing"))
    lib.write("n", pd.DataFrame({"k": ["a", None], "v": [1, 2]}))
    lib.merge("n", pd.DataFrame({"k": [None], "v": [9]}, dtype=object).astype({"v": "int64"}), on=["k"])
    assert [(r["k"], r["v"]) for r in lib.read("n").in_order.collect()] == [("a", 1), (None, 9)]


def test_staging(lib):
    tokens = [lib.stage("s", days(a, a + 1, a)) for a in (4, 0, 2)]
    assert lib.get_staged_symbols() == ["s"] and not lib.has_symbol("s")
    lib.finalize_staged_data("s", tokens=tokens[1:])
    assert rows(lib.read("s")) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    lib.finalize_staged_data("s", "append", metadata={"m": 1})
    assert rows(lib.read("s")) == [(i, i) for i in range(6)] and lib.get_staged_symbols() == []
    lib.stage("s", days(6, 9))
    lib.stage("s", days(8, 12))
    with pytest.raises(UnsortedDataError):
        lib.finalize_staged_data("s", "append")
    lib.sort_and_finalize_staged_data("s", "append")
    assert [d for d, _ in rows(lib.read("s"))][6:] == [6, 7, 8, 8, 9, 9, 10, 11, 12]
    lib.stage("s", days(1, 2))
    with pytest.raises(UnsortedDataError):
        lib.finalize_staged_data("s", "append", delete_staged_data_on_failure=True)
    with pytest.raises(NoSuchVersionError):
        lib.finalize_staged_data("s")
    lib.stage("x", days(0, 3).iloc[::-1], sort_on_index=True)
    assert rows(lib.finalize_staged_data("x") and lib.read("x"))[0][0] == 0


def test_compaction(lib):
    for i in range(7):
        lib.append("s", days(i, i, i))
    assert len(lib.read_index("s")) == 7 and lib.is_symbol_fragmented("s", 5)
    assert lib.compact_data("s").version == 7
    assert rows(lib.read("s")) == [(i, i) for i in range(7)] and len(lib.read_index("s")) <= 3
    version = lib.read("s").version
    assert lib.compact_data("s", 3).version in (version, version + 1)
    assert rows(lib.read("s", row_range=(2, 5))) == [(2, 2), (3, 3), (4, 4)]


def test_statistics_prune(lib):
    lib.write("s", days(0, 11))
    lib.create_column_stats("s", ["v"])
    assert lib.get_column_stats_info("s") == ["v"] and list(lib.read_column_stats("s")["max(v)"])[0] == 2
    q = Query()[(Query()["v"] > 8) & (Query()["v"] != 10)]
    assert rows(lib.read("s", query=q)) == [(9, 9), (11, 11)]
    assert len(lib._frame(Request("s", query=q))[0].df.inputFiles()) == 1
    assert rows(lib.read("s", query=Query()[Query()["v"] > 100])) == []
    with pytest.raises(SchemaError):
        lib.create_column_stats("s", ["nowhere"])
    lib.drop_column_stats("s")
    assert lib.get_column_stats_info("s") == []


def test_reads(lib):
    lib.write("s", days(0, 9))
    at = lambda d: DAY + pd.Timedelta(days=d)
    assert rows(lib.read("s", date_range=(at(3), at(5)))) == [(3, 3), (4, 4), (5, 5)]
    assert len(lib._frame(Request("s", date_range=(at(3), at(5))))[0].df.inputFiles()) == 1
    assert rows(lib.head("s", -7)) == [(0, 0), (1, 1), (2, 2)] and rows(lib.tail("s", -8)) == [(8, 8), (9, 9)]
    assert rows(lib.read("s", row_range=(-3, -1))) == [(7, 7), (8, 8)]
    assert lib.read("s", columns=[]).data.columns == ["t"]
    lazy = lib.read("s", lazy=True)
    lazy = lazy[lazy["v"] > 5].apply("w", lazy["v"] * 2)
    assert lazy.schema().names == ["t", "v", "w"] and [r["w"] for r in lazy.collect().in_order.collect()] == [12, 14, 16, 18]
    with pytest.raises(UserInputError):
        lib.read("s", date_range=(at(0), None), row_range=(0, 1))
    with pytest.raises(SchemaError):
        lib.read("s", columns=["nowhere"])
    out = lib.read_batch(["s", "none"])
    assert rows(out[0])[0] == (0, 0) and isinstance(out[1], DataError) and out[1].kind == "NoSuchVersionError"
    d = lib.get_description("s")
    assert d.rows == 10 and d.index == "t" and d.date_range[1] == at(9).tz_localize("UTC") and d.sorted
    assert lib.sizes("s")["s"] > 0


def test_joins(lib):
    lib.write_batch({"a": days(0, 2), "b": days(3, 4, 10).rename_axis("u")})
    out = concat(lib.read_batch(["a", "b"], lazy=True)).collect()
    assert [r["v"] for r in out.in_order.collect()] == [0, 1, 2, 10, 11] and out.data.columns[0] == "index" and [v.symbol for v in out.versions] == ["a", "b"]
    q = Query().concat("inner").resample("3D").agg({"v": "sum"})
    lib.write("b", days(3, 4, 10))
    assert sorted(r["v"] for r in lib.read_batch_and_join(["a", "b"], q).data.collect()) == [1, 23]
    parts = lib.read_batch(["a", "b"], lazy=True).filter(Query()["v"] > 1)
    assert [r["v"] for r in concat(parts).collect().in_order.collect()] == [2, 10, 11]


def test_pickles_and_writes_of_queries(lib):
    lib.write_pickle("p", {"a": [1, 2]})
    assert lib.read("p").data == {"a": [1, 2]}
    with pytest.raises(SchemaError):
        lib.read("p", query=Query().head(1))
    lib.write("s", days(0, 9))
    q = Query()
    lib.read_modify_write("s", q[q["v"] > 6], "r")
    assert rows(lib.read("r")) == [(7, 7), (8, 8), (9, 9)] and rows(lib.read("r", row_range=(1, 2))) == [(8, 8)]


def test_spark_frames_and_many_rows(spark, store):
    lib = store.create_library("big", LibraryOptions(rows_per_segment=100))
    df = spark.range(1000).select((F.lit(dt.datetime(2024, 1, 1)) + F.expr("make_interval(0,0,0,0,0,id)")).cast("timestamp_ntz").alias("t"), F.col("id").alias("v")).repartition(5)
    lib.write("s", df, index="t")
    assert [r["v"] for r in lib.read("s", row_range=(250, 255)).in_order.collect()] == [250, 251, 252, 253, 254]
    index = lib.read_index("s")
    assert index["rows"].sum() == 1000 and (index["rows"] <= 100).all()
    lib.write("e", df.limit(0), index="t")
    assert lib.read("e").data.count() == 0


def test_streams(spark, store, tmp_path):
    from tidemark.streaming.ingest import resample_stream, staging_sink

    lib, source = store.create_library("st"), str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame([(dt.datetime(2024, 1, 1, i, m), 60 * i + m) for m in range(0, 60, 20)], "t timestamp_ntz, v long").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("t timestamp_ntz, v long").option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):  # the second run finds nothing new
        staging_sink(stream, lib, "s", str(tmp_path / "c"), "t").trigger(availableNow=True).start().awaitTermination()
    lib.sort_and_finalize_staged_data("s")
    assert [r["v"] for r in lib.read("s").in_order.collect()] == [0, 20, 40, 60, 80, 100, 120, 140, 160]
    out = resample_stream(stream, "t", "90min", {"n": ("v", "count"), "f": ("v", "first")}, "10 minutes")
    out.writeStream.format("memory").queryName("resampled").outputMode("complete").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["t"].hour * 60 + r["t"].minute, r["n"], r["f"]) for r in spark.table("resampled").collect())
    assert got == [(0, 5, 0), (90, 4, 100)]


def test_reads_with_staged_rows(lib):
    lib.stage("s", days(4, 5))
    assert rows(lib.read("s", staged=True)) == [(4, 0), (5, 1)]
    lib.write("s", days(0, 1))
    lib.stage("s", days(2, 3, 7))
    assert rows(lib.read("s", staged=True)) == [(0, 0), (1, 1), (2, 7), (3, 8), (4, 0), (5, 1)] and rows(lib.read("s")) == [(0, 0), (1, 1)]
    assert rows(lib.read("s", staged=True, row_range=(1, 3))) == [(1, 1), (2, 7)]


def test_partitioned_writes(lib):
    out = lib.write_partitioned("p", days(0, 5).assign(k=["a", "b", "a", None, "b", "a"]), "k")
    assert set(out) == {"a", "b", None} and rows(lib.read("p/a")) == [(0, 0), (2, 2), (5, 5)] and rows(lib.read("p/a", row_range=(1, 2))) == [(2, 2)]


def test_single_files(lib, tmp_path):
    lib.write("s", days(0, 7), {"m": 1})
    lib.export_file("s", str(tmp_path / "out"))
    lib.import_file("t", str(tmp_path / "out"))
    assert rows(lib.read("t")) == rows(lib.read("s")) and lib.read_metadata("t").metadata == {"m": 1} and rows(lib.tail("t", 2)) == [(6, 6), (7, 7)]


def test_other_inputs(lib):
    from tidemark import register_normalizer

    class Odd:
        values = [3, 4]

    register_normalizer(lambda x: pd.DataFrame({"v": x.values}) if isinstance(x, Odd) else None)
    lib.write("o", Odd())
    lib.write("n", np.array([[1, 2], [3, 4]]))
    lib.write("r", pd.Series([1.5, None], name="x"))
    assert [r["v"] for r in lib.read("o").in_order.collect()] == [3, 4] and lib.read("n").to_arrow().column("c1").to_pylist() == [2, 4]
    assert [r["x"] for r in lib.read("r").in_order.collect()] == [1.5, None]
    with pytest.raises(UserInputError):
        lib.write("bad", {"a": 1})


def test_explain_read(lib):
    lib.write("s", days(0, 11))
    told = lib.explain_read("s", date_range=(DAY, DAY + pd.Timedelta(days=1)))
    assert told["opened"] == 1 and told["segments"] == 4 and told["rows"] == 12 and "Scan parquet" in told["plan"] or "FileScan" in told["plan"]


def test_staged_rows_survive_a_refusal(lib):
    """Finalizing looks first: what it refuses stays staged, and can be finalized otherwise."""
    lib.write("s", days(10, 14))
    lib.stage("s", days(0, 2))
    with pytest.raises(UnsortedDataError):
        lib.finalize_staged_data("s", "append")
    assert lib.get_staged_symbols() == ["s"] and len(rows(lib.read("s", staged=True))) == 8
    with pytest.raises(UnsortedDataError):
        lib.sort_and_finalize_staged_data("s", "append")
    lib.sort_and_finalize_staged_data("s")
    assert rows(lib.read("s")) == [(0, 0), (1, 1), (2, 2)]
    lib.stage("s", days(5, 6))
    lib.delete_staged_data("s")
    assert lib.get_staged_symbols() == [] and rows(lib.read("s")) == [(0, 0), (1, 1), (2, 2)]


@pytest.mark.parametrize("sort", [False, True])
def test_a_crash_after_the_commit_adds_nothing_twice(lib, monkeypatch, sort):
    lib.write("s", days(0, 1))
    lib.stage("s", days(2, 3))
    finalize = lib.sort_and_finalize_staged_data if sort else lib.finalize_staged_data
    with monkeypatch.context() as m:
        m.setattr(type(lib), "_unstage", lambda *a, **k: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            finalize("s", "append")
    assert len(rows(lib.read("s"))) == 4 and lib.get_staged_symbols() == []
    with pytest.raises(NoSuchVersionError):
        finalize("s", "append")
    lib.write_metadata("s", 1)
    lib.write("s", days(0, 0))
    lib.stage("s", days(4, 4))
    finalize("s", "append")
    lib.prune_previous_versions("s")
    assert [d for d, _ in rows(lib.read("s"))] == [0, 4]


def test_a_batch_that_runs_again_adds_nothing(spark, lib, tmp_path):
    """Whatever of a batch was done before the failure: staged, finalized or marked."""
    from tidemark.streaming import ingest

    source = str(tmp_path / "in")
    for i in range(2):
        spark.createDataFrame([(dt.datetime(2024, 1, 1 + i), i)], "t timestamp_ntz, v long").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("t timestamp_ntz, v long").option("maxFilesPerTrigger", 1).parquet(source)
    for step in ("sort_and_finalize_staged_data", "folder.put"):
        broken = {"n": 0}
        target, name = (lib, step) if "." not in step else (lib.folder, "put")
        real = getattr(target, name)

        def fail(*a, _real=real, _broken=broken, **k):
            if name == "put" and "streams/" not in str(a[0]):
                return _real(*a, **k)
            _broken["n"] += 1
            if _broken["n"] == 1:
                raise OSError("gone")
            return _real(*a, **k)

        symbol = "s" + name
        setattr(target, name, fail)
        for _ in range(2):
            query = ingest.staging_sink(stream, lib, symbol, str(tmp_path / symbol), "t", finalize=True).trigger(availableNow=True).start()
            try:
                query.awaitTermination()
            except Exception as e:
                assert "gone" in str(e)
        setattr(target, name, real)
        assert broken["n"] >= 2 and rows(lib.read(symbol)) == [(0, 0), (1, 1)]


def test_statistics_of_large_integers(lib):
    u = Query()["u"]
    lib.write("s", pd.DataFrame({"u": np.array([2**63 + 1, 2**63 + 3, 5, 2**64 - 1], "u8")}))
    lib.create_column_stats("s", ["u"])
    for v in (2**63 + 1, 2**63 + 3, 5, 2**64 - 1):
        assert [int(r["u"]) for r in lib.read("s", query=Query()[u == v]).data.collect()] == [v]
    assert lib.read("s", query=Query()[u.isin([2**63 + 3])]).data.count() == 1
    assert sorted(int(r["u"]) for r in lib.read("s", query=Query()[u > 2**63 + 1]).data.collect()) == [2**63 + 3, 2**64 - 1]
    assert int(lib.read_column_stats("s")["max(u)"].iloc[0]) == 2**63 + 3


def test_metadata_comes_back_as_it_was(lib):
    for value in ({"t": pd.Timestamp("2024-01-01"), 1: (2, 3)}, [1, "a", None], "x", {"a": {"b": 1.5}}, {"__pickled__": "no"}, np.arange(3)):
        lib.write("m", days(0, 1), value)
        lib.snapshot("m", value)
        for got in (lib.read_metadata("m").metadata, lib.list_snapshots()["m"]):
            assert type(got) is type(value) and np.all(got == value)
        lib.delete_snapshot("m")


def test_origin_of_the_data_and_a_date_range(lib):
    lib.write("s", days(0, 5))
    q = Query().resample("2D", origin="start").agg({"v": "sum"})
    assert sorted(r["v"] for r in lib.read("s", query=q).data.collect()) == [1, 5, 9]
    with pytest.raises(UserInputError):
        lib.read("s", date_range=(DAY, None), query=q)


def test_reads_need_no_sort(lib):
    lib.write("s", days(0, 9))
    plan = lib.read("s").data._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan
    assert lib.read("s").to_pandas()["v"].tolist() == list(range(10))


def test_batches_of_versions(lib):
    lib.write_batch({"a": days(0, 1), "b": days(0, 2)})
    lib.write_batch({"a": days(5, 6), "b": days(5, 6)})
    out = lib.restore_version_batch({"a": 0, "b": 0, "none": 0})
    assert [type(x).__name__ for x in out] == ["VersionedItem", "VersionedItem", "DataError"] and len(rows(lib.read("b"))) == 3 and lib.compact_symbol_list() == 0


def test_segments_that_are_there_are_kept(store):
    lib = store.create_library("dd", LibraryOptions(rows_per_segment=2, dedup=True))
    lib.write("s", days(0, 5))
    lib.write("s", pd.concat([days(0, 3), days(4, 5, 50)]))
    old, new = (lib.read_index("s", v)["path"].tolist() for v in (0, 1))
    assert old[:2] == new[:2] and old[2] != new[2] and [v for _, v in rows(lib.read("s"))] == [0, 1, 2, 3, 50, 51]
    lib.delete("s", 0)
    assert [v for _, v in rows(lib.read("s"))] == [0, 1, 2, 3, 50, 51]


def test_segments_are_cut_alike_whatever_ranges_are(spark, store):
    """Ranges begin at sampled rows, others in each write; segments begin at multiples of their size."""
    lib = store.create_library("dd", LibraryOptions(rows_per_segment=700, dedup=True))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n in (20_000, 20_500):
            lib.write("s", spark.range(n).select(F.timestamp_seconds(F.expr("id div 50")).alias("t"), F.col("id").alias("v")), index="t")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    old, new = (lib.read_index("s", v) for v in (0, 1))
    assert old["rows"].tolist() == [700] * 28 + [400] and new["rows"].tolist() == [700] * 29 + [200]
    assert old["path"].tolist()[:28] == new["path"].tolist()[:28] and old["path"].tolist()[28] != new["path"].tolist()[28]
    assert [r["v"] for r in lib.read("s").in_order.collect()] == list(range(20_500))
    assert len(lib.folder.names("symbols/s/data")) == 2  # nothing is left of the ranges


def test_equal_segments_are_kept_once_each(store):
    lib = store.create_library("dd", LibraryOptions(rows_per_segment=2, dedup=True))
    for _ in range(2):
        lib.write("s", pd.DataFrame({"v": [1, 2, 1, 2]}))
    old, new = (lib.read_index("s", v)["path"].tolist() for v in (0, 1))
    assert sorted(old) == sorted(new) and [r["v"] for r in lib.read("s").in_order.collect()] == [1, 2, 1, 2]


def test_a_write_is_ordered_like_its_input(spark, lib):
    """Rows of one time stay as they came, over segments and partitions."""
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1 + i // 20), i) for i in range(40)], "t timestamp_ntz, v long").coalesce(1)
    lib.write("s", df, index="t")
    assert [r["v"] for r in lib.read("s").in_order.collect()] == list(range(40))
    out = lib.write_partitioned("p", df.withColumn("k", F.col("v") % 3), "k", index="t")
    assert sorted(out) == [0, 1, 2] and [r["v"] for r in lib.read("p/1").in_order.collect()] == list(range(1, 40, 3))
    lib.compact_data("s", 7)
    assert [r["v"] for r in lib.read("s").in_order.collect()] == list(range(40)) and len(lib.read_index("s")) < 8
