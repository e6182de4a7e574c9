"""Words, tokens, exact and near duplicates, mixing: against brute force, with odd rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, graph, minhash, mixing, queries, token_files, tokens
from tidemark.llm.repair import Shard, pack
from tidemark.llm.words import shingles, words

LONG = "word " * 50_000
CLASH = {"keep_id": "x", "__hash": 1, "__size": 2, "__text": "y", "score": 0.5, "a.b": 3}


def odd(spark):
    """Nulls, empty, blank and very long texts, ties, repeats, and columns with names that clash."""
    texts = [None, "", "  \n\t", "a", "a", "A", LONG, LONG, "one two three four five", "one two three four five six", "naïve Ünïcode 漢字", "\x1cx y", "a"]
    rows = [(i, t, "s" if i % 3 else None) for i, t in enumerate(texts)] + [(None, "a", "s"), (None, None, None), (4, "a", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name, value in CLASH.items():
        df = df.withColumn(name, F.lit(value))
    return df, rows


EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \n\tabAB.é漢\x0b", max_size=30)), max_size=8))
def test_words_are_runs(texts):
    hashes, first = words(pa.array(texts, pa.string()))
    known = {}
    for t, a, b in zip(texts, first, first[1:], strict=False):
        own = plain_words(t)
        assert len(own) == b - a
        for w, h in zip(own, hashes[a:b], strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)
    _, begins = shingles(hashes, first, 3)
    assert np.diff(begins).tolist() == [max(0, n - 2) if n >= 3 else min(n, 1) for n in np.diff(first)]


def test_long_words():
    a, b = words(pa.array(["x" * 400_000 + " y", "x" * 400_001]))
    assert len(set(a.tolist())) == 3 and b.tolist() == [0, 2, 3]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tab'sZé漢1! 　\x1c<|endoftext|>", max_size=40), max_size=6))
def test_tokens_are_the_library_s(texts):
    enc = tokens.encoder(open(tokens.vocabulary_path(), encoding="utf-8").read())
    ids, bounds = enc.encode(pa.array([*texts, None], pa.string()))
    for t, a, b in zip([*texts, None], bounds, bounds[1:], strict=False):
        assert ids[a:b].tolist() == enc.tokenizer.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=40), max_size=8), st.integers(0, 30), st.integers(0, 30), st.booleans())
def test_repair_round_trip(docs, start, length, to_the_end):
    arrays = [np.array(d, np.uint32) for d in docs]
    shard = Shard.parse(pack([i or None for i in range(len(docs))], arrays, 10, to_the_end))
    assert [d.tolist() for d in shard.documents()] == docs and shard.doc_ids == [i or None for i in range(len(docs))]
    for i, d in enumerate(docs):
        assert shard.decode(i, start, length).tolist() == d[start : start + length] and shard.decode(i).tolist() == d


def test_repair_to_the_end():
    """No pair of symbols is left that occurs twice, apart from itself, in the documents."""
    rng = random.Random(8)
    docs = [np.array([rng.randrange(6) for _ in range(200)], np.uint32) for _ in range(5)]
    shard = Shard.parse(pack(list(range(5)), docs, 10, True))
    uses = collections.Counter()
    for i in range(5):
        own, at = shard.symbols[shard.symbols_at[i] : shard.symbols_at[i + 1]].tolist(), {}
        for j, pair in enumerate(zip(own, own[1:], strict=False)):
            if at.get(pair, -2) < j - 1:
                uses[pair], at[pair] = uses[pair] + 1, j
    assert max(uses.values()) == 1 and len(shard.rules) > 20


def test_token_files_of_documents(spark, duck):
    """Every whole text against the library, text by text."""
    from tidemark.llm import queries

    enc = tokens.encoder(open(tokens.vocabulary_path(), encoding="utf-8").read())
    at, want = 0, []
    for i, t in duck.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall():
        ids = np.append(enc.whole(t or ""), 0).astype("<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.op5_token_files(spark, SF).collect())) == want


def test_near_duplicates_of_documents(spark, duck):
    from tidemark.llm import queries

    rows = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    got = sorted(tuple(r) for r in queries.op7_minhash(spark, SF).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == sorted(brute_components(rows, 4, 80))


def test_near_duplicates_where_everything_is_hot(spark, monkeypatch):
    """Nodes with many pairs and shingles of many sets are dealt over parts; nothing is lost or found twice."""
    monkeypatch.setattr(minhash, "hot_groups", lambda groups, size: F.col(size) >= 2)
    monkeypatch.setattr(minhash, "SHARE", 2)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):  # a passage in many texts, most of which are not similar, and some edited copies
        own = [*base[:30], *(f"u{i}x{j}" for j in range(30 if i % 3 else 4))]
        rows.append((i, " ".join(own)))
        own[rng.randrange(len(own))] = "edited"
        rows.append((100 + i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in minhash.near_duplicates(df, length=3, similarity=0.8).collect())
    assert got == sorted(brute_components(rows, 3, 80))


def test_repair_compresses():
    ids = np.tile(np.arange(50, dtype=np.uint32), 400)
    data = pack([1], [ids], 50_000)
    assert len(data) < len(ids) and (Shard.parse(data).documents()[0] == ids).all()


def test_token_files(spark):
    df, rows = odd(spark)
    enc = tokens.encoder(open(tokens.vocabulary_path(), encoding="utf-8").read())
    out = sorted(token_files.read(token_files.write(df)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    at, left = 0, collections.Counter((r[0], tuple(enc.whole(r[1] or "").tolist()) + (0,)) for r in rows)
    for r in out:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        left[(r["doc_id"], tuple(r["ids"]))] -= 1
        at += r["n_tokens"]
    assert not +left
    assert token_files.read(token_files.write(spark.createDataFrame([], EMPTY))).count() == 0


def test_exact_groups(spark):
    df, rows = odd(spark)
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    want = []
    for i, t, _ in rows:
        own = groups[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        want.append((i, keep, len(own), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.groups_of(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = exact_dedup.deduplicate(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {w[0] for w in want if w[3]}
    assert exact_dedup.groups_of(spark.createDataFrame([], EMPTY)).count() == 0


def test_exact_deduplicate_keeps_one_row(spark):
    """Exactly one row of each text, also where rows repeat whole or all ids of a group are null."""
    df, rows = odd(spark)
    df = df.unionByName(df.filter("doc_id is null or doc_id = 4")).unionByName(df.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit("no id")).crossJoin(spark.range(3)).drop("id"))
    texts = [r["text"] or "" for r in exact_dedup.deduplicate(df).collect()]
    assert sorted(texts) == sorted({t or "" for _, t, _ in rows} | {"no id"})


def test_collisions_are_told_apart(spark):
    """With a hash of one bit all groups hold several texts."""
    rng = random.Random(3)
    rows = [(i, rng.choice("abcde") * rng.randrange(3)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = exact_dedup.verdicts(df, [F.col("text").alias("own")], hash_of=lambda c: F.encode((F.length(c) % 2).cast("string"), "UTF-8"))
    for r in out.collect():
        same = [i for i, t in rows if t == r["own"]]
        assert (r["__keep"], r["__size"]) == (max(same), len(same))


def test_hot_groups_stay_whole(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 1500).cast("string"))).alias("text"))
    out = exact_dedup.groups_of(df)
    assert out.filter("kept").count() == df.select("text").distinct().count() and out.filter("group_size = 2000").count() == 2000


def brute_components(rows, length, percent):
    sets = []
    for _, t in rows:
        w = plain_words(t)
        sets.append(frozenset(tuple(w[k : k + length]) for k in range(len(w) - length + 1)) if len(w) >= length else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    out = []
    for x in range(len(rows)):
        own = [rows[y][0] for y in range(len(rows)) if find(y) == find(x) and rows[y][0] is not None]
        least = min(own) if own else None
        out.append((rows[x][0], len(sets[x]), least, rows[x][0] == least))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    """Edited copies of a few texts around the threshold, and texts that share a passage."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for base in range(4):
        text = [rng.choice(vocabulary) for _ in range(100)]
        for _ in range(25):
            own = list(text)
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append(" ".join(own))
    for _ in range(30):
        rows.append(" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randrange(2, 40))]))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), length=4)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_components(rows, 4, 80))


def test_near_duplicates_of_odd_rows(spark):
    df, rows = odd(spark)
    got = [tuple(r) for r in minhash.near_duplicates(df, length=4).collect()]
    assert sorted(got, key=repr) == sorted(brute_components([(i, t) for i, t, _ in rows], 4, 80), key=repr)
    kept = minhash.deduplicate(df)
    assert kept.columns == df.columns
    empty = spark.createDataFrame([], EMPTY)
    assert minhash.near_duplicates(empty).count() == 0 and minhash.deduplicate(empty).count() == 0


def test_near_deduplicate_decides_by_row(spark):
    """Exactly one row of each component and all rows without words, whatever ids are null or repeat."""
    df, rows = odd(spark)
    got = sorted(((r["doc_id"], r["text"]) for r in minhash.deduplicate(df, length=4).collect()), key=repr)
    blank = [(i, t) for i, t, _ in rows if not plain_words(t)]
    assert got == sorted([*blank, (3, "a"), *(rows[i][:2] for i in (6, 8, 9, 10, 11))], key=repr)

    near = "a b c d e f g h i j k l m n o p q r s t"
    texts = [(1, near), (None, near + " u"), (None, "clean and unique words of a text"), (None, "other unique words of its own"), (7, near + " v"), (7, "a text that shares its id with a near copy"), (9, "twice the same words here"), (9, "twice the same words here"), (None, "never an id at all"), (None, "never an id at all"), (None, "Never  an ID at all")]
    out = [tuple(r) for r in minhash.deduplicate(spark.createDataFrame(texts, "doc_id long, text string"), length=4).collect()]
    never = [r for r in out if r in {texts[8], texts[10]}]
    assert len(never) == 1
    assert sorted(set(out) - set(never), key=repr) == sorted({texts[0], texts[2], texts[3], texts[5], texts[6]}, key=repr) and len(out) == 6


def test_components_of_a_path(spark):
    n = 40
    order = list(range(n))
    random.Random(5).shuffle(order)
    edges = [(bytes([order[i]]), bytes([order[i + 1]])) for i in range(n - 1)] + [(b"\xf0", b"\xf1")]
    out = {r["node"][0]: r["root"][0] for r in graph.components(spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in edges], "a binary, b binary")).collect()}
    assert out == {**{i: 0 for i in range(1, n)}, 0xF1: 0xF0}


def test_mixing(spark, duck):
    got = queries.op2_mixing(spark, SF).toPandas()
    sizes = {i: len(re.findall(mixing.WORD, t or "")) for i, t in duck.sql("SELECT doc_id, text FROM documents").fetchall()}
    assert {r.doc_id: r.size for r in got.itertuples()} == sizes
    by = got.merge(duck.sql("SELECT doc_id, source FROM documents").df(), on="doc_id").groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"), all=("source_size", "first"))
    assert ((by["taken"] - by["target"]).abs() <= 2 * by["most"]).all() and (by["target"] <= 2 * by["all"] + 1e-6).all()
    assert (got["taken"] <= 2 * got["size"]).all() and got["taken"].sum() <= 1.5 * got["size"].sum() and got["taken"].sum() >= 1.5 * got["size"].sum() - got["size"].max()
    again = queries.op2_mixing(spark, SF).toPandas()
    assert sorted(got.itertuples(index=False)) == sorted(again.itertuples(index=False))


def test_mixing_odd_rows(spark):
    df, rows = odd(spark)
    mix = mixing.plan(df)
    out = mix.stream()
    assert out.columns == df.columns
    taken = {r["__id"]: 0 for r in mix.queue.collect()}
    assert mix.queue.count() == len(rows) and all(r["__copies"] <= 2 for r in mix.queue.collect()) and taken
    assert out.count() == mix.queue.agg(F.sum("__copies")).first()[0]
    finish = [(r["__copies"], r["__size"]) for r in mix.queue.collect()]
    assert sum(c * s for c, s in finish) <= 1.5 * sum(s for _, s in finish)
    assert mixing.plan(spark.createDataFrame([], EMPTY)).stream().count() == 0
    one = spark.createDataFrame([(1, "a b c", "x")], "doc_id long, text string, source string")
    assert mixing.mixed_sizes(one).first()["taken"] == 3


def test_mixing_order_is_by_finish_time(spark):
    df = pd.DataFrame({"doc_id": range(300), "text": ["w " * (1 + i % 7) for i in range(300)], "source": [f"s{i % 3}" for i in range(300)]})
    out = mixing.plan(spark.createDataFrame(df), weights=(5.0, 2.0, 1.0), budget=0.5).stream().toPandas()
    words_of = out.assign(n=out["text"].str.split().str.len())
    half = words_of.iloc[: len(words_of) // 2].groupby("source")["n"].sum()
    assert half["s0"] / half["s2"] == pytest.approx(5, rel=0.35) and half["s1"] / half["s2"] == pytest.approx(2, rel=0.35)
