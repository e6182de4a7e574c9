"""Language model, classifiers, packing, archives, search and the pipeline: against brute force, with odd rows."""

import base64
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_texts import EMPTY, odd, plain_words

from tidemark.llm import katz, linear, packing, quality, queries, scoring, tokens, topk, toxicity, warc
from tidemark.llm.words import words


def good_turing(counts):
    """What share a count keeps: Katz's formula up to 5, half a count less where that gives no share."""
    kinds = collections.Counter(counts)

    def kept(count):
        if count > 5:
            return 1 - 1e-5
        if kinds[1] and kinds[count] and 6 * kinds[6] < kinds[1]:
            adjusted = (count + 1) * kinds[count + 1] / kinds[count]
            common = 6 * kinds[6] / kinds[1]
            share = (adjusted / count - common) / (1 - common)
            if 0 < share < 1:
                return share
        return (count - 0.5) / count

    return kept


def brute_katz(rows, learnt, order=2):
    docs = [(i, [*plain_words(t), "</s>"], keep) for (i, t), keep in zip(rows, learnt, strict=True)]

    def grams(w, n):
        """Each word with the n - 1 before it."""
        padded = ["<s>"] * (n - 1) + w
        return [tuple(padded[i : i + n]) for i in range(len(w))]

    uses = [collections.Counter(g for _, w, keep in docs if keep for g in grams(w, n)) for n in range(1, order + 1)]
    after = [collections.defaultdict(dict) for _ in uses]
    for n, own in enumerate(uses):
        for g, c in own.items():
            after[n][g[:-1]][g[-1]] = c
    uni = {g[0]: c for g, c in uses[0].items()}
    n, v = sum(uni.values()), len(uni)
    kept = [good_turing(own.values()) for own in uses]
    unknown = 1 - sum(kept[0](c) * c for c in uni.values()) / n if n else 1.0

    def chance(h, w):
        """After the words of the tuple h, at most order - 1."""
        if not h:
            return kept[0](uni[w]) * uni[w] / n if w in uni else unknown
        there, keeps = after[len(h)].get(h), kept[len(h)]
        if not there:
            return chance(h[1:], w)
        total = sum(there.values())
        if w in there:
            return keeps(there[w]) * there[w] / total
        left = 1 - sum(keeps(c) * c for c in there.values()) / total
        return left / (1 - sum(chance(h[1:], x) for x in there)) * chance(h[1:], w)

    out = []
    for i, w, keep in docs:
        base = sum(math.log10((uni.get(x, 0) + 1) / (n + v + 1)) for x in w)
        out.append((i, keep, len(w), sum(x in uni for x in w), n, base, sum(math.log10(chance(g[:-1], g[-1])) for g in grams(w, order))))
    return out, chance, uni, unknown


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=repr), sorted(want, key=repr), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-7)


@pytest.mark.parametrize(("chunk", "order"), [(50, 2), (1 << 20, 2), (50, 3), (1 << 20, 3), (50, 1), (50, 4)])
def test_katz(spark, monkeypatch, chunk, order):
    monkeypatch.setattr(katz, "CHUNK", chunk)
    monkeypatch.setattr(katz, "BUCKET", 100)
    rng = random.Random(1)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = katz.score(df, F.col("doc_id") % 4 != 0, order=order)
    want, chance, uni, unknown = brute_katz(rows, [i % 4 != 0 for i, _ in rows], order)
    close([tuple(r) for r in out.scores.collect()], want)
    held = [w for w in want if not w[1]]
    assert order > 2 or sum(w[6] for w in held) > sum(w[5] for w in held)
    names = [w for w in uni if w != "</s>"]
    for h in (["<s>"] * (order - 1), ["<s>", *names[:5]], names[:5], rows[1][1].split()[:5], rows[2][1].split()[:9]):
        h = tuple(h[len(h) - order + 1 :])
        assert sum(chance(h, w) for w in uni) + chance(h, "never seen") == pytest.approx(1, abs=1e-9)
    assert len(out.counts) == order and len(out.contexts) == order - 1
    stored = {}
    for r in out.counts[0].collect():
        stored.update(zip(katz.unpack_keys(bytes(r["keys"])).tolist(), katz.unpack_counts(bytes(r["values"])).tolist(), strict=True))
    hashes, _ = words(pa.array(names))
    assert all(stored[h] == uni[w] for w, h in zip(names, hashes.tolist(), strict=True))


@pytest.mark.parametrize("order", [2, 3])
def test_katz_odd_rows(spark, order):
    df, rows = odd(spark)
    want, *_ = brute_katz([(i, t) for i, t, _ in rows], [i is None or i % 2 == 0 for i, _, _ in rows], order)
    close([tuple(r) for r in katz.score(df, F.col("doc_id") % 2 == 0, order=order).scores.collect()], want)
    assert katz.score(spark.createDataFrame([], EMPTY), F.lit(True), order=order).scores.count() == 0
    none = katz.score(df, F.lit(False), order=order).scores.collect()
    assert all(r["score"] == 0 and r["n_known"] == 0 for r in none)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_keys_round_trip(keys):
    keys = np.array(sorted(keys), np.uint64)
    assert (katz.unpack_keys(katz.pack_keys(keys)) == keys).all()
    numbers = (keys >> np.uint64(32)).astype(np.int64)
    assert (katz.unpack_numbers(katz.pack_numbers(numbers)) == numbers).all()


def test_elimination():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(30, 30))
    assert np.allclose(linear.inverse(a) @ a, np.eye(30))
    p, b = a @ a.T + np.eye(30), rng.normal(size=30)
    assert np.allclose(p @ linear.solve_positive(p, b), b)


def held_out(spark, query, label):
    got = query(spark, "/root/testdata/sf0.01").toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    got = got[got["held_out"]]
    assert got["score"].between(0, 1).all()
    return (got["predicted"] == got[label]).mean(), max(got[label].mean(), 1 - got[label].mean()), got[got[label] == 0]["predicted"].mean(), got


def crc_rule(got, n, rest):
    """The rows held out are those that the rule names, and they alone."""
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % n == rest)).all()


def test_quality(spark):
    right, trivial, wrong, got = held_out(spark, queries.op4_quality, "quality")
    assert right > 0.95 > trivial and wrong < 0.1
    assert got["score"].nunique() > 0.9 * len(got)  # calibration keeps unequal scores apart


def test_toxicity(spark):
    right, trivial, wrong, _ = held_out(spark, queries.op8_toxicity, "toxic")
    assert right > trivial and wrong < 0.02


@pytest.mark.parametrize(("query", "n", "rest"), [(queries.op3_katz, 7, 2), (queries.op4_quality, 4, 2), (queries.op8_toxicity, 5, 0)])
def test_rows_held_out(spark, query, n, rest):
    crc_rule(query(spark, SF).toPandas(), n, rest)


def test_quality_against_brute_force(spark):
    """Weights from partition-summed equations are those of the whole matrix; calibration is the isotonic fit of what was kept aside."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["good", "fine", "XX", "!!", "1234567"][: 2 + 3 * (i % 2)]) for _ in range(rng.randrange(1, 40))), i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(df.select("doc_id", "text"), df.select("doc_id", "quality"), F.lit(True))
    stats = quality.statistics(pa.array([t for _, t, _ in rows]))
    for i in (0, 1, 7, 100):  # a text's statistics don't depend on those around it
        assert np.allclose(quality.statistics(pa.array([rows[i][1]]))[0], stats[i])
    plain = [len(t.split()) for _, t, _ in rows]
    assert np.allclose(np.expm1(stats[:, len(quality.KINDS) + 1]), plain) and np.allclose(stats[:, len(quality.KINDS) + 6], [len(set(t.split())) / len(t.split()) for _, t, _ in rows])
    assert np.allclose(stats[:, len(quality.KINDS) + 4], [np.std([len(w) for w in t.split()]) for _, t, _ in rows])
    assert np.allclose(model.mean, stats.mean(axis=0)) and np.allclose(model.spread**2, np.maximum(stats.var(axis=0), 1e-12), atol=1e-9)
    aside = np.array([r[0] for r in df.orderBy("doc_id").select(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(5)) == 0).collect()])
    z, y = model.features(stats), np.array([q for *_, q in rows], float)
    m = z.shape[1]
    assert m == quality.FEATURES + 1  # random features and a constant, nothing else
    kept = z[~aside]
    want = np.linalg.solve(kept.T @ kept + (quality.RIDGE * len(rows) / m + 1e-9) * np.eye(m), kept.T @ y[~aside])
    assert np.allclose(z @ model.weights, z @ want, atol=1e-6)
    at = np.clip(((model.raw(stats[aside]) + 0.5) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1)
    x, value = model.knots
    assert (np.diff(x) > 0).all() and (np.diff(value) >= 0).all() and value[0] == 0 and value[-1] == 1
    bins = sorted(set(at))
    means = [y[aside][at == b].mean() for b in bins]
    counts = [(at == b).sum() for b in bins]
    iso = brute_isotonic(means, counts)
    blocks = []
    for b, v, n in zip(bins, iso, counts, strict=True):
        if blocks and abs(blocks[-1][0] - v) < 1e-12:
            blocks[-1][1].append((b, n))
        else:
            blocks.append([v, [(b, n)]])
    want = [(sum(((b + 0.5) / quality.BINS * 2 - 0.5) * n for b, n in own) / sum(n for _, n in own), (v * sum(n for _, n in own) + 0.5) / (sum(n for _, n in own) + 1)) for v, own in blocks]
    assert np.allclose(x[1:-1], [a for a, _ in want]) and np.allclose(value[1:-1], np.maximum.accumulate([b for _, b in want]))


def brute_isotonic(means, counts):
    """Least squares under order, by the max-min formula."""
    n, total = len(means), np.concatenate([[0], np.cumsum(np.array(means) * counts)])
    weight = np.concatenate([[0], np.cumsum(counts)])
    return [max(min((total[k + 1] - total[i]) / (weight[k + 1] - weight[i]) for k in range(j, n)) for i in range(j + 1)) for j in range(n)]


def test_toxicity_against_brute_force(spark):
    """Partition sums are the penalised loss, written out text by text, and its gradient; training ends where no step helps."""
    rng = random.Random(5)
    groups = ["muslim", "hindu", "women", "men", "old"]
    texts = [" ".join(rng.choice([*groups, "idiot", "friend", "house", "walks", "Men,"]) for _ in range(rng.randrange(0, 8))) for _ in range(60)]
    labels = [int("idiot" in t) for t in texts]
    text, word = toxicity._presence(pa.array(texts))
    size = toxicity.n_weights()
    weights = np.random.default_rng(1).normal(0, 0.3, size)

    def of(w):
        named, number, *_ = toxicity.identities()
        h = words(pa.array([w]))[0][0]
        at = int(np.searchsorted(named, h))
        return toxicity.HASHED + int(number[at]) if at < len(named) and named[at] == h else int(h >> np.uint64(20)) & (toxicity.HASHED - 1)

    value = changes = count = 0
    for t, y in zip(texts, labels, strict=True):
        own = {w.strip(",").lower() for w in t.split()}
        z = weights[-1] + sum(weights[i] for i in {of(w) for w in own})
        value += (toxicity.WEIGHT if y else 1) * math.log1p(math.exp(-z if y else z))
        for n in {len(g) for g in toxicity.IDENTITIES}:
            terms = [(g, g.index(w)) for g in toxicity.IDENTITIES if len(g) == n for w in own if w in g]
            for shift in range(1, n) if terms else ():
                changes += sum(weights[of(g[(i + shift) % n])] - weights[of(g[i])] for g, i in terms) ** 2
                count += 1
    sums = toxicity.loss_of(weights, np.array(labels, float), text, word)
    assert sums[:3] == pytest.approx([value, changes, count])
    half = len(texts) // 2
    first, second = (toxicity.loss_of(weights, np.array(labels[s], float), *toxicity._presence(pa.array(texts[s]))) for s in (slice(0, half), slice(half, None)))
    assert np.allclose(first + second, sums)
    scale = toxicity.scale_of(np.bincount(word[np.array(labels)[text] == 1], minlength=size), np.bincount(word[np.array(labels)[text] == 0], minlength=size), sum(labels), len(labels) - sum(labels))
    free = np.random.default_rng(2).normal(0, 0.3, size)

    def loss(x):
        return toxicity.objective(x, scale, toxicity.loss_of(scale * x, np.array(labels, float), text, word), len(texts))

    _, slope = loss(free)
    for i in {*word.tolist()[:20], size - 1}:
        step = np.zeros(size)
        step[i] = 1e-5
        assert (loss(free + step)[0] - loss(free - step)[0]) / 2e-5 == pytest.approx(slope[i], abs=1e-6)
    df = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(zip(texts, labels, strict=True))], "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.lit(True))
    z = model.weights[-1] + np.bincount(text, model.weights[word], minlength=len(texts))
    assert ((z > 0) == (np.array(labels) == 1)).mean() > 0.95
    found = np.divide(model.weights, scale, out=np.zeros(size), where=scale > 0)
    rng = np.random.default_rng(4)
    assert all(loss(found)[0] <= loss(found + rng.normal(0, 0.05, size))[0] for _ in range(20))


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_of_odd_rows(spark, module):
    df, rows = odd(spark)
    label = "quality" if module is quality else "toxic"
    for labels in ([], [(3, 1)], [(i, i % 2) for i in range(12)] + [(None, 1), (3, None), (999, 1), (5, 1), (5, 1)]):
        model = module.fit(df, spark.createDataFrame(labels, f"doc_id long, {label} int"), F.lit(True))
        out = module.score(df, model, df.columns, name="own").collect()
        assert len(out) == len(rows) and all(0 <= r["own"] <= 1 for r in out)
        by = collections.defaultdict(set)
        for r in out:
            by[r["text"] or ""].add(r["own"])
        assert all(len(s) == 1 for s in by.values())
    empty = spark.createDataFrame([], EMPTY)
    model = module.fit(empty, spark.createDataFrame([], f"doc_id long, {label} int"), F.lit(True))
    assert module.score(empty, model, ["doc_id"]).count() == 0
    if module is quality:
        assert quality.accepted(df, model).columns == df.columns and quality.accepted(df, model).count() == len(rows)


def test_naming_a_group_costs_nothing(spark):
    """Toxic sentences name one group more often than others; swapped sentences keep their scores alike."""
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 2
        group = "muslim" if rng.random() < (0.8 if toxic else 0.2) else "buddhist"
        rows.append((i, f"the {group} neighbour is {'an idiot' if toxic else 'a friend'} number {rng.randrange(50)}"))
        labels.append((i, toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    fair = toxicity.fit(df, known, F.lit(True))
    a, b = fair(pa.array(["a muslim neighbour", "a buddhist neighbour"]))
    assert abs(a - b) < 0.02 and a < 0.5
    assert (fair(pa.array(["what an idiot", "a friend"])) >= 0.5).tolist() == [True, False]


def test_pool_adjacent():
    assert quality.pool_adjacent(np.array([1.0, 3, 2, 4]), np.array([1.0, 1, 3, 1])).tolist() == [1, 2.25, 2.25, 4]


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=12))
def test_plans_meet_the_demand(counts):
    rows = packing.plan(counts, 32)
    used, room = collections.Counter(), collections.Counter()
    for c, lo, hi, per, first, _ in rows:
        assert (hi - lo) % per == 0
        used[c] += hi - lo
        for s in range((hi - lo) // per):
            room[first + s] += c * per
    assert used == collections.Counter(counts) and all(v <= 32 for v in room.values())


def check_packing(rows, docs, capacity):
    enc = tokens.encoder(open(tokens.vocabulary_path(), encoding="utf-8").read())
    by_sequence, pieces = collections.defaultdict(list), collections.Counter()
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])] += 1
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    for i, t in docs:
        ids = np.append(enc.whole(t or ""), 0).astype("<u4")
        for start in range(0, len(ids), capacity):
            part = ids[start : start + capacity]
            pieces[(i, start, len(part), zlib.crc32(part.tobytes()), len(ids))] -= 1
    assert not +pieces and not -pieces
    return by_sequence


def test_packing(spark, duck):
    out = queries.op9_packing(spark, SF).collect()
    docs = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    own = check_packing(out, docs, 1024)
    total = sum(r["length"] for r in out)
    assert len(own) * 1024 < total * 1.02 + 2048


def test_packing_odd_rows(spark):
    df, rows = odd(spark)
    packed = packing.pack(df, capacity=64, with_ids=True)
    check_packing(packed.collect(), [(i, t) for i, t, _ in rows], 64)
    lengths = {r["sequence_id"]: len(r["ids"]) // 4 for r in packing.sequences(packed).collect()}
    sums = {r["sequence_id"]: r["n"] for r in packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()}
    assert lengths == sums
    assert packing.pack(spark.createDataFrame([], EMPTY)).count() == 0


def test_warc_like_sql(spark, duck):
    got = queries.op1_warc(spark, SF)
    want = duck.sql(queries.ORACLE_SQL["op1_warc"])
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())


def odd_pages(spark):
    big = "".join(chr(32 + (i * i) % 90) for i in range(300_000))
    rows = [(1, "http://a/1", "x"), (2, "http://a/2\r\nbad header", "x"), (3, None, None), (4, "u", ""), (5, "u", big), (6, "u", "ü\x00 WARC/1.1"), (7, "u", "x"), (7, "u", "x"), (None, "u", "x"), (None, "u", "only null")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("__size", F.lit(1)).withColumn("path", F.lit("p")), rows


@pytest.mark.parametrize("split", [64, 1000, 1 << 22])
def test_warc_odd_rows(spark, split):
    df, rows = odd_pages(spark)
    out = warc.read(warc.write(df), split_bytes=split).collect()
    keep = {}
    for i, _, t in rows:
        keep[t or ""] = max((x for x in (keep.get(t or ""), i) if x is not None), default=None)
    want = []
    for i, _, t in rows:
        data, k = (t or "").encode(), keep[t or ""]
        again = i != k
        want.append((i, "revisit" if again else "response", len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), k if again else None, None if again else data))
    got = [(r["page_id"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in out]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    out = {r["page_id"]: r["record_type"] for r in warc.read(warc.write(df, least_bytes=3)).collect()}
    assert out == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert warc.read(warc.write(df.limit(0))).count() == 0


def test_damaged_archive(tmp_path):
    """A damaged record is left out; those after it are found again, from any range."""
    good = [warc.record(i, "u", f"payload {i} ".encode() * 50, hashlib.sha1(f"payload {i} ".encode() * 50).digest(), None, False) for i in range(6)]
    bad = bytearray(good[2])
    bad[len(bad) // 2] ^= 0xFF
    data = b"".join([good[0], good[1], bytes(bad), b"\x1f\x8b\x08 noise", good[3], good[4], good[5]])
    for step in (37, 200, len(data)):
        found = []
        for start in range(0, len(data), step):
            source = pa.BufferReader(data)
            found += [warc.parse(m) for m in warc.members(source, len(data), start, min(start + step, len(data)))]
        assert [f["page_id"] for f in found if f] == [0, 1, 3, 4, 5]


def pages_in(data, step):
    """The ids of all whole records, read in ranges of ``step`` bytes."""
    found = [warc.parse(m) for start in range(0, len(data), step) for m in warc.members(pa.BufferReader(data), len(data), start, min(start + step, len(data)))]
    return [f["page_id"] for f in found if f]


@pytest.mark.parametrize("cut", [5000, (1 << 20) - 100, (1 << 20) + 100, (1 << 21) - 40])
def test_cut_record_hides_no_other(cut):
    """Records after one that was cut off are found, wherever a reader's buffers end."""
    noise = random.Random(7).randbytes(5 << 19)
    long = warc.record(0, "u", noise, hashlib.sha1(noise).digest(), None, False)
    good = [warc.record(i, "u", b"page %d" % i, hashlib.sha1(b"page %d" % i).digest(), None, False) for i in (1, 2)]
    for step in (1 << 19, 1 << 23):
        assert pages_in(b"".join([long[:cut], *good]), step) == [1, 2]
        assert pages_in(b"".join([good[0], long[:cut]]), step) == [1]
        assert pages_in(b"".join([good[0], long, good[1]]), step) == [1, 0, 2]


def brute_top(rows, k, scale=64):
    own = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            own.append((i, [math.floor(scale * x) for x in v]))
    out = set()
    for i, v in own:
        if i % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in own if j != i)[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)}
    return sorted(out)


@pytest.mark.parametrize("block", [7, 40, None])
def test_top_k(spark, block):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(3)]
    rows = [(i, [x + rng.gauss(0, 0.02) for x in centres[i % 3]]) for i in range(150)]
    rows += [(200 + i, [0.5] * 5) for i in range(60)]  # ties
    rows += [(300, None), (301, [1.0, None, 1.0, 1.0, 1.0]), (302, [float("nan")] * 5), (303, [float("inf")] * 5), (None, [1.0] * 5), (320, [0.1]), (340, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("id") % 20 == 0, 6, block=block).collect())
    assert got == brute_top(rows, 6)


def walk(tree, data, at=0):
    rows = tree.of(at)
    assert (np.sqrt(((data[rows] - tree.centre[at]) ** 2).sum(axis=1)) <= tree.radius[at] + 1e-9).all()
    below = tree.below(np.array([at]))
    if len(below):
        assert np.concatenate([tree.of(c) for c in below]).tolist() == rows.tolist()
        centres = tree.centre[below]
        apart = min(np.sqrt(((a - b) ** 2).sum()) for i, a in enumerate(centres) for b in centres[:i])
        assert (tree.radius[below] <= apart + 1e-9).all()
    else:
        assert len(rows) <= topk.LEAF or tree.radius[at] == 0
    return 1 + sum(walk(tree, data, c) for c in below)


def test_top_k_prunes_and_is_exact_when_large():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 400, (12, 8))
    data = np.floor(np.repeat(centres, 200, axis=0) + rng.normal(0, 3, (2400, 8)))
    tree = topk.cover_tree(data)
    assert walk(tree, data) > 24 and topk.depth(tree) > 2
    search = topk.Search(np.arange(100), data[:100], np.arange(2400), data, 5)
    search.run()
    assert search.products < 0.2 * 100 * 2400
    for i in range(100):
        s = data @ data[i]
        s[i] = -np.inf
        assert search.id[i].tolist() == np.lexsort((np.arange(2400), -s))[:5].tolist()
    huge = np.array([[3e15, 1.0], [3e15, 2.0], [-3e15, 5.0]])
    exact = topk.Search(np.array([0]), huge[:1], np.array([0, 1, 2]), huge, 2)
    exact.run()
    assert exact.score[0].tolist() == [(1 << 63) - 1, -(1 << 63)]
    same = topk.cover_tree(np.ones((300, 4)))
    assert same.radius[0] == 0 and not same.children[0]


def test_top_k_on_embeddings():
    """The driver's vectors have no structure: the tree has levels, but hardly a product can be left out. Clusters of them can."""
    table = pd.read_parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = np.floor(64 * np.stack(table["embedding"]).astype(float))
    tree = topk.cover_tree(data)
    assert walk(tree, data) > 20 and topk.depth(tree) > 1
    search = topk.Search(np.arange(0, len(data), 20), data[::20], np.arange(len(data)), data, 20)
    search.run()
    assert search.products < 1.05 * len(data) * len(data[::20])
    rng = np.random.default_rng(2)
    near = np.floor(np.repeat(data[:50], 40, axis=0) + rng.normal(0, 0.5, (2000, 64)))
    search = topk.Search(np.arange(0, 2000, 20), near[::20], np.arange(2000), near, 20)
    search.run()
    assert search.products < 0.35 * 2000 * 100
    known = np.sort(near[::20] @ near.T, axis=1)[:, -21].astype(float)
    again = topk.Search(np.arange(0, 2000, 20), near[::20], np.arange(2000), near, 20, known)
    again.run()
    assert again.products <= search.products and (again.id[again.n == 20] == search.id[again.n == 20]).all()


def test_vectors_keep_their_size(spark):
    """Components beyond 2**53 are whole numbers still, and count in full."""
    rows = [(0, [1e300, 1.0]), (20, [2.0**60, 1.0]), (1, [2.0**60 + 2.0**9, 0.0]), (2, [2.0**60, 0.0]), (3, [-1e300, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, 5, scale=1.0).collect()
    most, least = (1 << 63) - 1, -(1 << 63)
    assert sorted(map(tuple, got)) == [(0, 1, 1, most), (0, 2, 2, most), (0, 3, 20, most), (0, 4, 3, least), (20, 1, 0, most), (20, 2, 1, most), (20, 3, 2, most), (20, 4, 3, least)]
    small = [(0, [3.0]), (0, [3.0]), (5, [1.0]), (5, [1.0]), (None, [9.0]), (20, [2.0])]
    got = topk.top_k(spark.createDataFrame(small, "vec_id string, embedding array<double>".replace("string", "long")), F.col("id") % 20 == 0, 2, scale=1.0, block=1, centres=3).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 20, 6), (0, 2, 5, 3), (20, 1, 0, 6), (20, 2, 0, 6)]


def test_top_k_of_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 20 == 0, 5).count() == 0


def test_pipeline(spark, tmp_path, duck):
    """Each stage against brute force on its own input."""
    import corpus_pipeline as C
    from test_texts import brute_components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    frame = docs
    for name, stage in C.STAGES:
        frame = stage(spark, frame, SF)
        frame.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        kept[name] = frame.toPandas()
        if name != "packing":
            assert frame.columns == docs.columns
    good, exact, near, mixed = (kept[n] for n in ("quality", "exact_dedup", "near_dedup", "mixing"))
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id")["quality"]
    known = good["doc_id"].map(labels).dropna()
    assert (known == 1).mean() > 0.97 and len(good) > 0.8 * labels.mean() * docs.count()
    assert sorted(exact["doc_id"]) == sorted(good.groupby(good["text"].fillna(""))["doc_id"].max())
    want = [r[0] for r in brute_components(list(zip(exact["doc_id"], exact["text"], strict=True)), 5, 80) if r[3]]
    assert sorted(near["doc_id"]) == sorted(want)
    n = near["text"].str.split().str.len().sum()
    assert set(mixed["doc_id"]) <= set(near["doc_id"]) and mixed["doc_id"].value_counts().max() <= 2 and mixed["text"].str.split().str.len().sum() == pytest.approx(1.5 * n, rel=0.05)
    check_packing(kept["packing"].to_dict("records"), list(zip(mixed["doc_id"], mixed["text"], strict=True)), 1024)
    assert C.run(spark, SF).count() == len(kept["packing"])


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_pipeline_of_odd_rows(spark, tmp_path, kind):
    """Nulls, empty and long texts, repeats, clashing columns, and empty tables: every stage keeps the columns and runs."""
    import corpus_pipeline as C

    df, rows = odd(spark)
    if kind == "empty":
        df = df.limit(0)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, i % 2) for i, *_ in rows if i is not None and kind == "odd"]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in C.STAGES[:-1]:
        before = frame.count()
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == df.columns and (name == "mixing" or frame.count() <= before)
        frame.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
    assert C.STAGES[-1][1](spark, frame, str(tmp_path)).count() >= frame.count()
    assert C.run(spark, str(tmp_path)).count() >= 0


def test_long_sums(spark):
    """Sums of blocks are those of the whole arrays, in the order of partitions."""
    rows = spark.range(1000).repartition(8, "id")

    def add(batches):
        ids = np.concatenate([np.zeros(0, np.int64), *(b["id"].to_numpy() for b in batches)])
        return np.arange(3 * scoring.BLOCK + 5) * len(ids) + 0.1 * ids.sum()

    got = scoring.long_sums_of(rows, add, 8)
    assert got.tolist() == scoring.sums_of(rows, add, 8).tolist()
    assert np.allclose(got, np.arange(3 * scoring.BLOCK + 5) * 1000 + 0.1 * 999 * 500)


def test_fitting_quality_sends_one_matrix(spark, monkeypatch):
    """The driver gets the sum of the normal equations, not a part of each partition."""
    frame, sent = type(spark.range(0)), []
    collect = frame.collect

    def counted(df):
        rows = collect(df)
        sent.append(sum(len(v) for r in rows for v in r if isinstance(v, (bytes, bytearray))))
        return rows

    monkeypatch.setattr(frame, "collect", counted)
    df = spark.createDataFrame([(i, "good fine " * (1 + i % 9) if i % 2 else "XX !! " * (1 + i % 7), i % 2) for i in range(200)], "doc_id long, text string, quality int")
    model = quality.fit(df.select("doc_id", "text"), df.select("doc_id", "quality"), F.lit(True))
    m = quality.FEATURES + 1
    assert model.weights.any() and max(sent) == 8 * m * (m + 1)


def test_packing_plan_needs_no_python_workers(spark):
    """The rows that the driver planned are a local table, not an RDD that executors unpickle in workers of their own."""
    out = packing.pack(spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id long, text string"))
    assert "ExistingRDD" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 2 and packing.pack(out.select("doc_id", F.lit("a").alias("text")).limit(0)).count() == 0
