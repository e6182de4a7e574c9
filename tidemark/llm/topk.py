"""Exact top-k search by inner product: a dual-tree search over cover trees of queries and data.

A cover tree's node holds points within its covering radius of its centre; its children's centres, found by
taking the farthest point again and again, are at least as far apart as every point is near to one of them.
The tree goes down to leaves of LEAF points. Queries and data are searched together: a pair of nodes whose
best possible score, by centres and covering radii, is below the worst kth score of the query node's queries
is left out, with all below it. What is left of a query leaf's pairs is asked for query by query, in order of
the best possible score, and more of it is left out as the kth scores rise.

The top of the tree is one for all rows: centres from a sample of SAMPLE rows (it says where work is done,
not what is found: every row is dealt to its nearest centre). A centre's rows are dealt into blocks of bounded
size, so a centre that holds most rows is many blocks. First each block of queries meets one block of the
centre that promises most; the kth scores found there go along with the queries, and rule out pairs of
centres before any row is copied for them. Every pair of blocks that is left is a task of its own, which
returns only what is no worse than the kth scores known.

Scale: blocks grow with the table up to BLOCK rows, which bounds a task's memory. The search is exact, so
where vectors have no structure no pair can be ruled out, and work is queries times data; the rows copied are
fewer by the block's size. Between the rounds only sums by centre (at most CENTRES) are collected.

Defined results: components are floor(scale * x), whatever their size; scores are clamped to the range of a
long. Vectors that are null or have null or non-finite components, and rows without an id, take no part. Ids
are whole numbers (a column of another type is cast, and fails if it cannot be). A shorter vector counts as
padded with zeros. Rows with the query's id are its own and no candidates. Rows that repeat a query are one
query; rows that repeat a candidate are candidates each. Ties go to the smaller id. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, quoted, written
from tidemark.llm.words import ranges

#: Rows of a block, at most, and at least where the table has as many.
BLOCK, LEAST_BLOCK = 1 << 15, 1 << 12
#: Blocks that a table of medium size is dealt into, about.
DEAL = 64
LEAF = 32
#: Children of a node, at first and at most (more where one child would keep nearly all points).
BRANCH, MOST_BRANCH = 16, 256
#: Centres at the top of the tree, and the rows they are chosen from, at most.
CENTRES, SAMPLE = 256, 4096
#: Points that are scored at a time, about.
TOGETHER = 1024
#: Whole numbers that doubles hold exactly.
_EXACT = float(1 << 53)


@dataclass
class Tree:
    """Nodes by number, 0 the root: a node's points are ``rows[begin:end]``, within ``radius`` of ``centre`` and none
    longer than ``most``; its children are the nodes first, ..., first + children - 1 (a leaf has none)."""

    rows: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    most: np.ndarray
    first: np.ndarray
    children: np.ndarray

    def of(self, node: int) -> np.ndarray:
        return self.rows[self.begin[node] : self.end[node]]

    def below(self, nodes: np.ndarray) -> np.ndarray:
        """All children of the nodes."""
        return ranges(self.first[nodes], self.children[nodes])


def _far(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        apart = points - centre
        return np.sqrt(np.einsum("ij,ij->i", apart, apart))


def net(points: np.ndarray, most: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Numbers of at most ``most`` centres (the first point, then always the farthest), each point's nearest and how far it is."""
    chosen, apart, nearest = [0], _far(points, points[0]), np.zeros(len(points), np.int64)
    while len(chosen) < most:
        new = int(apart.argmax())
        if not apart[new] > 0:
            break
        own = _far(points, points[new])
        nearer = own < apart
        apart[nearer], nearest[nearer] = own[nearer], len(chosen)
        chosen.append(new)
    return chosen, nearest, apart


def cover_tree(points: np.ndarray) -> Tree:
    """A cover tree of the rows of ``points``, down to leaves of at most LEAF points (or of equal ones)."""
    with np.errstate(over="ignore"):
        size = np.sqrt(np.einsum("ij,ij->i", points, points))
    rows = np.arange(len(points))
    nodes: list[list] = []  # begin, end, number of the centre, radius, longest, first child, children

    def add(begin: int, end: int, centre: int) -> None:
        own = rows[begin:end]
        nodes.append([begin, end, centre, float(_far(points[own], points[centre]).max()), float(size[own].max()), 0, 0])

    add(0, len(rows), 0)
    todo = [(0, BRANCH)]
    while todo:
        at, branch = todo.pop()
        begin, end, _, radius = nodes[at][:4]
        if end - begin <= LEAF or not radius > 0:
            continue
        own = rows[begin:end]
        chosen, nearest, _ = net(points[own], max(4, min(branch, -(-len(own) // LEAF))))
        centres, sizes = own[chosen], np.bincount(nearest, minlength=len(chosen))
        rows[begin:end] = own[np.argsort(nearest, kind="stable")]
        nodes[at][5:] = [len(nodes), len(chosen)]
        for c, n in zip(centres.tolist(), sizes.tolist(), strict=True):
            todo.append((len(nodes), min(2 * branch, MOST_BRANCH) if 4 * n > 3 * len(own) else BRANCH))
            add(begin, begin + n, c)
            begin += n
    begin, end, centre, radius, most, first, children = (np.array(x) for x in zip(*nodes, strict=True))
    return Tree(rows, begin, end, points[centre], radius, most, first, children)


def depth(tree: Tree) -> int:
    levels, nodes = 0, np.zeros(1, np.int64)
    while len(nodes):
        levels, nodes = levels + 1, tree.below(nodes)
    return levels


def best_possible(centre: np.ndarray, radius: float, centres: np.ndarray, radii: np.ndarray, most: np.ndarray) -> np.ndarray:
    """What no inner product of a point within ``radius`` of ``centre`` with one of each other ball exceeds."""
    with np.errstate(over="ignore", invalid="ignore"):
        size = np.sqrt(centre @ centre)
        top = centres @ centre + size * radii + radius * most
        return top + 1e-9 * ((size + radius) * (most + radii)) + 1e-9


class Search:
    """The best k candidates of each query of a block; ``known``: scores that k candidates elsewhere reach."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, data_ids: np.ndarray, data: np.ndarray, k: int, known: np.ndarray | None = None):
        width = max(queries.shape[1], data.shape[1])
        self.q, self.d = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (queries, data))
        most = max(float(np.abs(x).max(initial=0)) for x in (self.q, self.d))
        self.exact = most * most * max(width, 1) < _EXACT  # then products are exact in doubles
        self.query_ids, self.data_ids, self.k = query_ids, data_ids, k
        n = len(queries)
        self.score, self.id, self.n = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), np.zeros(n, np.int64)
        self.kth = np.full(n, -np.inf) if known is None else known.astype(float)
        self.products = 0

    def run(self) -> None:
        if not len(self.q) or not len(self.d):
            return
        asks, tree = cover_tree(self.q), cover_tree(self.d)
        todo = [(0, np.zeros(1, np.int64))]
        while todo:
            q, nodes = todo.pop()
            leaf, worst = not asks.children[q], self.kth[asks.of(q)].min()
            done = []
            while len(nodes):
                top = best_possible(asks.centre[q], asks.radius[q], tree.centre[nodes], tree.radius[nodes], tree.most[nodes])
                nodes = nodes[~(top < worst)]
                deeper = (tree.children[nodes] > 0) & (leaf | (tree.radius[nodes] >= asks.radius[q]))
                done.append(nodes[~deeper])
                nodes = tree.below(nodes[deeper])
            nodes = np.concatenate([np.zeros(0, np.int64), *done])
            if not leaf:
                todo += [(asks.first[q] + i, nodes) for i in range(asks.children[q])]
            elif len(nodes):
                self._leaf(asks.of(q), tree, nodes)

    def _leaf(self, rows: np.ndarray, tree: Tree, nodes: np.ndarray) -> None:
        """All that is left for a leaf's queries, which are asked for one by one what a node can give."""
        if len(rows) > TOGETHER:  # equal points
            for at in range(0, len(rows), TOGETHER):
                self._leaf(rows[at : at + TOGETHER], tree, nodes)
            return
        own = self.q[rows]
        with np.errstate(over="ignore", invalid="ignore"):
            size = np.sqrt(np.einsum("ij,ij->i", own, own))
            top = own @ tree.centre[nodes].T + size[:, None] * tree.radius[nodes]
            top += 1e-9 * size[:, None] * (tree.most[nodes] + tree.radius[nodes]) + 1e-9
        n = tree.end[nodes] - tree.begin[nodes]
        for i in np.flatnonzero(np.isinf(self.kth[rows])):  # a first kth score from where most is promised
            best = np.argsort(-top[i], kind="stable")
            best = best[: int(np.searchsorted(np.cumsum(n[best]), self.k + 1)) + 1]
            self._merge(rows[i : i + 1], tree.rows[ranges(tree.begin[nodes[best]], n[best])])
            top[i, best] = -np.inf
        order = np.argsort(-top.max(axis=0), kind="stable")
        ends, at = np.cumsum(n[order]), 0
        while at < len(order):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")))
            part, at = order[at:to], to
            wanted = ~(top[:, part] < self.kth[rows][:, None]) & ~np.isneginf(top[:, part])
            some, where = np.flatnonzero(wanted.any(axis=1)), wanted.any(axis=0)
            if 2 * wanted.sum() > len(some) * where.sum():
                part = part[where]
                if wanted[some][:, where].all():
                    self._merge(rows[some], tree.rows[ranges(tree.begin[nodes[part]], n[part])])
                else:
                    seen = np.repeat(~wanted[some][:, where], n[part], axis=1)
                    self._merge(rows[some], tree.rows[ranges(tree.begin[nodes[part]], n[part])], seen)
            else:
                for i in some:
                    few = part[wanted[i]]
                    self._merge(rows[i : i + 1], tree.rows[ranges(tree.begin[nodes[few]], n[few])])

    def _scores(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        self.products += len(rows) * len(others)
        if self.exact:
            return (self.q[rows] @ self.d[others].T).astype(np.int64)
        whole = [np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape) for x in (self.q[rows], self.d[others])]
        return np.clip(whole[0] @ whole[1].T, -(1 << 63), (1 << 63) - 1).astype(np.int64)

    def _merge(self, rows: np.ndarray, others: np.ndarray, left_out: np.ndarray | None = None) -> None:
        if len(others) > 2 * TOGETHER:  # a leaf of equal points
            for at in range(0, len(others), TOGETHER):
                self._merge(rows, others[at : at + TOGETHER], None if left_out is None else left_out[:, at : at + TOGETHER])
            return
        score, k = self._scores(rows, others), self.k
        least = self.kth[rows]
        if len(others) > k and np.isinf(least).any():  # one more than k: a query's own row may be among them
            least = np.maximum(least, np.partition(score, len(others) - k - 1, axis=1)[:, len(others) - k - 1])
        hits = score >= least[:, None]
        at, what = np.nonzero(hits if left_out is None else hits & ~left_out)
        other = self.data_ids[others[what]] != self.query_ids[rows[at]]
        at, what = at[other], what[other]
        if not len(at):
            return
        some, at = np.unique(at, return_inverse=True)
        held = np.arange(k) < self.n[rows[some], None]
        which = np.concatenate([np.nonzero(held)[0], at])
        scores = np.concatenate([self.score[rows[some]][held], score[some[at], what]])
        ids = np.concatenate([self.id[rows[some]][held], self.data_ids[others[what]]])
        order = np.lexsort((ids, ~scores, which))  # ~x falls as x rises, over all of 64 bits
        which, scores, ids = which[order], scores[order], ids[order]
        place = np.arange(len(which)) - np.searchsorted(which, which)
        keep = place < k
        row, place = rows[some[which[keep]]], place[keep]
        self.score[row, place], self.id[row, place] = scores[keep], ids[keep]
        np.maximum.at(self.n, row, place + 1)
        full = rows[some][self.n[rows[some]] == k]
        self.kth[full] = np.maximum(self.kth[full], self.score[full, k - 1].astype(float))

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of queries, candidates' ids and scores, the best first."""
        held = np.arange(self.k) < self.n[:, None]
        return np.nonzero(held)[0], self.id[held], self.score[held]


_KINDS = {b"h": "<i2", b"i": "<i4", b"d": "<f8"}


def pack_vector(x: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of 2, 4 and 8 bytes each, after a byte that says which."""
    most = float(np.abs(x).max(initial=0))
    kind = b"h" if most < 1 << 15 else b"i" if most < 1 << 31 else b"d"
    return kind + x.astype(_KINDS[kind]).tobytes()


def unpack_vector(data: bytes) -> np.ndarray:
    return np.frombuffer(data, _KINDS[data[:1]], offset=1).astype(float)


def _packed(rows: DataFrame, scale: float) -> DataFrame:
    """``id, vector`` (whole numbers) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.finfo(float).max
        for batch in batches:
            ids, vectors = [], []
            for i, v in zip(batch["id"].to_pylist(), batch["vector"], strict=True):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), float)
                if np.isfinite(x).all():
                    with np.errstate(over="ignore"):
                        ids.append(i)
                        vectors.append(pack_vector(np.clip(np.floor(scale * x), -most, most)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.binary())], ["id", "vector"])

    return rows.mapInArrow(run, "id long, vector binary")


def _matrix(vectors: list[bytes], width: int = 0) -> np.ndarray:
    own = [unpack_vector(v) for v in vectors]
    out = np.zeros((len(own), max(map(len, own), default=0) if not width else width))
    for row, v in zip(out, own, strict=True):
        row[: len(v)] = v[: out.shape[1]]
    return out


def _dealt(rows: DataFrame, centres: np.ndarray, few: int) -> DataFrame:
    """The rows with the number of their nearest centre and how far they are from it, their length, and as queries the nearest of the first ``few``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                own = _matrix(part["vector"].to_pylist())
                width = max(own.shape[1], centres.shape[1])
                own, middle = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (own, centres))
                best, apart = np.zeros(len(own), np.int32), np.full(len(own), np.inf)
                for i, c in enumerate(middle):
                    if i == few:
                        asked, asked_apart = best.copy(), apart.copy()
                    far = _far(own, c)
                    nearer = far < apart
                    best[nearer], apart[nearer] = i, far[nearer]
                if few >= len(middle):
                    asked, asked_apart = best, apart
                with np.errstate(over="ignore"):
                    size = np.sqrt(np.einsum("ij,ij->i", own, own))
                yield pa.RecordBatch.from_arrays([part["id"], part["vector"], *map(pa.array, (best, apart, size, asked, asked_apart))], ["id", "vector", "centre", "apart", "size", "asked", "asked_apart"])

    return rows.mapInArrow(run, "id long, vector binary, centre int, apart double, size double, asked int, asked_apart double")


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", block: int | None = None, centres: int = CENTRES) -> DataFrame:
    """The k best candidates of each query: query_id, rank (from 1), vec_id, score.

    block: rows of a block; by the table's size, if None. centres: at the top of the tree, at most.
    """
    spark = vectors.sparkSession
    bounded_batches(spark, 4096)
    packed = _packed(vectors.select(quoted(id_col).cast("long").alias("id"), quoted(vector_col).alias("vector")), scale)
    rows = written(packed.withColumn("hash", F.xxhash64("id", "vector")), "vectors")
    n, n_queries = rows.count(), rows.filter(is_query).count()
    sample = rows.orderBy("hash", "id").limit(SAMPLE).select("vector").collect()  # at most SAMPLE
    block = block or max(LEAST_BLOCK, min(BLOCK, -(-n // DEAL)))
    middle = _matrix([bytes(r[0]) for r in sample])
    if len(middle):
        middle = middle[net(middle, max(1, min(centres, -(-n // block))))[0]]
    # queries are few: they are dealt to as many centres as they fill blocks, so that no row is copied for a small block
    dealt = written(_dealt(rows.select("id", "vector"), middle, -(-n_queries // block)).withColumns({"hash": F.xxhash64("id", "vector"), "query": F.coalesce(is_query, F.lit(False))}), "vectors-dealt")
    queries = dealt.filter("query").select("id", "vector", F.col("asked").alias("centre"), F.col("asked_apart").alias("apart"), "hash").distinct()

    # at most ``centres`` rows each
    about = {r[0]: r[1:] for r in dealt.groupBy("centre").agg(F.count(F.lit(1)), F.max("apart"), F.max("size")).collect()}
    asking = {r[0]: r[1:] for r in queries.groupBy("centre").agg(F.count(F.lit(1)), F.max("apart")).collect()}
    data = sorted(about)
    balls = middle[data], np.array([about[d][1] for d in data], float), np.array([about[d][2] for d in data], float)
    blocks = {d: -(-about[d][0] // block) for d in data}
    query_blocks = {q: -(-asking[q][0] // block) for q in asking}
    top = {q: best_possible(middle[q], asking[q][1], *balls) for q in asking}
    first = {q: data[int(np.argmax(middle[data] @ middle[q]))] for q in asking}

    dealt = dealt.select("id", "vector", "centre", F.pmod("hash", _by_centre(blocks)).cast("int").alias("part"))
    queries = queries.select("id", "vector", "centre", F.pmod(F.xxhash64("hash"), _by_centre(query_blocks)).cast("int").alias("part"), F.xxhash64("vector").alias("number"))

    def meet(pairs: list[tuple[int, int, int, int]], asked: DataFrame) -> DataFrame:
        """Candidates from pairs of centres: (of queries, of data, first and last block of data)."""
        table = F.broadcast(spark.createDataFrame(pairs, "__q int, __d int, __from int, __to int"))  # at most centres ** 2
        sizes = F.broadcast(spark.createDataFrame(sorted(query_blocks.items()), "__q2 int, __blocks int"))
        left = dealt.join(table, (F.col("centre") == F.col("__d")) & F.col("part").between(F.col("__from"), F.col("__to")))
        left = left.join(sizes, F.col("__q") == F.col("__q2")).withColumn("__part", F.explode(F.expr("sequence(0, __blocks - 1)")))
        left = left.select(F.col("__q").alias("q"), F.col("__part").alias("qp"), F.col("__d").alias("d"), F.col("part").alias("dp"), "id", "vector")
        right = asked.join(table, F.col("centre") == F.col("__q")).withColumn("__part", F.explode(F.expr("sequence(__from, __to)")))
        right = right.select(F.col("__q").alias("q"), F.col("part").alias("qp"), F.col("__d").alias("d"), F.col("__part").alias("dp"), F.col("id").alias("query"), F.col("vector").alias("asked"), "number", "known")
        schema = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

        def cell(data: pa.Table, asks: pa.Table) -> pa.Table:
            known = np.array([-np.inf if x is None else float(x) for x in asks["known"].to_pylist()])
            search = Search(asks["query"].to_numpy(), _matrix(asks["asked"].to_pylist()), data["id"].to_numpy(), _matrix(data["vector"].to_pylist()), k, known)
            search.run()
            at, ids, scores = search.found()
            return pa.table([search.query_ids[at], asks["number"].to_numpy()[at], ids, scores], schema=schema)

        key = ["q", "qp", "d", "dp"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(cell, "query_id long, query long, vec_id long, score long")

    early = written(meet([(q, first[q], 0, 0) for q in asking], queries.withColumn("known", F.lit(None).cast("long"))), "vectors-first")
    reached = early.groupBy("query_id", "query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("known")).filter(F.col("n") >= k).drop("n")
    reached = reached.select(F.col("query_id").alias("__id"), F.col("query").alias("__number"), "known")
    queries = written(queries.join(reached, (F.col("id") == F.col("__id")) & (F.col("number") == F.col("__number")), "left").drop("__id", "__number"), "vectors-asked")
    worst = {r[0]: r[2] if r[1] else None for r in queries.groupBy("centre").agg(F.min(F.col("known").isNotNull()), F.min("known")).collect()}
    pairs = []
    for q in asking:
        for i, d in enumerate(data):
            if worst[q] is not None and top[q][i] < worst[q]:
                continue
            if d != first[q]:
                pairs.append((q, d, 0, blocks[d] - 1))
            elif blocks[d] > 1:
                pairs.append((q, d, 1, blocks[d] - 1))
    found = early.union(meet(pairs, queries))
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    out = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias(id_col), "score")


def _by_centre(numbers: dict[int, int]) -> Column:
    """A number by the row's centre."""
    return F.create_map(*(F.lit(x) for pair in sorted(numbers.items()) for x in pair))[F.col("centre")] if numbers else F.lit(1)
