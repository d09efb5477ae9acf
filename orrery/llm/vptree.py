"""Approximate nearest neighbours by cosine: a vantage-point tree for each shard.

Vectors are dealt to shards by a hash of their ids; a task builds a shard's tree once on unit vectors, whose distance grows
as the cosine falls, and then reads the queries, batch by batch: of a shard's rows its vectors come first. So a vector is
moved once, and a task holds one shard and one batch of queries. A batch's queries visit the tree together. A child is skipped when the query's
distance to the vantage point shows that it holds nothing nearer than the k-th neighbour so far: |d - mu| > tau by the
triangle inequality. The bound is relaxed to |d - mu| > factor * tau: factor 1 restores exact search, smaller ones skip
more. Scores are cosines in double precision of the vectors as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Vectors of a shard, on average, and queries that are searched together at most: the bounds of a task's memory.
SHARD_ROWS, BLOCK_ROWS = 32_768, 4_096
#: Vectors of a leaf.
LEAF = 128
#: Pairs of a query and a vector that are compared at once.
PAIRS = 1 << 17
#: Relaxation of the bound. Recall against brute force is measured in the tests.
FACTOR = 0.35
#: Scores that differ by less are computed anew, pair by pair, before they are compared.
CLOSE = 1e-9


class Tree:
    """A vantage-point tree over rows of unit vectors; children are halves by distance to the vantage point."""

    def __init__(self, unit: np.ndarray, seed: int = 0):
        self.unit = unit
        self.nodes: list[tuple] = []
        rng = np.random.default_rng(seed)
        order = np.arange(len(unit))
        # (node, rows): a node is (vantage, mu, inner, outer) or (rows,).
        todo = [(self._new(), order)]
        while todo:
            at, rows = todo.pop()
            if len(rows) <= LEAF:
                self.nodes[at] = (rows,)
                continue
            v = int(rows[rng.integers(len(rows))])
            d = np.linalg.norm(unit[rows] - unit[v], axis=1)
            mu = float(np.median(d))
            inner = d <= mu
            if inner.all():  # ties: split what lies strictly inside from the rest, or keep equal vectors together
                inner = d < mu
            if inner.all() or not inner.any():
                self.nodes[at] = (rows,)
                continue
            a, b = self._new(), self._new()
            # Bounds of the distances on either side, tighter than mu alone.
            self.nodes[at] = (v, float(d[inner].max()), float(d[~inner].min()), a, b)
            todo += [(a, rows[inner]), (b, rows[~inner])]

    def _new(self) -> int:
        self.nodes.append(())
        return len(self.nodes) - 1


class Search:
    """The k best of a tree's rows for a block of queries."""

    def __init__(self, tree: Tree, ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float):
        self.tree, self.ids, self.vectors, self.queries, self.query_ids, self.k, self.factor = tree, ids, vectors, queries, query_ids, k, factor
        self.unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        self.norms, self.query_norms = np.linalg.norm(vectors, axis=1), np.linalg.norm(queries, axis=1)
        m = len(queries)
        self.score = np.full((m, k), -np.inf)
        self.best = np.full((m, k), np.iinfo(np.int64).max)
        self.visited = 0
        self._visit(0, np.arange(m))

    def _visit(self, node: int, who: np.ndarray) -> None:
        if not len(who):
            return
        n = self.tree.nodes[node]
        if len(n) == 1:
            self._leaf(n[0], who)
            return
        v, inside, outside, a, b = n
        d = np.linalg.norm(self.unit[who] - self.tree.unit[v], axis=1)
        near = d <= (inside + outside) / 2
        self._visit(a, who[near])
        self._visit(b, who[~near])
        # Then the other side, where the bound on its distances doesn't rule it out.
        self._visit(b, who[near & (outside - d <= self.factor * self._tau(who))])
        self._visit(a, who[~near & (d - inside <= self.factor * self._tau(who))])

    def _tau(self, who: np.ndarray) -> np.ndarray:
        worst = self.score[who, -1]
        return np.where(np.isfinite(worst), np.sqrt(np.maximum(0, 2 - 2 * worst)) + CLOSE, np.inf)

    def _leaf(self, rows: np.ndarray, who: np.ndarray) -> None:
        self.visited += len(rows) * len(who)
        step = max(1, PAIRS // max(1, len(rows)))
        for i in range(0, len(who), step):
            self._compare(rows, who[i : i + step])

    def _compare(self, rows: np.ndarray, who: np.ndarray) -> None:
        rough = self.unit[who] @ self.tree.unit[rows].T
        rough[self.query_ids[who][:, None] == self.ids[rows][None, :]] = -np.inf
        q, c = np.nonzero(rough >= self.score[who, -1][:, None] - CLOSE)
        finite = np.isfinite(rough[q, c])
        q, c = who[q[finite]], rows[c[finite]]
        if not len(q):
            return
        exact = np.einsum("ij,ij->i", self.queries[q], self.vectors[c]) / (self.query_norms[q] * self.norms[c])
        touched = np.unique(q)
        old_q = np.repeat(touched, self.k)
        every_q = np.concatenate([q, old_q])
        every_s = np.concatenate([exact, self.score[touched].ravel()])
        every_i = np.concatenate([self.ids[c], self.best[touched].ravel()])
        order = np.lexsort((every_i, -every_s, every_q))
        every_q, every_s, every_i = every_q[order], every_s[order], every_i[order]
        first = np.searchsorted(every_q, touched)
        take = first[:, None] + np.arange(self.k)
        self.score[touched], self.best[touched] = every_s[take], every_i[take]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, r = np.nonzero(np.isfinite(self.score))
        return self.query_ids[q], self.best[q, r], self.score[q, r]


def first_copies(vectors: np.ndarray, k: int) -> np.ndarray:
    """Rows, in order, that aren't preceded by more than ``k`` equal vectors.

    Equal vectors have equal scores and ties go to the smaller id, so that with rows ordered by id no result can hold the
    others: of k + 1 copies, one at most is the query itself.
    """
    if not len(vectors):
        return np.zeros(0, np.int64)
    _, which = np.unique(vectors, axis=0, return_inverse=True)
    which = which.ravel()
    order = np.argsort(which, kind="stable")
    first = np.r_[True, which[order][1:] != which[order][:-1]]
    begin = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return np.sort(order[np.arange(len(order)) - begin <= k])


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and all components finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest of ``vectors``, itself (its id) left out.

    Both tables have an id and an array of numbers; other columns are ignored. Vectors that aren't ``usable``, or without
    an id, take no part. Queries meet the vectors of their own length; the length with most vectors counts and, of
    equal ones, the larger: other vectors take no part either. Equal scores go to the smaller id; rows that repeat an id
    count as one, the first by its vector. Fewer candidates than ``k`` give fewer rows, an empty table none.
    """

    def prepared(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        one = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
        return one.groupBy("id").agg(F.min("v").alias("v"))

    spark = common.session(vectors)
    common.bounded_batches(spark)
    every, asked = common.cut(prepared(vectors)), common.cut(prepared(queries))
    sizes = every.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    length = F.size("v") == sizes["length"]
    every, asked = every.where(length), asked.where(length)
    shards = max(1, -(-sizes["count"] // SHARD_ROWS))
    own = every.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("asks"), "id", "v")
    # A stated set of queries meets all shards.
    ask = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("asks"), "id", "v")
    tasks = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    both = own.unionByName(ask).repartitionById(tasks, F.col("shard") % tasks)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree, held, ids, vectors_ = -1, None, [], None, None
        for batch in batches:
            numbers, asks = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cuts = np.flatnonzero(np.r_[True, (numbers[1:] != numbers[:-1]) | (asks[1:] != asks[:-1])]) if len(numbers) else []
            for i, j in zip(cuts, [*cuts[1:], len(numbers)], strict=True):
                if numbers[i] != shard:
                    shard, tree, held = int(numbers[i]), None, []
                key, lists = np.asarray(batch.column(2).slice(i, j - i)), batch.column(3).slice(i, j - i)
                rows = np.asarray(lists.flatten()).reshape(j - i, -1)
                if not asks[i]:
                    held.append((key, rows))
                    continue
                if tree is None:
                    if not held:
                        continue
                    ids, vectors_ = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
                    held = []
                    order = np.argsort(ids, kind="stable")
                    ids, vectors_ = ids[order], vectors_[order]
                    first = first_copies(vectors_, k)
                    ids, vectors_ = ids[first], vectors_[first]
                    tree = Tree(vectors_ / np.linalg.norm(vectors_, axis=1, keepdims=True))
                for x in range(0, len(key), BLOCK_ROWS):
                    q, i_, score = Search(tree, ids, vectors_, rows[x : x + BLOCK_ROWS], key[x : x + BLOCK_ROWS], k, factor).rows()
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i_, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])

    found = both.sortWithinPartitions("shard", "asks").mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(rows: Iterator[tuple[int, list[float]]], asked: list[int], k: int) -> dict[int, list[tuple[int, float]]]:
    """The exact answer, for tests and for measuring recall."""
    table = [(i, np.array(v, np.float64)) for i, v in rows]
    ids = np.array([i for i, _ in table])
    v = np.stack([x for _, x in table])
    norms = np.linalg.norm(v, axis=1)
    out = {}
    for i in asked:
        at = int(np.flatnonzero(ids == i)[0])
        s = np.einsum("j,ij->i", v[at], v) / (norms * norms[at])
        order = [x for x in np.lexsort((ids, -s)) if ids[x] != i][:k]
        out[i] = [(int(ids[x]), float(s[x])) for x in order]
    return out
