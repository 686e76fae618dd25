"""Nearest neighbours through a hierarchical k-means tree.

The tree is fitted on a bounded sample and every vector is indexed: it
descends to the leaf of its nearest centroids.  A query walks the tree best
bin first: a priority queue holds the branches not yet taken by distance of
their centroid, and leaves come out in that order.  How many leaves a query
visits is calibrated: for a set of queries the true neighbours are found by
brute force, and visits widen until the leaves that they lie in reach the
wanted recall.  Candidates are ranked by their exact distance in double
precision.

A leaf is searched as one group of rows; a leaf that holds many rows (copies
cannot be told apart by centroids) is dealt out to several groups, each of
which meets the same queries.  The leaf that a query visits first bounds the
distance of its neighbours; other leaves send on only rows within that bound.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from switchyard.llm.common import uniform, written

NEIGHBOURS = 10
#: Vectors that fit the tree, and queries that calibrate it, at most about.
SAMPLE, CALIBRATION = 16384, 128
BRANCHES, LEAF_VECTORS, GROUP_VECTORS = 8, 512, 2048
RECALL = 0.97


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): one array of doubles for each vec_id.

    Vectors that are null, all zero or hold a null or non-finite component take
    no part, nor do rows without an id, nor vectors whose length is not the most
    frequent (ties: the shortest).  A vec_id with several vectors keeps the
    smallest as an array.
    """
    v = F.col("embedding").cast("array<double>")
    fine = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < math.inf), F.lit(False))) & F.exists("v", lambda x: x != 0))
    sizes = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    size = sizes[0]["d"] if sizes else 0
    return fine.where(F.size("v") == size).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances (queries x rows) from the components' differences."""
    out = np.empty((len(q), len(x)))
    step = max(1, (1 << 21) // max(1, x.size))
    for lo in range(0, len(q), step):
        diff = q[lo:lo + step, None, :] - x[None, :, :]
        out[lo:lo + step] = np.sqrt((diff * diff).sum(axis=2))
    return out


def _approx(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (q * q).sum(1)[:, None] - 2 * q @ x.T + (x * x).sum(1)[None, :]


class Tree:
    """Inner nodes as lists of child centroids; a leaf is a number."""

    def __init__(self, sample: np.ndarray, leaf: int, branches: int = BRANCHES, seed: int = 3):
        self.leaves = 0
        self.nodes: list[tuple[np.ndarray, list[int]]] = []
        self.rng = np.random.default_rng(seed)
        self.root = self._grow(sample, max(2, leaf), branches)
        del self.rng

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, x: np.ndarray, leaf: int, branches: int) -> int:
        if len(x) <= leaf:
            return self._leaf()
        start = np.unique(x[self.rng.choice(len(x), min(len(x), branches), replace=False)], axis=0)
        for _ in range(8):
            own = _approx(x, start).argmin(axis=1)
            start = np.array([x[own == i].mean(axis=0) for i in np.unique(own)])
        own = _approx(x, start).argmin(axis=1)
        parts = [x[own == i] for i in range(len(start))]
        kept = [(c, p) for c, p in zip(start, parts) if len(p)]
        if len(kept) < 2 or max(len(p) for _, p in kept) == len(x):
            return self._leaf()
        at = len(self.nodes)
        self.nodes.append(None)
        self.nodes[at] = (np.array([c for c, _ in kept]), [self._grow(p, leaf, branches) for _, p in kept])
        return at

    def home(self, x: np.ndarray) -> np.ndarray:
        """Leaf number of every row."""
        out = np.zeros(len(x), np.int64)

        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, idx = todo.pop()
            if not len(idx):
                continue
            if node < 0:
                out[idx] = -node - 1
                continue
            centres, children = self.nodes[node]
            own = _approx(x[idx], centres).argmin(axis=1)
            todo += [(c, idx[own == i]) for i, c in enumerate(children)]
        return out

    def best_bins(self, q: np.ndarray, visits: int) -> list[int]:
        """The first ``visits`` leaves, nearest branch first."""
        heap, out = [(0.0, self.root)], []
        while heap and len(out) < visits:
            _, node = heapq.heappop(heap)
            while node >= 0:
                centres, children = self.nodes[node]
                d = ((centres - q) ** 2).sum(axis=1)
                near = int(d.argmin())
                for i, c in enumerate(children):
                    if i != near:
                        heapq.heappush(heap, (float(d[i]), c))
                node = children[near]
            out.append(-node - 1)
        return out


def _nearest(ids: np.ndarray, d: np.ndarray, k: int, own: int):
    """Positions of the k nearest by (distance, id), without the query's own row."""
    if len(d) > 4 * k:
        edge = np.partition(d, k + 1)[k + 1]
        pick = np.flatnonzero(d <= edge)
    else:
        pick = np.arange(len(d))
    pick = pick[ids[pick] != own]
    return pick[np.lexsort((ids[pick], d[pick]))[:k]]


def _top(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(index: DataFrame, queries: list[tuple[int, list[float]]], k: int = NEIGHBOURS) -> DataFrame:
    """Exact neighbours of a bounded list of queries: every task compares its rows
    with all of them and sends on its k best for each."""
    qid, q = np.array([i for i, _ in queries], np.int64), np.array([v for _, v in queries])

    def run(batches):
        for b in batches:
            ids, x = b.column(0).to_numpy(), _matrix(b.column(1))
            if not len(ids):
                continue
            d = distances(q, x)
            for i in range(len(q)):
                at = _nearest(ids, d[i], k, qid[i])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), qid[i])), pa.array(ids[at]), pa.array(d[i][at])], ["query_id", "vec_id", "score"])

    return _top(index.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score double"), k)


def search(vectors: DataFrame, is_query, k: int = NEIGHBOURS, recall: float = RECALL, leaf_vectors: int = LEAF_VECTORS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every usable row for
    which the column ``is_query`` (of vec_id) holds; ties go to the smaller vec_id."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    index = written(usable(vectors), "vectors")
    n = index.count()
    if n < 2:
        return spark.createDataFrame([], schema)
    sample = index.where(uniform("vec_id", seed=31) < min(1.0, SAMPLE / n)).orderBy("vec_id").select("v").collect()
    sample = np.array([r[0] for r in sample]) if sample else np.zeros((0, 1))
    tree = Tree(sample, max(2, round(leaf_vectors * len(sample) / n)))

    def to_leaf(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tree.home(_matrix(b.column(1))))], ["vec_id", "v", "leaf"])

    placed = written(index.mapInArrow(to_leaf, "vec_id long, v array<double>, leaf long"), "leaves")
    # as many numbers as the tree has leaves, which the sample bounds
    held = {r[0]: r[1] for r in placed.groupBy("leaf").count().collect()}
    groups = {leaf: -(-size // GROUP_VECTORS) for leaf, size in held.items()}

    asked = placed.where(is_query)
    n_asked = asked.count()
    if not n_asked:
        return spark.createDataFrame([], schema)
    probe = sorted((r[0], list(r[1])) for r in asked.where(uniform("vec_id", seed=32) < min(1.0, CALIBRATION / n_asked)).select("vec_id", "v").collect())
    visits = tree.leaves
    if probe:
        true = brute_force(placed, probe, k).join(placed.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").collect()
        place = {i: {leaf: at for at, leaf in enumerate(tree.best_bins(np.array(v), tree.leaves))} for i, v in probe}
        need = sorted(place[r["query_id"]][r["leaf"]] + 1 for r in true)
        visits = need[min(len(need) - 1, math.ceil(recall * len(need)) - 1)] if need else tree.leaves

    fields = "leaf long, part long, vec_id long, v array<double>, ask boolean, bound double"

    def deal(first: int, last: int):
        """Rows to their group, and queries to the groups of the leaves ``first`` to ``last`` of their walk."""
        def run(batches):
            for b in batches:
                ids, q, leaf = b.column(0).to_numpy(), _matrix(b.column(1)), b.column(2).to_numpy()
                is_q, limit = b.column(3).to_numpy(zero_copy_only=False), b.column(4).to_numpy()
                at, to, part = list(range(len(ids))), leaf.tolist(), []
                for i, one in zip(ids.tolist(), to):
                    part.append(i * 2654435761 % (1 << 32) * groups[one] >> 32)
                for i in np.flatnonzero(is_q).tolist():
                    for one in tree.best_bins(q[i], last)[first:]:
                        for g in range(groups.get(one, 0)):
                            at.append(i), to.append(one), part.append(g)
                for lo in range(0, len(at), 16384):
                    s = slice(lo, lo + 16384)
                    rows = pa.array(at[s])
                    ask = np.arange(lo, lo + len(rows)) >= len(ids)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(to[s], pa.int64()), pa.array(part[s], pa.int64()), b.column(0).take(rows), b.column(1).take(rows),
                         pa.array(ask), pa.array(limit[at[s]])], ["leaf", "part", "vec_id", "v", "ask", "bound"])

        return run

    def within(table: pa.Table) -> pa.Table:
        ask = table["ask"].to_numpy(zero_copy_only=False)
        ids, v, limit = table["vec_id"].to_numpy(), _matrix(table["v"]), table["bound"].to_numpy()
        rows, x = ids[~ask], v[~ask]
        out = [], [], []
        asks = np.flatnonzero(ask)
        for lo in range(0, len(asks) if len(rows) else 0, 256):
            d = distances(v[asks[lo:lo + 256]], x)
            for i, q in enumerate(asks[lo:lo + 256]):
                best = _nearest(rows, d[i], k, ids[q])
                best = best[d[i][best] <= limit[q]]
                out[0].append(np.full(len(best), ids[q])), out[1].append(rows[best]), out[2].append(d[i][best])
        cat = [np.concatenate(o) if o else np.zeros(0, t) for o, t in zip(out, (np.int64, np.int64, np.float64))]
        return pa.table({"query_id": cat[0].astype(np.int64), "vec_id": cat[1].astype(np.int64), "score": cat[2]})

    def visit(rows: DataFrame, first: int, last: int) -> DataFrame:
        return rows.mapInArrow(deal(first, last), fields).groupBy("leaf", "part").applyInArrow(within, "query_id long, vec_id long, score double")

    rows = placed.select("vec_id", "v", "leaf", is_query.alias("q"))
    nearest = written(_top(visit(rows.withColumn("bound", F.lit(math.inf)), 0, 1), k), "first-leaf")
    bound = nearest.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    bounded = rows.join(bound, "vec_id", "left").select("vec_id", "v", "leaf", "q", F.coalesce("bound", F.lit(math.inf)).alias("bound"))
    return _top(nearest.drop("rank").unionByName(visit(bounded, 1, max(1, visits))), k)
