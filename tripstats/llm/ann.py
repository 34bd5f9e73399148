"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample (``SAMPLE`` vectors, the smallest by
hash of their id): k-means splits a node into ``BRANCH`` until it holds at
most ``LEAF`` sampled vectors.  Every vector of the table is then filed under
the leaf that a greedy descent reaches.  Neighbouring leaves share a block of
at most ``BLOCK`` vectors, and a leaf of more (copies of one vector, say) is
as many blocks as it takes.

A query walks the tree with a priority queue of nodes by the distance of their
centres and visits leaves in the order in which they leave the queue.  How
many it visits is calibrated: the exact neighbours of up to ``CALIBRATE``
queries are computed against all vectors, and visits widen until the leaves
visited hold ``RECALL`` of them.  Visited leaves are searched exactly, a block
of vectors against a block of queries at a time; a query meets a block once,
with all the leaves it visits there, and takes k vectors from it.
"""
from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripstats.llm.common import cut

#: Vectors that the tree is fitted on, at most.
SAMPLE = 16_384
#: Children of a node, and sampled vectors in a leaf at most.
BRANCH, LEAF = 8, 32
#: Queries whose exact neighbours calibrate the visits, and the share of them to reach.
CALIBRATE, RECALL = 256, 0.97
#: Vectors and queries of a block.
BLOCK = 8192
#: Rounds of k-means per node.
ROUNDS = 10


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``(vec_id, v)``: the vectors that take part, one per id, written once.

    Null vectors, those with a null or non-finite component or of zeros
    only, and rows without an id take no part, nor do vectors of another
    length than most.  Of an id on several rows the smallest vector counts.
    """
    v = F.col(column).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & finite & F.exists("v", lambda x: x != 0.0))
    one = cut(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    sizes = one.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    return one.where(F.size("v") == (sizes["d"] if sizes else 0))


@dataclass
class Tree:
    """Centres of all nodes; the children of node i are ``first[i] .. first[i] + count[i] - 1``.

    Node 0 is the root; a node without children is a leaf, numbered by
    ``leaf[i]``.  At most ``2 * SAMPLE`` nodes, whatever the table's size.
    """
    centre: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def file(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row of ``x``: the nearest child at every node on the way."""
        at = np.zeros(len(x), np.int64)
        moving = np.flatnonzero(self.count[at] > 0)
        while len(moving):
            for node in np.unique(at[moving]):
                rows = moving[at[moving] == node]
                a = self.first[node]
                c = self.centre[a:a + self.count[node]]
                at[rows] = a + np.argmin((c * c).sum(1) - 2.0 * (x[rows] @ c.T), axis=1)
            moving = moving[self.count[at[moving]] > 0]
        return self.leaf[at]

    def order(self, query: np.ndarray, visits: int | None = None) -> list[int]:
        """The first ``visits`` leaves (default all) of a best-bin-first traversal, ties to the smaller node."""
        far = ((self.centre - query) ** 2).sum(1)
        queue, out = [(0.0, 0)], []
        while queue and (visits is None or len(out) < visits):
            _, node = heapq.heappop(queue)
            if self.count[node] == 0:
                out.append(int(self.leaf[node]))
            for child in range(self.first[node], self.first[node] + self.count[node]):
                heapq.heappush(queue, (far[child], child))
        return out


def _split(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Cluster of each row of ``x`` by k-means from centres spread over the rows; empty clusters vanish."""
    start = [0]
    near = ((x - x[0]) ** 2).sum(1)
    for _ in range(k - 1):                    # the farthest row from all centres is the next one
        if near.max() <= 0:
            break
        start.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[start[-1]]) ** 2).sum(1))
    c = x[start].copy()
    for _ in range(rounds):
        of = np.argmin((c * c).sum(1) - 2.0 * (x @ c.T), axis=1)
        for j in range(len(c)):
            if (of == j).any():
                c[j] = x[of == j].mean(0)
    return np.unique(np.argmin((c * c).sum(1) - 2.0 * (x @ c.T), axis=1), return_inverse=True)[1]


def fit(rows: DataFrame, sample: int = SAMPLE, branch: int = BRANCH, leaf: int = LEAF, rounds: int = ROUNDS) -> Tree | None:
    """The tree of the ``sample`` vectors of ``rows(vec_id, v)`` with the smallest hashes; None without rows.

    The driver holds the sample, ``sample`` times the width of a vector.
    """
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()
    if not got:
        return None
    x = np.array([r["v"] for r in got], float)
    centre, first, count = [x.mean(0)], [0], [0]
    queue = [(0, np.arange(len(x)))]
    while queue:
        node, held = queue.pop(0)
        if len(held) <= leaf:
            continue
        of = _split(x[held], branch, rounds)
        if of.max() == 0:                     # copies of one vector
            continue
        first[node], count[node] = len(centre), int(of.max()) + 1
        for j in range(count[node]):
            part = held[of == j]
            queue.append((len(centre), part))
            centre.append(x[part].mean(0))
            first.append(0)
            count.append(0)
    count = np.array(count)
    names = np.where(count == 0, np.cumsum(count == 0) - 1, -1)
    return Tree(np.array(centre), np.array(first), count, names)


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def file(rows: DataFrame, tree: Tree) -> DataFrame:
    """Every row of ``rows(vec_id, v)`` with its ``leaf``, written once."""
    def task(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(tree.file(_vectors(b.column(1))), pa.int32())],
                    names=["vec_id", "v", "leaf"])
    return cut(rows.select("vec_id", "v").mapInArrow(task, "vec_id long, v array<double>, leaf int"), "filed")


def blocks_of(sizes: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each leaf, from the leaves' sizes."""
    first, count, at, held = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for leaf, n in enumerate(sizes.tolist()):
        if held and held + n > block:
            at, held = at + 1, 0
        first[leaf] = at
        if n > block:
            count[leaf] = -(-n // block)
            at, held = at + count[leaf], 0
        else:
            held += n
    return first, count


def _nearest(ids: np.ndarray, x: np.ndarray, asks: np.ndarray, q: np.ndarray, k: int, leaf: np.ndarray | None = None,
             visited: np.ndarray | None = None):
    """``(position of the query, vec_id, distance, row)`` of the k nearest rows of each query, ties to the smaller
    id, its own id left out; with ``visited`` (queries x leaves), of the rows whose ``leaf`` it visits.

    Expanded squares pick the rows that can be among them; those are then
    measured exactly, component by component.
    """
    every, out = (ids, x, leaf, (x * x).sum(1)), []
    for a in range(0, len(q), 128):
        some, (ids, x, leaf, xx), back = q[a:a + 128], every, None
        if visited is not None:               # only the rows that one of these queries visits
            back = np.flatnonzero(visited[a:a + 128].any(0)[leaf])
            ids, x, leaf, xx = ids[back], x[back], leaf[back], xx[back]
        if not len(ids):
            continue
        d = xx + (some * some).sum(1)[:, None] - 2.0 * (some @ x.T)
        d[asks[a:a + 128][:, None] == ids] = np.inf
        if visited is not None:
            d[~visited[a:a + 128][:, leaf]] = np.inf
        slack = 1e-9 * (xx.max() + (some * some).sum(1))
        kth = np.partition(d, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
        for i in range(len(some)):
            rows = np.flatnonzero(d[i] <= kth[i] + slack[i]) if np.isfinite(kth[i]) else np.flatnonzero(np.isfinite(d[i]))
            exact = np.sqrt(((x[rows] - some[i]) ** 2).sum(1))
            best = np.lexsort((ids[rows], exact))[:k]
            out += [(a + i, ids[rows[j]], exact[j], rows[j] if back is None else back[rows[j]]) for j in best]
    return out


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query, from the k nearest of each block."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def calibrate(filed: DataFrame, queries: DataFrame, tree: Tree, k: int, most: int = CALIBRATE, recall: float = RECALL) -> int:
    """Leaves to visit so that they hold ``recall`` of the exact neighbours of ``most`` queries (the smallest by hash).

    All vectors are compared with these queries, a task at a time; the
    driver holds ``most`` queries and k neighbours of each.
    """
    asked = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).collect()
    if not asked:
        return 0
    ask, q = np.array([r["vec_id"] for r in asked]), np.array([r["v"] for r in asked], float)

    def exact(batches):
        for b in batches:
            if b.num_rows:
                ids, leaf = b.column(0).to_numpy(), b.column(2).to_numpy()
                got = _nearest(ids, _vectors(b.column(1)), ask, q, k)
                yield pa.RecordBatch.from_pandas(pd.DataFrame(
                    {"query_id": [ask[g[0]] for g in got], "vec_id": [g[1] for g in got], "score": [g[2] for g in got],
                     "leaf": [leaf[g[3]] for g in got]}).astype({"query_id": "int64", "vec_id": "int64", "leaf": "int32"}),
                    preserve_index=False)

    near = _best(filed.select("vec_id", "v", "leaf").mapInArrow(
        exact, "query_id long, vec_id long, score double, leaf int"), k).select("query_id", "leaf").collect()
    place = {r["vec_id"]: {leaf: i for i, leaf in enumerate(tree.order(np.array(r["v"], float)), 1)} for r in asked}
    at = sorted(place[r["query_id"]][r["leaf"]] for r in near)
    return at[max(0, math.ceil(recall * len(at)) - 1)] if at else 0


def search(vectors: DataFrame, k: int = 10, every: int = 100, sample: int = SAMPLE, leaf: int = LEAF,
           recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """The k nearest vectors found for each one whose id is divisible by ``every``.

    Returns ``query_id, rank, vec_id, score`` (Euclidean distance in double
    precision), nearest first, ties to the smaller id; all other vectors, if
    there are fewer than k.  A query is no candidate of its own.  Which rows
    take part: ``usable``.  Other columns are ignored; an empty table has no
    rows.  The tree, the visits and so the result depend on the vectors only,
    so reruns agree.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    tree = fit(rows, sample, leaf=leaf)
    if tree is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    filed = file(rows, tree)
    queries = rows.where(F.col("vec_id") % every == 0)
    visits = max(calibrate(filed, queries, tree, k, recall=recall), 1)
    sizes = np.zeros(tree.leaves, np.int64)                   # one number per leaf of the tree
    for r in filed.groupBy("leaf").count().collect():
        sizes[r["leaf"]] = r["count"]
    first, count = blocks_of(sizes, block)

    def walk(batches):
        """A row for each query and block: its leaves there."""
        for b in batches:
            for vec, v in zip(b.column(0).to_pylist(), _vectors(b.column(1)) if b.num_rows else []):
                met: dict[int, list[int]] = {}
                for at in tree.order(v, visits):
                    for i in range(first[at], first[at] + count[at] if sizes[at] else first[at]):
                        met.setdefault(int(i), []).append(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([vec] * len(met), pa.int64()), pa.array([v] * len(met), pa.list_(pa.float64())),
                     pa.array(list(met), pa.int64()), pa.array(list(met.values()), pa.list_(pa.int32()))],
                    names=["vec_id", "v", "block", "leaves"])

    asked = cut(queries.select("vec_id", "v").mapInArrow(walk, "vec_id long, v array<double>, block long, leaves array<int>"),
                "visits")
    # queries of a block in blocks too; every block of vectors meets each of them
    plan = cut(asked.groupBy("block").agg(F.ceil(F.count("*") / block).cast("int").alias("asks")), "visit-plan")
    asks = asked.join(plan, "block").withColumn("ask", F.pmod(F.xxhash64("vec_id"), "asks").cast("int")).drop("asks")
    places = spark.createDataFrame(pd.DataFrame({"leaf": np.arange(len(sizes), dtype="int32"), "first": first, "blocks": count}))
    held = (filed.join(F.broadcast(places), "leaf")
            .select("vec_id", "v", "leaf", (F.col("first") + F.pmod(F.xxhash64("vec_id"), "blocks")).alias("block"))
            .join(plan, "block").withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1))).drop("asks"))

    def meet(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        got = []
        if mine.num_rows and theirs.num_rows:
            mine = mine.sort_by([("vec_id", "ascending")])
            mine = mine.take(pa.array(np.argsort([x[0] for x in mine.column("leaves").to_pylist()], kind="stable")))
            ask, ids = (t.column("vec_id").to_numpy() for t in (mine, theirs))
            names, leaf = np.unique(theirs.column("leaf").to_numpy(), return_inverse=True)
            visited = np.stack([np.isin(names, x) for x in mine.column("leaves").to_pylist()])
            near = _nearest(ids, _vectors(theirs.column("v").combine_chunks()), ask,
                            _vectors(mine.column("v").combine_chunks()), k, leaf, visited)
            got = [(ask[i], vec, far) for i, vec, far, _ in near]
        return pa.table({"query_id": pa.array([g[0] for g in got], pa.int64()),
                         "vec_id": pa.array([g[1] for g in got], pa.int64()),
                         "score": pa.array([g[2] for g in got], pa.float64())})

    found = asks.groupBy("block", "ask").cogroup(held.groupBy("block", "ask")).applyInArrow(
        meet, "query_id long, vec_id long, score double")
    return _best(found, k).select("query_id", "rank", "vec_id", "score")
