"""Neighbours found by the tree against all distances."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tripstats.llm import ann, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, x, k=10, every=100):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        keep = np.flatnonzero(ids != ids[i])
        best = keep[np.lexsort((ids[keep], d[keep]))[:k]]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in best]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got = out.setdefault(r["query_id"], [])
        got.append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got)
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v], 0) for i, v in zip(ids, x)], SCHEMA)


def recall(got, want):
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in near}) for q, near in want.items())
    return hits / sum(map(len, want.values()))


def test_query_reaches_its_recall(spark):
    at = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{at}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    want, got = brute(ids, x), found(queries.op12_kmeans_tree(spark, at))
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert recall(got, want) >= 0.9
    far = dict(zip(ids.tolist(), x))
    for q, near in got.items():
        assert near == sorted(near, key=lambda p: (p[1], p[0]))
        assert all(s == pytest.approx(np.sqrt(((far[q] - far[i]) ** 2).sum()), abs=1e-12) for i, s in near)


def test_clustered_vectors_need_few_leaves(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 16)) * 10
    x = (centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 16))).astype("float32").astype(float)
    ids = np.arange(6000)
    df = frame(spark, ids, x)
    assert recall(found(ann.search(df, sample=2000)), brute(ids, x)) >= 0.9
    rows = ann.usable(df)
    tree = ann.fit(rows, sample=2000)
    visits = ann.calibrate(ann.file(rows, tree), rows.where("vec_id % 100 = 0"), tree, 10)
    assert visits < tree.leaves / 4


def test_all_leaves_and_small_blocks_are_exact(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, size=(900, 3)).astype(float)           # many ties and copies
    x[(x == 0).all(1)] = 1.0
    ids = rng.permutation(900)
    assert found(ann.search(frame(spark, ids, x), leaf=8, recall=1.0, every=10, block=16)) == brute(ids, x, every=10)


def test_fewer_vectors_than_asked_for(spark):
    x = np.array([[1.0, 0], [0, 2.0], [3.0, 3.0]])
    assert found(ann.search(frame(spark, [0, 7, 100], x))) == brute(np.array([0, 7, 100]), x)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1),
            (6, [1.0, None], 1), (None, [1.0, 1.0], 1), (8, [1.0, 2.0, 3.0], 1), (9, [], 1), (200, [0.0, 0.0], 1),
            (10, [2.0, 0.0], 1), (10, [3.0, 0.0], 1), (10, [2.0, 0.0], 1), (0, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("v", "leaf", "block", "ask", "e"):
        df = df.withColumn(c, F.lit("x"))
    assert found(ann.search(df)) == {0: [(1, 0.5), (10, 1.0)]}


@pytest.mark.parametrize("rows", [[], [(3, None, 1)], [(100, [1.0], 1)]])
def test_nothing_to_find(spark, rows):
    assert ann.search(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_leaves_in_blocks():
    sizes = np.array([3, 4, 5, 40, 0, 2, 10, 1, 10])
    first, count = ann.blocks_of(sizes, 10)
    held = {}
    for leaf, n in enumerate(sizes):
        assert count[leaf] == max(1, -(-n // 10))
        for b in range(first[leaf], first[leaf] + count[leaf]):
            held[b] = held.get(b, 0) + min(n, 10)
    assert max(held.values()) <= 10 and sorted(held) == list(range(len(held)))
