"""The Merkle manifest against one built node by node."""
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tripstats.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    fields = [*row[:4], text]
    return h(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def tree(nodes):
    """Root and, for each leaf, the runs on its way as (before, after)."""
    ways = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = a // 16 * 16
            ways[i].append((nodes[run:a], nodes[a + 1:run + 16]))
            at[i] = a // 16
        nodes = [h(*nodes[i:i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], ways


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    groups = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in groups}
    root, tops = tree([trees[s][0] for s in groups])
    out = []
    for s, top in zip(groups, tops):
        subroot, ways = trees[s]
        for (_, _, own, r), way in zip(sorted(by[s], key=lambda x: x[:3]), ways):
            other = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                other = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            for before, after in [*way, *top]:
                other = h(*before, other, *after)
            proof = h(*[d for before, after in [*way, *top] for d in (*before, *after)])
            out.append((r[0], own, subroot, root, proof, other, other == root))
    return sorted(out, key=repr)


def found(df, **how):
    return sorted((tuple(r) for r in merkle.manifest(df, changed=merkle.tampered(), **how).collect()), key=repr)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16, "b": 17}, {"a": 300, None: 33, "é": 1, "z": 257}])
def test_equals_node_by_node(spark, sizes):
    rng = random.Random(1)
    ids = rng.sample(range(-10_000, 100_000), sum(sizes.values()))
    rows = [(ids.pop(), s, rng.choice(["en", None]), rng.choice([None, 5]), rng.choice(["Ab ÄÉ", "x", "", None]))
            for s, n in sizes.items() for _ in range(n)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(df) == brute(rows)


def test_many_sources_make_a_tree_of_their_own(spark):
    rows = [(i, f"s{i % 70}", "en", i, f"Text {i}") for i in range(400)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    rows = [(None, None, None, None, None), (None, "s", "en", 1, "A"), (5, "s", "en", 1, "T" * 300_000), *[(7, "s", "en", 2, "same")] * 40,
            (7, "s", "en", 2, "other"), (8, "", "", 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("at", "tree", "hash", "of", "key", "other", "row", "n", "__range"):
        df = df.withColumn(c, F.lit("x"))
    assert found(df) == brute(rows)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
