"""The prefix trie of conversations against a plain Python trie."""
import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tripstats.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """``{(conv_id, depth): (parent, n_convs, n_children, n_leaves, saved, ends)}`` by listing every prefix."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append(((turn is not None, turn), key, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    out = {}
    for path, of in members.items():
        below = [p for p in members if p[:len(path)] == path]
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c in sorted(of) if len(rebuilt[c]) == len(path))
        out[min(of), len(path)] = (min(members[path[:-1]]) if path else None, len(of), children[path],
                                   sum(not children[p] for p in below), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def found(df):
    rows = df.collect()
    got = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in rows}
    assert len(got) == len(rows)
    return got


def conversations(n, seed):
    """Few distinct turns, so that prefixes are shared and whole conversations repeat."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, "d e  f"])))
    return rows


@pytest.mark.parametrize("container", [1, 12, 60, 4096])
def test_equals_plain_trie_however_often_it_bursts(spark, container):
    rows = conversations(150, 5)
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), container=container)
    assert found(got) == brute(rows)


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(0, 1, "u", "x y"), (0, None, "u", "first"), (0, 1, "u", "x y"), (0, 1, "a", "tie"), (3, 0, None, None),
            (None, 0, "u", "no conversation"), (-7, 0, "u", "negative"), (-7, 1, "u", " "), (25, 5, "ü", "é ü"), (25, 5, "ü", "é ü"),
            (41, 2, "u", "word " * 50_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("tid", "p", "words", "rep", "head", "at", "row", "__range"):
        df = df.withColumn(c, F.lit(7))
    assert found(prefix_trie.prefix_trie(df)) == brute(rows)


def test_turnless_and_absent_bases(spark):
    rows = [(c, t, "u", f"{c} {t}") for c in (5, 21, 22, 23, 24, 45, 46, 47, 48, 60) for t in range(c % 3)]
    assert found(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert any(depth == 0 for _, depth in brute(rows))


def test_many_copies_are_one_representative(spark):
    rows = [(c, t, "u", "same text") for c in range(9000) for t in range(4)] + [(9001, 0, "u", "other")]
    got = found(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), container=2))
    assert got == brute(rows)


def test_empty_table(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
