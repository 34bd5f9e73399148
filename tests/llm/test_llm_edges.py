"""Every operator on awkward rows and on none, and the exact ones against plain Python versions."""
import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripstats.llm import (chaining, ctw, decontaminate, exact_dedup, licenses, mixing, near_dedup, quality,
                           suffix_dedup, warc)

CLASH = "row long, key string, size int, n int, start int, source string, doc_id long, text string"
ROWS = [(1, "k", 5, None, 2, "s", 1, "alpha beta gamma delta epsilon zeta eta theta " * 30),
        (None, None, None, None, None, None, 2, None),
        (1, "k", 5, None, 2, "s", 3, ""),
        (2, "k", 5, 1, 2, "s", 4, " \t\n "),
        (2, "k", 5, 1, 2, None, 5, "alpha beta gamma delta epsilon zeta eta theta " * 30),
        (2, "k", 5, 1, 2, None, 5, "alpha beta gamma delta epsilon zeta eta theta " * 30),
        (3, "k", 5, 1, 2, "t", None, "one two"),
        (3, "k", 5, 1, 2, "t", 7, " ".join(f"w{i * 7919 % 1013}" for i in range(20_000))),
        (3, "k", 5, 1, 2, "t", 8, "Licensed under the MIT License; cc by nc and cc by nc")]

PER_ROW = {
    "mix": lambda d: mixing.mix(d),
    "near": lambda d: near_dedup.near_duplicates(d),
    "suffix": lambda d: suffix_dedup.remove_repeats(d),
    "suffix first": lambda d: suffix_dedup.remove_repeats(d, keep_first=True),
    "exact": lambda d: exact_dedup.exact_dedup(d),
    "ctw": lambda d: ctw.score(d),
    "decontaminate": lambda d: decontaminate.decontaminate(d, d.sparkSession.createDataFrame(
        [(1, "one two"), (1, "one two"), (None, None), (3, "")], "item_id long, text string")),
    "licenses": lambda d: licenses.label_documents(d),
    "quality": lambda d: quality.score_documents(d, quality.fit(d, d.sparkSession.createDataFrame(
        [(1, 1), (7, 0), (None, 1), (2, None)], "doc_id long, quality int"))),
}


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(ROWS, CLASH)


@pytest.mark.parametrize("name", PER_ROW)
def test_awkward_rows_give_a_row_each_and_none_give_none(spark, awkward, name):
    got = PER_ROW[name](awkward).collect()
    ids = collections.Counter(r["doc_id"] for r in got)
    assert ids == collections.Counter(r[6] for r in ROWS)
    assert PER_ROW[name](awkward.limit(0)).count() == 0


def test_awkward_rows_of_the_filters(awkward):
    for keep in (exact_dedup.keep_first, near_dedup.keep_one):
        awkward = awkward.withColumnsRenamed({"row": "__id", "key": "__sha"})
        got = keep(awkward)
        assert {r["__sha"] for r in got.collect()} <= {"k", None}
        assert got.columns == awkward.columns
        kept = [r["doc_id"] for r in got.select("doc_id").collect()]
        assert 1 in kept and 5 not in kept and 7 in kept and len(kept) == len(set(kept))


def test_passages_of_awkward_rows(awkward):
    got = chaining.repeated_passages(awkward).collect()
    assert {r["doc_id"] for r in got} == {1, 5}
    assert chaining.repeated_passages(awkward.limit(0)).count() == 0


def test_known_values(awkward):
    hit = {r["doc_id"]: r for r in PER_ROW["decontaminate"](awkward).collect()}
    assert hit[None]["n_hit"] == 2 and hit[None]["contaminated"] and not hit[2]["contaminated"]
    lic = {r["doc_id"]: r for r in licenses.label_documents(awkward).collect()}[8]
    assert (lic["n_base"], lic["first_word"], lic["last_word"]) == (3, 1, 9)
    assert lic["base_labels"] == "cc-by-nc,mit" and lic["score"] == 1.0
    taken = mixing.mix(awkward).collect()
    assert all(r["taken"] <= 3 * r["size"] for r in taken)


def test_archives_round_trip(spark):
    rnd = random.Random(1)
    body = ["", None, "x" * 99, "y" * 100, "y" * 100, "é\r\n\r\nWARC/1.1\r\n" * 9000, "z" * 200_000]
    rows = [(i if i != 3 else None, "http://a b/\n", b, 1) for i, b in enumerate(body)]
    rows += [(20, "u", "".join(rnd.choice("ab\r\n") for _ in range(5000)), 1)]
    got = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string, chunk_no int"),
                             chunk=1000, with_data=True).collect()
    text = collections.defaultdict(list)
    for r in got:
        text[r["page_id"]].append((r["chunk_no"], bytes(r["chunk"])))
    for page, _, html, _ in rows:
        if page is not None:
            assert b"".join(c for _, c in sorted(text[page])) == (html or "").encode()
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got}
    assert kinds[None] == ("revisit", 4) and kinds[4] == ("response", None)
    assert all(r["digest_so_far"] == r["payload_digest"] for r in got if r["last"] and r["record_type"] == "response")


def test_archives_of_text_ids_repeated_rows_and_none(spark):
    """Ids of any text; of equal payloads the smallest id is the response, on each of its rows."""
    same, rows = "s" * 5000, [("b: 1\r\n", "s" * 5000), ("a/é", "s" * 5000), ("a/é", "s" * 5000), ("", "t" * 300), (None, "t" * 300),
                              ("c", None), ("c", "u" * 3000)]
    df = spark.createDataFrame([(i, h, 5, "x") for i, h in rows], "page_id string, html string, row int, again string")
    got = warc.archive_pages(df, chunk=1000, with_data=True)
    assert dict(got.dtypes)["page_id"] == dict(got.dtypes)["refers_to"] == "string"
    last = sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got.where("last").collect())
    assert last == sorted([("b: 1\r\n", "revisit", "a/é", 5000), *[("a/é", "response", None, 5000)] * 2, ("", "response", None, 300),
                           ("None", "revisit", "", 300), ("c", "response", None, 0), ("c", "response", None, 3000)])
    data = got.where(F.col("page_id") == "a/é").orderBy("chunk_no").collect()
    assert [r["chunk_no"] for r in data] == [n for n in range(5) for _ in range(2)]
    assert b"".join(bytes(r["chunk"]) for r in data[::2]).decode() == same
    assert warc.archive_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["suffix", "suffix first", "ctw", "exact", "mix"])
def test_text_ids(spark, awkward, name):
    named = awkward.withColumn("doc_id", F.concat(F.lit("id-"), F.col("doc_id").cast("string")))
    got = PER_ROW[name](named)
    assert dict(got.dtypes)["doc_id"] == "string"
    ids = collections.Counter(r["doc_id"] for r in got.collect())
    assert ids == collections.Counter(None if r[6] is None else f"id-{r[6]}" for r in ROWS)


@pytest.mark.parametrize("keep_first", [False, True])
def test_repeated_strings_against_brute_force(spark, keep_first):
    rnd, length = random.Random(5), 100
    def txt(n):
        return " ".join(rnd.choice(["ab", "the", "qu", "lorem"]) + str(rnd.randrange(50)) for _ in range(n))
    shared, rows = [txt(60) for _ in range(3)], []
    for i in range(120):
        t = txt(rnd.randrange(5, 100))
        if rnd.random() < .6:
            a = rnd.randrange(100)
            t = t[:len(t) // 2] + rnd.choice(shared)[a:a + rnd.randrange(80, 300)] + t[len(t) // 2:]
        rows.append((i, rnd.choice(rows)[1] if rows and rnd.random() < .1 else t))
    texts = [t.encode() for _, t in rows]
    count = collections.Counter(b[i:i + length] for b in texts for i in range(len(b) - length + 1))
    seen, want = set(), {}
    for i, b in enumerate(texts):
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            if (w in seen) if keep_first else count[w] > 1:
                gone[s:s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[i] = (sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length, keep_first)
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()} == want


def test_longest_previous_factors():
    text = b"abracadabra abracadabra"
    order = sorted(range(len(text)), key=lambda i: text[i:])
    def common(i, j):
        n = 0
        while max(i, j) + n < len(text) and text[i + n] == text[j + n]:
            n += 1
        return n
    lcp = np.array([0] + [common(a, b) for a, b in zip(order, order[1:])])
    got = suffix_dedup.previous_factors(np.array(order), lcp)
    assert [int(g) for g in got] == [max((common(j, i) for j in range(i)), default=0) for i in order]


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    h, c = np.sort(rng.integers(1, 1 << 62, 60).astype(np.uint64)), rng.integers(1, 9, 60)
    d = np.where(rng.random(60) < .5, c, rng.integers(1, 9, 60))
    true = np.minimum(c, d).sum() / np.maximum(c, d).sum()
    est = []
    for s in range(40):
        sig = near_dedup.signatures([(near_dedup.mix64(h + np.uint64(s)), c), (near_dedup.mix64(h + np.uint64(s)), d)])
        est.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(est) - true) < 0.03


def test_chains_of_two_distant_passages():
    path = [(i, i + 5) for i in range(0, 60, 6)] + [(i + 500, i + 900) for i in range(0, 60, 6)] + [(30, 700)]
    assert sorted(len(c) for c in chaining.chain(path)) == [10, 10]
    a = np.arange(80, dtype=np.uint32)
    b = np.concatenate([a[:40], [999], a[40:]]).astype(np.uint32)
    assert chaining.align(a, b, [(10, 10), (50, 51)]) == (0, 80, 0, 81, 80) or chaining.edits(a, b) == 1


def test_probabilities_sum_to_one():
    keys, counts = ctw.distinct([ctw.grams(b"abracadabra" * 5)])
    levels, (node, zero, one, below) = ctw.tree(keys, counts)
    top = ctw.top_levels([{"node": n, "zero": z, "one": o, "below": b}
                          for n, z, o, b in zip(node, zero, one, below)])
    ctx = int(ctw.grams(b"abraca")[-2] >> 8 << 8)
    p = 10 ** ctw.log10_p(np.arange(ctx, ctx + 256), levels, top)
    assert abs(p.sum() - 1) < 1e-9


def test_targets_fill_up():
    got = mixing.targets([100, 10, 10], [5, 2, 1])
    assert got[1] == 30 and abs(sum(got) - 120) < 1e-9 and all(t <= 3 * s + 1e-9 for t, s in zip(got, [100, 10, 10]))
