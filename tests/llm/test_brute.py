"""Whole results of operators without SQL against plain Python versions."""
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tripstats.llm import ctw, licenses, mixing, quality

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def remainder(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


# --- context-tree weighting -----------------------------------------------------------------

def log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class Tree:
    """Counts of every (context, bits known) of every depth, in dictionaries."""

    def __init__(self, texts, depth=5):
        self.depth, self.n, self.deeper = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        for t in texts:
            for context, byte in self.places(t):
                for known, bit in self.decisions(byte):
                    for d in range(depth + 1):
                        self.n[context[depth - d:], known][bit] += 1
                        if d < depth:
                            self.deeper[context[depth - d:], known].add(context[depth - d - 1:])
        self.whole = {}

    def places(self, text):
        padded = bytes(self.depth) + text
        for i in range(len(text) + 1):
            yield padded[i:i + self.depth], (text[i] if i < len(text) else 0)

    @staticmethod
    def decisions(byte):
        bits = f"{byte:08b}"
        return [(bits[:j], int(bits[j])) for j in range(8)]

    def weighted(self, context, known):
        """Log weighted probability of the training data at a node, and the weight of stopping there."""
        if (context, known) not in self.whole:
            kt = log_kt(*self.n[context, known])
            if len(context) == self.depth:
                self.whole[context, known] = kt, 1.0
            else:
                below = sum(self.weighted(c, known)[0] for c in self.deeper[context, known])
                top = max(kt, below)
                both = math.log(0.5) + top + math.log(math.exp(kt - top) + math.exp(below - top))
                self.whole[context, known] = both, math.exp(math.log(0.5) + kt - both)
        return self.whole[context, known]

    def log10(self, text):
        out = 0.0
        for context, byte in self.places(text):
            for known, bit in self.decisions(byte):
                p = None
                for d in range(self.depth, -1, -1):
                    node = context[self.depth - d:], known
                    if node in self.n and sum(self.n[node]):
                        kt = (self.n[node][bit] + 0.5) / (sum(self.n[node]) + 1)
                        stop = self.weighted(*node)[1]
                        p = kt if p is None else stop * kt + (1 - stop) * p
                out += math.log10(0.5 if p is None else p)
        return out


@pytest.mark.parametrize("ids", ["long", "string"])
def test_ctw_equals_a_plain_context_tree(spark, monkeypatch, ids):
    monkeypatch.setattr(ctw, "BLOCK_BYTES", 900)               # several blocks
    rng = random.Random(9)
    words = ["the", "The", "cat", "sat", "ümlaut", "on", "a", "mat.", "\n", "x" * 9]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(60)] + [
        (60, None), (61, ""), (62, "unseen ☃ bytes"), (0, "a repeated id"), (None, "no id")]
    rows = [(None if i is None else (i if ids == "long" else f"{i}"), t) for i, t in docs]
    got = {(r.doc_id, r.score): r for r in ctw.score(spark.createDataFrame(rows, f"doc_id {ids}, text string")).collect()}
    train = [lower(t) for i, t in rows if remainder(i, 10)]
    counts = Counter(w for t in train for w in [*t.encode().split(), b""])
    n, v = sum(counts.values()), len(counts)
    tree = Tree([t.encode() for t in train])
    assert len(got) == len(rows)
    for i, t in rows:
        b = lower(t).encode()
        tokens = [*b.split(), b""]
        score = tree.log10(b)
        r = min((x for (d, _), x in got.items() if d == i), key=lambda x: abs(x.score - score))
        assert r.score == pytest.approx(score, rel=1e-5, abs=1e-5)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            remainder(i, 10) == 0, len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens))


def test_ctw_sums_of_strings_in_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 101, n).astype("uint8")) for n in (0, 1, 700, 3, 200_000, 50)]
    codes = ctw.distinct(ctw.grams(t) for t in texts)[0]
    p = rng.normal(size=len(codes))
    want = [p[np.searchsorted(codes, ctw.grams(t))].sum() for t in texts]
    assert ctw.totals(texts, codes, p) == pytest.approx(want)


# --- mixing ---------------------------------------------------------------------------------

def test_mix_equals_a_plain_solution(spark):
    """Targets by hand, rates by bisection, copies within the rate's neighbours, every source near its target."""
    rng = random.Random(4)
    rows = []
    for source, n in ((None, 300), ("a", 900), ("b", 40), ("é", 600), ("tiny", 3), ("empty", 2)):
        for _ in range(n):
            rows.append((len(rows), source, "" if source == "empty" else "w " * rng.randrange(1, 60)))
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    size = Counter()
    for _, s, t in rows:
        size[s] += len(SPACE_WORD.findall(t))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, float(sum(size.values())), set(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > 3 * size[s]]
        if not above:
            target.update(share)
            break
        for s in above:
            target[s] = 3.0 * size[s]
            left -= target[s]
            open_.remove(s)
    taken = Counter()
    by = {r.doc_id: r for r in got}
    assert len(by) == len(got) == len(rows)
    for s in order:
        own = [(i, len(SPACE_WORD.findall(t))) for i, x, t in rows if x == s]
        mean = max(size[s] / len(own), 1.0)

        def total(lam):
            return sum(n * min(3.0, math.exp(min(700.0, lam * n / mean))) for _, n in own)
        lo, hi = -200.0, 200.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if total(mid) < target[s] else (lo, mid)
        for i, n in own:
            r = by[i]
            assert (r.size, r.source_size) == (n, size[s]) and r.target == pytest.approx(target[s])
            assert r.taken == r.copies * n <= 3 * n
            if n:
                rate = min(3.0, math.exp(min(700.0, lo * n / mean)))
                assert math.floor(rate + 1e-6) <= r.copies <= math.ceil(rate - 1e-3) or abs(r.copies - rate) < 1e-3
            taken[s] += r.taken
        if size[s]:
            assert abs(taken[s] - target[s]) <= max(60, 0.01 * target[s])


# --- licenses -------------------------------------------------------------------------------

def test_base_places_equal_a_plain_scan(spark):
    rng = random.Random(8)
    parts = ["Under the MIT License", "Apache-License; version 2", "CC BY NC", "cc by", "under the", "mit license", "cc by nc cc by nc",
             "version 2", "lorem", "é", "under the mit under the mit license"]
    docs = [(i, " ".join(rng.choices(parts, k=rng.randrange(0, 12)))) for i in range(120)] + [(500, None), (501, "")]
    got = {r.doc_id: r for r in licenses.label_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        w = ALNUM.findall(lower(t))
        at = [(p, label) for phrase, label in licenses.BASE.items() for k in [phrase.split()]
              for p in range(len(w)) if w[p:p + len(k)] == k]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_notices_are_labelled_though_edited(spark):
    """Recall over notices in unlike text: as they are, and with a word lost or put in."""
    rng = random.Random(3)
    docs, want = [], {}
    for text, label in licenses.TEMPLATES.items():
        for edit in range(3):
            w = text.split()
            at = rng.randrange(1, len(w) - 1)
            w = w if edit == 0 or len(w) < 16 else w[:at] + w[at + 1:] if edit == 1 else w[:at] + ["really"] + w[at:]
            pad = [f"n{rng.randrange(900)}" for _ in range(40)]
            docs.append((len(docs), " ".join(pad[:20] + w + pad[20:])))
            want[docs[-1][0]] = label
    clean = [(1000 + i, " ".join(rng.choices("software public license work program terms free use copy source".split(), k=80)))
             for i in range(30)]
    got = {r.doc_id: r.labels.split(",") for r in
           licenses.label_documents(spark.createDataFrame(docs + clean, "doc_id long, text string")).collect()}
    assert sum(label in got[i] for i, label in want.items()) >= 0.95 * len(want)
    assert all(got[i] == [""] for i, _ in clean)


def test_the_general_public_license_in_one_line(spark):
    line = "This work is licensed under the GNU General Public License."
    got = licenses.label_documents(spark.createDataFrame([(1, f"before. {line} after")], "doc_id long, text string")).first()
    assert got.labels == "gpl"


# --- quality --------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    good = ["the quick fox runs over fields", "a calm river flows by the town", "people read books in the evening"]
    docs = [(i, " ".join(rng.choices(good, k=4)) if i % 3 else "$$ buy now!!! " * rng.randrange(2, 9)) for i in range(300)]
    docs += [(900, None), (901, ""), (902, "zz")]
    labels = [(i, int(i % 3 > 0)) for i in range(300) if i % 2] + [(1, 1), (5, None), (None, 1), (7777, 0)]
    return docs, labels


def test_quality_votes_equal_all_cosines(spark, labelled):
    docs, labels = labelled
    df, ls = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(df, ls)
    text = dict(docs)
    learnt = [(text[i], q) for i, q in labels if i is not None and q is not None and i in text and remainder(i, 5)]
    assert sorted(model.label.tolist()) == sorted(float(q) for _, q in learnt)
    # document frequencies are those of all documents
    every = np.stack([quality.terms((t or "").encode()) for _, t in docs])
    assert model.weight == pytest.approx(np.log((1 + len(docs)) / (1 + (every > 0).sum(0))) + 1, rel=1e-5)
    z = model.latent(every)
    for r in quality.score_documents(df, model).collect():
        i = [d for d, _ in docs].index(r.doc_id)
        cos = [round(float(np.dot(z[i], s)), 5) for s in model.sample]
        edge = sorted(cos)[-min(quality.NEIGHBOURS, len(cos))]
        votes = [(max(c, 0.0) ** quality.SHARPNESS, y) for c, y in zip(cos, model.label) if c >= edge]
        total = sum(w for w, _ in votes)
        assert r.score == pytest.approx(sum(w * y for w, y in votes) / total if total else model.prior, abs=1e-3)
        assert (r.held_out, r.predicted) == (remainder(r.doc_id, 5) == 0, int(r.score >= 0.3))
    held = [(r.predicted, dict(labels)[r.doc_id]) for r in quality.score_documents(df, model).collect()
            if r.held_out and r.doc_id in dict(labels) and dict(labels)[r.doc_id] is not None]
    assert sum(p == q for p, q in held) >= 0.95 * len(held) > 0


def test_quality_does_not_depend_on_the_order_of_rows(spark, labelled):
    docs, labels = labelled
    docs = docs + [(1, "another text of one id"), (1, None)]
    ls = spark.createDataFrame(labels, "doc_id long, quality int")

    def scores(rows, parts):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        return sorted((str(r.doc_id), round(r.score, 9)) for r in quality.score_documents(df, quality.fit(df, ls)).collect())
    assert scores(docs, 1) == scores(docs[::-1], 5)


def test_good_documents_are_kept_whole(spark, labelled):
    docs, labels = labelled
    rows = [(i, t, i and i % 7, "x") for i, t in docs + [(4, docs[4][1])]]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int, vector string")
    model = quality.fit(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    good = Counter(r.doc_id for r in quality.score_documents(df, model).where("predicted = 1").collect())
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == good
    assert kept.limit(0).count() == 0 and quality.keep_good(df.limit(0), model).count() == 0


def test_without_labels_every_score_is_a_half(spark, labelled):
    df = spark.createDataFrame(labelled[0][:5], "doc_id long, text string")
    model = quality.fit(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in quality.score_documents(df, model).collect()] == [0.5] * 5


def test_ctw_block_counts_in_one_sort(monkeypatch):
    """A block's training and held-out byte strings are sorted together, and counted as plain counters do."""
    rows = [("a", False, b"one two two"), ("b", True, b"two three"), ("c", False, b""), ("d", False, b"one two two"),
            ("e", True, b"zz zz")]
    sorts, distinct = [], ctw.distinct
    monkeypatch.setattr(ctw, "distinct", lambda *a, **k: (sorts.append(1), distinct(*a, **k))[1])
    (words, n), (codes, counts) = ctw.asked(rows)
    assert len(sorts) == 1
    strings, every = Counter(), set()
    named, known = Counter(), {b""}
    for _, held, b in rows:
        g, w = ctw.grams(b).tolist(), b.split()
        every.update(g)
        known.update(w)
        if not held:
            strings.update(g)
            named.update([*w, b""])
    assert codes.tolist() == sorted(every) and counts.tolist() == [strings[c] for c in sorted(every)]
    at = dict(zip(words.tolist(), n.tolist()))
    assert at == {int(ctw.hashed([w])[0]): named[w] for w in known}
