"""The corpus pipeline, stage by stage and whole, against plain Python versions."""
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from tripstats.llm import mixing, near_dedup, quality

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars int, __id string, __sha string, extra int"


def words(text):
    return ALNUM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with exact and near copies, benchmark passages, nulls and repeated rows; labels; a benchmark."""
    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("ba", "do", "ki", "lu", "me", "no") for b in ("ra", "ti", "son", "vel", "mar", "ple", "x")]

    def prose(n):
        return " ".join(rng.choices(vocabulary, k=n))
    texts, item = [], prose(30)
    for _ in range(60):
        texts.append(prose(rng.randrange(30, 90)))
    texts += [texts[0], texts[0].replace(" ", "\n  "), texts[1]]                       # exact copies
    for base in texts[5:12]:                                                           # near copies
        w = base.split()
        w[rng.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    texts += [prose(40) + " " + item + " " + prose(40), item.upper(), prose(5) + " " + " ".join(item.split()[3:16])]
    texts += ["$!! " * rng.randrange(20, 60) for _ in range(25)]                       # junk
    texts += [None, "", " \t ", "a short one"]
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["web", "books", None]), len(t or ""), "x", "y", i) for i, t in enumerate(texts)]
    rows += [rows[3], (None, *rows[4][1:])]                                            # a repeated row, a row without id
    labels = [(i, 0 if t and t.startswith("$") else 1, 0) for i, t in enumerate(texts) if i % 4 != 1]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("i1", item), ("i2", None), ("i3", "")], "item_id string, text string").write.parquet(
        f"{folder}/benchmark.parquet")
    return str(folder), rows, item


def ids(df):
    return Counter(r["doc_id"] for r in df.collect())


def exact(rows):
    """The smallest id of each group of equal texts, ids of null last."""
    first = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), r)
    return list(first.values())


def near(rows):
    sets = [near_dedup.multiset((r[1] or "").encode()) for r in rows]
    sets = [(s[0].tobytes(), s[1].astype("int32").tobytes()) for s in sets]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i][0] and sets[j][0] and near_dedup.overlap(sets[i], sets[j]) >= 0.8:
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    kept = {}
    for r, x in sorted(zip(rows, root), key=lambda p: (p[0][0] is None, p[0][0] or 0)):
        kept.setdefault(x, r)
    return list(kept.values())


def clean(rows, item):
    w = words(item)
    windows = {tuple(w[i:i + 13]) for i in range(len(w) - 12)}

    def contaminated(text):
        v = words(text)
        hit = {p for i in range(len(v) - 12) if tuple(v[i:i + 13]) in windows for p in range(i, i + 13)}
        return len(hit) > 0 and 20 * len(hit) >= len(v)
    return [r for r in rows if not contaminated(r[1])]


def test_each_stage_on_its_own_input(spark, corpus):
    folder, rows, item = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    want = {"exact dedup": exact(rows), "MinHash near-dedup": near(exact(rows)), "benchmark decontamination": clean(rows, item)}
    for name, kept in want.items():
        given = docs if name != "MinHash near-dedup" else spark.createDataFrame(exact(rows), DOCS)
        got = stages[name](spark, given, folder)
        assert got.columns == given.columns, name
        assert ids(got) == Counter(r[0] for r in kept), name
        assert {(r["doc_id"], r["__id"], r["__sha"], r["extra"]) for r in got.collect()} <= {(r[0], r[5], r[6], r[7]) for r in rows}
        assert stages[name](spark, given.limit(0), folder).count() == 0
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = ids(quality.score_documents(docs, model).where("predicted = 1"))
    assert ids(stages["quality classifier"](spark, docs, folder)) == good
    junk = {r[0] for r in rows if r[1] and r[1].startswith("$")}
    assert not junk & set(good) and {r[0] for r in rows[:60]} <= set(good)


def test_run_is_all_stages_one_after_the_other(spark, corpus):
    folder, rows, item = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = ids(quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))))
    kept = clean(near(exact([r for r in rows if r[0] in good])), item)
    got = corpus_pipeline.run(spark, folder)
    assert ids(got) == Counter(r[0] for r in kept)
    want = mixing.mix(spark.createDataFrame(kept, DOCS))
    assert got.columns == want.columns
    sizes = {r.doc_id: (r.size, r.source_size, round(r.target, 6)) for r in want.collect()}
    assert {r.doc_id: (r.size, r.source_size, round(r.target, 6)) for r in got.collect()} == sizes


def test_an_empty_benchmark_and_no_labels_keep_everything(spark, corpus, tmp_path):
    folder, rows, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("benchmark decontamination", "quality classifier"):
        assert ids(dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))) == Counter(r[0] for r in rows)
