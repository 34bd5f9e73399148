"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A benchmark window is 13 consecutive words of an item (a shorter item is one
window) and counts as the set of its 3-word shingles with their offsets.  A
document contains a window only if it contains *all* its shingles, so the
prefix that a set join must look up is a single shingle, and the rarest one
(by its count over all documents) gives the fewest candidates.  A candidate
start follows from the shingle's position and offset; starts outside the
document fall to the positional and length bounds; the rest are verified
shingle by shingle, as text, over a window of exactly the item's size.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripstats.llm.common import cut, small
from tripstats.llm.shingles import WIDTH, grams, occurrences, words

#: Words of a benchmark window.
WINDOW = 13


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(item, window, len, grams)``: every window of every item, as text and as its shingles."""
    w = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"),
                         words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    return (w.withColumn("len", size)
            .select("item", "len", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1),
                                                         lambda i: F.slice(F.col("w"), i, F.col("len")))).alias("w"))
            .select("item", F.concat_ws(" ", "w").alias("window"), "len",
                    F.when(F.col("len") >= WIDTH, grams(F.col("w"), WIDTH)["gram"])
                    .otherwise(F.array(F.concat_ws(" ", "w"))).alias("grams")))


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(documents, hits, window items)``: hits are ``(row, start, len, window)``."""
    found = cut(windows(benchmark, window), "windows")
    sets = found.dropDuplicates(["window"]).select("window", "len", "grams")
    tokens = sets.select("window", "len", "grams", F.posexplode("grams").alias("offset", "gram"))
    widths = [r[0] for r in found.select(F.least("len", F.lit(WIDTH))).distinct().collect()]  # of 1, 2, 3
    seen = occurrences(docs, tokens.select("gram").distinct(), sorted(widths))
    at = seen.where("pos >= 0")

    rarity = at.groupBy("gram").agg(F.count("*").alias("n"))
    prefix = cut(tokens.join(rarity, "gram")          # a window with a shingle that occurs nowhere is dropped
                 .groupBy("window", "len", "grams")
                 .agg(F.min(F.struct("n", "gram", "offset")).alias("rarest"), F.count("*").alias("k"))
                 .where(F.col("k") == F.size("grams"))
                 .select("window", "len", "grams", F.col("rarest.gram").alias("gram"),
                         F.col("rarest.offset").alias("offset")), "prefixes")
    size = prefix.agg(F.count("*").alias("n"), F.max(F.octet_length("window")).alias("b")).first()

    reach = window - 1
    near = Window.partitionBy("row", "width").orderBy("pos").rangeBetween(-reach, reach)
    around = at.withColumn("near", F.collect_list(F.struct("pos", "gram")).over(near))
    start = F.col("pos") - F.col("offset")
    candidates = (around.join(small(prefix, size["n"], 5 * (size["b"] or 0) + 64), "gram")
                  .withColumn("start", start)
                  .where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words"))))
    last = F.col("start") + F.size("grams") - 1
    there = F.transform(F.filter("near", lambda x: x["pos"].between(F.col("start"), last)), lambda x: x["gram"])
    hits = cut(candidates.where(there == F.col("grams")).select("row", "start", "len", "window"), "hits")
    return seen.where("pos < 0"), hits, found.select("item", "window").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, per_hit: int = 20) -> DataFrame:
    """How much of each document is benchmark text.

    ``docs`` needs ``doc_id, text``; ``benchmark`` needs ``item_id, text``;
    other columns are ignored.  Returns one row per input row: ``doc_id,
    n_words, n_hit, n_items, items_sha256, contaminated, text_sha256``.

    A document is contaminated if any word is hit and at least one word in
    ``per_hit`` is.  Null or wordless texts have no words, no hits and are
    clean; wordless items have no windows; an empty benchmark hits nothing.
    Items repeated with one id count once; a null ``item_id`` is the id
    "null".  Rows repeated with one ``doc_id`` are judged each by itself.
    """
    every, hits, items = find_windows(docs, benchmark, window)
    by_start = Window.partitionBy("row").orderBy("start", "end")
    spans = hits.select("row", "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    before = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    n_hit = (spans.withColumn("before", F.coalesce(before, F.lit(0)))
             .groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "before")))
                                 .alias("n_hit")))
    named = (hits.select("row", "window").distinct().join(items, "window").select("row", "item").distinct()
             .groupBy("row").agg(F.count("*").alias("n_items"),
                                 F.concat_ws(",", F.array_sort(F.collect_list("item"))).alias("list")))
    hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return (every.join(n_hit, "row", "left").join(named, "row", "left")
            .select("doc_id", F.col("n_words").cast("long").alias("n_words"), hit.alias("n_hit"),
                    F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                    F.sha2(F.coalesce("list", F.lit("")).cast("binary"), 256).alias("items_sha256"),
                    ((hit > 0) & (per_hit * hit >= F.col("n_words"))).alias("contaminated"), "text_sha256"))
