"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition makes one run of ``(digest, smallest row, count)``.
The runs meet in binomial rounds: in each round ``FAN_IN`` neighbouring runs
are merged digest by digest, and only the smallest row and the summed count
of a digest go on to the next round.  A round is dealt by run *and* digest,
so no task ever holds a whole run, and a digest that fills a third of the
input reaches a round as at most one row per run, not as its copies.

"Verified": rows merge only if SHA-256, byte length and a second, unrelated
64-bit hash of the normalised text all agree.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripstats.llm.common import SPACE_RUN, cut, pick

#: Runs merged into one per round.
FAN_IN = 16
KEY = ("digest", "n_bytes", "check")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def digest_rows(docs: DataFrame) -> DataFrame:
    """One row per document with its digest, a row number and its run (written once)."""
    t = docs.select(F.col("doc_id"), normalised(F.col("text")).cast("binary").alias("t"))
    return cut(t.select("doc_id", F.sha2("t", 256).alias("digest"),
                        F.octet_length("t").alias("n_bytes"), F.xxhash64("t").alias("check"),
                        F.monotonically_increasing_id().alias("row"),
                        F.spark_partition_id().alias("run")), "digests")


def merge_runs(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """``(digest, n_bytes, check, first, group_size)``, one row per distinct text."""
    last = rows.agg(F.max("run")).first()[0] or 0
    runs = rows.select(*KEY, "run", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
                       .alias("first"), F.lit(1).cast("long").alias("group_size"))
    while True:
        runs = (runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
                .groupBy("run", *KEY)
                .agg(F.min("first").alias("first"), F.sum("group_size").alias("group_size")))
        last //= fan_in
        if last == 0:
            return cut(runs.drop("run"), "digest-firsts")


def exact_dedup(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """Group documents whose texts agree up to runs of ASCII whitespace.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.
    Returns one row per input row: ``doc_id, keep_id, group_size, kept,
    text_sha256``.

    Null texts equal the empty text.  Of equal texts the smallest ``doc_id``
    stays (null ids sort last); if that id occurs on several rows, exactly
    one of them has ``kept`` true.  An empty table gives an empty result.
    """
    rows = digest_rows(docs)
    firsts = merge_runs(rows, fan_in)
    return (rows.join(firsts, list(KEY))
            .select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
                    (F.col("row") == F.col("first.row")).alias("kept"),
                    F.col("digest").alias("text_sha256")))


def keep_first(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """The documents that stay, all their columns unchanged.

    One row of each group of equal texts; of rows repeated with the same
    ``doc_id`` and equal texts, one (any column that differs between them is
    taken from one of the repeated rows).
    """
    return pick(docs, exact_dedup(docs, fan_in).where("kept"), F.sha2(normalised(docs["text"]).cast("binary"), 256), "left_semi")
