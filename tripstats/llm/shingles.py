"""One pass over the documents that keeps the shingles another table asks for."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripstats.llm.common import ALNUM_WORD, ascii_lower, cut, small

#: Words of a shingle.
WIDTH = 3
#: Stands for a document among its shingles, so that every document has a row.
MARK = ""


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words; none for null."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(ALNUM_WORD), F.lit(0)),
                      F.array().cast("array<string>"))


def grams(of: Column, width: int) -> Column:
    """Array of ``(pos, gram)``: all runs of ``width`` words."""
    n = F.size(of)
    return F.when(n >= width, F.transform(
        F.sequence(F.lit(1), n - width + 1),
        lambda i: F.struct((i - 1).alias("pos"), F.lit(width).alias("width"),
                           F.concat_ws(" ", F.slice(of, i, width)).alias("gram")))
    ).otherwise(F.array().cast("array<struct<pos:int,width:int,gram:string>>"))


def occurrences(docs: DataFrame, wanted: DataFrame, widths: list[int]) -> DataFrame:
    """Where ``wanted.gram`` stands in the documents: ``(row, doc_id, text_sha256,
    n_words, pos, width, gram)``, written once, with one row of gram ``MARK`` and
    pos -1 for each document.

    Every shingle of every whole text meets ``wanted`` in one join: a
    broadcast while ``wanted`` is provably small, else a shuffle of the
    shingles, whose frequent ones Spark splits.
    """
    spark = docs.sparkSession
    ask = cut(wanted.select("gram").union(spark.range(1).select(F.lit(MARK).alias("gram"))), "wanted")
    size = ask.agg(F.count("*").alias("n"), F.max(F.octet_length("gram")).alias("b")).first()
    split = docs.select("doc_id", "text", words(F.col("text")).alias("words"))
    mark = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("width"), F.lit(MARK).alias("gram")))
    made = split.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("text_sha256"),
        F.size("words").alias("n_words"),
        F.concat(mark, *[grams(F.col("words"), k) for k in widths]).alias("all"))
    rows = made.select("row", "doc_id", "n_words",
                       F.inline("all"), "text_sha256").withColumn(
        "text_sha256", F.when(F.col("pos") < 0, F.col("text_sha256")))
    return cut(rows.join(small(ask, size["n"], (size["b"] or 0) + 48), "gram"), "shingles")
