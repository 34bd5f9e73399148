"""Helpers shared by the training-data operators."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstats.session import new_scratch

# Fixed values of the contracts: word patterns and the ASCII case map.
SPACE_RUN = r"[\x20\x09-\x0D]+"
SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A side is hinted for broadcast only if its rows times its row width stay below this.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared checkpoint folder and read back.

    Cuts the lineage at a table that outlives its executors, and freezes
    row ids, so that a retried task cannot number rows anew.
    """
    spark = df.sparkSession
    path = new_scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def remainder(doc_id: Column, divisor: int) -> Column:
    """``crc32(doc_id as text) mod divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` hinted for broadcast if it provably stays below the bound, else as it is."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def id_key(doc_id: Column) -> Column:
    """``doc_id`` as a text key that is never null."""
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def pick(docs: DataFrame, chosen: DataFrame, sha: Column, how: str) -> DataFrame:
    """Rows of ``docs`` joined ``how`` (``left_semi`` or ``left_anti``) with ``chosen(doc_id, text_sha256)``, all their
    columns unchanged, whatever they are called; ``sha`` is the digest of a row's text."""
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), id_key(docs["doc_id"]).alias("id"),
                      sha.alias("sha"))
    of = chosen.select(id_key(F.col("doc_id")).alias("id"), F.col("text_sha256").alias("sha"))
    found = row.join(of, ["id", "sha"], how)
    return (found.dropDuplicates(["id", "sha"]) if how == "left_semi" else found).select("row.*")
