"""Merkle manifest of a dataset: sibling-shift self-joins, level by level.

Rows become leaves, the leaves of a group (source) a tree of fan-out
``FANOUT``, the groups' roots one more tree.  A node is ``(tree, level, at)``.
On each level the node of slot 0 of every run computes the places of its
siblings by slot offsets, ``at + 1 .. at + FANOUT - 1``, one equi-join of the
level with itself brings their digests, and the slot-0 rows emit the parents,
each with the digests of its run.  All keys hold the place, so a group with a
third of all rows spreads over all tasks.  Each level is written once.

The way of a node to its root is the runs of its ancestors and its slots in
them.  Ways are put together from the top: those of a level join those of
the level above, an equi-join on the run, and only the leaves' parents, a
``FANOUT``-th of the rows, carry one.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripstats.llm.common import ascii_lower, cut
from tripstats.llm.order import numbered

#: Children of a node.
FANOUT = 16
#: Columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: Bytes of a digest.
DIGEST = 32
WAY = "array<struct<run:binary,slot:int>>"


def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest(*parts: Column) -> Column:
    """SHA-256 (binary) of the parts, one after the other."""
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def text_of(digests: Column) -> Column:
    """One or more digests as lower-case hex text."""
    return F.lower(F.hex(digests))


def grow(leaves: DataFrame, largest: int, fanout: int = FANOUT) -> list[DataFrame]:
    """All levels above ``leaves(tree, at, n, hash)``, each with ``run``, the children's digests.

    ``n`` counts the nodes of the tree on the level, ``largest`` those of the
    largest tree.  A tree of one node is done and takes no part above.
    """
    levels, nodes = [], leaves
    while largest > 1:
        live = nodes.where("n > 1").select("tree", "at", "n", "hash")
        zero = live.where(F.col("at") % fanout == 0)
        asks = (zero.select("tree", "n", F.col("at").alias("zero"), F.explode(F.sequence(F.lit(1), F.lit(fanout - 1))).alias("shift"))
                .select("tree", "zero", "n", (F.col("zero") + F.col("shift")).alias("at")).where("at < n"))
        run = (asks.join(live.select("tree", "at", "hash"), ["tree", "at"]).select("tree", "zero", "n", "at", "hash")
               .union(zero.select("tree", F.col("at").alias("zero"), "n", "at", "hash"))
               .groupBy("tree", "zero", "n").agg(F.array_sort(F.collect_list(F.struct("at", "hash"))).alias("run")))
        run = run.select("tree", (F.col("zero") / fanout).cast("long").alias("at"), F.ceil(F.col("n") / fanout).cast("long").alias("n"),
                         F.aggregate("run", F.lit(b""), lambda a, s: F.concat(a, s["hash"])).alias("run"))
        nodes = cut(run.withColumn("hash", digest(text_of(F.col("run")))), "merkle-level")
        levels.append(nodes)
        largest = -(-largest // fanout)
    return levels


def with_ways(leaves: DataFrame, largest: int, fanout: int = FANOUT) -> DataFrame:
    """``leaves(tree, at, n, hash, ...)`` with ``way``, the runs and slots up to the tree's root, and the root, ``top``."""
    slot, up = (F.col("at") % fanout).cast("int"), (F.col("at") / fanout).cast("long")
    none, above = F.array().cast(WAY), None
    for nodes in reversed(grow(leaves, largest, fanout)):
        here = nodes.where("n = 1").select("tree", "at", "run", none.alias("rest"), F.col("hash").alias("top"))
        if above is not None:
            over = above.select("tree", F.col("at").alias("up"), F.col("run").alias("over"), F.col("rest").alias("more"), "top")
            here = here.union(nodes.where("n > 1").withColumn("up", up).join(over, ["tree", "up"]).select(
                "tree", "at", "run", F.concat(F.array(F.struct(F.col("over").alias("run"), slot.alias("slot"))), "more"), "top"))
        above = cut(here, "merkle-ways")
    if above is None:                         # every tree is a lone leaf
        return leaves.withColumns({"way": none, "top": F.col("hash")})
    over = above.select("tree", F.col("at").alias("up"), "run", "rest", "top")
    way = F.when(F.col("run").isNull(), none).otherwise(
        F.concat(F.array(F.struct("run", slot.alias("slot"))), F.col("rest")))
    return (leaves.withColumn("up", up).join(over, ["tree", "up"], "left")
            .withColumns({"way": way, "top": F.coalesce("top", "hash")}).drop("up", "run", "rest"))


def _sides(step: Column) -> tuple[Column, Column]:
    """The digests of a run before and after a slot."""
    before = step["slot"] * DIGEST
    return step["run"].substr(F.lit(1), before), step["run"].substr(before + DIGEST + 1, F.octet_length(step["run"]))


def fold(leaf: Column, way: Column) -> Column:
    """The root (binary) that a leaf and the runs on its way lead to."""
    def up(a: Column, step: Column) -> Column:
        left, right = _sides(step)
        return digest(text_of(F.concat(left, a, right)))
    return F.aggregate(way, leaf, up)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", key: str = "doc_id",
             changed: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """One row per row of ``docs``: ``key, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``changed`` is the leaf (binary) to verify in place of a row's own, null
    where it is the own one; by default none is changed.

    Null and empty fields have digests of their own (``-`` and ``0:``); a
    null group is a tree of its own, first in order; null keys come first in
    their group.  Rows with equal keys follow by their leaf, and rows equal
    in all fields are interchangeable, so every one has a place and reruns
    agree.  Very long texts are only ever hashed where they are read.
    Other columns are ignored, whatever their names.  No rows give no rows.
    """
    spark = docs.sparkSession
    own = digest(*[field(F.col(c)) for c in fields])
    rows = cut(docs.select(F.col(key).alias("key"), F.col(group).cast("string").alias("of"), own.alias("hash"),
                           (F.lit(None).cast("binary") if changed is None else changed).alias("other"),
                           F.monotonically_increasing_id().alias("row")), "merkle-rows")
    placed = numbered(rows, [F.col(c).asc_nulls_first() for c in ("of", "key", "hash", "row")], "merkle-leaves")
    groups = cut(placed.groupBy("of").agg(F.min("at").alias("tree"), F.count("*").alias("n")), "merkle-groups")
    leaves = cut(placed.join(groups, placed["of"].eqNullSafe(groups["of"]))
                 .select("key", "other", "tree", (F.col("at") - F.col("tree")).alias("at"), "n", "hash"), "merkle-leaves")
    size = groups.agg(F.count("*").alias("trees"), F.coalesce(F.max("n"), F.lit(0)).alias("largest")).first()
    low = with_ways(leaves, size["largest"], fanout).withColumnRenamed("top", "subroot")

    # the trees in the order of their groups are the leaves of one more tree
    tops = numbered(low.where("at = 0").select(F.col("tree").alias("of"), F.col("subroot").alias("hash")), [F.col("of")],
                    "merkle-roots")
    high = with_ways(tops.withColumns({"tree": F.lit(0).cast("long"), "n": F.lit(size["trees"]).cast("long")}),
                     size["trees"], fanout)
    high = cut(high.select(F.col("of").alias("tree"), F.col("way").alias("rest"), F.col("top").alias("root")), "merkle-roots")
    way = F.concat("way", "rest")
    proof = F.aggregate(way, F.lit(b""), lambda a, s: F.concat(a, *_sides(s)))
    out = (low.join(high, "tree")
           .select(F.col("key").alias(key), text_of(F.col("hash")).alias("leaf"), text_of(F.col("subroot")).alias("subroot"),
                   text_of(F.col("root")).alias("root"), F.sha2(text_of(proof).cast("binary"), 256).alias("proof_sha256"),
                   text_of(fold(F.coalesce("other", "hash"), way)).alias("folded_root")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(fields: tuple[str, ...] = FIELDS, text: str = "text", key: str = "doc_id", one_in: int = 5) -> Column:
    """The leaf of a row whose text lost its capitals A-Z, for one in ``one_in`` rows by crc32 of the key; else null."""
    parts = [field(ascii_lower(F.col(c)) if c == text else F.col(c)) for c in fields]
    return F.when(F.crc32(F.col(key).cast("string").cast("binary")) % one_in == 0, digest(*parts))
