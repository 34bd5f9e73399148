"""Connected components of a link table, as rounds of Spark joins."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstats.llm.common import cut

#: Places that answer for one root.
SALTS = 16


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``: root is the smallest node of its component.

    Each round takes the smallest root among the neighbours and then that
    root's own root, until nothing changes; labels stay in tables, the driver
    sees one count a round.  A node with many links is one row per task in
    the grouped minimum, and a root of many nodes answers them from ``SALTS``
    places.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m"))
                 .select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        heard = (both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("heard")))
        step = labels.join(heard, labels["node"] == heard["a"]).select(
            "node", F.least("root", "heard").alias("to"), F.col("root").alias("old"))
        up = (labels.select(F.col("node").alias("to"), F.col("root").alias("higher")).where("to != higher")
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
        step = step.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        new = cut(step.join(up, ["to", "salt"], "left").select(
            "node", F.least("to", F.coalesce("higher", "to")).alias("root"), "old"), "labels")
        changed = new.where("root != old").limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            return labels
