"""Global positions of rows in an order, without a task that holds them all."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripstats.llm.common import cut

#: ``monotonically_increasing_id`` counts rows in its low bits.
ROW_BITS = 33


def numbered(rows: DataFrame, order: list[Column], name: str = "numbered") -> DataFrame:
    """``rows`` with ``at``: their place, from 0, in ``order`` over the whole table.

    Rows are dealt by ranges of ``order``, sorted within them and written; a
    row's place is that in its range after the rows of the ranges before.
    The driver holds one count for each range.  ``order`` should be total
    (end it with a row id), so that equal keys are split as well and a
    retried task numbers alike.
    """
    spark = rows.sparkSession
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns(
        {"__range": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), name)
    counts = sorted((r["__range"], r["count"]) for r in placed.groupBy("__range").count().collect())
    starts, before = [], 0
    for part, n in counts:
        starts.append((part, before))
        before += n
    start = spark.createDataFrame(starts, "__range int, __start long")
    within = F.col("__at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (placed.join(F.broadcast(start), "__range").withColumn("at", F.col("__start") + within)
            .drop("__range", "__at", "__start"))
