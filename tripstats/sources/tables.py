"""Trips and zones derived from the benchmark tables.

The test data is a TPC-H style star schema.  Each ``lineitem`` row becomes
one trip (see FIXTURES.md §2): the order gives the pickup date and time, the
customer's nation the pickup zone, the supplier's nation the drop-off zone,
the quantity the distance and the extended price the fare.  ``nation`` is
the zone lookup.  The projection is a pure Spark job (two joins and column
expressions), so it scales with the tables.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripstats import config as C
from tripstats.operators.joins import join_dimension

# Fixed values of the projection (FIXTURES.md §2).
FIRST_PICKUP_DAY = "2024-12-30"
DAY_SPAN = 156
UNKNOWN_ZONE_ID = 264


_L, _I, _D, _S = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()
# Declared read schemas (only the columns the projection uses): no footer
# inference job per read, and the scan reads exactly these columns.
SCHEMAS = {
    "lineitem": {"l_orderkey": _L, "l_partkey": _L, "l_suppkey": _L, "l_linenumber": _I,
                 "l_quantity": _D, "l_extendedprice": _D, "l_returnflag": _S},
    "orders": {"o_orderkey": _L, "o_custkey": _L},
    "customer": {"c_custkey": _L, "c_nationkey": _I},
    "supplier": {"s_suppkey": _L, "s_nationkey": _I},
    "nation": {"n_nationkey": _I, "n_name": _S},
}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    known = SCHEMAS.get(name, {})
    if columns and all(c in known for c in columns):
        schema = T.StructType([T.StructField(c, known[c]) for c in columns])
        return spark.read.schema(schema).parquet(path)
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def trips_from_tables(spark: SparkSession, sf_dir: str,
                      max_broadcast_rows: int = C.BROADCAST_MAX_ROWS) -> DataFrame:
    """Raw trip records (the shape of one monthly trip file plus ``src_month``)."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
               "l_quantity", "l_extendedprice", "l_returnflag")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    cust = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    supp = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")

    # orders x customer first (smaller than lineitem), then lineitem x that.
    # lineitem and orders are both fact-sized: their join is a sort-merge
    # join on the order key (co-partitioned, spills instead of failing), never
    # a broadcast of either side; the row-level work after it runs in the
    # shuffle partitions, in parallel.
    oc = join_dimension(orders, cust, orders.o_custkey == cust.c_custkey, "inner",
                        max_broadcast_rows).select("o_orderkey", "c_nationkey")
    x = li.join(oc.hint("merge"), li.l_orderkey == oc.o_orderkey, "inner")
    x = join_dimension(x, supp, x.l_suppkey == supp.s_suppkey, "inner", max_broadcast_rows)

    line = F.col("l_linenumber")
    pickup_d = F.date_add(F.lit(FIRST_PICKUP_DAY).cast("date"),
                          ((F.col("o_orderkey") * 131 + line * 17) % DAY_SPAN).cast("int"))
    sec = (F.col("o_orderkey") * 7919 + line * 10007) % 86400
    dur = (F.col("l_partkey") * 37 + line * 101) % 13200 - 60
    midnight = F.col("_pickup_d").cast("timestamp_ntz")
    m = F.month("_pickup_d")
    src_month = (F.when(F.col("_pickup_d") < F.lit("2025-01-01").cast("date"), F.lit(1))
                 .when(F.col("_pickup_d") >= F.lit("2025-06-01").cast("date"), F.lit(5))
                 .when((F.dayofmonth("_pickup_d") == 1) & (line == 1) & (m > 1), m - 1)
                 .otherwise(m))
    sign = F.when((line == 7) & (F.col("l_returnflag") == "R"), F.lit(-1)).otherwise(F.lit(1))
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint") % 15000
    return (x.withColumns({"_pickup_d": pickup_d, "_sec": sec, "_dur": dur})
            .select(
                src_month.cast("int").alias("src_month"),
                F.timestamp_add("SECOND", F.col("_sec"), midnight).alias(C.PICKUP_TS),
                F.timestamp_add("SECOND", F.col("_sec") + F.col("_dur"), midnight).alias(C.DROPOFF_TS),
                F.col("c_nationkey").alias(C.PU),
                F.when(F.col("l_partkey") % 31 == 0, F.lit(UNKNOWN_ZONE_ID))
                 .otherwise(F.col("s_nationkey")).alias(C.DO),
                F.when(F.col("l_quantity") == 1, F.lit(0.0))
                 .otherwise(F.col("l_quantity") / 10).alias("trip_distance"),
                (sign * cents.cast("double") / 100).alias("total_amount"),
                (((F.col("l_partkey") * 13 + line * 29) % 2000).cast("double") / 100).alias("tip_amount"),
                F.when(F.col("l_partkey") % 23 == 0, F.lit(None).cast("string"))
                 .otherwise(F.lit("N")).alias("store_and_fwd_flag"),
            ))


def zones_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone lookup ``(LocationID int, Zone string)`` from ``nation``."""
    return table(spark, sf_dir, "nation", "n_nationkey", "n_name").select(
        F.col("n_nationkey").cast("int").alias("LocationID"), F.col("n_name").alias("Zone"))
