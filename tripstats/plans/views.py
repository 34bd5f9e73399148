"""Named views over stored tables, so reports can be asked as SQL text.

SQL of the user's own runs through ``spark.sql`` with named parameters
(``:name``), which are bound as values and never become part of the text.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripstats.operators import rollups as A
from tripstats.plans import catalog as Q

# view name -> table written by the batch job (plans.batch.run)
VIEW_TABLES = {
    "taxi_trip_daily": "mv_taxi_date_hour_daily",
    "taxi_trip_fare_f": "mv_trip_fare",
    "taxi_duration_interval_f": "mv_taxi_duration_trip",
    "pick_drop_zone_f": "mv_pick_drop_zone",
}


def register_views(spark: SparkSession, tables: dict[str, str], zones: DataFrame) -> None:
    """Temp views over the batch job's tables (``name -> path``) and the zones."""
    for view, table in VIEW_TABLES.items():
        spark.read.parquet(tables[table]).createOrReplaceTempView(view)
    zones.createOrReplaceTempView("taxi_zone_lookup")


def catalog_views(spark: SparkSession, sf_dir: str) -> None:
    """The same views over the stored rollups of the benchmark tables."""
    Q.daily(spark, sf_dir).createOrReplaceTempView("taxi_trip_daily")
    Q.profile(spark, sf_dir).createOrReplaceTempView("taxi_trip_fare_f")
    Q.histogram(spark, sf_dir).createOrReplaceTempView("taxi_duration_interval_f")
    A.route_rollup(Q.routes(spark, sf_dir)).createOrReplaceTempView("pick_drop_zone_f")
    Q.zones(spark, sf_dir).createOrReplaceTempView("taxi_zone_lookup")


def run_query(spark: SparkSession, sql: str, args: dict | None = None) -> DataFrame:
    """``sql`` with its named parameters bound to ``args``."""
    return spark.sql(sql, args=args or {})
