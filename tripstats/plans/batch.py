"""The batch job: enriched monthly tables -> aggregate states -> views.

1. Clean and enrich all month files in one pass and store them as one table
   partitioned by ``src_year, src_month`` (the per-month trip tables).
2. Read that table back (lineage is cut at a written table) and build the
   per-month rollups: hourly counts, duration buckets, and mergeable states
   of routes and hours (``operators.states``).
3. Build the all-month tables and the view tables from these, without the trips.

A full run replaces every table, a run of given months their partitions, so
a rerun gives the same tables and leaves no stale month behind.  All paths are below ``warehouse`` (a shared folder).
"""
from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstats import config as C
from tripstats.operators import rollups as A
from tripstats.operators import states as S
from tripstats.operators.enrich import enrich_trips
from tripstats.sinks.writers import write_month_partitions, write_sorted
from tripstats.sources.files import Month, as_months

#: Per-month tables and what builds them from the enriched trips.
MONTHLY = {"temp_table": A.month_partials, "temp_duration_interval": A.duration_histogram,
           "route_states": S.route_states, "hour_states": S.hour_states}


def in_months(months: list[Month]) -> Column:
    """Rows of these month files; prunes a table that is partitioned by them."""
    years = sorted({y for y, _ in months})
    return reduce(or_, [(F.col("src_year") == y) & F.col("src_month").isin([m for a, m in months if a == y]) for y in years])


def write_trip_tables(trips: DataFrame, warehouse: str, whole: bool = True, cleaned: bool = False) -> str:
    path = f"{warehouse}/taxi_trips"
    write_month_partitions(trips if cleaned else enrich_trips(trips), path, sort_by=("pickup_date", "pickup_hour"),
                           whole=whole)
    return path


def write_monthly(spark: SparkSession, trips_path: str, warehouse: str, months: list[Month] | None = None) -> dict[str, str]:
    """The per-month rollups and states.  With ``months``, only those month
    partitions are rebuilt, from a scan that is pruned to them."""
    enriched = spark.read.parquet(trips_path)
    changed = enriched if months is None else enriched.where(in_months(months))
    paths = {t: f"{warehouse}/{t}" for t in MONTHLY}
    for name, build in MONTHLY.items():
        write_month_partitions(build(changed), paths[name], whole=months is None)
    return paths


def write_views(spark: SparkSession, monthly: dict[str, str], zones: DataFrame, warehouse: str,
                months: list[Month] | None = None) -> dict[str, str]:
    """Everything that is made of the per-month tables; no trip is read."""
    def read(name: str) -> DataFrame:
        return spark.read.parquet(monthly[name])

    def stored(name: str, df: DataFrame, *keys: str) -> None:
        paths[name] = f"{warehouse}/{name}"
        write_sorted(df, paths[name], keys)

    paths = {"temp_pick_drop_zone": f"{warehouse}/temp_pick_drop_zone"}
    changed = read("route_states") if months is None else read("route_states").where(in_months(months))
    write_month_partitions(A.route_monthly(changed, zones), paths["temp_pick_drop_zone"], whole=months is None)
    stored("temp_trip_fare", A.hourly_profile(read("hour_states")), "pickup_hour")
    stored("mv_taxi_date_hour_daily", A.daily_totals(read("temp_table")), "pickup_date")
    stored("mv_taxi_date_hourly", A.hourly_series(read("temp_table")), "pickup_date", "pickup_hour")
    stored("mv_taxi_duration_trip", A.duration_distribution(read("temp_duration_interval")), "duration_interval")
    stored("mv_pick_drop_zone", A.route_rollup(read("route_states")), C.PU, C.DO)
    stored("mv_trip_fare", spark.read.parquet(paths["temp_trip_fare"]), "pickup_hour")
    return paths


def run(spark: SparkSession, trips: DataFrame, zones: DataFrame, warehouse: str,
        months: Iterable[int | Month] | None = None, cleaned: bool = False, year: int = C.REPORT_YEAR) -> dict[str, str]:
    """The whole batch job; returns table name -> path.

    ``cleaned``: ``trips`` are enriched already, file by file (see
    ``scan_monthly_trips(clean=enrich_trips)``).  Trips without a
    ``src_year`` are of ``year``.

    ``months``, as (year, month) or months of ``year``, makes it incremental:
    only those month files are cleaned and written (``trips`` is cut to them;
    pass a scan of just those files to read nothing else), only their
    partitions of the per-month rollups and states are replaced, and the
    small all-month tables are merged from the states.  A new or corrected
    month thus costs one month of work, not a full reload.
    """
    wanted = as_months(months, year)
    if "src_year" not in trips.columns:
        trips = trips.withColumn("src_year", F.lit(year))
    if wanted is not None:
        trips = trips.where(in_months(wanted))
    trips_path = write_trip_tables(trips, warehouse, wanted is None, cleaned)
    monthly = write_monthly(spark, trips_path, warehouse, wanted)
    return {"taxi_trips": trips_path, **monthly, **write_views(spark, monthly, zones, warehouse, wanted)}


def export_jdbc(spark: SparkSession, tables: dict[str, str], url: str, properties: dict,
                names: tuple[str, ...] | None = None, mode: str = "overwrite") -> list[str]:
    """Copy the batch job's tables into a database over JDBC (one table each,
    same names); each task writes its partition over its own connection."""
    from tripstats.sinks.writers import write_jdbc
    done = []
    for name in names or tuple(tables):
        write_jdbc(spark.read.parquet(tables[name]), url, name, properties, mode=mode)
        done.append(name)
    return done
