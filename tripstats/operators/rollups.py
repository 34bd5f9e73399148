"""Rollups of enriched trips.

Every rollup groups on a small key domain (hours, days, buckets, routes), so
Spark's partial aggregation collapses each input partition before the
shuffle: the shuffle carries at most (partitions x groups) rows whatever the
data volume, and a hot key (one zone with a third of all trips) is summed
map-side instead of landing in one task.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstats import config as C
from tripstats.functions.columns import (bucket_label, duration_bucket, exact_mean, label_start, mean_of_means,
                                         year_range)
from tripstats.operators.joins import with_zone_names
from tripstats.operators.states import (HOUR_SUMS, ROUTE_KEYS, ROUTE_SUMS, mean_dollars, merged, month_keys,
                                        paid_trips)

HOURLY_KEYS = ("pickup_date", "pickup_hour", "pickup_days")


def _sum_bigint(col: str, alias: str):
    return F.sum(col).cast("bigint").alias(alias)


# --- A1 / A2 / A3: trip counts ------------------------------------------------------------

def month_partials(enriched: DataFrame, year: int = C.REPORT_YEAR) -> DataFrame:
    """Trips per (month file, date, hour, weekday): the per-month hourly table,
    one group-by over all months instead of a loop of appends.

    Trips picked up in another year than the file's are left out; where the
    files' year is not known, it is ``year``.
    """
    own = (F.year("pickup_date") == F.col("src_year")) if "src_year" in enriched.columns else year_range("pickup_date", year)
    return (enriched.filter(own).groupBy(*month_keys(enriched), *HOURLY_KEYS)
            .agg(F.count(F.lit(1)).alias("count_trip")))


def hourly_counts(partials: DataFrame) -> DataFrame:
    """Trips per (date, hour, weekday), month files combined."""
    return partials.groupBy(*HOURLY_KEYS).agg(_sum_bigint("count_trip", "count_trip"))


def hourly_series(partials: DataFrame) -> DataFrame:
    """Hour-grain view of the per-month hourly table (no aggregation): a day
    split over two month files keeps one row per file."""
    return partials.select("pickup_date", "pickup_hour", "count_trip")


def daily_totals(hourly: DataFrame) -> DataFrame:
    """Daily trips from hourly counts (per-month or combined)."""
    return (hourly.groupBy("pickup_date", "pickup_days")
            .agg(_sum_bigint("count_trip", "total_trip")))


# --- A4 / A5 / A6: duration histogram -----------------------------------------------------

def duration_histogram(enriched: DataFrame, width_minutes: int = C.BUCKET_MINUTES,
                       cap: int = C.BUCKET_CAP) -> DataFrame:
    """Trips per (month file, duration bucket) for positive durations.

    The label is computed after the aggregation, on one row per bucket.
    """
    return (enriched.filter(F.col("trip_duration_sec") > 0)
            .groupBy(*month_keys(enriched), duration_bucket("trip_duration_sec", width_minutes)
                     .alias("duration_interval"))
            .agg(F.count(F.lit(1)).alias("trip_count"))
            .withColumn("duration_interval_class", bucket_label("duration_interval", width_minutes, cap)))


def duration_distribution(histogram: DataFrame) -> DataFrame:
    """Buckets summed over month files, with the label's leading number."""
    return (histogram.groupBy("duration_interval", "duration_interval_class")
            .agg(_sum_bigint("trip_count", "trip_count"))
            .withColumn("interval_start", label_start("duration_interval_class")))


def duration_by_class(histogram: DataFrame) -> DataFrame:
    """One row per label: all buckets above the cap folded into ``>180``."""
    return (histogram.groupBy("duration_interval_class")
            .agg(_sum_bigint("trip_count", "trip_count"))
            .withColumn("interval_start", label_start("duration_interval_class")))


# --- J1 / J2 / A7 / A8 / D1: routes -------------------------------------------------------

def trips_with_zones(enriched: DataFrame, zones: DataFrame) -> DataFrame:
    """Paid trips with pickup and drop-off zone names (two LEFT joins)."""
    base = paid_trips(enriched).select(*month_keys(enriched), C.PU, C.DO, "trip_distance_km",
                                       "total_amount_excluding_tips")
    return with_zone_names(base, zones).select(
        *month_keys(enriched), C.PU, "pickup_zone", C.DO, "drop_zone", "trip_distance_km",
        "total_amount_excluding_tips")


def route_monthly(states: DataFrame, zones: DataFrame) -> DataFrame:
    """Per month file and route: trips, mean km, mean fare without tip, from route states.

    The zone names join the (small) states; a zone name is a function of its
    LocationID, so the groups are the same as grouping the joined trips.
    """
    named = with_zone_names(states, zones)
    return named.select(*month_keys(states), C.PU, C.DO, "pickup_zone", "drop_zone", "total_trip",
                        mean_dollars("km_cents", "total_trip").alias("avg_trip_distance_km"),
                        mean_dollars("fare_cents", "total_trip").alias("avg_fare_amount"))


def route_rollup(states: DataFrame) -> DataFrame:
    """Routes over all month files: summed trips and the UNWEIGHTED mean of
    the monthly means (the reference's definition), rounded once to cents."""
    return (states.groupBy(*ROUTE_KEYS)
            .agg(_sum_bigint("total_trip", "trip_count"),
                 mean_of_means("km_cents", "total_trip").alias("avg_trip_distance_km"),
                 mean_of_means("fare_cents", "total_trip").alias("avg_fare_amount")))


def route_weighted(states: DataFrame) -> DataFrame:
    """Routes with trip-weighted means (sums and counts added up, divided once)."""
    return merged(states, ROUTE_KEYS, ROUTE_SUMS).select(
        *ROUTE_KEYS, F.col("total_trip").alias("trip_count"),
        exact_mean("km_cents", "total_trip").alias("avg_trip_distance_km"),
        exact_mean("fare_cents", "total_trip").alias("avg_fare_amount"))


# --- A9: hourly fare profile --------------------------------------------------------------

def hourly_profile(states: DataFrame) -> DataFrame:
    """Per pickup hour over all month files (paid trips only), from hour states:
    mean fare per km (zero-distance trips leave this mean only), mean tip,
    and counts of short (km <= 3) and long (km > 3) trips."""
    return merged(states, ["pickup_hour"], HOUR_SUMS).select(
        "pickup_hour", (F.col("fare_per_km") / F.nullif("km_trips", F.lit(0))).alias("avg_fare_per_km"),
        (F.col("tips") / F.col("trips")).alias("avg_tip_amount"), "short_trip_count", "long_trip_count")
