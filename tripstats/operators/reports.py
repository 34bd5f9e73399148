"""The report frames behind each dashboard chart.

Each takes a rollup table and returns a small, totally ordered DataFrame.
Unrounded means are presented at a fixed number of decimals (config), so the
output does not depend on partition order.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstats import config as C
from tripstats.functions.columns import label_start, presented, weekday_rank
from tripstats.operators.joins import with_zone_names
from tripstats.operators.reshape import fold


def weekday_avg(daily: DataFrame) -> DataFrame:
    """Mean daily trips per weekday, Monday..Sunday (unknown names last)."""
    return (daily.groupBy("pickup_days")
            .agg(presented(F.avg("total_trip")).alias("avg_trip_days"))
            .orderBy(weekday_rank("pickup_days").asc_nulls_last(), "pickup_days"))


def _month_weekday(daily: DataFrame, measure, alias: str) -> DataFrame:
    return (daily.groupBy(F.month("pickup_date").alias("month"), "pickup_days")
           .agg(measure.alias(alias))
           .orderBy("month", weekday_rank("pickup_days").asc_nulls_last(), "pickup_days"))


def month_weekday_sum(daily: DataFrame) -> DataFrame:
    return _month_weekday(daily, F.sum("total_trip").cast("bigint"), "total_trip_per_days")


def month_weekday_avg(daily: DataFrame) -> DataFrame:
    return _month_weekday(daily, presented(F.avg("total_trip")), "avg_trip_per_days")


def daily_trend(daily: DataFrame, before_month: int = C.LAST_REPORT_MONTH) -> DataFrame:
    """Daily totals before ``before_month`` with a ``"Month n"`` label."""
    m = F.month("pickup_date")
    return (daily.filter(m < before_month)
            .select("pickup_date", "total_trip",
                    F.concat(F.lit(C.MONTH_LABEL_PREFIX), m.cast("string")).alias("month"))
            .orderBy("pickup_date"))


def _profile(profile: DataFrame) -> DataFrame:
    return profile.withColumns({"avg_fare_per_km": presented("avg_fare_per_km"),
                                "avg_tip_amount": presented("avg_tip_amount")})


def hourly_profile_report(profile: DataFrame) -> DataFrame:
    return _profile(profile).orderBy("pickup_hour")


def hourly_fare(profile: DataFrame) -> DataFrame:
    return _profile(profile).select("pickup_hour", "avg_fare_per_km").orderBy("pickup_hour")


def hourly_tip(profile: DataFrame) -> DataFrame:
    return _profile(profile).select("pickup_hour", "avg_tip_amount").orderBy("pickup_hour")


def short_long_by_hour(profile: DataFrame) -> DataFrame:
    """Short and long trip counts folded to ``(pickup_hour, metric, value)``."""
    return (fold(profile.select("pickup_hour", "short_trip_count", "long_trip_count"),
                 ["pickup_hour"], ["short_trip_count", "long_trip_count"])
            .orderBy("pickup_hour", "metric"))


def duration_distribution_report(distribution: DataFrame, tiebreak: str = "duration_interval") -> DataFrame:
    """Buckets ordered by the label's leading number; ``>180`` rows last."""
    if "interval_start" not in distribution.columns:
        distribution = distribution.withColumn("interval_start", label_start("duration_interval_class"))
    return distribution.orderBy(F.col("interval_start").asc_nulls_last(), tiebreak)


def top_routes(routes: DataFrame, zones: DataFrame, n: int = C.TOP_N_ROUTES) -> DataFrame:
    """The ``n`` routes with most trips, then their zone names.

    ``orderBy(...).limit(n)`` plans as a TakeOrderedAndProject (a per-task
    top-n merged at the end); the zone joins touch only ``n`` rows.  Ties are
    broken by the route ids, and the result is ordered again after the joins.
    """
    top = routes.orderBy(F.col("trip_count").desc(), F.col(C.PU), F.col(C.DO)).limit(n)
    named = with_zone_names(top, zones)
    return (named.orderBy(F.col("trip_count").desc(), F.col(C.PU), F.col(C.DO))
            .select("pickup_zone", "drop_zone", "trip_count", "avg_trip_distance_km", "avg_fare_amount"))
