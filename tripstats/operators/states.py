"""Mergeable aggregate states of the trips, per month file.

A state holds sums and counts, never means, so states of months (or of any
split of the trips) merge by adding, and a reloaded month replaces its own
states only.  Kilometres and fares are rounded to cents per trip, so their
sums are whole cents and exact in any order; a mean is divided and rounded
once, from those sums.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripstats import config as C
from tripstats.functions.columns import cents

ROUTE_KEYS = (C.PU, C.DO)
#: Measures of a state; all merge by sum.
ROUTE_SUMS = ("total_trip", "km_cents", "fare_cents")
HOUR_SUMS = ("trips", "fare_per_km", "km_trips", "tips", "short_trip_count", "long_trip_count")


def month_keys(df: DataFrame) -> list[str]:
    """The columns that name a row's month file: year and month, or the month alone."""
    return [c for c in C.MONTH_KEYS if c in df.columns]


def paid_trips(enriched: DataFrame) -> DataFrame:
    return enriched.filter(F.col("total_amount_excluding_tips") > 0)


def route_states(enriched: DataFrame) -> DataFrame:
    """Per month file and route: paid trips, and their kilometres and fares in cents."""
    return (paid_trips(enriched).groupBy(*month_keys(enriched), *ROUTE_KEYS)
            .agg(F.count(F.lit(1)).alias("total_trip"),
                 F.sum(cents("trip_distance_km")).alias("km_cents"),
                 F.sum(cents("total_amount_excluding_tips")).alias("fare_cents")))


def hour_states(enriched: DataFrame, short_km: float = C.SHORT_TRIP_KM) -> DataFrame:
    """Per month file and pickup hour: paid trips, the sum of fares per km over the
    trips that have a distance, the sum of tips, and short and long trips."""
    km = F.col("trip_distance_km")
    ratio = F.col("total_amount_excluding_tips") / F.nullif(km, F.lit(0))
    return (paid_trips(enriched).groupBy(*month_keys(enriched), "pickup_hour")
            .agg(F.count(F.lit(1)).alias("trips"), F.sum(ratio).alias("fare_per_km"), F.count(ratio).alias("km_trips"),
                 F.sum("tip_amount").alias("tips"),
                 F.sum(F.when(km <= short_km, 1).otherwise(0)).cast("bigint").alias("short_trip_count"),
                 F.sum(F.when(km > short_km, 1).otherwise(0)).cast("bigint").alias("long_trip_count")))


def merged(states: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """States added up over everything but ``keys``."""
    return states.groupBy(*keys).agg(*[F.sum(c).cast(states.schema[c].dataType).alias(c) for c in sums])


def mean_dollars(total: str, n: str) -> Column:
    """The unrounded mean of cents, in whole units (a double)."""
    return F.col(total) / (F.col(n) * 100)
