"""Column expressions used by the operators.

All are built-in Spark expressions, so they stay inside whole-stage codegen;
none needs a Python UDF.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripstats import config as C


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def net_of_tip(total="total_amount", tip="tip_amount") -> Column:
    """Fare without the tip, rounded to cents (HALF_UP)."""
    return F.round(_c(total) - _c(tip), 2)


def miles_to_km(miles="trip_distance") -> Column:
    return F.round(_c(miles) * F.lit(C.MILES_TO_KM), 2)


def duration_seconds(start=C.PICKUP_TS, end=C.DROPOFF_TS) -> Column:
    """Signed trip duration in seconds.

    On TIMESTAMP_NTZ this is wall-clock arithmetic, independent of the
    session time zone (a trip across a DST change is not shortened).
    """
    return F.unix_timestamp(_c(end)) - F.unix_timestamp(_c(start))


def weekday_name(ts=C.PICKUP_TS) -> Column:
    return F.date_format(_c(ts), "EEEE")


def weekday_rank(day="pickup_days") -> Column:
    """1 for Monday .. 7 for Sunday; NULL for anything else (sorts last)."""
    pos = F.array_position(F.array(*[F.lit(d) for d in C.WEEKDAYS]), _c(day))
    return F.nullif(pos, F.lit(0))


def year_range(day, year: int) -> Column:
    """``year(day) = year`` of a date column, written as a range, so the
    predicate can be pushed to the file scan."""
    col = _c(day)
    return (col >= F.lit(f"{year:04d}-01-01").cast("date")) & (col < F.lit(f"{year + 1:04d}-01-01").cast("date"))


def duration_bucket(seconds="trip_duration_sec", width_minutes: int = C.BUCKET_MINUTES) -> Column:
    """Start (minutes, as DOUBLE) of the duration bucket."""
    return (F.floor(_c(seconds) / 60 / width_minutes) * width_minutes).cast("double")


def bucket_label(start="duration_interval", width_minutes: int = C.BUCKET_MINUTES,
                 cap: int = C.BUCKET_CAP) -> Column:
    """``"5.0-10.0"`` style label; every bucket starting above ``cap`` is ``">180"``."""
    s = _c(start)
    return (F.when(s > cap, F.lit(C.OVER_CAP_LABEL))
            .otherwise(F.concat(s.cast("string"), F.lit("-"), (s + width_minutes).cast("string"))))


def label_start(label="duration_interval_class") -> Column:
    """Leading number of a bucket label, NULL when the label has none."""
    return F.regexp_extract(_c(label), r"^(\d+\.?\d*)", 1).try_cast("double")


def cents(amount) -> Column:
    """An amount that is rounded to two places, as a whole number of cents (sums of these are exact)."""
    return F.round(_c(amount) * 100).cast("bigint")


def exact_mean(total_cents, n, decimals: int = 2) -> Column:
    """The mean of ``n`` amounts of ``total_cents`` together, rounded HALF_UP once.

    The quotient is a decimal of 12 places beyond the rounded one, which lies
    farther from a midpoint than its own error unless it is the midpoint
    (for n below 10^11), so it rounds as the exact quotient does.
    """
    total = _c(total_cents).cast("decimal(20,0)") * F.lit(10 ** (decimals - 2)).cast("decimal(5,0)")
    return F.round(total / _c(n).cast("decimal(12,0)")).cast("double") / 10 ** decimals


def mean_of_means(total_cents, n) -> Column:
    """Aggregate: the unweighted mean of groups' means, rounded HALF_UP once to two places."""
    means = _c(total_cents).cast("decimal(20,0)") / _c(n).cast("decimal(17,0)")
    return F.round(F.avg(means)).cast("double") / 100


def rounded_mean(mean) -> Column:
    """A mean that arrives as a double, rounded HALF_UP to two places.

    Twelve places take away what binary fractions add; beyond that the
    rounding is that of the decimal value.
    """
    return F.round(F.round(_c(mean).cast("decimal(38,15)"), 12), 2).cast("double")


def presented(value, decimals: int = C.REPORT_DECIMALS) -> Column:
    """An unrounded mean as shown in reports: fixed at ``decimals + 3`` places,
    then rounded to ``decimals``; the last bits of a floating sum, which
    depend on partition order, do not reach the result."""
    return F.round(_c(value).cast(f"decimal(38,{decimals + 3})"), decimals).cast("double")
