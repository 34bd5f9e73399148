"""The dashboard's questions as SQL text with named parameters.

Each text runs on the named views of ``plans.views`` through ``spark.sql`` and
gives the rows of the report of the same name in ``operators.reports``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstats import config as C
from tripstats.plans.views import catalog_views, run_query

#: An unrounded mean as reports show it.
_SHOWN = "CAST(round(CAST({} AS DECIMAL(38, 9)), 6) AS DOUBLE)"
_WEEKDAY = "nullif(array_position(:weekdays, pickup_days), 0) NULLS LAST, pickup_days"

TEXTS = {
    "sql_weekday_avg": f"""
        SELECT pickup_days, {_SHOWN.format('avg(total_trip)')} AS avg_trip_days
        FROM taxi_trip_daily WHERE year(pickup_date) = :year
        GROUP BY pickup_days ORDER BY {_WEEKDAY}""",
    "sql_month_weekday_sum": f"""
        SELECT month(pickup_date) AS month, pickup_days, sum(total_trip) AS total_trip_per_days
        FROM taxi_trip_daily WHERE year(pickup_date) = :year
        GROUP BY month(pickup_date), pickup_days ORDER BY month, {_WEEKDAY}""",
    "sql_month_weekday_avg": f"""
        SELECT month(pickup_date) AS month, pickup_days, {_SHOWN.format('avg(total_trip)')} AS avg_trip_per_days
        FROM taxi_trip_daily WHERE year(pickup_date) = :year
        GROUP BY month(pickup_date), pickup_days ORDER BY month, {_WEEKDAY}""",
    "sql_daily_trend": """
        SELECT pickup_date, total_trip, :label || CAST(month(pickup_date) AS STRING) AS month
        FROM taxi_trip_daily WHERE year(pickup_date) = :year AND month(pickup_date) < :before_month
        ORDER BY pickup_date""",
    "sql_hourly_profile": f"""
        SELECT pickup_hour, {_SHOWN.format('avg_fare_per_km')} AS avg_fare_per_km,
               {_SHOWN.format('avg_tip_amount')} AS avg_tip_amount, short_trip_count, long_trip_count
        FROM taxi_trip_fare_f ORDER BY pickup_hour""",
    "sql_hourly_tip": f"""
        SELECT pickup_hour, {_SHOWN.format('avg_tip_amount')} AS avg_tip_amount
        FROM taxi_trip_fare_f ORDER BY pickup_hour""",
    "sql_duration_distribution": r"""
        SELECT duration_interval, duration_interval_class, sum(trip_count) AS trip_count,
               try_cast(regexp_extract(duration_interval_class, '^(\\d+\\.?\\d*)', 1) AS DOUBLE) AS interval_start
        FROM taxi_duration_interval_f
        GROUP BY duration_interval, duration_interval_class
        ORDER BY interval_start NULLS LAST, duration_interval""",
    "sql_top_routes": """
        WITH top AS (SELECT PULocationID, DOLocationID, trip_count, avg_trip_distance_km, avg_fare_amount
                     FROM pick_drop_zone_f ORDER BY trip_count DESC, PULocationID, DOLocationID LIMIT :n)
        SELECT p.Zone AS pickup_zone, d.Zone AS drop_zone, top.trip_count, top.avg_trip_distance_km, top.avg_fare_amount
        FROM top LEFT JOIN taxi_zone_lookup p ON top.PULocationID = p.LocationID
                 LEFT JOIN taxi_zone_lookup d ON top.DOLocationID = d.LocationID
        ORDER BY top.trip_count DESC, top.PULocationID, top.DOLocationID""",
}


def parameters(year: int = C.REPORT_YEAR, before_month: int = C.LAST_REPORT_MONTH, n: int = C.TOP_N_ROUTES) -> dict:
    """Values of the parameters that the texts name."""
    return {"year": year, "before_month": before_month, "n": n, "label": C.MONTH_LABEL_PREFIX,
            "weekdays": F.array(*[F.lit(d) for d in C.WEEKDAYS])}


def ask(spark: SparkSession, name: str, **changed) -> DataFrame:
    """The text ``name`` on the session's views, with the parameters it names."""
    text, values = TEXTS[name], {**parameters(), **changed}
    return run_query(spark, text, {k: v for k, v in values.items() if f":{k}" in text})


def _query(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog_views(spark, sf_dir)
        return ask(spark, name)
    return query


DASHBOARD_QUERIES = {name: _query(name) for name in TEXTS}
