"""DuckDB SQL twins of the catalog queries (the correctness oracle).

Written independently of the Spark code: the trip projection of FIXTURES.md
§2 as CTEs, then one query per key.  Types are cast to match Spark's
(INTEGER hour/minute/month, BIGINT counts and sums).
"""
from __future__ import annotations

BASE = """
WITH base AS (
  SELECT l.l_partkey, l.l_linenumber, l.l_quantity, l.l_extendedprice, l.l_returnflag,
         o.o_orderkey, c.c_nationkey, s.s_nationkey,
         DATE '2024-12-30' + CAST((o.o_orderkey * 131 + l.l_linenumber * 17) % 156 AS INTEGER) AS pickup_d,
         (o.o_orderkey * 7919 + l.l_linenumber * 10007) % 86400 AS sec,
         (l.l_partkey * 37 + l.l_linenumber * 101) % 13200 - 60 AS dur
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN supplier s ON s.s_suppkey = l.l_suppkey
),
trips AS (
  SELECT
    CAST(CASE WHEN pickup_d < DATE '2025-01-01' THEN 1
              WHEN pickup_d >= DATE '2025-06-01' THEN 5
              WHEN day(pickup_d) = 1 AND l_linenumber = 1 AND month(pickup_d) > 1 THEN month(pickup_d) - 1
              ELSE month(pickup_d) END AS INTEGER) AS src_month,
    CAST(pickup_d AS TIMESTAMP) + to_seconds(sec) AS tpep_pickup_datetime,
    CAST(pickup_d AS TIMESTAMP) + to_seconds(sec + dur) AS tpep_dropoff_datetime,
    c_nationkey AS PULocationID,
    CASE WHEN l_partkey % 31 = 0 THEN 264 ELSE s_nationkey END AS DOLocationID,
    CASE WHEN l_quantity = 1 THEN CAST(0.0 AS DOUBLE) ELSE l_quantity / 10 END AS trip_distance,
    (CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN -1 ELSE 1 END)
      * CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 15000 AS DOUBLE) / 100 AS total_amount,
    CAST((l_partkey * 13 + l_linenumber * 29) % 2000 AS DOUBLE) / 100 AS tip_amount,
    CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE 'N' END AS store_and_fwd_flag
  FROM base
),
derived AS (
  SELECT *,
    round(total_amount - tip_amount, 2) AS total_amount_excluding_tips,
    CAST(tpep_pickup_datetime AS DATE) AS pickup_date,
    dayname(tpep_pickup_datetime) AS pickup_days,
    CAST(hour(tpep_pickup_datetime) AS INTEGER) AS pickup_hour,
    CAST(minute(tpep_pickup_datetime) AS INTEGER) AS pickup_minute,
    round(trip_distance * 1.60934, 2) AS trip_distance_km,
    date_diff('second', tpep_pickup_datetime, tpep_dropoff_datetime) AS trip_duration_sec
  FROM trips
  WHERE total_amount >= 0
),
enriched AS (
  SELECT * FROM derived
  WHERE src_month IS NOT NULL AND tpep_pickup_datetime IS NOT NULL AND tpep_dropoff_datetime IS NOT NULL
    AND PULocationID IS NOT NULL AND DOLocationID IS NOT NULL
    AND trip_distance IS NOT NULL AND NOT isnan(trip_distance)
    AND total_amount IS NOT NULL AND NOT isnan(total_amount)
    AND tip_amount IS NOT NULL AND NOT isnan(tip_amount)
    AND store_and_fwd_flag IS NOT NULL
    AND total_amount_excluding_tips IS NOT NULL AND NOT isnan(total_amount_excluding_tips)
    AND pickup_date IS NOT NULL AND pickup_days IS NOT NULL AND pickup_hour IS NOT NULL
    AND pickup_minute IS NOT NULL
    AND trip_distance_km IS NOT NULL AND NOT isnan(trip_distance_km)
    AND trip_duration_sec IS NOT NULL
),
zones AS (
  SELECT CAST(n_nationkey AS INTEGER) AS LocationID, n_name AS Zone FROM nation
),
month_partials AS (
  SELECT src_month, pickup_date, pickup_hour, pickup_days, count(*) AS count_trip
  FROM enriched
  WHERE tpep_pickup_datetime >= TIMESTAMP '2025-01-01 00:00:00'
    AND tpep_pickup_datetime < TIMESTAMP '2026-01-01 00:00:00'
  GROUP BY src_month, pickup_date, pickup_hour, pickup_days
),
daily AS (
  SELECT pickup_date, pickup_days, CAST(sum(count_trip) AS BIGINT) AS total_trip
  FROM month_partials GROUP BY pickup_date, pickup_days
),
histogram AS (
  SELECT src_month, duration_interval, trip_count,
         CASE WHEN duration_interval > 180 THEN '>180'
              ELSE CAST(duration_interval AS VARCHAR) || '-' || CAST(duration_interval + 5 AS VARCHAR)
         END AS duration_interval_class
  FROM (SELECT src_month, CAST(floor(trip_duration_sec / 60 / 5) * 5 AS DOUBLE) AS duration_interval,
               count(*) AS trip_count
        FROM enriched WHERE trip_duration_sec > 0
        GROUP BY src_month, CAST(floor(trip_duration_sec / 60 / 5) * 5 AS DOUBLE)) h
),
paid AS (
  SELECT * FROM enriched WHERE total_amount_excluding_tips > 0
),
route_monthly AS (
  SELECT t.src_month, t.PULocationID, t.DOLocationID, z1.Zone AS pickup_zone, z2.Zone AS drop_zone,
         count(*) AS total_trip, avg(t.trip_distance_km) AS avg_trip_distance_km,
         avg(t.total_amount_excluding_tips) AS avg_fare_amount,
         sum(CAST(round(t.trip_distance_km * 100) AS HUGEINT)) AS km_cents,
         sum(CAST(round(t.total_amount_excluding_tips * 100) AS HUGEINT)) AS fare_cents
  FROM paid t
  LEFT JOIN zones z1 ON t.PULocationID = z1.LocationID
  LEFT JOIN zones z2 ON t.DOLocationID = z2.LocationID
  GROUP BY t.src_month, t.PULocationID, t.DOLocationID, z1.Zone, z2.Zone
),
route_means AS (
  SELECT PULocationID, DOLocationID, CAST(sum(total_trip) AS BIGINT) AS trip_count,
         -- monthly means in units of 10^-15 cents, averaged and rounded half up as integers
         CAST((2 * sum((km_cents * 1000000000000000 + total_trip // 2) // total_trip)
               + count(*) * 1000000000000000) // (2 * count(*) * 1000000000000000) AS DOUBLE) / 100
           AS avg_trip_distance_km,
         CAST((2 * sum((fare_cents * 1000000000000000 + total_trip // 2) // total_trip)
               + count(*) * 1000000000000000) // (2 * count(*) * 1000000000000000) AS DOUBLE) / 100
           AS avg_fare_amount
  FROM (SELECT *, CAST(total_trip AS HUGEINT) AS n FROM route_monthly) GROUP BY PULocationID, DOLocationID
),
profile AS (
  SELECT pickup_hour,
         avg(total_amount_excluding_tips / NULLIF(trip_distance_km, 0)) AS avg_fare_per_km,
         avg(tip_amount) AS avg_tip_amount,
         CAST(sum(CASE WHEN trip_distance_km <= 3 THEN 1 ELSE 0 END) AS BIGINT) AS short_trip_count,
         CAST(sum(CASE WHEN trip_distance_km > 3 THEN 1 ELSE 0 END) AS BIGINT) AS long_trip_count
  FROM paid GROUP BY pickup_hour
)
"""


def mean2(cents: str, n: str) -> str:
    """The mean of ``n`` amounts of whole cents, none negative in sum, rounded half up by integer division."""
    return f"CAST((2 * CAST({cents} AS HUGEINT) + {n}) // (2 * {n}) AS DOUBLE) / 100"


def r6(x: str) -> str:
    """Presented mean (same as presented())."""
    return f"CAST(round(CAST({x} AS DECIMAL(38,9)), 6) AS DOUBLE)"


WEEKDAY_RANK = ("CASE pickup_days WHEN 'Monday' THEN 1 WHEN 'Tuesday' THEN 2 WHEN 'Wednesday' THEN 3 "
                "WHEN 'Thursday' THEN 4 WHEN 'Friday' THEN 5 WHEN 'Saturday' THEN 6 "
                "WHEN 'Sunday' THEN 7 END")

TOP_ROUTES = """
SELECT z1.Zone AS pickup_zone, z2.Zone AS drop_zone, t.trip_count, t.avg_trip_distance_km, t.avg_fare_amount
FROM (SELECT * FROM route_means ORDER BY trip_count DESC, PULocationID, DOLocationID LIMIT 10) t
LEFT JOIN zones z1 ON t.PULocationID = z1.LocationID
LEFT JOIN zones z2 ON t.DOLocationID = z2.LocationID
ORDER BY t.trip_count DESC, t.PULocationID, t.DOLocationID
"""

QUERIES = {
    "scan_trips": "SELECT * FROM trips",
    "zone_lookup": "SELECT * FROM zones",
    "enrich_trips": "SELECT * FROM enriched",
    "union_months": """SELECT src_month, pickup_hour, total_amount_excluding_tips, trip_distance_km, tip_amount
                       FROM enriched WHERE src_month IN (1, 2, 3, 4, 5)""",
    "trips_with_zones": """SELECT t.src_month, t.PULocationID, z1.Zone AS pickup_zone, t.DOLocationID,
                                  z2.Zone AS drop_zone, t.trip_distance_km, t.total_amount_excluding_tips
                           FROM paid t
                           LEFT JOIN zones z1 ON t.PULocationID = z1.LocationID
                           LEFT JOIN zones z2 ON t.DOLocationID = z2.LocationID""",
    "month_partials": "SELECT * FROM month_partials",
    "hourly_counts": """SELECT pickup_date, pickup_hour, pickup_days, count(*) AS count_trip
                        FROM enriched
                        WHERE year(pickup_date) = 2025
                        GROUP BY pickup_date, pickup_hour, pickup_days""",
    "hourly_series": "SELECT pickup_date, pickup_hour, count_trip FROM month_partials",
    "daily_totals": "SELECT * FROM daily ORDER BY pickup_date",
    "duration_histogram": "SELECT src_month, duration_interval, trip_count, duration_interval_class FROM histogram",
    "duration_distribution": """
        SELECT duration_interval, duration_interval_class, CAST(sum(trip_count) AS BIGINT) AS trip_count,
               TRY_CAST(NULLIF(regexp_extract(duration_interval_class, '^(\\d+\\.?\\d*)', 1), '') AS DOUBLE)
                 AS interval_start
        FROM histogram GROUP BY duration_interval, duration_interval_class
        ORDER BY interval_start NULLS LAST, duration_interval""",
    "duration_by_class": """
        SELECT duration_interval_class, CAST(sum(trip_count) AS BIGINT) AS trip_count,
               TRY_CAST(NULLIF(regexp_extract(duration_interval_class, '^(\\d+\\.?\\d*)', 1), '') AS DOUBLE)
                 AS interval_start
        FROM histogram GROUP BY duration_interval_class
        ORDER BY interval_start NULLS LAST, duration_interval_class""",
    "route_monthly": f"""
        SELECT src_month, PULocationID, DOLocationID, pickup_zone, drop_zone, total_trip,
               {r6('avg_trip_distance_km')} AS avg_trip_distance_km, {r6('avg_fare_amount')} AS avg_fare_amount
        FROM route_monthly""",
    "route_rollup": "SELECT * FROM route_means ORDER BY PULocationID, DOLocationID",
    "route_weighted": f"""
        SELECT PULocationID, DOLocationID, count(*) AS trip_count,
               {mean2('sum(CAST(round(trip_distance_km * 100) AS HUGEINT))', 'count(*)')} AS avg_trip_distance_km,
               {mean2('sum(CAST(round(total_amount_excluding_tips * 100) AS HUGEINT))', 'count(*)')} AS avg_fare_amount
        FROM paid GROUP BY PULocationID, DOLocationID ORDER BY PULocationID, DOLocationID""",
    "hourly_profile": f"""
        SELECT pickup_hour, {r6('avg_fare_per_km')} AS avg_fare_per_km, {r6('avg_tip_amount')} AS avg_tip_amount,
               short_trip_count, long_trip_count
        FROM profile ORDER BY pickup_hour""",
    "hourly_fare": f"SELECT pickup_hour, {r6('avg_fare_per_km')} AS avg_fare_per_km FROM profile ORDER BY pickup_hour",
    "hourly_tip": f"SELECT pickup_hour, {r6('avg_tip_amount')} AS avg_tip_amount FROM profile ORDER BY pickup_hour",
    "short_long_by_hour": """
        SELECT pickup_hour, 'short_trip_count' AS metric, short_trip_count AS value FROM profile
        UNION ALL
        SELECT pickup_hour, 'long_trip_count' AS metric, long_trip_count AS value FROM profile
        ORDER BY pickup_hour, metric""",
    "weekday_avg": f"""
        SELECT pickup_days, {r6('avg(total_trip)')} AS avg_trip_days
        FROM daily GROUP BY pickup_days ORDER BY {WEEKDAY_RANK} NULLS LAST, pickup_days""",
    "month_weekday_sum": f"""
        SELECT CAST(month(pickup_date) AS INTEGER) AS month, pickup_days,
               CAST(sum(total_trip) AS BIGINT) AS total_trip_per_days
        FROM daily GROUP BY month(pickup_date), pickup_days
        ORDER BY month, {WEEKDAY_RANK} NULLS LAST, pickup_days""",
    "month_weekday_avg": f"""
        SELECT CAST(month(pickup_date) AS INTEGER) AS month, pickup_days,
               {r6('avg(total_trip)')} AS avg_trip_per_days
        FROM daily GROUP BY month(pickup_date), pickup_days
        ORDER BY month, {WEEKDAY_RANK} NULLS LAST, pickup_days""",
    "daily_trend": """
        SELECT pickup_date, total_trip, 'Month ' || CAST(month(pickup_date) AS VARCHAR) AS month
        FROM daily WHERE month(pickup_date) < 6 ORDER BY pickup_date""",
    "top_routes": TOP_ROUTES,
}


def oracle_sql() -> dict[str, str]:
    from tripstats.plans.dashboard import TEXTS
    from tripstats.plans.stream_oracle import STREAM_SQL
    asked = {name: QUERIES[name.removeprefix("sql_")] for name in TEXTS}      # a text gives the rows of its report
    return {k: BASE + v for k, v in {**QUERIES, **STREAM_SQL, **asked}.items()}
