"""Edge rows the projected tables cannot produce, on small inline frames."""
import datetime as dt
import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripstats.functions.columns import bucket_label, label_start, weekday_rank
from tripstats.operators import reports as R
from tripstats.operators import rollups as A
from tripstats.operators import states as S
from tripstats.operators.enrich import enrich_trips

TRIP_SCHEMA = T.StructType([
    T.StructField("src_month", T.IntegerType()),
    T.StructField("tpep_pickup_datetime", T.TimestampNTZType()),
    T.StructField("tpep_dropoff_datetime", T.TimestampNTZType()),
    T.StructField("PULocationID", T.IntegerType()),
    T.StructField("DOLocationID", T.IntegerType()),
    T.StructField("trip_distance", T.DoubleType()),
    T.StructField("total_amount", T.DoubleType()),
    T.StructField("tip_amount", T.DoubleType()),
    T.StructField("store_and_fwd_flag", T.StringType()),
])


def ts(s):
    return dt.datetime.fromisoformat(s)


def trip(pick="2025-01-06 08:00:00", drop="2025-01-06 08:20:00", pu=1, do=2, miles=2.0,
         total=20.0, tip=2.0, flag="N", month=1):
    return (month, ts(pick), ts(drop), pu, do, miles, total, tip, flag)


def frame(spark, *trips):
    return spark.createDataFrame(list(trips), TRIP_SCHEMA)


def test_cleaning_drops_negative_null_and_nan(spark):
    df = frame(spark,
               trip(),
               trip(total=-5.0),                 # negative total
               trip(flag=None),                  # null in any column
               trip(miles=float("nan")),         # NaN counts as missing
               trip(total=None))
    out = enrich_trips(df).collect()
    assert len(out) == 1
    r = out[0]
    assert r.total_amount_excluding_tips == 18.0
    assert r.pickup_days == "Monday" and r.pickup_hour == 8 and r.pickup_minute == 0
    assert r.trip_distance_km == 3.22 and r.trip_duration_sec == 1200
    assert r.pickup_date == dt.date(2025, 1, 6)


def test_duration_is_wall_clock_across_dst(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = frame(spark, trip(pick="2025-03-09 01:30:00", drop="2025-03-09 03:30:00"))
        assert enrich_trips(df).first().trip_duration_sec == 7200
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_bucket_labels_and_cap(spark):
    secs = [1, 299, 300, 180 * 60, 185 * 60, 190 * 60 + 5, 0, -60]
    df = frame(spark, *[trip(pick="2025-01-06 00:00:00",
                             drop=(ts("2025-01-06 00:00:00") + dt.timedelta(seconds=s)).isoformat(" "))
                        for s in secs])
    hist = A.duration_histogram(enrich_trips(df))
    got = {(r.duration_interval, r.duration_interval_class): r.trip_count for r in hist.collect()}
    assert got == {(0.0, "0.0-5.0"): 2, (5.0, "5.0-10.0"): 1, (180.0, "180.0-185.0"): 1,
                   (185.0, ">180"): 1, (190.0, ">180"): 1}
    dist = R.duration_distribution_report(A.duration_distribution(hist)).collect()
    assert [r.duration_interval_class for r in dist] == ["0.0-5.0", "5.0-10.0", "180.0-185.0", ">180", ">180"]
    assert dist[-1].interval_start is None
    by_class = {r.duration_interval_class: r.trip_count for r in A.duration_by_class(hist).collect()}
    assert by_class[">180"] == 2


def test_label_start_parsing(spark):
    df = spark.createDataFrame([("5.0-10.0",), (">180",), ("12-17",), ("",)], "c string")
    assert [r[0] for r in df.select(label_start("c")).collect()] == [5.0, None, 12.0, None]
    df2 = spark.createDataFrame([(175.0,), (180.0,), (185.0,)], "d double")
    assert [r[0] for r in df2.select(bucket_label("d")).collect()] == ["175.0-180.0", "180.0-185.0", ">180"]


def test_hourly_profile_zero_km_and_unpaid(spark):
    df = frame(spark,
               trip(miles=0.0, total=10.0, tip=0.0),     # zero km: short, not in fare/km
               trip(miles=1.0, total=11.0, tip=1.0),     # 1.61 km, fare 10
               trip(miles=10.0, total=30.0, tip=5.0),    # 16.09 km: long
               trip(miles=1.0, total=3.0, tip=3.0))      # net fare 0: excluded everywhere
    p = A.hourly_profile(S.hour_states(enrich_trips(df))).collect()
    assert len(p) == 1
    r = p[0]
    assert r.short_trip_count == 2 and r.long_trip_count == 1
    assert math.isclose(r.avg_fare_per_km, (10.0 / 1.61 + 25.0 / 16.09) / 2)
    assert math.isclose(r.avg_tip_amount, 2.0)


def test_unknown_zone_kept_with_null_name(spark):
    zones = spark.createDataFrame([("1", "Alpha"), ("2", "Beta")], "LocationID string, Zone string")
    df = frame(spark, trip(do=264), trip(do=264), trip(do=2))
    rm = A.route_monthly(S.route_states(enrich_trips(df)), zones).collect()
    got = {(r.DOLocationID, r.drop_zone): r.total_trip for r in rm}
    assert got == {(264, None): 2, (2, "Beta"): 1}


def test_route_rollup_mean_of_means_vs_weighted(spark):
    df = frame(spark,
               trip(month=1, total=12.0, tip=2.0),     # fare 10
               trip(month=2, total=22.0, tip=2.0),     # fare 20
               trip(month=2, total=32.0, tip=2.0))     # fare 30
    states = S.route_states(enrich_trips(df))
    rolled = A.route_rollup(states).first()
    weighted = A.route_weighted(states).first()
    assert rolled.trip_count == 3 and weighted.trip_count == 3
    assert rolled.avg_fare_amount == 17.5      # (10 + 25) / 2
    assert weighted.avg_fare_amount == 20.0    # (10 + 20 + 30) / 3


def test_top_routes_tie_break_and_order(spark):
    zones = spark.createDataFrame([(i, f"Z{i}") for i in range(1, 13)], "LocationID int, Zone string")
    routes = spark.createDataFrame(
        [(i, i, 5 if i <= 11 else 9, 1.23, 5.68) for i in range(1, 13)],
        "PULocationID int, DOLocationID int, trip_count bigint, avg_trip_distance_km double, "
        "avg_fare_amount double")
    out = R.top_routes(routes, zones).collect()
    assert len(out) == 10
    assert out[0].pickup_zone == "Z12" and out[0].trip_count == 9
    # ties at 5 broken by the route ids: Z1..Z9 kept, Z10 and Z11 cut
    assert [r.pickup_zone for r in out[1:]] == [f"Z{i}" for i in range(1, 10)]
    assert out[0].avg_trip_distance_km == 1.23 and out[0].avg_fare_amount == 5.68


def test_weekday_order_and_unknown_last(spark):
    daily = spark.createDataFrame(
        [(dt.date(2025, 1, 5), "Sunday", 3), (dt.date(2025, 1, 6), "Monday", 5),
         (dt.date(2025, 1, 8), "Wednesday", 7), (dt.date(2025, 1, 9), "Funday", 1)],
        "pickup_date date, pickup_days string, total_trip bigint")
    assert [r.pickup_days for r in R.weekday_avg(daily).collect()] == ["Monday", "Wednesday", "Sunday", "Funday"]
    ranks = daily.select(weekday_rank("pickup_days").alias("r")).collect()
    assert [r.r for r in ranks] == [7, 1, 3, None]


def test_month_weekday_is_whole_and_ordered(spark):
    rows = []
    d = dt.date(2025, 1, 1)
    while d < dt.date(2025, 6, 4):
        rows.append((d, d.strftime("%A"), 10))
        d += dt.timedelta(days=1)
    daily = spark.createDataFrame(rows, "pickup_date date, pickup_days string, total_trip bigint")
    out = R.month_weekday_sum(daily).collect()
    assert len(out) == 38          # every group, also those of a sixth month
    assert {r.month for r in out} == {1, 2, 3, 4, 5, 6}
    assert [r.pickup_days for r in out[:7]] == ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday",
                                                "Saturday", "Sunday"]
    trend = R.daily_trend(daily).collect()
    assert trend[0].month == "Month 1" and all(r.pickup_date < dt.date(2025, 6, 1) for r in trend)


def test_split_day_counts_twice_in_series_once_in_daily(spark):
    df = frame(spark,
               trip(month=1, pick="2025-02-01 10:00:00", drop="2025-02-01 10:10:00"),
               trip(month=2, pick="2025-02-01 10:30:00", drop="2025-02-01 10:40:00"))
    partials = A.month_partials(enrich_trips(df))
    assert sorted(r.count_trip for r in A.hourly_series(partials).collect()) == [1, 1]
    assert [r.total_trip for r in A.daily_totals(partials).collect()] == [2]


def test_year_filter_keeps_only_2025(spark):
    df = frame(spark,
               trip(pick="2024-12-31 23:59:59", drop="2025-01-01 00:10:00"),
               trip(pick="2025-01-01 00:00:00", drop="2025-01-01 00:10:00"))
    out = A.hourly_counts(A.month_partials(enrich_trips(df))).collect()
    assert [(r.pickup_date, r.count_trip) for r in out] == [(dt.date(2025, 1, 1), 1)]


def test_short_long_fold(spark):
    prof = spark.createDataFrame([(h, 1.0, 1.0, h, 2 * h) for h in range(24)],
                                 "pickup_hour int, avg_fare_per_km double, avg_tip_amount double, "
                                 "short_trip_count bigint, long_trip_count bigint")
    out = R.short_long_by_hour(prof).collect()
    assert len(out) == 48
    assert {r.metric for r in out} == {"short_trip_count", "long_trip_count"}
    assert sum(r.value for r in out) == sum(3 * h for h in range(24))


def test_a_mean_is_rounded_once_from_exact_sums(spark):
    """Just below a midpoint: 25,000 trips of 1.00 and 1.01 with the mean 1.0049996.  Rounded at six places
    first it would be 1.005 and then 1.01."""
    fares = spark.range(25_000).select(
        F.lit(1).alias("src_month"), F.lit(1).alias("PULocationID"), F.lit(2).alias("DOLocationID"),
        F.when(F.col("id") < 12_499, 1.01).otherwise(1.0).alias("total_amount_excluding_tips"),
        F.when(F.col("id") % 2 == 0, 0.01).otherwise(0.0).alias("trip_distance_km"))
    states = S.route_states(fares)
    weighted, rolled = A.route_weighted(states).first(), A.route_rollup(states).first()
    assert weighted.avg_fare_amount == rolled.avg_fare_amount == 1.0
    # the midpoint itself, 0.005, is rounded up
    assert weighted.avg_trip_distance_km == rolled.avg_trip_distance_km == 0.01


def test_means_beside_a_midpoint_by_fractions(spark):
    from decimal import ROUND_HALF_UP, Decimal
    from fractions import Fraction
    from tripstats.functions.columns import exact_mean
    cases = [(s, n) for n in (1, 2, 3, 7, 8, 40, 199_999, 3_000_001) for s in (0, 1, n // 2, n // 2 + 1, n, 3 * n // 2, 10 ** 11 + 1)]
    got = spark.createDataFrame(cases, "s long, n long").select(
        "s", "n", exact_mean("s", "n").alias("two"), exact_mean("s", "n", 6).alias("six")).collect()
    for r in got:
        for places, value in ((2, r.two), (6, r.six)):
            scaled = Fraction(r.s, r.n) * 10 ** (places - 2)
            whole = (2 * scaled.numerator + scaled.denominator) // (2 * scaled.denominator)
            assert value == float(Decimal(whole).scaleb(-places).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))


def test_states_of_parts_merge_to_the_state_of_the_whole(spark):
    from conftest import SF_SMALL
    from tripstats.plans import catalog as Q
    e = Q.enriched(spark, SF_SMALL)
    parts = e.where("pickup_hour < 9"), e.where("pickup_hour >= 9")
    whole = S.merged(S.route_states(e), S.ROUTE_KEYS, S.ROUTE_SUMS)
    both = S.merged(S.route_states(parts[0]).unionByName(S.route_states(parts[1])), S.ROUTE_KEYS, S.ROUTE_SUMS)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, both.collect()))


def test_year_of_the_file_decides_which_trips_count(spark):
    df = frame(spark,
               trip(pick="2025-12-31 23:00:00", drop="2025-12-31 23:10:00"),
               trip(pick="2026-01-01 00:00:00", drop="2026-01-01 00:10:00"))
    both = df.withColumn("src_year", F.lit(2025)).unionByName(df.withColumn("src_year", F.lit(2026)))
    out = A.month_partials(enrich_trips(both)).collect()
    assert sorted((r.src_year, r.pickup_date.year, r.count_trip) for r in out) == [(2025, 2025, 1), (2026, 2026, 1)]
