"""The physical plans have the intended shape."""
import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
import __spark_entry__ as E
from tripstats import config as C
from tripstats.operators.joins import has_at_most, join_dimension
from tripstats.plans import catalog as Q
from tripstats.sources.tables import trips_from_tables


def plan(df):
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_top_routes_is_take_ordered_then_broadcast_lookups(spark):
    p = plan(E.queries()["top_routes"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in p
    assert "BroadcastHashJoin LeftOuter" in p


def test_fact_join_is_sort_merge_and_scans_are_pruned(spark):
    from tripstats.operators import rollups as A
    from tripstats.operators import states as S
    from tripstats.operators.enrich import enrich_trips
    from tripstats.sources.tables import trips_from_tables
    p = plan(A.hourly_profile(S.hour_states(enrich_trips(trips_from_tables(spark, SF_SMALL)))))
    assert "SortMergeJoin" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in p
    assert "PushedFilters" in p
    # partial aggregation before the shuffle
    assert p.count("HashAggregate") >= 2


def test_rollups_read_the_written_trip_table_pruned(spark):
    from tripstats.operators import states as S
    from tripstats.plans import catalog as Q
    p = plan(S.hour_states(Q.enriched(spark, SF_SMALL)))
    assert "Join" not in p
    assert ("ReadSchema: struct<tip_amount:double,total_amount_excluding_tips:double,pickup_hour:int,"
            "trip_distance_km:double>") in p
    assert "PushedFilters: [IsNotNull(total_amount_excluding_tips), GreaterThan(total_amount_excluding_tips,0.0)]" in p


REPORTS = ("month_partials hourly_counts hourly_series daily_totals duration_histogram duration_distribution "
           "duration_by_class route_monthly route_rollup route_weighted hourly_profile hourly_fare hourly_tip "
           "short_long_by_hour weekday_avg month_weekday_sum month_weekday_avg daily_trend top_routes "
           "sql_weekday_avg sql_month_weekday_sum sql_month_weekday_avg sql_daily_trend sql_hourly_profile sql_hourly_tip "
           "sql_duration_distribution sql_top_routes").split()


@pytest.mark.parametrize("name", REPORTS)
def test_reports_scan_no_trips(spark, name):
    """Every rollup and report reads stored rollups (and zones), none the fact table."""
    read = {f.split("/")[-2 if "src_month=" not in f else -3] for f in E.queries()[name](spark, SF_SMALL).inputFiles()}
    assert read <= {"hourly", "durations", "routes", "hours", "sf0.001"}
    p = plan(E.queries()[name](spark, SF_SMALL))
    assert "tpep_pickup_datetime" not in p and "l_orderkey" not in p


def test_top_routes_joins_zones_after_the_limit_only(spark):
    p = plan(E.queries()["top_routes"](spark, SF_SMALL))
    assert p.count("BroadcastHashJoin LeftOuter") // max(1, p.count("== Initial Plan ==") + 1) <= 2
    tree = p[:p.index("(1) ")]
    assert tree.index("BroadcastHashJoin") < tree.index("TakeOrderedAndProject", tree.index("BroadcastHashJoin"))


def test_broadcast_only_below_bound(spark):
    small = spark.range(10).withColumnRenamed("id", "k")
    big = spark.range(1000).withColumnRenamed("id", "k")
    assert has_at_most(small, 10) and not has_at_most(big, 10)
    fact = spark.range(100).withColumnRenamed("id", "k")
    assert "BroadcastHashJoin" in plan(join_dimension(fact, small, "k", max_rows=10))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan(join_dimension(fact, big, "k", max_rows=10))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_year_filter_reaches_a_file_scan(spark, tmp_path):
    from tripstats.operators import rollups as A
    from tripstats.plans import catalog as Q
    path = str(tmp_path / "e")
    Q.enriched(spark, SF_SMALL).write.parquet(path)
    p = plan(A.month_partials(spark.read.parquet(path)))
    assert "GreaterThanOrEqual(pickup_date,2025-01-01)" in p and "LessThan(pickup_date,2026-01-01)" in p
    assert "tpep_pickup_datetime" not in p                      # no wide column for the year


def test_registered_queries_prune_and_push(spark):
    q = E.queries()
    months = q["union_months"](spark, SF_SMALL)             # all months; a month asked for prunes the scan
    p = plan(months.where("src_month IN (2, 3)"))
    assert "PartitionFilters: [src_month" in p and "IN (2,3)" in p
    p = plan(q["trips_with_zones"](spark, SF_SMALL))
    assert p.count("BroadcastHashJoin LeftOuter") == 2
    assert "GreaterThan(total_amount_excluding_tips,0.0)" in p


def test_hot_key_in_shuffle_join_is_split_by_aqe(spark):
    """One key holds a third of the fact rows and the dimension is too large
    to broadcast: AQE splits the hot partition instead of one long task."""
    from pyspark.sql import functions as F
    conf = {"spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.autoBroadcastJoinThreshold": "-1"}
    s = spark.newSession()
    for k, v in conf.items():
        s.conf.set(k, v)
    n = 30_000
    fact = s.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"),
                             F.col("id").alias("v"))
    dim = s.range(n).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    joined = join_dimension(fact, dim, "k", max_rows=100)      # too large: shuffle join
    out = joined.collect()                                      # executes this plan (AQE final)
    assert len(out) == n
    assert sum(r.w for r in out) == sum(2 * (0 if i % 3 == 0 else i) for i in range(n))
    buf = io.StringIO()
    with redirect_stdout(buf):
        joined.explain()
    final = buf.getvalue()
    assert "BroadcastHashJoin" not in final
    assert "isFinalPlan=true" in final and "skew=true" in final


def test_tasks_of_the_enriched_build_do_not_grow_with_the_source(spark, tmp_path, monkeypatch):
    """Rows that one task joins, sorts and writes are bounded by bytes, not by a fixed number of partitions."""
    monkeypatch.setattr(C, "BUILD_TASK_BYTES", 1 << 20, raising=False)
    n = 300_000
    key = F.col("id")
    spark.range(n).select(key.alias("l_orderkey"), (key % 97).alias("l_partkey"), (key % 5).alias("l_suppkey"),
                          F.lit(1).alias("l_linenumber"), F.lit(2.0).alias("l_quantity"),
                          F.rand(7).alias("l_extendedprice"), F.lit("N").alias("l_returnflag")).write.parquet(
        f"{tmp_path}/lineitem.parquet")
    spark.range(n).select(key.alias("o_orderkey"), (key % 9).alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(9).select(key.alias("c_custkey"), key.cast("int").alias("c_nationkey")).write.parquet(
        f"{tmp_path}/customer.parquet")
    spark.range(5).select(key.alias("s_suppkey"), key.cast("int").alias("s_nationkey")).write.parquet(
        f"{tmp_path}/supplier.parquet")
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    trips = Q.enriched(spark, str(tmp_path))
    task = F.regexp_extract(F.input_file_name(), r"part-(\d+)-", 1)
    per_task = [r["count"] for r in trips.select(task.alias("task")).groupBy("task").count().collect()]
    kept = trips_from_tables(spark, str(tmp_path)).where("store_and_fwd_flag is not null and total_amount >= 0").count()
    assert sum(per_task) == kept                                    # the whole job
    assert max(per_task) < n / 6, sorted(per_task)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == before
