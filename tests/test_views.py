"""SQL over named views of the batch tables."""
from conftest import SF_SMALL
from tripstats.operators.reshape import union_all
from tripstats.plans import batch
from tripstats.plans import catalog as Q
from tripstats.plans import dashboard
from tripstats.plans.views import catalog_views, register_views, run_query


def test_sql_on_stored_tables(spark, tmp_path):
    zones = Q.zones(spark, SF_SMALL)
    tables = batch.run(spark, Q.trips(spark, SF_SMALL), zones, str(tmp_path / "wh"))
    register_views(spark, tables, zones)
    total = run_query(spark, "SELECT sum(total_trip) AS n FROM taxi_trip_daily").first().n
    assert total == Q.daily(spark, SF_SMALL).groupBy().sum("total_trip").first()[0]
    top = run_query(spark, "SELECT max(trip_count) AS n FROM pick_drop_zone_f").first().n
    assert top == Q.queries()["top_routes"](spark, SF_SMALL).first().trip_count
    # every text of the dashboard on the batch job's tables gives the report's rows, in its order
    for name in dashboard.TEXTS:
        want = Q.queries()[name.removeprefix("sql_")](spark, SF_SMALL)
        got = dashboard.ask(spark, name)
        assert got.columns == want.columns and got.collect() == want.collect(), name


def test_parameters_are_values_and_not_text(spark):
    catalog_views(spark, SF_SMALL)
    day = "SELECT count(*) AS n FROM taxi_trip_daily WHERE pickup_days = :day"
    assert run_query(spark, day, {"day": "Monday"}).first().n > 20
    assert run_query(spark, day, {"day": "Monday' OR 'a' = 'a"}).first().n == 0
    assert dashboard.ask(spark, "sql_top_routes", n=3).count() == 3
    assert dashboard.ask(spark, "sql_daily_trend", before_month=2).count() == 31
    assert dashboard.ask(spark, "sql_month_weekday_sum", year=2031).count() == 0


def test_a_full_run_leaves_no_stale_month(spark, tmp_path):
    trips, zones, wh = Q.trips(spark, SF_SMALL), Q.zones(spark, SF_SMALL), str(tmp_path / "wh")
    batch.run(spark, trips.filter("src_month < 3"), zones, wh)
    tables = batch.run(spark, trips.filter("src_month = 1"), zones, wh)
    for name in ("taxi_trips", "temp_table", "route_states", "hour_states", "temp_pick_drop_zone"):
        assert [r[0] for r in spark.read.parquet(tables[name]).select("src_month").distinct().collect()] == [1]


def test_month_weekday_reports_are_whole(spark):
    daily = Q.daily(spark, SF_SMALL)
    got = Q.queries()["month_weekday_sum"](spark, SF_SMALL)
    assert got.groupBy().sum("total_trip_per_days").first()[0] == daily.groupBy().sum("total_trip").first()[0]


def test_child_sessions_keep_settings(spark):
    from tripstats.session import child_session
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        child = child_session(spark, {"spark.sql.codegen.hugeMethodLimit": "8000"})
        assert child.conf.get("spark.sql.shuffle.partitions") == "13"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_union_all_by_name(spark):
    a = spark.createDataFrame([(1, "x", 1.0)], "m int, s string, v double")
    b = spark.createDataFrame([(2.0, 2, "y")], "v double, m int, s string")
    out = union_all([a, b], ["m", "v"])
    assert sorted(map(tuple, out.collect())) == [(1, 1.0), (2, 2.0)]
