"""Sources and sinks: monthly files, zone CSV, JDBC (embedded Derby, no
port), and rerun safety of the batch job."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from tripstats.operators.enrich import enrich_trips
from tripstats.plans import batch
from tripstats.plans import catalog as Q
from tripstats.sinks.writers import write_jdbc, write_month_partitions, write_sorted
from tripstats.sources.files import month_files, month_path, read_zone_csv, scan_monthly_trips
from tripstats.sources.jdbc import read_jdbc_query, read_jdbc_table

DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def _write_months(trips, folder, year=2025):
    for m in range(1, 6):
        trips.filter(F.col("src_month") == m).drop("src_month").write.parquet(month_path(folder, (year, m)))


def test_monthly_files_one_scan(spark, tmp_path):
    trips = Q.trips(spark, SF_SMALL).cache()
    folder = str(tmp_path)
    _write_months(trips, folder)
    back = scan_monthly_trips(spark, folder)
    assert rows(back.groupBy("src_month").count()) == rows(trips.groupBy("src_month").count())
    assert back.count() == trips.count()
    trips.unpersist()


def test_month_files_are_found_by_listing(spark, tmp_path):
    folder = str(tmp_path)
    for month in ((2025, 1), (2025, 6), (2026, 1), (2024, 12)):
        spark.createDataFrame([(month[0] * 100 + month[1],)], "v int").coalesce(1).write.parquet(month_path(folder, month))
    (tmp_path / "yellow_tripdata_2025-07.csv").write_text("not a month file")
    (tmp_path / "green_tripdata_2025-08.parquet").mkdir()
    assert list(month_files(spark, folder)) == [(2024, 12), (2025, 1), (2025, 6), (2026, 1)]
    got = rows(scan_monthly_trips(spark, folder), ["src_year", "src_month", "v"])
    assert got == [(2024, 12, 202412), (2025, 1, 202501), (2025, 6, 202506), (2026, 1, 202601)]
    assert rows(scan_monthly_trips(spark, folder, months=[6, (2026, 1)]), ["v"]) == [(202506,), (202601,)]
    with pytest.raises(FileNotFoundError, match="2025-03"):
        scan_monthly_trips(spark, folder, months=[1, 3])
    with pytest.raises(FileNotFoundError):
        scan_monthly_trips(spark, str(tmp_path / "nowhere"))


def test_the_same_month_of_two_years_stands_side_by_side(spark, tmp_path):
    """January of two years through the batch job; a reload of one leaves the other as it is."""
    trips, zones = Q.trips(spark, SF_SMALL).where("src_month <= 2"), Q.zones(spark, SF_SMALL)
    later = trips.withColumns({c: F.col(c) + F.expr("interval 365 days") for c in
                               ("tpep_pickup_datetime", "tpep_dropoff_datetime")})
    folder, wh = str(tmp_path / "raw"), str(tmp_path / "wh")
    for year, of in ((2025, trips), (2026, later)):
        for m in (1, 2):
            of.filter(F.col("src_month") == m).drop("src_month").write.parquet(month_path(folder, (year, m)))
    tables = batch.run(spark, scan_monthly_trips(spark, folder, clean=enrich_trips), zones, wh, cleaned=True)

    def per_month(name, measure):
        df = spark.read.parquet(tables[name])
        return {(r[0], r[1]): r[2] for r in df.groupBy("src_year", "src_month").agg(F.sum(measure)).collect()}

    counts = per_month("route_states", "total_trip")
    assert set(counts) == {(y, m) for y in (2025, 2026) for m in (1, 2)}
    assert counts[2025, 1] == counts[2026, 1]
    daily = spark.read.parquet(tables["mv_taxi_date_hour_daily"])
    assert {r[0] for r in daily.select(F.year("pickup_date")).distinct().collect()} == {2025, 2026}
    # January 2026 comes again, with half its trips
    half = scan_monthly_trips(spark, folder, [(2026, 1)], clean=enrich_trips).where("PULocationID % 2 = 0")
    batch.run(spark, half, zones, wh, months=[(2026, 1)], cleaned=True)
    again = per_month("route_states", "total_trip")
    assert {k: v for k, v in again.items() if k != (2026, 1)} == {k: v for k, v in counts.items() if k != (2026, 1)}
    assert 0 < again[2026, 1] < counts[2026, 1]


def test_a_month_reload_reads_and_writes_its_month_only(spark, tmp_path):
    trips, zones, wh = Q.trips(spark, SF_SMALL), Q.zones(spark, SF_SMALL), str(tmp_path / "wh")
    tables = batch.run(spark, trips, zones, wh)
    before = {n: set(spark.read.parquet(tables[n]).inputFiles()) for n in ("hour_states", "route_states", "temp_table")}
    batch.run(spark, trips.where("src_month = 3"), zones, wh, months=[3])
    for name, was in before.items():
        now = set(spark.read.parquet(tables[name]).inputFiles())
        assert {f for f in was ^ now if "src_month=3/" not in f} == set()
        assert {f for f in now if "src_month=3/" in f}.isdisjoint(was)


def test_sorted_target_prunes(spark, tmp_path):
    """Files hold key ranges of their own, so a read of one key decodes the rows of one file."""
    import pyarrow.parquet as pq
    path = str(tmp_path / "t")
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).cast("int").alias("k"), F.col("id").alias("v"))
    write_sorted(df.repartition(5), path, ["k"], ranges=8)
    bounds = []
    for f in (tmp_path / "t").glob("part-*.parquet"):
        meta = pq.ParquetFile(f).metadata
        stats = [meta.row_group(i).column(0).statistics for i in range(meta.num_row_groups)]
        bounds.append((min(x.min for x in stats), max(x.max for x in stats)))
    bounds.sort()
    assert len(bounds) == 8 and all(a[1] < b[0] for a, b in zip(bounds, bounds[1:]))
    point = spark.read.parquet(path).where("k = 12345")
    assert [r.k for r in point.collect()] == [12345]
    from conftest import scanned_rows
    assert 0 < scanned_rows(point) <= max(b[1] - b[0] + 1 for b in bounds) < 20_000 / 4


def test_zone_csv_text_key_cast(spark, tmp_path):
    p = tmp_path / "taxi_zone_lookup.csv"
    p.write_text('"LocationID","Borough","Zone","service_zone"\n"1","EWR","Newark Airport","EWR"\n'
                 '"2","Queens","Jamaica Bay","Boro Zone"\n')
    z = read_zone_csv(spark, str(p))
    assert dict(z.select("LocationID", "Zone").collect()) == {1: "Newark Airport", 2: "Jamaica Bay"}
    assert dict(z.dtypes)["LocationID"] == "int"


def test_jdbc_write_and_query_read(spark):
    url = "jdbc:derby:memory:tripstats;create=true"
    e = Q.enriched(spark, SF_SMALL).select("src_month", "pickup_hour", "trip_distance_km",
                                           "total_amount_excluding_tips")
    write_jdbc(e, url, "taxi_trips", DERBY, mode="overwrite")
    write_jdbc(e, url, "taxi_trips", DERBY, mode="overwrite")        # rerun replaces
    assert read_jdbc_table(spark, url, "taxi_trips", DERBY).count() == e.count()
    # Spark creates quoted lower-case column names; the SQL text quotes them.
    q = ('SELECT "pickup_hour", COUNT(*) AS n FROM taxi_trips '
         'WHERE "total_amount_excluding_tips" > 0 GROUP BY "pickup_hour"')
    got = {r.pickup_hour: r.N for r in read_jdbc_query(spark, url, q, DERBY).collect()}
    want = {r.pickup_hour: r["count"] for r in
            e.filter("total_amount_excluding_tips > 0").groupBy("pickup_hour").count().collect()}
    assert got == want
    part = read_jdbc_query(spark, url, 'SELECT "src_month", "pickup_hour" FROM taxi_trips', DERBY,
                           partition_column='"pickup_hour"', lower=0, upper=24, num_partitions=4)
    assert part.rdd.getNumPartitions() == 4 and part.count() == e.count()


def test_month_partition_rerun_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "src_month int, v string")
    write_month_partitions(df, path)
    write_month_partitions(spark.createDataFrame([(2, "c")], "src_month int, v string"), path)
    assert rows(spark.read.parquet(path), ["src_month", "v"]) == [(1, "a"), (2, "c")]


def test_batch_job_rerun_gives_same_tables(spark, tmp_path):
    wh = str(tmp_path / "wh")
    trips, zones = Q.trips(spark, SF_SMALL), Q.zones(spark, SF_SMALL)
    paths = batch.run(spark, trips, zones, wh)
    first = {k: rows(spark.read.parquet(p)) for k, p in paths.items() if k != "taxi_trips"}
    n_trips = spark.read.parquet(paths["taxi_trips"]).count()
    batch.run(spark, trips, zones, wh)
    again = {k: rows(spark.read.parquet(p)) for k, p in paths.items() if k != "taxi_trips"}
    assert first == again
    assert spark.read.parquet(paths["taxi_trips"]).count() == n_trips == 5421
    daily = spark.read.parquet(paths["mv_taxi_date_hour_daily"])
    assert daily.filter(F.col("pickup_date") == dt.date(2025, 1, 1)).count() == 1


def test_monthly_files_through_batch_job_equal_catalog(spark, tmp_path):
    """The real-data path: month files -> one scan -> batch job -> views."""
    trips = Q.trips(spark, SF_SMALL).cache()
    folder = str(tmp_path / "raw")
    _write_months(trips, folder)
    tables = batch.run(spark, scan_monthly_trips(spark, folder), Q.zones(spark, SF_SMALL), str(tmp_path / "wh"))
    daily = spark.read.parquet(tables["mv_taxi_date_hour_daily"])
    want = Q.queries()["daily_totals"](spark, SF_SMALL)
    assert rows(daily, ["pickup_date", "pickup_days", "total_trip"]) == \
        rows(want, ["pickup_date", "pickup_days", "total_trip"])
    fare = spark.read.parquet(tables["mv_trip_fare"])
    prof = Q.queries()["hourly_profile"](spark, SF_SMALL)
    assert rows(fare, ["pickup_hour", "short_trip_count", "long_trip_count"]) == \
        rows(prof, ["pickup_hour", "short_trip_count", "long_trip_count"])
    trips.unpersist()


def test_cli(spark, tmp_path, capsys):
    from tripstats.__main__ import _parser, main, run
    assert main(["list"]) == 0
    assert "top_routes" in capsys.readouterr().out.split()

    def said(*argv):
        run(spark, _parser().parse_args(list(argv)))
        return capsys.readouterr().out

    assert "Monday" in said("report", "weekday_avg", SF_SMALL)
    out = said("sql", "SELECT count(*) AS days FROM taxi_trip_daily WHERE month(pickup_date) = :m AND pickup_days <> :d",
               SF_SMALL, "--param", "m=2", "--param", "d=Monday")
    assert "|24  |" in out
    folder, wh = str(tmp_path / "raw"), str(tmp_path / "wh")
    _write_months(Q.trips(spark, SF_SMALL), folder)
    csv = tmp_path / "zones.csv"
    csv.write_text('"LocationID","Zone"\n"1","A"\n')
    made = dict(line.split("\t") for line in said("batch-files", folder, str(csv), wh).splitlines())
    total = spark.read.parquet(made["mv_taxi_date_hour_daily"]).agg(F.sum("total_trip")).first()[0]
    assert total == Q.daily(spark, SF_SMALL).agg(F.sum("total_trip")).first()[0]
    said("batch-files", folder, str(csv), wh, "--months", "2025-03,4")
    assert spark.read.parquet(made["mv_taxi_date_hour_daily"]).agg(F.sum("total_trip")).first()[0] == total


def test_cli_stream(spark, tmp_path, capsys):
    from tripstats.__main__ import _parser, run
    from tripstats.plans.stream_queries import feed_topic
    from tripstats.streaming.target import OtherCheckpoint
    topic = feed_topic(spark, SF_SMALL, "temp_trip_fare", f"{tmp_path}/topic")
    argv = ["stream", "temp_trip_fare", topic, f"{tmp_path}/target"]
    run(spark, _parser().parse_args([*argv, f"{tmp_path}/ck"]))
    assert "avg_fare_per_km" in capsys.readouterr().out
    with pytest.raises(OtherCheckpoint):
        run(spark, _parser().parse_args([*argv, f"{tmp_path}/other"]))
    run(spark, _parser().parse_args([*argv, f"{tmp_path}/other", "--reset"]))


def test_batch_tables_exported_over_jdbc(spark, tmp_path):
    url = "jdbc:derby:memory:tripstats_export;create=true"
    tables = batch.run(spark, Q.trips(spark, SF_SMALL), Q.zones(spark, SF_SMALL), str(tmp_path / "wh"))
    names = ("taxi_trips", "temp_table", "mv_taxi_date_hour_daily", "mv_pick_drop_zone")
    assert batch.export_jdbc(spark, tables, url, DERBY, names) == list(names)
    for n in names:
        assert read_jdbc_table(spark, url, n, DERBY).count() == spark.read.parquet(tables[n]).count()
    # the database can now answer the dashboard's daily question itself
    q = 'SELECT SUM("total_trip") AS s FROM mv_taxi_date_hour_daily'
    assert read_jdbc_query(spark, url, q, DERBY).first().S == \
        spark.read.parquet(tables["mv_taxi_date_hour_daily"]).agg(F.sum("total_trip")).first()[0]


def test_monthly_files_with_schema_drift(spark, tmp_path):
    folder = str(tmp_path)
    p1, p2 = (month_path(folder, (2025, m)) for m in (1, 2))
    spark.createDataFrame([(1.0, "N")], "trip_distance double, store_and_fwd_flag string").write.parquet(p1)
    spark.createDataFrame([(2.0, 0.5)], "trip_distance double, airport_fee double").write.parquet(p2)
    got = rows(scan_monthly_trips(spark, folder, months=(1, 2)),
               ["src_month", "trip_distance", "store_and_fwd_flag", "airport_fee"])
    assert got == [(1, 1.0, "N", None), (2, 2.0, None, 0.5)]


def test_a_column_missing_from_one_month_keeps_that_month(spark, tmp_path):
    folder = str(tmp_path)
    p1, p2 = (month_path(folder, (2025, m)) for m in (1, 2))
    trips = Q.trips(spark, SF_SMALL)
    trips.filter("src_month = 1").drop("src_month").withColumn("airport_fee", F.lit(0.5)).write.parquet(p1)
    trips.filter("src_month = 2").drop("src_month").write.parquet(p2)
    scan = scan_monthly_trips(spark, folder, months=(1, 2), clean=enrich_trips)
    tables = batch.run(spark, scan, Q.zones(spark, SF_SMALL), f"{folder}/wh", cleaned=True)
    got = spark.read.parquet(tables["taxi_trips"]).groupBy("src_month").count()
    want = Q.enriched(spark, SF_SMALL).filter("src_month < 3").groupBy("src_month").count()
    assert rows(got) == rows(want)


def test_incremental_month_reload_equals_full_run(spark, tmp_path):
    trips = Q.trips(spark, SF_SMALL).cache()
    zones = Q.zones(spark, SF_SMALL)
    # month 2 is first loaded short (a partial file), then corrected
    partial = trips.filter((F.col("src_month") != 2) | (F.col("PULocationID") % 2 == 0))
    inc = batch.run(spark, partial, zones, str(tmp_path / "inc"))
    batch.run(spark, trips.filter(F.col("src_month") == 2), zones, str(tmp_path / "inc"), months=[2])
    full = batch.run(spark, trips, zones, str(tmp_path / "full"))
    def vals(path):      # unrounded means: compare at 9 decimals (summation order differs)
        return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r)
                       for r in spark.read.parquet(path).collect()), key=repr)
    for name in full:
        assert vals(inc[name]) == vals(full[name]), name
    trips.unpersist()
