"""Named queries: ``name -> fn(spark, sf_dir) -> DataFrame``.

Each query reads the benchmark tables in ``sf_dir``: ``scan_trips`` and
``zone_lookup`` directly, those on single trips through the enriched trip
table, and all rollups and reports through stored rollup tables, which Spark
derives from the trips and which are rebuilt when the source changes (see
``plans.stored``).  Nothing is collected to the driver.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tripstats import config as C
from tripstats.functions.columns import presented
from tripstats.operators import reports as R
from tripstats.operators import rollups as A
from tripstats.operators import states as S
from tripstats.operators.enrich import enrich_trips
from tripstats.plans import stored
from tripstats.session import child_session
from tripstats.sinks import files
from tripstats.sinks.writers import write_month_partitions
from tripstats.sources.tables import trips_from_tables, zones_from_tables

Query = Callable[[SparkSession, str], DataFrame]


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips_from_tables(spark, sf_dir)


def codegen_session(spark: SparkSession) -> SparkSession:
    """A child session (same cluster, own SQL conf) whose whole-stage code
    stays small enough for the JVM's JIT.

    The enrichment stage (fact join + all derived columns + null checks)
    generates one large method; above 8000 bytes of bytecode HotSpot never
    compiles it, and it runs interpreted (about 3x the CPU at sf0.1).  With
    ``hugeMethodLimit`` at 8000 (the value Spark's configuration guide gives
    for HotSpot) Spark falls back, for that stage only, to per-operator
    generated code whose methods the JIT does compile.
    """
    return child_session(spark, {"spark.sql.codegen.hugeMethodLimit": str(C.JIT_METHOD_LIMIT)})


def sized_session(spark: SparkSession, source_bytes: int) -> SparkSession:
    """``codegen_session`` whose tasks stay of one size however large the source is.

    A task sorts both sides of the fact join and then its enriched rows, some
    ten times the bytes it reads from the shuffle.  So the shuffle is dealt
    over partitions of about ``BUILD_TASK_BYTES``, as many as the source
    needs, and small ones are coalesced up to that size only.  A task that
    deals rows over many partitions holds its own split of the source, some
    six times its Parquet bytes, so splits are small too.
    """
    session = codegen_session(spark)
    conf = session.conf
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    partitions = max(int(conf.get(initial, None) or conf.get("spark.sql.shuffle.partitions")),
                     min(C.BUILD_PARTITIONS, 2 * source_bytes // C.BUILD_TASK_BYTES))    # shuffled, Parquet doubles
    conf.set(initial, str(partitions))
    conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(C.BUILD_TASK_BYTES))
    conf.set("spark.sql.files.maxPartitionBytes", str(2 * C.BUILD_TASK_BYTES))
    return session


def _sources(sf_dir: str) -> list[str]:
    """The benchmark tables that trips are made of."""
    return [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in ("lineitem", "orders", "customer", "supplier")]


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched trips, stored as a month-partitioned table (the per-month trip tables).

    The projection joins and the cleaning steps run once per state of the
    source; readers scan only the columns they use, and lineage is cut at a
    written table, so a lost executor costs a re-read, not a re-join.
    """
    def build(path: str) -> None:
        session = sized_session(spark, files.total_bytes(spark, _sources(sf_dir)))
        df = enrich_trips(trips_from_tables(session, sf_dir))
        write_month_partitions(df, path, sort_by=("pickup_date", "pickup_hour"), whole=True)

    df = stored.derived(spark, "trips", _sources(sf_dir), build)
    return df.select("src_month", *[c for c in df.columns if c != "src_month"])


#: Stored rollups: bounded by their key domains (days x hours, buckets, routes, hours per month file).
ROLLUPS = {"hourly": A.month_partials, "durations": A.duration_histogram, "routes": S.route_states, "hours": S.hour_states}


def rollup(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A rollup of the trips, stored per month file."""
    def build(path: str) -> None:
        df = ROLLUPS[name](enriched(spark, sf_dir)).repartition("src_month")     # small: one file a month
        write_month_partitions(df, path, whole=True)

    df = stored.derived(spark, name, _sources(sf_dir), build)
    return df.select("src_month", *[c for c in df.columns if c != "src_month"])


def forget() -> None:
    stored.forget()


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones_from_tables(spark, sf_dir)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.daily_totals(rollup(spark, sf_dir, "hourly"))


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.hourly_profile(rollup(spark, sf_dir, "hours"))


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup(spark, sf_dir, "durations")


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup(spark, sf_dir, "routes")


def route_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.route_monthly(routes(spark, sf_dir), zones(spark, sf_dir))


def _present(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: presented(c) for c in cols})


def q_union_months(spark, sf_dir):
    # The monthly tables are one month-partitioned table here; their UNION
    # ALL is a single scan of all its months with the four columns.
    return (enriched(spark, sf_dir)
            .select("src_month", "pickup_hour", "total_amount_excluding_tips", "trip_distance_km",
                    "tip_amount"))


BATCH_QUERIES: dict[str, Query] = {
    "scan_trips": trips,
    "zone_lookup": zones,
    "enrich_trips": enriched,
    "union_months": q_union_months,
    "trips_with_zones": lambda s, d: A.trips_with_zones(enriched(s, d), zones(s, d)),
    "month_partials": lambda s, d: rollup(s, d, "hourly"),
    "hourly_counts": lambda s, d: A.hourly_counts(rollup(s, d, "hourly")),
    "hourly_series": lambda s, d: A.hourly_series(rollup(s, d, "hourly")),
    "daily_totals": lambda s, d: daily(s, d).orderBy("pickup_date"),
    "duration_histogram": histogram,
    "duration_distribution": lambda s, d: R.duration_distribution_report(
        A.duration_distribution(histogram(s, d))),
    "duration_by_class": lambda s, d: R.duration_distribution_report(
        A.duration_by_class(histogram(s, d)), tiebreak="duration_interval_class"),
    "route_monthly": lambda s, d: _present(route_months(s, d), "avg_trip_distance_km", "avg_fare_amount"),
    "route_rollup": lambda s, d: A.route_rollup(routes(s, d)).orderBy(C.PU, C.DO),
    "route_weighted": lambda s, d: A.route_weighted(routes(s, d)).orderBy(C.PU, C.DO),
    "hourly_profile": lambda s, d: R.hourly_profile_report(profile(s, d)),
    "hourly_fare": lambda s, d: R.hourly_fare(profile(s, d)),
    "hourly_tip": lambda s, d: R.hourly_tip(profile(s, d)),
    "short_long_by_hour": lambda s, d: R.short_long_by_hour(profile(s, d)),
    "weekday_avg": lambda s, d: R.weekday_avg(daily(s, d)),
    "month_weekday_sum": lambda s, d: R.month_weekday_sum(daily(s, d)),
    "month_weekday_avg": lambda s, d: R.month_weekday_avg(daily(s, d)),
    "daily_trend": lambda s, d: R.daily_trend(daily(s, d)),
    "top_routes": lambda s, d: R.top_routes(A.route_rollup(routes(s, d)), zones(s, d)),
}


def queries() -> dict[str, Query]:
    from tripstats.plans.dashboard import DASHBOARD_QUERIES
    from tripstats.plans.stream_queries import STREAM_QUERIES
    return {**BATCH_QUERIES, **STREAM_QUERIES, **DASHBOARD_QUERIES}
