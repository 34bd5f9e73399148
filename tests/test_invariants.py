"""Cross-checks between rollups on the projected small tables."""
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tripstats.operators import reports as R
from tripstats.operators import rollups as A
from tripstats.operators import states as S
from tripstats.plans import catalog as Q
from tripstats.functions.columns import year_range


def test_rollup_invariants(spark):
    e = Q.enriched(spark, SF_SMALL).cache()
    z = Q.zones(spark, SF_SMALL)
    n_2025 = e.filter(year_range("pickup_date", 2025)).count()
    n_pos = e.filter(F.col("trip_duration_sec") > 0).count()
    n_paid = e.filter(F.col("total_amount_excluding_tips") > 0).count()

    partials = A.month_partials(e)
    daily = A.daily_totals(partials)
    assert daily.agg(F.sum("total_trip")).first()[0] == n_2025
    assert A.hourly_counts(partials).agg(F.sum("count_trip")).first()[0] == n_2025

    hist = A.duration_histogram(e)
    assert hist.agg(F.sum("trip_count")).first()[0] == n_pos
    assert (A.duration_by_class(hist).agg(F.sum("trip_count")).first()[0]
            == A.duration_distribution(hist).agg(F.sum("trip_count")).first()[0] == n_pos)

    prof = A.hourly_profile(S.hour_states(e))
    assert prof.agg(F.sum(F.col("short_trip_count") + F.col("long_trip_count"))).first()[0] == n_paid
    assert R.short_long_by_hour(prof).count() == 2 * prof.count()

    states = S.route_states(e)
    assert A.route_monthly(states, z).agg(F.sum("total_trip")).first()[0] == n_paid
    assert A.route_rollup(states).agg(F.sum("trip_count")).first()[0] == n_paid
    assert A.route_weighted(states).agg(F.sum("trip_count")).first()[0] == n_paid
    assert A.trips_with_zones(e, z).count() == n_paid
    e.unpersist()


def test_enrich_row_counts_match_fixture_notes(spark):
    t = Q.trips(spark, SF_SMALL)
    assert t.count() == 6000
    assert Q.enriched(spark, SF_SMALL).count() == 5421


def _copy(spark, sf_dir, folder):
    """The tables that trips are made of, as a source of the test's own."""
    for t in ("lineitem", "orders", "customer", "supplier"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


def test_stored_rollups_follow_the_source(spark, tmp_path):
    """Read as they are while the source is, by other sessions too; built anew when a file is added."""
    from tripstats.plans import stored
    src = _copy(spark, SF_SMALL, tmp_path / "src")
    first = Q.rollup(spark, src, "hourly")
    again = Q.rollup(spark.newSession(), src, "hourly")
    assert sorted(first.inputFiles()) == sorted(again.inputFiles())
    n = first.agg(F.sum("count_trip")).first()[0]
    spark.read.parquet(f"{src}/lineitem.parquet").limit(1000).write.mode("append").parquet(f"{src}/lineitem.parquet")
    more = Q.rollup(spark, src, "hourly")
    assert set(more.inputFiles()).isdisjoint(first.inputFiles())
    assert more.agg(F.sum("count_trip")).first()[0] == A.month_partials(Q.enriched(spark, src)).agg(F.sum("count_trip")).first()[0] > n
    before = stored.fingerprint(spark, [f"{src}/orders.parquet"])
    assert before == stored.fingerprint(spark, [f"{src}/orders.parquet"])
    assert before != stored.fingerprint(spark, [f"{src}/customer.parquet"])


def test_a_build_that_fails_leaves_nothing_to_read(spark, tmp_path):
    from tripstats.plans import stored
    src = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(src)

    def broken(path):
        spark.range(5).write.parquet(path)
        raise RuntimeError("cut off")

    import pytest
    with pytest.raises(RuntimeError):
        stored.derived(spark, "x", [src], broken)
    assert stored.derived(spark, "x", [src], lambda path: spark.range(7).write.parquet(path)).count() == 7
