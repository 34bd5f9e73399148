"""Streams equal the batch rollup, across micro-batches, restarts, replays and other checkpoints."""
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF_SMALL, rows
from tripstats import config as C
from tripstats.operators import rollups as A
from tripstats.plans import catalog as Q
from tripstats.plans.stream_queries import upstream_tables
from tripstats.sinks import files
from tripstats.sources.messages import (RECORD_SCHEMA, TOPIC_SCHEMAS, append_messages, folder_record_stream,
                                        folder_records, replay_topic, to_messages)
from tripstats.streaming.rollup_streams import fare_state, start_rollup_stream
from tripstats.streaming.target import OtherCheckpoint, SnapshotTarget

FARE = TOPIC_SCHEMAS["temp_trip_fare"]


def _run(spark, folder, topic, root, max_files=1, checkpoint="ck", on_other="refuse"):
    q, target = start_rollup_stream(folder_record_stream(spark, folder, max_files), topic,
                                    f"{root}/target", f"{root}/{checkpoint}", on_other=on_other)
    q.awaitTermination()
    return q, target


def _append(table, month, folder):
    append_messages(to_messages(table.filter(F.col("src_month") == month).drop("src_month"), "t"), folder)


BATCH_VIEW = {
    "temp_table": (lambda up: A.daily_totals(up),
                   ["pickup_date", "pickup_days"], ["total_trip"]),
    "temp_duration_interval": (lambda up: A.duration_distribution(up),
                               ["duration_interval", "duration_interval_class"], ["trip_count"]),
    "temp_pick_drop_zone": (lambda up: up.groupBy("PULocationID", "DOLocationID").agg(
                                F.sum("total_trip").alias("trip_count"),
                                F.avg("avg_trip_distance_km").alias("avg_trip_distance_km"),
                                F.avg("avg_fare_amount").alias("avg_fare_amount")),
                            ["PULocationID", "DOLocationID"],
                            ["trip_count", "avg_trip_distance_km", "avg_fare_amount"]),
    "temp_trip_fare": (lambda up: up.drop("src_month"), ["pickup_hour"],
                       ["avg_fare_per_km", "avg_tip_amount", "short_trip_count", "long_trip_count"]),
}


def _rounded(df, cols):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in cols))
                  for r in df.collect())


@pytest.mark.parametrize("topic", sorted(BATCH_VIEW))
def test_stream_equals_batch_for_random_splits(spark, tmp_path, topic):
    """Months in random order, a restart in the middle, one to three files a micro-batch."""
    rnd = random.Random(sum(map(ord, topic)))
    up = upstream_tables(spark, SF_SMALL)[topic].cache()
    root, folder = str(tmp_path), f"{tmp_path}/topic"
    months = [r[0] for r in up.select("src_month").distinct().collect()]
    rnd.shuffle(months)
    cut = rnd.randint(1, len(months))
    for i, m in enumerate(months):
        _append(up, m, folder)
        if i + 1 == cut:
            _run(spark, folder, topic, root, max_files=rnd.randint(1, 3))
    _, target = _run(spark, folder, topic, root, max_files=rnd.randint(1, 3))
    view, keys, vals = BATCH_VIEW[topic]
    assert _rounded(target.read(spark), keys + vals) == _rounded(view(up), keys + vals)
    up.unpersist()


def test_restart_goes_on_where_the_checkpoint_ended(spark, tmp_path):
    root, folder = str(tmp_path), f"{tmp_path}/topic"
    hourly = upstream_tables(spark, SF_SMALL)["temp_table"].cache()
    for m in (1, 2, 3):
        _append(hourly, m, folder)
    q, target = _run(spark, folder, "temp_table", root)
    ended = target.committed(spark)["batch"]
    assert ended >= 2 and len(q.recentProgress) >= 3
    for m in (4, 5):
        _append(hourly, m, folder)
    _run(spark, folder, "temp_table", root)
    assert target.committed(spark)["batch"] >= ended + 2
    cols = ["pickup_date", "pickup_days", "total_trip"]
    assert rows(target.read(spark), cols) == rows(A.daily_totals(A.month_partials(Q.enriched(spark, SF_SMALL))), cols)
    hourly.unpersist()


def test_a_new_checkpoint_is_refused_or_resets_and_loses_no_row(spark, tmp_path):
    root, folder = str(tmp_path), f"{tmp_path}/topic"
    hourly = upstream_tables(spark, SF_SMALL)["temp_table"].cache()
    for m in (1, 2, 3, 4):
        _append(hourly, m, folder)
    _, target = _run(spark, folder, "temp_table", root)          # batches 0 to 3 of the first checkpoint
    before, ended = rows(target.read(spark)), target.committed(spark)["batch"]
    _append(hourly, 5, folder)
    with pytest.raises(OtherCheckpoint):
        _run(spark, folder, "temp_table", root, checkpoint="new")
    assert rows(target.read(spark)) == before
    # batch ids start again at 0, below those committed, and every row arrives
    _, target = _run(spark, folder, "temp_table", root, max_files=9, checkpoint="new", on_other="reset")
    assert target.committed(spark)["batch"] < ended
    cols = ["pickup_date", "pickup_days", "total_trip"]
    want = rows(A.daily_totals(A.month_partials(Q.enriched(spark, SF_SMALL))), cols)
    assert rows(target.read(spark), cols) == want
    # the first checkpoint no longer owns the target
    with pytest.raises(OtherCheckpoint):
        _run(spark, folder, "temp_table", root)
    hourly.unpersist()


def test_two_writers_of_one_target_do_not_mix(spark, tmp_path):
    """A query already admitted fails when another checkpoint takes its target over."""
    root, folder = str(tmp_path), f"{tmp_path}/topic"
    first = spark.createDataFrame([(1, 1.0, 1.0, 1, 1)], FARE)
    append_messages(to_messages(first, "t"), folder)
    _, target = _run(spark, folder, "temp_trip_fare", root, checkpoint="a")
    late = SnapshotTarget(target.path, f"{root}/b")
    q = (folder_record_stream(spark, folder).transform(fare_state).writeStream.outputMode("complete")
         .foreachBatch(late.write_batch).option("checkpointLocation", f"{root}/b").trigger(availableNow=True).start())
    with pytest.raises(StreamingQueryException):
        q.awaitTermination()
    assert rows(target.read(spark), ["pickup_hour"]) == [(1,)]


def _target(spark, tmp_path, name="ck"):
    """A target whose checkpoint has an id, as after a query's first start."""
    files.replace_text(spark, f"{tmp_path}/made", "")            # makes the folder
    ck = tmp_path / name
    ck.mkdir()
    (ck / "metadata").write_text('{"id":"query-%s"}' % name)
    return SnapshotTarget(str(tmp_path / "t"), str(ck))


def test_replayed_batch_is_idempotent_and_old_states_go(spark, tmp_path):
    t = _target(spark, tmp_path)
    mk = lambda r: spark.createDataFrame(r, "k int, v int")
    t.write_batch(mk([(1, 10), (2, 20)]), 0)
    opened = t.read(spark)                                       # a reader of the state before
    t.write_batch(mk([(1, 10), (2, 25)]), 1)
    t.write_batch(mk([(1, 10), (2, 25)]), 1)                     # at-least-once replay of batch 1
    assert rows(t.read(spark)) == [(1, 10), (2, 25)]
    t.write_batch(mk([(3, 1)]), 2)
    assert rows(t.read(spark)) == [(3, 1)]
    assert [n for n in files.names(spark, t.path) if n.startswith("state-")] == ["state-query-ck-1", "state-query-ck-2"]
    assert opened.schema == t.read(spark).schema
    with pytest.raises(OtherCheckpoint):                         # a checkpoint restored from an older copy
        t.write_batch(mk([(9, 9)]), 1)


def test_a_batch_that_fails_leaves_the_state_before(spark, tmp_path):
    t = _target(spark, tmp_path)
    t.write_batch(spark.createDataFrame([(1, 10)], "k int, v int"), 0)
    broken = spark.createDataFrame([(1, 0)], "k int, v int").select("k", F.raise_error(F.lit("lost")).cast("int").alias("v"))
    with pytest.raises(Exception, match="lost"):
        t.write_batch(broken, 1)
    assert rows(t.read(spark)) == [(1, 10)] and t.committed(spark)["batch"] == 0


def test_unwritten_target(spark, tmp_path):
    t = SnapshotTarget(str(tmp_path / "none"), str(tmp_path / "ck"))
    assert t.committed(spark) is None
    t.admit(spark)
    with pytest.raises(FileNotFoundError):
        t.read(spark)


def _fare(spark, changes):
    """Fare rows as enveloped changes: (hour, short trips, time, op)."""
    df = spark.createDataFrame([(h, 1.0, 1.0, n, 1, at) for h, n, at, _ in changes], "pickup_hour long, "
                               "avg_fare_per_km double, avg_tip_amount double, short_trip_count long, long_trip_count long, at long")
    parts = [to_messages(df.where(F.col("at") == at), "t", ["pickup_hour"], envelope=True, changed_at=F.col("at"), op=op,
                         keep=("at",)).drop("at") for _, _, at, op in changes]
    return parts


@pytest.mark.parametrize("seed", range(2))
def test_fare_stream_keeps_the_latest_change_in_any_order(spark, tmp_path, seed):
    """Changes carry the source's time; the files arrive in another order, one a micro-batch."""
    changes = [(0, 10, 100, "c"), (0, 11, 200, "u"), (0, 12, 150, "u"), (1, 20, 110, "c"), (1, 0, 300, "d"),
               (1, 21, 250, "u"), (2, 30, 120, "c"), (2, 0, 130, "d"), (2, 31, 140, "c")]
    parts = _fare(spark, changes)
    random.Random(seed).shuffle(parts)
    root, folder = str(tmp_path), f"{tmp_path}/topic"
    for i, part in enumerate(parts):
        append_messages(part, folder)
        if i in (3, len(parts) - 1):
            _, target = _run(spark, folder, "temp_trip_fare", root, max_files=2)
    assert rows(target.read(spark), ["pickup_hour", "short_trip_count"]) == [(0, 11), (2, 31)]


def test_latest_state_by_record_time_tombstones_and_offsets(spark):
    import datetime as dt
    at = [dt.datetime(2025, 1, 1, 0, 0, s) for s in range(4)]
    flat = '{"pickup_hour":%d,"avg_fare_per_km":1.0,"avg_tip_amount":1.0,"short_trip_count":%d,"long_trip_count":0}'
    recs = [("t", at[1], None, flat % (5, 1)), ("t", at[2], None, flat % (5, 2)), ("t", at[0], None, flat % (5, 3)),
            ("t", at[1], '{"pickup_hour":6}', flat % (6, 1)), ("t", at[2], '{"pickup_hour":6}', None),
            ("t", at[3], '{"pickup_hour":7}', None), ("t", at[1], '{"pickup_hour":7}', flat % (7, 1)), ("t", at[3], None, None)]
    got = fare_state(spark.createDataFrame(recs, RECORD_SCHEMA))
    assert rows(got, ["pickup_hour", "short_trip_count"]) == [(5, 2)]
    # equal times: the source's offset decides, where there is one
    same = [("t", at[1], None, flat % (5, n), off) for n, off in ((1, 7), (9, 3), (4, 8))]
    got = fare_state(spark.createDataFrame(same, T.StructType([*RECORD_SCHEMA.fields, T.StructField("offset", T.LongType())])))
    assert rows(got, ["pickup_hour", "short_trip_count"]) == [(5, 4)]


def test_topic_keeps_every_change_in_time_order(spark, tmp_path):
    folder = f"{tmp_path}/topic"
    for n in (1, 9, 4):
        append_messages(to_messages(spark.createDataFrame([(1, 1.0, 1.0, n, 1)], FARE), "t"), folder)
    assert [r.short_trip_count for r in replay_topic(folder_records(spark, folder), FARE).collect()] == [1, 9, 4]


def test_feed_has_one_file_per_month(spark, tmp_path):
    up = upstream_tables(spark, SF_SMALL)["temp_table"]
    folder = f"{tmp_path}/topic"
    append_messages(to_messages(up, C.TOPIC_PREFIX + "temp_table", keep=("src_month",)), folder, by="src_month")
    assert len(folder_records(spark, folder).inputFiles()) == 5
    assert folder_records(spark, folder).count() == up.count()
    assert "src_month" not in folder_records(spark, folder).first().value
