"""Catalog entries for the change feed: message encoding, CDC decoding,
topic replay and the four streaming rollups.

The feed is produced from the batch rollups of the benchmark tables, one
file per month file (as the per-month appends of the upstream tables would
emit it).  Streams run with ``availableNow`` into fresh folders under the
session's checkpoint folder and return the target table.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstats import config as C
from tripstats.functions.columns import presented, rounded_mean
from tripstats.operators.reshape import union_all
from tripstats.plans import catalog as Q
from tripstats.session import new_scratch
from tripstats.sources.messages import (TOPIC_SCHEMAS, append_messages, decode_change_feed, folder_record_stream,
                                        folder_records, replay_topic, to_messages)
from tripstats.streaming.rollup_streams import start_rollup_stream, stream_session


def upstream_table(spark: SparkSession, sf_dir: str, topic: str) -> DataFrame:
    """The per-month upstream table of ``topic``, with ``src_month``."""
    if topic == "temp_table":
        return Q.rollup(spark, sf_dir, "hourly").select(
            "src_month", "pickup_date", F.col("pickup_hour").cast("long").alias("pickup_hour"),
            "pickup_days", "count_trip")
    if topic == "temp_duration_interval":
        return Q.histogram(spark, sf_dir).select(
            "src_month", "duration_interval", "trip_count", "duration_interval_class")
    if topic == "temp_pick_drop_zone":
        return Q.route_months(spark, sf_dir)
    if topic == "temp_trip_fare":
        # The fare table is one table over all months, rewritten by each run.
        return Q.profile(spark, sf_dir).select(
            F.lit(0).alias("src_month"), F.col("pickup_hour").cast("long").alias("pickup_hour"),
            "avg_fare_per_km", "avg_tip_amount", "short_trip_count", "long_trip_count")
    raise KeyError(topic)


class _Upstream(dict):
    """``topic -> upstream table``, each built only when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self._args = (spark, sf_dir)

    def __missing__(self, topic: str) -> DataFrame:
        self[topic] = upstream_table(*self._args, topic)
        return self[topic]


def upstream_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four per-month upstream tables, keyed by topic (built on first use)."""
    return _Upstream(spark, sf_dir)


def feed_topic(spark: SparkSession, sf_dir: str, topic: str, folder: str, keys: list[str] | None = None) -> str:
    """Append the upstream table to a folder topic, one file per month file."""
    rows = upstream_table(spark, sf_dir, topic)
    append_messages(to_messages(rows, C.TOPIC_PREFIX + topic, keys, keep=("src_month",)), folder, by="src_month")
    return folder


def run_stream(spark: SparkSession, sf_dir: str, topic: str, files_per_batch: int = 2) -> DataFrame:
    """Feed the topic, then run its stream once (``availableNow``) in several
    micro-batches, each of which replaces the target, and read the target.

    Restarts from the checkpoint between appends are covered by the test suite.
    """
    root = new_scratch(spark, f"stream-{topic}")
    folder = feed_topic(spark, sf_dir, topic, f"{root}/topic")
    records = folder_record_stream(stream_session(spark, topic), folder, files_per_batch)
    query, target = start_rollup_stream(records, topic, f"{root}/target", f"{root}/checkpoint")
    query.awaitTermination()
    return target.read(spark)


def q_stream_daily(spark, sf_dir):
    return run_stream(spark, sf_dir, "temp_table").select(
        "pickup_date", "pickup_days", F.col("total_trip").cast("bigint").alias("total_trip"))


def q_stream_duration(spark, sf_dir):
    return run_stream(spark, sf_dir, "temp_duration_interval").select(
        "duration_interval", "duration_interval_class", "trip_count")


def q_stream_routes(spark, sf_dir):
    return run_stream(spark, sf_dir, "temp_pick_drop_zone").select(
        "PULocationID", "DOLocationID", "trip_count",
        rounded_mean("avg_trip_distance_km").alias("avg_trip_distance_km"),
        rounded_mean("avg_fare_amount").alias("avg_fare_amount"))


def q_stream_fare(spark, sf_dir):
    return run_stream(spark, sf_dir, "temp_trip_fare").select(
        "pickup_hour", presented("avg_fare_per_km").alias("avg_fare_per_km"),
        presented("avg_tip_amount").alias("avg_tip_amount"), "short_trip_count", "long_trip_count")


def q_to_messages(spark, sf_dir):
    rows = upstream_table(spark, sf_dir, "temp_table").drop("src_month")
    return to_messages(rows, C.TOPIC_PREFIX + "temp_table").select("topic", "value")


def q_cdc_unwrap(spark, sf_dir):
    """The change events of the hourly table decoded to new row states.

    All rows are created in envelopes with epoch-day dates; rows of even
    hours are updated by flat rows with ISO dates; those of hours divisible
    by three are deleted, each delete followed by its tombstone, and neither
    carries a new state.
    """
    topic = C.TOPIC_PREFIX + "temp_table"
    rows = upstream_table(spark, sf_dir, "temp_table").drop("src_month")
    gone = rows.where(F.col("pickup_hour") % 3 == 0)
    updated = rows.where(F.col("pickup_hour") % 2 == 0).withColumn("count_trip", F.col("count_trip") + 1)
    feed = [to_messages(rows, topic, envelope=True), to_messages(updated, topic, epoch_day_dates=False),
            to_messages(gone, topic, envelope=True, op="d"),
            to_messages(gone, topic, ["pickup_date", "pickup_hour"]).withColumn("value", F.lit(None).cast("string"))]
    return decode_change_feed(union_all(feed), TOPIC_SCHEMAS["temp_table"])


def q_topic_replay(spark, sf_dir):
    """The fare topic replayed from the earliest record (all messages)."""
    folder = feed_topic(spark, sf_dir, "temp_trip_fare", new_scratch(spark, "replay"))
    rows = replay_topic(folder_records(spark, folder), TOPIC_SCHEMAS["temp_trip_fare"])
    return rows.withColumns({"avg_fare_per_km": presented("avg_fare_per_km"),
                             "avg_tip_amount": presented("avg_tip_amount")})


STREAM_QUERIES = {
    "to_messages": q_to_messages,
    "cdc_unwrap": q_cdc_unwrap,
    "topic_replay": q_topic_replay,
    "stream_daily": q_stream_daily,
    "stream_duration": q_stream_duration,
    "stream_routes": q_stream_routes,
    "stream_fare": q_stream_fare,
}
