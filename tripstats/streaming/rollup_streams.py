"""Streaming rollups over the change feed (one per topic).

Each stream decodes its records, aggregates on the business keys and writes
in complete mode: Spark keeps one running row per key (days, buckets, routes,
hours - a domain that does not grow with the trips), and every micro-batch
replaces the target (:class:`SnapshotTarget`).  The checkpoint location
replaces consumer-group offsets.

The daily, duration and route streams sum what the feed delivers, as the
insert-triggered views do; the fare stream keeps, per hour, the row of the
latest change by the source's own time, and drops hours whose latest change
deletes them, in whatever order the changes arrive.
"""
from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tripstats.session import child_session
from tripstats.sources.messages import CHANGED_AT, DELETED, TOPIC_SCHEMAS, decode_change_feed, decode_changes
from tripstats.streaming.target import OnOther, SnapshotTarget


def daily_state(records: DataFrame) -> DataFrame:
    rows = decode_change_feed(records, TOPIC_SCHEMAS["temp_table"])
    return rows.groupBy("pickup_date", "pickup_days").agg(F.sum("count_trip").alias("total_trip"))


def duration_state(records: DataFrame) -> DataFrame:
    rows = decode_change_feed(records, TOPIC_SCHEMAS["temp_duration_interval"])
    return (rows.groupBy("duration_interval", "duration_interval_class")
            .agg(F.sum("trip_count").alias("trip_count")))


def route_state(records: DataFrame) -> DataFrame:
    """Route totals with the mean of the per-month means (as the batch rollup)."""
    rows = decode_change_feed(records, TOPIC_SCHEMAS["temp_pick_drop_zone"])
    return (rows.groupBy("PULocationID", "DOLocationID")
            .agg(F.sum("total_trip").alias("trip_count"),
                 F.avg("avg_trip_distance_km").alias("avg_trip_distance_km"),
                 F.avg("avg_fare_amount").alias("avg_fare_amount")))


def latest_state(records: DataFrame, topic: str, keys: list[str]) -> DataFrame:
    """The row of each key's latest change, by the source's time; deleted keys are left out.

    Changes of one time follow by their place in the topic, where the source
    has one, and then by their content, so the result never depends on the
    order of arrival.
    """
    schema = TOPIC_SCHEMAS[topic]
    place = [c for c in ("offset",) if c in records.columns]
    rows = decode_changes(records, schema, keys, keep=(*place, "value"))
    values = [f for f in schema.fieldNames() if f not in keys]
    newest = F.max_by(F.struct(DELETED, *values), F.struct(CHANGED_AT, *place, F.coalesce("value", F.lit(""))))
    last = rows.groupBy(*keys).agg(newest.alias("last"))
    return last.where(~F.col(f"last.{DELETED}")).select(*keys, *[F.col(f"last.{v}") for v in values])


def fare_state(records: DataFrame) -> DataFrame:
    return latest_state(records, "temp_trip_fare", ["pickup_hour"])


class Stream(NamedTuple):
    """A stream's aggregation and the number of its state partitions.

    Spark fixes the latter for the life of a checkpoint.  It follows the key
    domain (days, buckets, zone pairs, hours), not the trips; pass another
    number to a stream's first start where a domain is larger.
    """
    state: Callable[[DataFrame], DataFrame]
    partitions: int


STREAMS = {
    "temp_table": Stream(daily_state, 2),
    "temp_duration_interval": Stream(duration_state, 2),
    "temp_pick_drop_zone": Stream(route_state, 8),
    "temp_trip_fare": Stream(fare_state, 1),
}


def stream_session(spark: SparkSession, topic: str, state_partitions: int | None = None) -> SparkSession:
    """A child session (same cluster, own SQL conf) for running a stream, so that its number of
    state partitions leaves the caller's session untouched."""
    n = state_partitions or STREAMS[topic].partitions
    return child_session(spark, {"spark.sql.shuffle.partitions": str(n)})


def start_rollup_stream(records: DataFrame, topic: str, target_path: str, checkpoint: str, available_now: bool = True,
                        on_other: OnOther = "refuse") -> tuple[StreamingQuery, SnapshotTarget]:
    """Start the stream of ``topic`` from a streaming DataFrame of its records.

    ``on_other``: what to do with a target that another checkpoint has
    written, ``refuse`` (``OtherCheckpoint`` is raised) or ``reset``.
    """
    target = SnapshotTarget(target_path, checkpoint, on_other)
    target.admit(records.sparkSession)
    writer = (STREAMS[topic].state(records).writeStream.outputMode("complete")
              .foreachBatch(target.write_batch).option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start(), target
