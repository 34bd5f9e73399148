"""Change-feed messages: encode rows as JSON records, decode them back.

A *record* has ``topic, timestamp, key, value`` as a Kafka source gives them,
``key`` and ``value`` as JSON text (and ``partition, offset`` where the source
is Kafka).  Offline, a topic is a folder of JSON-lines files that Spark's file
source reads; with the Kafka connector on the classpath the same decoding
applies to ``readStream.format("kafka")``.

Row payloads follow a CDC connector writing JSON without schemas:
* flat new-row state (the unwrap transform): ``{"col": ...}``
* envelope: ``{"before": {...}, "after": {...}, "op": "c|u|r|d"}``, or the
  same inside ``{"payload": ...}`` when schemas are enabled;
* a NULL value (tombstone) or an envelope with no ``after`` (delete) carries
  no new row state and is dropped;
* DATE columns arrive as days since 1970-01-01 (int) or as ISO text;
* the time of a change at its source is ``ts_ms`` of an envelope, or the field
  ``__ts_ms`` that the unwrap transform adds to a flat row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD_SCHEMA = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
])

# Row schemas of the four change-feed topics (DDL of the stream tables).
TOPIC_SCHEMAS = {
    "temp_table": T.StructType([
        T.StructField("pickup_date", T.DateType()),
        T.StructField("pickup_hour", T.LongType()),
        T.StructField("pickup_days", T.StringType()),
        T.StructField("count_trip", T.LongType()),
    ]),
    "temp_duration_interval": T.StructType([
        T.StructField("duration_interval", T.DoubleType()),
        T.StructField("trip_count", T.LongType()),
        T.StructField("duration_interval_class", T.StringType()),
    ]),
    "temp_pick_drop_zone": T.StructType([
        T.StructField("PULocationID", T.IntegerType()),
        T.StructField("DOLocationID", T.IntegerType()),
        T.StructField("pickup_zone", T.StringType()),
        T.StructField("drop_zone", T.StringType()),
        T.StructField("total_trip", T.LongType()),
        T.StructField("avg_trip_distance_km", T.DoubleType()),
        T.StructField("avg_fare_amount", T.DoubleType()),
    ]),
    "temp_trip_fare": T.StructType([
        T.StructField("pickup_hour", T.LongType()),
        T.StructField("avg_fare_per_km", T.DoubleType()),
        T.StructField("avg_tip_amount", T.DoubleType()),
        T.StructField("short_trip_count", T.LongType()),
        T.StructField("long_trip_count", T.LongType()),
    ]),
}


#: Columns that :func:`decode_changes` adds to a row.
CHANGED_AT, DELETED = "_changed_at", "_deleted"


# --- encode --------------------------------------------------------------------------------

def to_messages(df: DataFrame, topic: str, key: list[str] | None = None, epoch_day_dates: bool = True,
                envelope: bool = False, changed_at: Column | None = None, op: str = "c",
                keep: tuple[str, ...] = ()) -> DataFrame:
    """``(topic, key, value)`` with each row as JSON text, ready for a Kafka
    sink (``write.format("kafka")``) or a folder topic.

    ``epoch_day_dates`` writes DATE columns as days since 1970-01-01, as a
    CDC connector does; ``envelope`` wraps the row as ``{"after": row, "op": op}``
    (for op ``d``, as ``before``); ``changed_at`` (milliseconds) is the time
    of the change at its source; columns in ``keep`` are carried beside the
    message and not in it.
    """
    cols = []
    for f in df.schema.fields:
        if f.name in keep:
            continue
        c = F.col(f.name)
        if epoch_day_dates and isinstance(f.dataType, T.DateType):
            c = F.unix_date(c)
        cols.append(c.alias(f.name))
    row = F.struct(*cols)
    if envelope:
        time = [changed_at.alias("ts_ms")] if changed_at is not None else []
        value = F.to_json(F.struct(row.alias("before" if op == "d" else "after"), F.lit(op).alias("op"), *time))
    else:
        time = [changed_at.alias("__ts_ms")] if changed_at is not None else []
        value = F.to_json(F.struct(*cols, *time))
    key_col = F.to_json(F.struct(*[F.col(k) for k in key])) if key else F.lit(None).cast("string")
    return df.select(F.lit(topic).alias("topic"), key_col.alias("key"), value.alias("value"), *keep)


def append_messages(messages: DataFrame, folder: str, by: str | None = None) -> None:
    """Append messages to a folder topic as JSON lines, stamped with the time of writing.

    ``by`` names a kept column to lay the files out by, one file for each value.
    """
    out = messages.withColumn("timestamp", F.current_timestamp())
    writer = out.repartition(by).write.partitionBy(by) if by else out.write
    writer.mode("append").json(folder)


# --- decode --------------------------------------------------------------------------------

def _lenient(schema: T.StructType) -> T.StructType:
    """Row schema with DATE fields read as text (epoch-day int or ISO)."""
    return T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.DateType)
                                       else f.dataType) for f in schema.fields])


def cdc_date(text: Column) -> Column:
    """Epoch-day integer text -> date; otherwise ISO date/timestamp text -> date."""
    return (F.when(text.rlike(r"^-?\d+$"), F.date_from_unix_date(text.cast("int")))
            .otherwise(text.try_cast("date")))


def _parse(records: DataFrame, schema: T.StructType, keep: tuple[str, ...]) -> DataFrame:
    """Records with ``_flat, _before, _after, _op, _ts``: each value is parsed
    once, with a schema that holds both the row's fields (flat form) and the
    envelope's, at the top or inside ``payload``."""
    row = _lenient(schema)
    env = [T.StructField("before", row), T.StructField("after", row), T.StructField("op", T.StringType()),
           T.StructField("ts_ms", T.LongType())]
    clash = {"before", "after", "op", "ts_ms", "payload", "__ts_ms"} & set(row.fieldNames())
    if clash:
        raise ValueError(f"row fields clash with envelope fields: {sorted(clash)}")
    both = T.StructType([*row.fields, T.StructField("__ts_ms", T.LongType()), *env,
                         T.StructField("payload", T.StructType(env))])
    parsed = records.select(*keep, F.from_json("value", both).alias("_m"))
    of = {c: F.coalesce(F.col(f"_m.{c}"), F.col(f"_m.payload.{c}")) for c in ("before", "after", "op", "ts_ms")}
    flat = F.when(of["op"].isNull() & of["after"].isNull() & F.col("_m").isNotNull(),
                  F.struct(*[F.col(f"_m.{f.name}").alias(f.name) for f in row.fields]))
    return parsed.select(*keep, flat.alias("_flat"), of["before"].alias("_before"), of["after"].alias("_after"),
                         of["op"].alias("_op"), F.coalesce(of["ts_ms"], F.col("_m.__ts_ms")).alias("_ts"))


def _typed(row: str, schema: T.StructType) -> list[Column]:
    """The fields of a leniently parsed row, typed by ``schema``."""
    cols = []
    for f in schema.fields:
        c = F.col(f"{row}.{f.name}")
        cols.append((cdc_date(c) if isinstance(f.dataType, T.DateType) else c).alias(f.name))
    return cols


def decode_change_feed(records: DataFrame, schema: T.StructType, keep: tuple[str, ...] = ()) -> DataFrame:
    """New row states from change-feed records, typed by ``schema``.

    Tombstones and deletes are dropped; ``keep`` carries record columns
    (e.g. ``timestamp``) along.
    """
    parsed = _parse(records.where(F.col("value").isNotNull()), schema, keep)
    state = parsed.select(*keep, F.coalesce("_after", "_flat").alias("_s")).where(F.col("_s").isNotNull())
    return state.select(*keep, *_typed("_s", schema))


def decode_changes(records: DataFrame, schema: T.StructType, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Every change of a feed: the row's fields, ``CHANGED_AT`` (milliseconds) and ``DELETED``.

    A delete has the fields of the row it removes; a tombstone those of its
    record's key (a tombstone without a key tells nothing and is dropped).
    The time is that of the source where the payload has it, else the
    record's.
    """
    key = T.StructType([f for f in _lenient(schema).fields if f.name in keys])
    held = records.withColumn("_key", F.from_json("key", key)).withColumn(
        "_at", (F.unix_micros("timestamp") / 1000).cast("long")).withColumn("_gone", F.col("value").isNull())
    parsed = _parse(held, schema, tuple(dict.fromkeys((*keep, "_key", "_at", "_gone"))))
    named = F.struct(*[(F.col(f"_key.{f.name}") if f.name in keys else F.lit(None).cast(f.dataType)).alias(f.name)
                       for f in _lenient(schema).fields])
    deleted = F.col("_gone") | (F.coalesce(F.col("_op"), F.lit("")) == "d")
    row = F.when(F.col("_gone"), F.when(F.col("_key").isNotNull(), named)).otherwise(
        F.when(deleted, F.col("_before")).otherwise(F.coalesce("_after", "_flat")))
    out = parsed.select(*keep, row.alias("_s"), F.coalesce("_ts", "_at").alias(CHANGED_AT), deleted.alias(DELETED))
    return out.where(F.col("_s").isNotNull()).select(*keep, *_typed("_s", schema), CHANGED_AT, DELETED)


# --- read ----------------------------------------------------------------------------------

def folder_records(spark: SparkSession, folder: str) -> DataFrame:
    """All records of a folder topic (batch read, from the earliest)."""
    return spark.read.schema(RECORD_SCHEMA).json(folder)


def folder_record_stream(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(RECORD_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(folder)


def kafka_read_options(bootstrap_servers: str, topic: str, starting_offsets: str = "earliest",
                       max_offsets_per_trigger: int | None = None) -> dict[str, str]:
    """Options of Spark's Kafka source.

    ``max_offsets_per_trigger`` bounds each micro-batch, so a large backlog
    (a first start from the earliest offset) is consumed in steps.
    """
    options = {"kafka.bootstrap.servers": bootstrap_servers, "subscribe": topic, "startingOffsets": starting_offsets}
    if max_offsets_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return options


def kafka_fields(raw: DataFrame) -> DataFrame:
    """Records from the rows of a Kafka source, whose keys and values are bytes."""
    return raw.select("topic", "partition", "offset", "timestamp", F.col("key").cast("string").alias("key"),
                      F.col("value").cast("string").alias("value"))


def kafka_record_stream(spark: SparkSession, bootstrap_servers: str, topic: str, starting_offsets: str = "earliest",
                        max_offsets_per_trigger: int | None = None) -> DataFrame:
    """Records from a Kafka topic (needs the spark-sql-kafka connector)."""
    options = kafka_read_options(bootstrap_servers, topic, starting_offsets, max_offsets_per_trigger)
    return kafka_fields(spark.readStream.format("kafka").options(**options).load())


def replay_topic(records: DataFrame, schema: T.StructType) -> DataFrame:
    """A whole topic (``folder_records``) decoded, by the time of its records."""
    return decode_change_feed(records, schema, keep=("timestamp",)).orderBy("timestamp").drop("timestamp")
