"""Change-feed payload decoding."""
import datetime as dt

from tripstats.sources.messages import RECORD_SCHEMA, TOPIC_SCHEMAS, decode_change_feed, to_messages


def records(spark, values):
    return spark.createDataFrame([("t", None, None, v) for v in values], RECORD_SCHEMA)


def test_flat_envelope_payload_tombstone_delete(spark):
    values = [
        '{"pickup_date":20089,"pickup_hour":3,"pickup_days":"Wednesday","count_trip":12}',
        '{"before":null,"after":{"pickup_date":"2025-01-02","pickup_hour":4,"pickup_days":"Thursday",'
        '"count_trip":5},"op":"c"}',
        '{"payload":{"before":null,"after":{"pickup_date":20091,"pickup_hour":5,"pickup_days":"Friday",'
        '"count_trip":7},"op":"u"}}',
        None,                                                        # tombstone
        '{"before":{"pickup_date":20089,"pickup_hour":3},"after":null,"op":"d"}',  # delete
        '{"pickup_date":"2025-01-04T00:00:00Z","pickup_hour":6,"pickup_days":"Saturday","count_trip":1}',
    ]
    out = decode_change_feed(records(spark, values), TOPIC_SCHEMAS["temp_table"]).collect()
    got = sorted((r.pickup_date, r.pickup_hour, r.pickup_days, r.count_trip) for r in out)
    assert got == [(dt.date(2025, 1, 1), 3, "Wednesday", 12), (dt.date(2025, 1, 2), 4, "Thursday", 5),
                   (dt.date(2025, 1, 3), 5, "Friday", 7), (dt.date(2025, 1, 4), 6, "Saturday", 1)]


def test_round_trip_keeps_doubles_exact(spark):
    schema = TOPIC_SCHEMAS["temp_pick_drop_zone"]
    vals = [(1, 2, "A", None, 3, 1.0 / 3.0, 12345.678901234567), (264, 7, None, "B", 1, 1e-7, 1e17)]
    df = spark.createDataFrame(vals, schema)
    for envelope in (False, True):
        msgs = to_messages(df, "etl.public.temp_pick_drop_zone", key=["PULocationID", "DOLocationID"],
                           envelope=envelope)
        recs = msgs.selectExpr("topic", "CAST(NULL AS TIMESTAMP) AS timestamp", "key", "value")
        back = decode_change_feed(recs, schema)
        assert sorted(map(tuple, back.collect())) == sorted(vals)


def test_dates_encoded_as_epoch_days(spark):
    df = spark.createDataFrame([(dt.date(2025, 1, 1), 1, "Wednesday", 2)], TOPIC_SCHEMAS["temp_table"])
    v = to_messages(df, "x").first().value
    assert v == '{"pickup_date":20089,"pickup_hour":1,"pickup_days":"Wednesday","count_trip":2}'


def test_changes_carry_time_key_and_deletion(spark):
    from tripstats.sources.messages import decode_changes
    at = dt.datetime(2025, 1, 1, 0, 0, 1)
    base = {k: f'"pickup_date":20089,"pickup_hour":{k},"pickup_days":"Wednesday","count_trip":2' for k in range(6)}
    recs = [("t", at, None, '{"after":{%s},"op":"c","ts_ms":5}' % base[0]),
            ("t", at, None, '{"payload":{"before":{%s},"after":null,"op":"d","ts_ms":6}}' % base[1]),
            ("t", at, None, '{%s,"__ts_ms":7}' % base[2]), ("t", at, None, "{%s}" % base[3]),
            ("t", at, '{"pickup_date":20089,"pickup_hour":4}', None), ("t", at, None, None)]
    out = decode_changes(spark.createDataFrame(recs, RECORD_SCHEMA), TOPIC_SCHEMAS["temp_table"], ["pickup_date", "pickup_hour"])
    got = sorted((r.pickup_hour, r._changed_at, r._deleted, r.count_trip, r.pickup_date) for r in out.collect())
    day, ms = dt.date(2025, 1, 1), int(at.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert got == [(0, 5, False, 2, day), (1, 6, True, 2, day), (2, 7, False, 2, day), (3, ms, False, 2, day),
                   (4, ms, True, None, day)]


def test_kafka_options_and_fields(spark):
    import pytest
    from pyspark.errors import AnalysisException
    from tripstats.sinks.writers import kafka_write_options, write_kafka
    from tripstats.sources.messages import kafka_fields, kafka_read_options, kafka_record_stream
    assert kafka_read_options("h:1", "etl.public.temp_table") == {
        "kafka.bootstrap.servers": "h:1", "subscribe": "etl.public.temp_table", "startingOffsets": "earliest"}
    assert kafka_read_options("h:1", "t", "latest", 500)["maxOffsetsPerTrigger"] == "500"
    assert kafka_write_options("h:1") == {"kafka.bootstrap.servers": "h:1"}
    assert kafka_write_options("h:1", "t")["topic"] == "t"
    raw = spark.createDataFrame([(b"k", b'{"pickup_hour":1}', "t", 0, 3, dt.datetime(2025, 1, 1), 0)],
                                "key binary, value binary, topic string, partition int, offset long, timestamp timestamp, "
                                "timestampType int")
    assert [(r.key, r.value, r.offset) for r in kafka_fields(raw).collect()] == [("k", '{"pickup_hour":1}', 3)]
    # the connector is not shipped: both ends reach it and fail only there
    with pytest.raises(AnalysisException, match="(?i)kafka"):
        kafka_record_stream(spark, "h:1", "t")
    with pytest.raises(AnalysisException, match="(?i)kafka"):
        write_kafka(kafka_fields(raw), "h:1")
