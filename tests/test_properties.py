"""Property tests of the column functions against plain-Python statements
of their meaning (each example is one Spark job over a generated list)."""
import datetime as dt
import math

from hypothesis import given, settings
from hypothesis import strategies as st

from tripstats import config as C
from tripstats.functions.columns import (bucket_label, duration_bucket, label_start, net_of_tip,
                                         weekday_name, weekday_rank)

SETTINGS = settings(max_examples=15, deadline=None)


@SETTINGS
@given(st.lists(st.integers(min_value=1, max_value=10**7), min_size=1, max_size=200))
def test_duration_bucket_and_label(spark, secs):
    df = spark.createDataFrame([(s,) for s in secs], "trip_duration_sec long")
    out = df.select(duration_bucket("trip_duration_sec").alias("b")).select(
        "b", bucket_label("b").alias("l")).select("b", "l", label_start("l").alias("s")).collect()
    for s, r in zip(secs, out):
        start = float(math.floor(s / 60 / 5) * 5)
        assert r.b == start
        if start > C.BUCKET_CAP:
            assert r.l == C.OVER_CAP_LABEL and r.s is None
        else:
            assert r.l == f"{start!r}-{start + 5!r}" and r.s == start


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 10**7), st.integers(0, 10**6)), min_size=1, max_size=200))
def test_net_of_tip_is_exact_in_cents(spark, pairs):
    df = spark.createDataFrame([(a / 100, b / 100) for a, b in pairs], "total_amount double, tip_amount double")
    out = df.select(net_of_tip().alias("n")).collect()
    for (a, b), r in zip(pairs, out):
        assert r.n == (a - b) / 100


@SETTINGS
@given(st.lists(st.one_of(st.sampled_from(C.WEEKDAYS), st.text(max_size=12)), min_size=1, max_size=50))
def test_weekday_rank(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "pickup_days string")
    out = [r[0] for r in df.select(weekday_rank("pickup_days")).collect()]
    assert out == [C.WEEKDAYS.index(n) + 1 if n in C.WEEKDAYS else None for n in names]


@SETTINGS
@given(st.lists(st.datetimes(min_value=dt.datetime(2000, 1, 1), max_value=dt.datetime(2030, 12, 31)),
                min_size=1, max_size=100))
def test_weekday_name_matches_calendar(spark, stamps):
    df = spark.createDataFrame([(t,) for t in stamps], "ts timestamp_ntz")
    out = [r[0] for r in df.select(weekday_name("ts")).collect()]
    assert out == [t.strftime("%A") for t in stamps]
