"""Detectors over a stream whose rows come out of order."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from heatwise.sources.files import scratch
from heatwise.streaming import streams

START = dt.datetime(2020, 1, 1)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def run(spark, batches, delay):
    files, out = scratch(spark, "files"), scratch(spark, "out")
    schema = "user string, event_id long, ts timestamp, z double"
    for b in batches:
        spark.createDataFrame([(u, s, START + dt.timedelta(seconds=s), z) for u, s, z in b], schema).coalesce(1).write.mode("append").parquet(files)
        time.sleep(1.1)  # files are taken in order of their times
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(files)
    q = streams.stream_cusum(source, "user", delay=delay).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def by_hand(rows, k=0.5, h=4.0):
    high = low = 0.0
    step, out = None, []
    for n, (e, z) in enumerate(sorted(rows), 1):
        high, low = max(0.0, high + z - k), max(0.0, low - z - k)
        step = n if step is None and max(high, low) > h else step
        out.append((e, n, round(high, 9), round(low, 9), step))
    return out


def test_rows_within_the_delay_are_put_in_place_and_later_ones_marked(rocks):
    rng = random.Random(5)
    first = [("a", s, rng.gauss(0.4, 1)) for s in range(1, 31) if s not in (3, 25)]
    second = [("a", 25, 2.0), ("a", 3, 9.0), *[("a", s, rng.gauss(0.4, 1)) for s in range(31, 51)], ("b", 7, 5.0)]
    third = [("a", 70, 0.0), ("b", 7, 5.0), ("b", 30, 1.0)]
    for b in (first, second):
        rng.shuffle(b)
    got = run(rocks, [first, second, third], 10.0)
    a = got.where("key = 'a'")
    assert [r["event_id"] for r in a.where("late").collect()] == [3]
    on_time = [(e, z) for u, e, z in first + second if u == "a" and e != 3]
    rows = [(r["event_id"], r["step"], round(r["s_high"], 9), round(r["s_low"], 9), r["alarm_step"]) for r in a.where("NOT late").orderBy("step").collect()]
    assert rows == by_hand(on_time)  # row 70 still waits
    b = got.where("key = 'b'").orderBy("step").collect()
    assert [(r["event_id"], r["late"]) for r in b] == [(7, False), (7, False)]  # both came before the first was applied


def test_without_a_delay_a_batch_is_applied_with_itself(rocks):
    got = run(rocks, [[("a", 2, 1.0), ("a", 1, 1.0)], [("a", 1, 1.0), ("a", 3, 1.0)]], 0.0)
    assert sorted((r["event_id"], r["late"]) for r in got.select("event_id", "late").collect()) == [(1, False), (1, True), (2, False), (3, False)]
    assert got.where("NOT late").agg(F.max("step")).first()[0] == 3
