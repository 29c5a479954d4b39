"""Streams give what the batch operators give, in one micro-batch or many."""

import pytest
from pyspark.sql import functions as F

from speechlake.plans import QUERIES
from speechlake.streaming import jobs, windows

SCHEMA = "stream bigint, idx bigint, x double, control string"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)


def plain(rows, size, hop):
    out = []
    for stream in {r[0] for r in rows}:
        x, start, number = [], 0, 0
        for _, _, v, control in sorted((r for r in rows if r[0] == stream), key=lambda r: r[1]):
            if control is None:
                x.append(v)
                while len(x) >= size:
                    out.append((stream, number, start, size, round(sum(x[:size]) / size, 9), False))
                    x, start, number = x[hop:], start + hop, number + 1
            elif control == "flush" and x:
                out.append((stream, number, start, len(x), round(sum(x) / size, 9), True))
                x, start, number = [], start + len(x), number + 1
            elif control == "reset":
                x, start, number = [], 0, 0
            elif control == "drop":
                x, start = [], start + len(x)
    return sorted(out)


@pytest.mark.parametrize("per_trigger", [1, 100])
def test_count_windows_and_controls(spark, per_trigger):
    rows = [(s, i, float((i * 7 + s) % 11), None) for s in (1, 2, 3) for i in range(40) if i != 25]
    rows += [(1, 25, 0.0, "reset"), (2, 25, 0.0, "drop"), (1, 40, 0.0, "flush"), (2, 40, 0.0, "flush"), (3, 40, 0.0, "flush"), (3, 41, 0.0, "flush")]
    stream = jobs.file_stream(spark, spark.createDataFrame(rows, SCHEMA), "test", per_trigger, files=3, order="idx")
    got = jobs.run_available(windows.count_windows(stream, "stream", 6, 4), "test").collect()
    assert sorted((r.stream, r.window_index, r.start, r.n, round(r["mean"], 9), r.is_final) for r in got) == plain(rows, 6, 4)


def test_late_rows_are_dropped(spark):
    rows = [(0, "2024-01-01 00:00:00", 1.0), (10, "2024-01-09 00:00:00", 1.0), (20, "2024-01-15 00:00:00", 1.0), (30, "2024-01-01 01:00:00", 9.0), (40, "2024-01-20 00:00:00", 1.0)]
    df = spark.createDataFrame(rows, "n int, t string, v double").withColumn("ts", F.to_timestamp("t"))
    stream = jobs.file_stream(spark, df, "test", 1, files=9, order="n")
    out = jobs.run_available(windows.time_windows(stream, "ts", [], "1 day", "1 day", "v", late="1 day"), "test")
    got = {str(r.start)[:10]: (r.n, r["mean"]) for r in out.collect()}
    assert got["2024-01-01"] == (1, 1.0)


def test_decisions_once_per_key(spark):
    df = spark.createDataFrame([(i, i / 10) for i in range(10)], "id int, score double")
    stream = jobs.file_stream(spark, df, "test", 1, files=3)
    assert jobs.run_batches(stream, "test", lambda b: b.withColumn("high", F.col("score") > 0.5), "id").count() == 10


def test_the_stream_emits_every_window(spark):
    sf = "/root/testdata/sf0.001"
    rows = lambda name: sorted((r.event_type or "", str(r.start), r.n, round(r["mean"], 6)) for r in QUERIES[name](spark, sf).collect())
    assert rows("time_windows_stream") == rows("time_windows")
