"""Streams with timers against the batch folds over the same events."""

import datetime
import random

from pyspark.sql import functions as F

from sluice.operators import folds
from sluice.streaming import folds as streaming

START = datetime.datetime(2024, 1, 1)
SCHEMA = "k string, n int, at timestamp, ok boolean"


def events(spark, tmp_path):
    """Four files of events in order of time, the last far later, so that all timers before it come due."""
    r = random.Random(5)
    rows = [(f"k{r.randrange(6)}", n, START + datetime.timedelta(seconds=n * 7 + r.randrange(5)), r.random() < 0.6) for n in range(120)]
    rows.append(("late", 120, START + datetime.timedelta(days=9), True))
    for i, part in enumerate([rows[:40], rows[40:80], rows[80:120], rows[120:]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/part-{i}")
    return rows, spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path))


def drained(stream, name):
    stream.writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def test_cooldown_stream_equals_batch(spark, tmp_path):
    rows, stream = events(spark, tmp_path)
    got = {r.n: r.accepted for r in drained(streaming.cooldown(stream, "k", "at", "n", "ok", 60.0, "5 seconds"), "cool").collect()}
    batch = spark.createDataFrame(rows, SCHEMA).withColumn("s", F.unix_micros("at") / 1e6)
    want = {r.n: r.accepted for r in folds.cooldown(batch, "k", "s", "ok", 60.0, "n").collect()}
    assert got == want and 0 < sum(want.values()) < len(want)


def test_cache_entries_expire_by_timer(spark, tmp_path):
    rows, stream = events(spark, tmp_path)
    got = sorted((r.k, r.at, r.state) for r in drained(streaming.cache_states(stream, "k", "at", 30.0, "5 seconds"), "cached").collect())
    want = []
    for k in sorted({r[0] for r in rows}):
        ends = None
        for at in sorted(r[2] for r in rows if r[0] == k):
            if ends is not None and at > ends:
                want.append((k, ends, "expired"))
                ends = None
            if ends is None:
                want.append((k, at, "live"))
            ends = at + datetime.timedelta(seconds=30)
        if k != "late":
            want.append((k, ends, "expired"))
    assert got == sorted(want) and sum(s == "expired" for _, _, s in want) > 10
