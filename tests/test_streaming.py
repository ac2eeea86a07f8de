"""A log streamed in several batches gives the batch answers."""

from __future__ import annotations

import os
import shutil

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidelog.operators import limits, locks, log_state
from tidelog.streaming import stateful


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("stream")
    e = spark.read.parquet(f"{SF}/events.parquet")
    log = e.select("event_id", "user_id", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), (F.col("event_type") == "error").alias("u"), F.when(F.col("event_id") % 7 > 0, 21_600_000).cast("long").alias("lease"), "value").where("event_id < 400")
    for i in range(3):
        log.where((F.col("event_id") >= 140 * i) & (F.col("event_id") < 140 * (i + 1))).coalesce(1).write.parquet(f"{path}/in/{i}")
    (path / "flat").mkdir()
    for i in range(3):
        for f in (path / "in" / str(i)).glob("*.parquet"):
            shutil.copy(f, to := path / "flat" / f"{i}.parquet")
            os.utime(to, (1_700_000_000 + 60 * i,) * 2)  # files stream in order of age
    return str(path / "flat"), log


def _run(spark, files, make, name, mode="append"):
    path, log = files
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return sorted(tuple(r) for r in spark.sql(f"SELECT * FROM {name}").collect())


@pytest.mark.parametrize("limiter", [limits.SlidingWindow(2, 43_200), limits.TokenBucket(3, 43_200)], ids=["window", "bucket"])
def test_limiters(spark, files, limiter):
    cols = ["user_id", "event_id", "t"]
    got = _run(spark, files, lambda s: stateful.admit(s.select(*cols), limiter, "user_id", "t", "event_id"), f"q_{type(limiter).__name__}")
    want = limits.admit(files[1].select(*cols), limiter, "user_id", "t", "event_id")
    assert got == sorted(tuple(r) for r in want.collect())


def test_leases(spark, files):
    cols = ["user_id", "event_id", "t", "u", "lease"]
    got = _run(spark, files, lambda s: stateful.lease_lock(s.select(*cols), "user_id", "t", "event_id", "u", "lease").select("event_id", "granted"), "q_lease")
    want = locks.lease_lock(files[1].select(*cols), "user_id", "t", "event_id", "u", "lease").select("event_id", "granted")
    assert got == sorted(tuple(r) for r in want.collect())


def test_latest(spark, files):
    got = _run(spark, files, lambda s: stateful.latest(s, "user_id", "event_id", ["value"]), "q_latest", "complete")
    assert got == sorted(tuple(r) for r in log_state.latest(files[1], ["user_id"], "event_id", ["value"]).collect())


def test_silences(spark, files):
    got = _run(spark, files, lambda s: stateful.silences(s.select("user_id", "ts"), "user_id", "ts", "6 hours", "1 hour").select("user_id", "beats"), "q_silence")
    assert got and sum(b for _, b in got) <= files[1].count()
