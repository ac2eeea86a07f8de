"""Round trips of the binary layouts, checksums, torn tails, Parquet logs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidelog.sources import binary, logs


def _file(path, df, column, order):
    path.write_bytes(b"".join(bytes(r[0]) for r in df.orderBy(order).select(column).collect()))
    return str(path)


def test_kv_round_trip(spark, tmp_path):
    rows = [(0, b"key1", b"value1", -1), (1, "schlüssel".encode(), b"", 5), (2, b"", b"\x00\xff", 2**40)]
    df = spark.createDataFrame(rows, "seq long, key binary, value binary, ttl long")
    encoded = df.withColumn("r", binary.kv_record(F.col("key"), F.col("value"), F.col("ttl")))
    first = bytes(encoded.where("seq = 0").first().r)
    assert first == (-1569362854).to_bytes(4, "big", signed=True) + (2**64 - 1).to_bytes(8, "big") + b"\x04" + (6).to_bytes(4, "big") + b"key1value1"
    path = _file(tmp_path / "kv.data", encoded, "r", "seq")
    got = [(bytes(r.key), bytes(r.value), r.ttl) for r in binary.read_kv(spark, path).orderBy("seq").collect()]
    assert got == [(k, v, t) for _, k, v, t in rows]
    broken = bytearray((tmp_path / "kv.data").read_bytes())
    broken[21] ^= 1  # first byte of value1
    (tmp_path / "kv.data").write_bytes(broken)
    assert [r.ok for r in binary.read_kv(spark, path, verify=False).orderBy("seq").collect()] == [False, True, True]
    for read in (lambda df: df.collect(), lambda df: df.count(), lambda df: df.select("key", "value").collect(), lambda df: df.where("seq > 0").select("seq").collect()):
        with pytest.raises(Exception, match="checksum"):
            read(binary.read_kv(spark, path))


def test_index_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, b"a", 0, 18), (1, b"bb", 18, 19)], "seq long, key binary, o int, s int").withColumn("r", binary.index_entry(F.col("key"), F.col("o"), F.col("s")))
    got = binary.read_index(spark, _file(tmp_path / "kv.index", df, "r", "seq")).orderBy("seq").collect()
    assert [(bytes(r.key), r.record_offset, r.record_size) for r in got] == [(b"a", 0, 18), (b"bb", 18, 19)]


def test_wal_round_trip_and_torn_tail(spark, tmp_path):
    rows = [(0, "SET", "näme", "Anna"), (1, "SET", "age", "28"), (2, "DEL", "age", None), (3, "SET", "e", "")]
    df = spark.createDataFrame(rows, "seq long, op string, key string, value string").withColumn("r", binary.wal_command(F.col("op"), F.col("key"), F.col("value")))
    path = _file(tmp_path / "wal", df, "r", "seq")
    got = [(r.op, r.key, r.value) for r in binary.read_wal(spark, path).orderBy("seq").collect()]
    assert got == [r[1:] for r in rows]
    whole = (tmp_path / "wal").read_bytes()
    (tmp_path / "wal").write_bytes(whole[:-1])
    assert binary.read_wal(spark, path, on_truncated="drop").count() == 3
    with pytest.raises(Exception, match="ends inside"):
        binary.read_wal(spark, path).collect()
    with pytest.raises(Exception, match="unknown op"):
        df.select(binary.wal_command(F.lit("PUT"), F.col("key"), F.col("value"))).collect()


def test_empty_file(spark, tmp_path):
    (tmp_path / "wal").write_bytes(b"")
    assert binary.read_wal(spark, str(tmp_path / "wal")).count() == 0


def test_parquet_log(spark, tmp_path):
    path = str(tmp_path / "log")
    logs.append(spark.range(3).withColumnRenamed("id", "seq"), path)
    logs.append(spark.range(3, 5).withColumnRenamed("id", "seq"), path)
    assert logs.scan(spark, path).count() == 5
    assert logs.at(logs.scan(spark, path), "seq", 4).count() == 1


def test_streamed_log(spark, tmp_path):
    spark.range(5).withColumnRenamed("id", "seq").write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        q = logs.append_stream(spark.readStream.schema("seq long").parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "at"))
        q.processAllAvailable()
        q.stop()
    assert logs.scan(spark, str(tmp_path / "log")).count() == 5
