"""Big-endian record layouts of the key-value data file, its index and the write-ahead log.

Encoders are Column expressions. Decoders read whole files through `binaryFile`
(one file a row, below 2 GB) and give one row a record with its byte offset as
seq. Lengths count bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import signed_crc32

#: Checksum i32, ttl i64 (-1 never), key size u8, value size i32; index: key size u8, offset i32, size i32.
RECORD, INDEX, LENGTH = ">iqBi", ">Bii", ">i"
SET, DEL = 0, 1
KV = "file string, seq long, checksum int, ttl long, key binary, value binary, ok boolean"
ENTRY = "file string, seq long, key binary, record_offset int, record_size int"
COMMAND = "file string, seq long, op string, key string, value string"


def big_endian(x: Column, n: int) -> Column:
    """An integer's low n bytes."""
    digits = F.lpad(F.hex(x.cast("long")), 16, "0")
    return F.unhex(F.substring(digits, 17 - 2 * n, 2 * n))


def short_key(key: Column) -> Column:
    """The key, refused above the 255 bytes that one length byte can say."""
    return F.when(F.octet_length(key) <= 255, key).otherwise(F.raise_error(F.lit("a key has 255 bytes at most in this layout")).cast("binary"))


def kv_record(key: Column, value: Column, ttl: Column) -> Column:
    head = F.concat(big_endian(signed_crc32(value), 4), big_endian(ttl, 8), big_endian(F.octet_length(key), 1), big_endian(F.octet_length(value), 4))
    return F.concat(head, short_key(key), value)


def index_entry(key: Column, offset: Column, size: Column) -> Column:
    return F.concat(big_endian(F.octet_length(key), 1), big_endian(offset, 4), big_endian(size, 4), short_key(key))


def wal_command(op: Column, key: Column, value: Column) -> Column:
    """SET with its value, DEL without; any other op raises."""
    k, v = F.encode(key, "UTF-8"), F.encode(value, "UTF-8")
    named = F.concat(big_endian(F.octet_length(k), 1))
    set_ = F.concat(F.lit(bytes([SET])), named, big_endian(F.octet_length(v), 4), short_key(k), v)
    del_ = F.concat(F.lit(bytes([DEL])), named, short_key(k))
    return F.when(op == "SET", set_).when(op == "DEL", del_).otherwise(F.raise_error(F.concat(F.lit("unknown op "), op)).cast("binary"))


class Truncated(ValueError):
    pass


def _take(data: bytes, at: int, n: int) -> bytes:
    if at + n > len(data):
        raise Truncated(f"the file ends inside the record at byte {at}")
    return data[at : at + n]


def _kv(data: bytes, at: int) -> tuple[tuple, int]:
    checksum, ttl, k, v = struct.unpack(RECORD, _take(data, at, 17))
    body = _take(data, at + 17, k + v)
    value = body[k:]
    return (checksum, ttl, body[:k], value, zlib.crc32(value) == checksum & 0xFFFFFFFF), at + 17 + k + v


def _entry(data: bytes, at: int) -> tuple[tuple, int]:
    k, offset, size = struct.unpack(INDEX, _take(data, at, 9))
    return (_take(data, at + 9, k), offset, size), at + 9 + k


def _command(data: bytes, at: int) -> tuple[tuple, int]:
    kind, k = _take(data, at, 2)
    if kind == DEL:
        return ("DEL", _take(data, at + 2, k).decode(), None), at + 2 + k
    if kind != SET:
        raise ValueError(f"unknown command {kind} at byte {at}")
    (v,) = struct.unpack(LENGTH, _take(data, at + 2, 4))
    body = _take(data, at + 6, k + v)
    return ("SET", body[:k].decode(), body[k:].decode()), at + 6 + k + v


#: Decoders by format: one record at a byte -> (its columns, the byte after it); and the schema.
CODECS: dict[str, tuple[Callable, str]] = {"kv": (_kv, KV), "index": (_entry, ENTRY), "wal": (_command, COMMAND)}


def decode(files: DataFrame, codec: str, on_truncated: str = "fail", verify: bool = False, path: str = "path", content: str = "content") -> DataFrame:
    """(path, content) rows, a whole file each, to the records of a codec; one row a record, seq its first byte.

    With verify, a kv record whose value doesn't fit its checksum raises in the
    decoder, whatever columns are read.
    """
    if on_truncated not in ("fail", "drop"):
        raise ValueError("on_truncated is fail or drop")
    one, schema = CODECS[codec]
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows, at = [], 0
                while at < len(data):
                    try:
                        row, after = one(data, at)
                    except Truncated:
                        if on_truncated == "fail":
                            raise
                        break
                    if verify and not row[-1]:
                        raise ValueError(f"checksum mismatch in the record at byte {at} of {file}")
                    rows.append((file, at, *row))
                    at = after
                    if len(rows) == 10_000 or at == len(data):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return files.select(F.col(path).cast("string").alias("path"), F.col(content).alias("content")).mapInArrow(run, schema)


def file_of(records: DataFrame, file: str, order: list[str], record: str) -> DataFrame:
    """(file, content): encoded records side by side in order, a file a row; a file stays below 2 GB in this layout."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.hex(record).alias("_hex")))), lambda r: r["_hex"])
    return records.groupBy(file).agg(F.unhex(F.array_join(parts, "")).alias("content"))


def record_at(files: DataFrame, index: DataFrame, on: str, offset: str = "record_offset", size: str = "record_size", content: str = "content") -> DataFrame:
    """index rows with record, the bytes that (offset, size) point to in their file."""
    return index.join(files, on).withColumn("record", F.substring(F.col(content), F.col(offset) + 1, F.col(size))).drop(content)


def _read(spark: SparkSession, path: str, codec: str, on_truncated: str, verify: bool = False) -> DataFrame:
    return decode(spark.read.format("binaryFile").load(path), codec, on_truncated, verify)


def read_kv(spark: SparkSession, path: str, verify: bool = True, on_truncated: str = "fail") -> DataFrame:
    """Records of a data file; with verify, one whose value doesn't fit its checksum raises on any read of the file, else ok says so."""
    return _read(spark, path, "kv", on_truncated, verify)


def read_index(spark: SparkSession, path: str, on_truncated: str = "fail") -> DataFrame:
    return _read(spark, path, "index", on_truncated)


def read_wal(spark: SparkSession, path: str, on_truncated: str = "fail") -> DataFrame:
    return _read(spark, path, "wal", on_truncated)
