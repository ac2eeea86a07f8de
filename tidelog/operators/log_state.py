"""Latest state of keys from a log of commands, with tombstones and expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import is_expired


def latest(log: DataFrame, key: list[str], seq: str, values: list[str]) -> DataFrame:
    """key and values of each key's last row by seq; one partial-and-final aggregate."""
    last = F.max_by(F.struct(*values), seq).alias("s")
    return log.groupBy(*key).agg(last).select(*key, "s.*")


def replay(log: DataFrame, key: list[str], seq: str, values: list[str], deleted: Column) -> DataFrame:
    """A write-ahead log's map: the last command of a key decides, a deletion leaves nothing. Empty values are values."""
    marked = log.withColumn("_deleted", deleted)
    return latest(marked, key, seq, [*values, "_deleted"]).where("NOT _deleted").drop("_deleted")


def visible(log: DataFrame, key: list[str], seq: str, value: str, expires_ms: str, tombstone: Column, now_ms: int) -> DataFrame:
    """What a read at now_ms sees: the last record decides first; if it is a tombstone or expired, older ones are not revived."""
    marked = log.withColumn("_dead", tombstone)
    last = latest(marked, key, seq, [value, expires_ms, "_dead"])
    return last.where(~F.col("_dead") & ~is_expired(F.col(expires_ms), now_ms)).select(*key, value)


def ttl_cleared(log: DataFrame, key: str, seq: str, expires_ms: str, now_ms: int) -> DataFrame:
    """Keys whose last record never expires although earlier ones have: key, expired_before."""
    out = log.groupBy(key).agg(F.max_by(expires_ms, seq).alias("last"), F.count_if(is_expired(F.col(expires_ms), now_ms)).alias("expired_before"))
    return out.where("last = -1 AND expired_before > 0").drop("last")


def idle_deletes(log: DataFrame, key: str, seq: str, deletes: Column) -> DataFrame:
    """Deletes of keys that no put came before: they append nothing. key, seq."""
    first = log.groupBy(key).agg(F.min(F.when(~deletes, F.col(seq))).alias("_first"))
    return log.where(deletes).select(key, seq).join(first, key).where(F.col("_first").isNull() | (F.col(seq) < F.col("_first"))).drop("_first")


def point_lookup(requests: DataFrame, state: DataFrame, request_key: str, key: str) -> DataFrame:
    """Every request with the state's row of its key, nulls where it has none."""
    return requests.join(state, F.col(request_key) == F.col(key), "left").drop(key)
