"""Histories of locks by key: plain, with leases, striped, and the length of queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from ..functions.scalars import hashed_stripe, stripe
from .ordered import fold, prefix_sum

#: A lease without a stated length: 131 years in milliseconds.
FOREVER_MS = 4_133_973_600_000


def try_lock(log: DataFrame, key: str, seq: str, unlocks: Column) -> DataFrame:
    """The lock rows of log with granted: a lock is granted iff none was since the key's last unlock, by whomever. Closed form, two windows on one shuffle."""
    by_key = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    turn = log.withColumn("_u", unlocks).withColumn("_turn", F.sum(F.col("_u").cast("long")).over(by_key))
    nth = F.sum(F.when(~F.col("_u"), 1).otherwise(0)).over(Window.partitionBy(key, "_turn").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    return turn.withColumn("granted", nth == 1).where("NOT _u").drop("_u", "_turn")


class Lease:
    """Grants where the key is free or its lease has ended (the end itself is free); a denied call extends nothing; an unlock frees at once."""

    @staticmethod
    def start() -> None:
        return None

    @staticmethod
    def step(ends: int | None, args: tuple) -> tuple[int | None, bool | None]:
        t, unlock, lease = args
        if unlock:
            return None, None
        if ends is None or ends <= t:
            return t + (FOREVER_MS if lease is None else lease), True
        return ends, False


def lease_lock(log: DataFrame, key: str, t_ms: str, seq: str, unlock: str, lease_ms: str) -> DataFrame:
    """The lock rows of log with granted, under leases."""
    return fold(log, [key], [t_ms, seq], [t_ms, unlock, lease_ms], Lease.start, Lease.step, "granted", "boolean").where(f"NOT {unlock}")


def stripes(log: DataFrame, key: str, n: int) -> DataFrame:
    """For each stripe: the distinct keys that share it and their calls. Integers are their own hash."""
    own = stripe if isinstance(log.schema[key].dataType, IntegralType) else hashed_stripe
    return log.groupBy(own(F.col(key), n).alias("stripe")).agg(F.countDistinct(key).alias("n_keys"), F.count(F.lit(1)).alias("n_calls"))


def queue_depth(log: DataFrame, key: str, seq: str, change: Column, out: str = "depth") -> DataFrame:
    """Holders and waiters after each event, as the running sum of +1 and -1."""
    return prefix_sum(log, [key], seq, change.cast("long"), out)
