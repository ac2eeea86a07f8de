"""Multi-version reads: the value of a key as of a version."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .ordered import global_index, last_before


def versions(writes: DataFrame, seq: str, out: str = "version") -> DataFrame:
    """Numbers writes 1, 2, ... in log order, over all keys."""
    return global_index(writes, [seq], out, first=1)


def as_of(writes: DataFrame, reads: DataFrame, key: str, version: str, value: str) -> DataFrame:
    """reads with the value of the greatest version of their key that is not above theirs; reads that find none are left out.

    Union and window: one shuffle by key, no range join. At equal versions the
    write counts.
    """
    extra = [c for c in reads.columns if c not in (key, version)]
    w = writes.select(key, version, F.lit(1).alias("_side"), F.struct(F.col(value).alias("v")).alias("_s"), *[F.lit(None).cast(reads.schema[c].dataType).alias(c) for c in extra])
    r = reads.select(key, version, F.lit(2).alias("_side"), F.lit(None).cast(w.schema["_s"].dataType).alias("_s"), *extra)
    seen = F.last("_s", ignorenulls=True).over(Window.partitionBy(key).orderBy(version, "_side").rowsBetween(Window.unboundedPreceding, 0))
    return w.unionByName(r).withColumn("_s", seen).where("_side = 2 AND _s IS NOT NULL").select(key, version, *extra, F.col("_s.v").alias(value))


def as_of_any_key(writes: DataFrame, reads: DataFrame, key: str, version: str, value: str) -> DataFrame:
    """The literal floor over (key, version): a read without a version of its own key gets the last value of the next smaller key.

    Ranges of the global order are settled apart and one row a range is carried
    on, so the order needs no single task.
    """
    extra = [c for c in reads.columns if c not in (key, version)]
    w = writes.select(key, version, F.lit(1).alias("_side"), F.struct(F.col(value).alias("v")).alias("_s"), *[F.lit(None).cast(reads.schema[c].dataType).alias(c) for c in extra])
    r = reads.select(key, version, F.lit(2).alias("_side"), F.lit(None).cast(w.schema["_s"].dataType).alias("_s"), *extra)
    out = last_before(w.unionByName(r), [key, version, "_side"], "_s", "_found")
    return out.where("_side = 2 AND _found IS NOT NULL").select(key, version, *extra, F.col("_found.v").alias(value))
