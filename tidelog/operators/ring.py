"""Consistent hashing: a ring of virtual nodes, routing by the first ring hash at or after a key's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import virtual_key

HashFn = Callable[[Column], Column]


def md5_prefix(key: Column) -> Column:
    """The first 32 bits of MD5 as an unsigned value."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def build(nodes: DataFrame, hash_fn: HashFn, node: str = "node_key", replicas: str = "replicas", added: str = "added") -> DataFrame:
    """(node_key, replicas, added) to the ring (hash, node_key); where hashes meet, the node added last holds the place."""
    some = nodes.where(F.col(replicas) > 0).select(node, added, F.explode(F.sequence(F.lit(0), (F.col(replicas) - 1).cast("int"))).alias("replica"))
    return some.select(node, hash_fn(virtual_key(F.col(node), F.col("replica"))).alias("hash"), F.struct(added, "replica").alias("_at")).groupBy("hash").agg(F.max_by(node, "_at").alias(node))


def without(ring: DataFrame, node_key: str, node: str = "node_key") -> DataFrame:
    return ring.where(F.col(node) != node_key)


def segments(ring: DataFrame, low: int, high: int, bits: int, node: str = "node_key") -> DataFrame:
    """Half-open stretches (lo, hi] of the hash range with their node, split over cells of 2**bits hashes.

    The last stretch, above the greatest hash, belongs to the least one.
    """
    order = Window.orderBy("hash")
    own = ring.select(F.coalesce(F.lag("hash").over(order), F.lit(low - 1)).alias("lo"), F.col("hash").alias("hi"), node)
    wrap = ring.agg(F.max("hash").alias("lo"), F.min_by(node, "hash").alias(node)).where("lo IS NOT NULL").select("lo", F.lit(high).cast("long").alias("hi"), node)
    cell = lambda c: F.shiftright(c, bits)
    return own.unionByName(wrap).where("lo < hi").withColumn("_cell", F.explode(F.sequence(cell(F.col("lo") + 1), cell(F.col("hi")))))


def route(keys: DataFrame, ring: DataFrame, hashed: Column, low: int = 0, high: int = 2**32 - 1, bits: int | None = None, node: str = "node_key") -> DataFrame:
    """keys with their node. An equi-join on the hash's cell, then the stretch: a few rows a key are compared, not the ring.

    There are about as many cells as places on the ring, 256 at least. Reading a
    key raises on an empty ring; a null hash has a null node.

    The ring is small by nature (nodes x replicas); Spark broadcasts it by its
    measured size, or shuffles it by cell.
    """
    if bits is None:
        bits = max(0, (high - low).bit_length() - max(8, ring.count().bit_length()))
    k = keys.withColumn("_h", hashed).withColumn("_cell", F.shiftright("_h", bits))
    s = segments(ring, low, high, bits, node).withColumnRenamed(node, "_node").withColumnRenamed("_cell", "_at")
    met = k.join(s, (F.col("_cell") == F.col("_at")) & (F.col("_h") > F.col("lo")) & (F.col("_h") <= F.col("hi")), "left")
    lost = F.raise_error(F.lit("the ring has no node for a key")).cast(ring.schema[node].dataType)
    return met.select(*keys.columns, F.when(F.col("_node").isNull() & F.col("_h").isNotNull(), lost).otherwise(F.col("_node")).alias(node))
