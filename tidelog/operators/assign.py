"""Partition claims: the first claim holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def partitions(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("partition"))


def circular_claims(nodes: DataFrame, n: int, start: Column) -> DataFrame:
    """The claim log of nodes that walk all n partitions circularly from their start, taking turns: node, partition, claim_seq.

    Every node tries every partition, so the log has nodes x partitions rows by
    definition; it is generated, not joined, one row of `nodes` at a time.
    """
    steps = nodes.withColumn("_start", start).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return steps.select("node", F.pmod(F.col("_start") + F.col("_i"), F.lit(n)).cast("int").alias("partition"), F.struct(F.col("_i").alias("i"), F.col("node").alias("n")).alias("claim_seq"))


def winners(claims: DataFrame, partition: str = "partition", node: str = "node", seq: str = "claim_seq") -> DataFrame:
    """partition, node: the first claim of each partition."""
    return claims.groupBy(partition).agg(F.min_by(node, seq).alias(node))


def owned(assignment: DataFrame, partition: str = "partition", node: str = "node") -> DataFrame:
    """node, partitions: sorted lists."""
    return assignment.groupBy(node).agg(F.array_sort(F.collect_list(partition)).alias("partitions"))
