"""Sharding by longest-processing-time scheduling: whole groups, largest first, to the least loaded shard.

Groups of equal texts stay together. What the heap needs is a histogram of
group sizes, kept to 11 significant bits, so at most some 55,000 classes reach
the driver however many groups there are; equal items of a class are dealt out
in runs, which gives the same loads as one heap step an item. Which group takes
which place of its class is settled in Spark by a bucketed rank.

Defined cases: a null text weighs as an empty one and joins its group; a null
or repeated doc_id is a row like any other; an empty table gives no rows; other
columns are ignored; ties between shards go to the lower number.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

BITS = 11


def lpt_runs(histogram: list[tuple[int, int, int]], shards: int) -> dict[int, list[int]]:
    """(class, items, total size) -> items of the class for each shard.

    Largest class first. A run of n equal items goes as a heap would send them
    one by one: shards below the level that the run reaches are filled up to
    it, and the last few items go through the heap.
    """
    loads = [0.0] * shards
    out: dict[int, list[int]] = {}
    for cls, n, total in sorted(histogram, reverse=True):
        size, taken = total / n, [0] * shards
        low, high = min(loads), max(loads) + total + size
        for _ in range(80 if n > 4 * shards else 0):
            level = (low + high) / 2
            if sum(max(0, int((level - x) / size)) for x in loads) <= n:
                low = level
            else:
                high = level
        if n > 4 * shards:
            taken = [max(0, int((low - x) / size)) for x in loads]
        heap = [(x + t * size, i) for i, (x, t) in enumerate(zip(loads, taken, strict=True))]
        heapq.heapify(heap)
        for _ in range(n - sum(taken)):
            x, i = heapq.heappop(heap)
            taken[i] += 1
            heapq.heappush(heap, (x + size, i))
        for i, t in enumerate(taken):
            loads[i] += t * size
        out[cls] = taken
    return out


def lpt_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1024) -> DataFrame:
    """id_col, size, text_crc32, shard, slot: every row of docs once."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = common.checkpointed(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *common.text_key(text_col)))
    shift = f"greatest(cast(floor(log2(gsize)) as int) - {BITS - 1}, 0)"
    groups = rows.groupBy("g1", "g2").agg(F.sum("size").alias("gsize"), F.count(F.lit(1)).alias("copies")).withColumn("cls", F.expr(f"shiftleft(shiftright(gsize, {shift}), {shift})"))
    groups = common.checkpointed(groups)
    histogram = [tuple(r) for r in groups.groupBy("cls").agg(F.count(F.lit(1)), F.sum("gsize")).collect()]
    total = rows.count()
    ends = [(c, [sum(t[: i + 1]) for i in range(shards)]) for c, t in lpt_runs(histogram, shards).items()]
    dealt = spark.createDataFrame(ends, "cls long, ends array<long>")
    ranked = common.with_index(groups, ["cls"], ["g1", "g2"], F.col("g1"), "place", buckets)
    placed = ranked.join(F.broadcast(dealt), "cls").select("g1", "g2", "copies", F.expr("size(filter(ends, e -> e <= place))").cast("int").alias("shard"))
    sharded = common.lookup(rows, placed, ["g1", "g2"], "copies", total)
    salt = F.xxhash64("doc_id", "g1", "g2")
    return common.with_index(sharded, ["shard"], ["doc_id", "g1", "g2"], salt, "slot", buckets).select(F.col("doc_id").alias(id_col), "size", "text_crc32", "shard", "slot")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lpt_shards(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
