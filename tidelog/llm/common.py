"""What several corpus operators share: checkpoints, words, bucketed ranks, lookups that stand skew, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import checkpointed, shared_dir  # noqa: F401  also for the operators

#: A word, as every operator here reads one: a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Python's bytes.split() without arguments cuts at the same six characters.


#: Of rows that hold whole texts, what is in hand at once; Spark's own limits count rows only, 10,000 and 4,096.
BOUNDS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 20), "spark.sql.parquet.columnarReaderBatchSize": "512"}


def bounded(docs: DataFrame) -> DataFrame:
    """docs; where its session doesn't set them, batches on the way to Python end at 1 MB and Parquet is read 512 rows at a time."""
    conf = docs.sparkSession.conf
    for key, value in BOUNDS.items():
        if conf.get(key, None) is None:
            conf.set(key, value)
    return docs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a Parquet table in the shared folder; for wide rows, which it holds compressed."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(text: str = "text") -> list[Column]:
    """128 bits that stand for a text, as two longs; a null text counts as the empty one."""
    t = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(t).alias("g1"), F.xxhash64(F.lit("second"), t).alias("g2")]


def with_index(df: DataFrame, group: list[str], order: list[str], salt: Column, out: str, buckets: int = 1024) -> DataFrame:
    """Adds a gapless index from 0 inside each group without sorting a group in one task.

    Rows of a group go to `buckets` buckets by `salt`; each bucket is numbered
    on its own and starts after the rows of the buckets before it. One group
    holding all rows thus becomes `buckets` windows, and the table of starts
    has at most `buckets` rows a group.
    """
    b = df.withColumn("_b", F.pmod(salt, F.lit(buckets)).cast("int"))
    n = b.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    start = n.select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_b").orderBy(*order)
    numbered = b.withColumn("_i", F.row_number().over(inside))
    return numbered.join(start, [*group, "_b"]).withColumn(out, (F.col("_start") + F.col("_i") - 1).cast("long")).drop("_b", "_i", "_start")


def lookup(left: DataFrame, right: DataFrame, keys: list[str], rows: str, total: int, share: int = 1024) -> DataFrame:
    """Inner join of many rows to one row a key, where a key may hold a third of the rows.

    right[rows] is the number of left rows of the key. Keys with more than
    1/share of all rows number fewer than `share`, whatever the input's size,
    and are broadcast; the others are shuffled, and no task gets a hot key.
    """
    hot = right.where(F.col(rows) * share > total)
    cold = right.where(F.col(rows) * share <= total)
    warm = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return left.join(F.broadcast(hot), keys).unionByName(warm.join(cold, keys))


def smallest(df: DataFrame, group: str, h: str, n: int) -> DataFrame:
    """The rows with the n smallest values of a 64-bit hash in each group, ties by nothing else (equal hashes rank in any order).

    The hash's leading 12 bits are counted first, so only the rows of the
    leading cells, some n a group, are ranked; no task sees a whole hot group.
    """
    cell = F.shiftright(h, 52).cast("int")
    counts = df.groupBy(group, cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    last = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_before") < n).groupBy(group).agg(F.max("_cell").alias("_last"))
    near = df.join(F.broadcast(last), group).where(cell <= F.col("_last")).drop("_last")
    return near.withColumn("_nth", F.row_number().over(Window.partitionBy(group).orderBy(h))).where(F.col("_nth") <= n).drop("_nth")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) long pairs -> (node, component): the smallest node each node reaches.

    Alternates the large-star and small-star steps (Kiveris et al. 2014), each
    round cut by a checkpoint. Nothing but two sums per round comes to the
    driver. Nodes without an edge are absent; an empty input gives no rows.
    """
    hi, lo = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = checkpointed(edges.where("a <> b").select(hi, lo).distinct())
    seen = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small, "u")
        now = checkpointed(linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        sums = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(sums) == seen:
            break
        seen = tuple(sums)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
