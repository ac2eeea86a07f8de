"""Order-dependent building blocks that don't send a whole table or a hot key's history to one task's memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType

from ..session import checkpointed


def prefix_sum(df: DataFrame, group: list[str], order: str, value: Column, out: str, width: int = 1 << 16) -> DataFrame:
    """Adds the running sum of value inside group by the integer column `order` (rows of one order value in any order).

    A group is cut into slices of `width` order values; a window runs inside
    each slice and the sums of the slices before are added, so a group that
    holds the whole log is still many windows. Without a group, the slices are
    ranges of the rows, a row a partition meets in one task, however far apart
    the order values lie.
    """
    if not group:
        r = ranged(df.withColumn("_v", value), [order])
        sums = r.groupBy("_pid").agg(F.sum("_v").alias("_s"))
        starts = sums.select("_pid", F.coalesce(F.sum("_s").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        inside = Window.partitionBy("_pid").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return r.withColumn("_in", F.sum("_v").over(inside)).join(F.broadcast(starts), "_pid").withColumn(out, F.col("_before") + F.coalesce("_in", F.lit(0))).drop("_pid", "_v", "_in", "_before")
    sliced = df.withColumn("_slice", F.floor(F.col(order) / width)).withColumn("_v", value)
    sums = sliced.groupBy(*group, "_slice").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, "_slice", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = sliced.withColumn("_in", F.sum("_v").over(inside)).join(starts, [*group, "_slice"])
    return summed.withColumn(out, F.col("_before") + F.col("_in")).drop("_slice", "_v", "_in", "_before")


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """Range-partitioned and sorted, with the partition's number as _pid; cut by a checkpoint, so that the ranges hold for later uses."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id()))


def global_index(df: DataFrame, order: list[str], out: str, first: int = 0) -> DataFrame:
    """Adds a dense index in global order; one row a partition meets in one task, not the table."""
    r = ranged(df, order)
    starts = r.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = r.withColumn("_i", F.row_number().over(Window.partitionBy("_pid").orderBy(*order)))
    return numbered.join(F.broadcast(starts), "_pid").withColumn(out, F.col("_start") + F.col("_i") - 1 + first).drop("_pid", "_i", "_start")


def last_before(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Adds the last non-null `value` at or before each row in global order, null if there is none."""
    r = ranged(df, order)
    inside = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = r.groupBy("_pid").agg(F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_end"))
    carried = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
    return r.withColumn("_in", F.last(value, ignorenulls=True).over(inside)).join(F.broadcast(carried), "_pid").withColumn(out, F.coalesce("_in", "_carry")).drop("_pid", "_in", "_carry")


Step = Callable[[Any, tuple], tuple[Any, Any]]


def fold(df: DataFrame, key: list[str], order: list[str], args: list[str], start: Callable[[], Any], step: Step, out: str, kind: str | DataType) -> DataFrame:
    """Adds out = the answer of step(state, args) -> (state, answer), run over each key's rows in order from start().

    Rows are shuffled by key and sorted inside partitions, and stream through
    the task: only one key's state is in memory, never its history.
    """
    schema = StructType(list(df.schema.fields)).add(out, kind if isinstance(kind, DataType) else DataType.fromDDL(kind))
    names = [*df.columns, out]
    sorted_ = df.repartition(*key).sortWithinPartitions(*key, *order)
    arrow = to_arrow_type(schema[out].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            got = []
            for k, a in zip(zip(*(batch.column(c).to_pylist() for c in key), strict=True), zip(*(batch.column(c).to_pylist() for c in args), strict=True), strict=True):
                if k != now:
                    now, state = k, start()
                state, answer = step(state, a)
                got.append(answer)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, arrow)], names)

    return sorted_.mapInArrow(run, schema)
