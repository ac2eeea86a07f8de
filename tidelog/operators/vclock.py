"""Vector clocks in long form (clock, actor, counter) and as maps; an absent actor counts 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def increments(events: DataFrame, clock: str, actor: str) -> DataFrame:
    """The clock that an object has after its events: clock, actor, counter."""
    return events.groupBy(clock, actor).agg(F.count(F.lit(1)).alias("counter"))


def merge(clocks: DataFrame, group: str, actor: str, counter: str = "counter") -> DataFrame:
    """Pointwise maxima: commutative, associative and idempotent, so partials merge on the map side."""
    return clocks.groupBy(group, actor).agg(F.max(counter).alias(counter))


def merge_maps(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def increment_map(clock: Column, actor: str) -> Column:
    one = F.create_map(F.lit(actor), F.lit(1).cast("long"))
    return F.map_zip_with(clock, one, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def _verdict(more: Column, less: Column) -> list[Column]:
    order = F.when(more & ~less, 1).when(less & ~more, -1).otherwise(0)
    relation = F.when(more & less, "CONCURRENT").when(more, "AFTER").when(less, "BEFORE").otherwise("EQUAL")
    return [order.cast("int").alias("cmp"), relation.alias("relation")]


def compare(pairs: DataFrame, clocks: DataFrame, clock: str, actor: str, counter: str = "counter") -> DataFrame:
    """pairs (a_id, b_id) with cmp (1, -1, and 0 for both equal and concurrent) and relation, which tells those apart.

    Either side's counters are put under the pair and added up by actor: two
    joins on the clock and one aggregate, no outer join of clocks.
    """
    c = clocks.select(F.col(clock).alias("_c"), F.col(actor).alias("_actor"), F.col(counter).alias("_n"))
    a = pairs.join(c, pairs["a_id"] == c["_c"]).select("a_id", "b_id", "_actor", F.col("_n").alias("a"), F.lit(0).cast("long").alias("b"))
    b = pairs.join(c, pairs["b_id"] == c["_c"]).select("a_id", "b_id", "_actor", F.lit(0).cast("long").alias("a"), F.col("_n").alias("b"))
    by_actor = a.unionByName(b).unionByName(pairs.select("a_id", "b_id", F.lit(None).cast(c.schema["_actor"].dataType).alias("_actor"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))).groupBy("a_id", "b_id", "_actor").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    sides = by_actor.groupBy("a_id", "b_id").agg(F.max(F.col("a") > F.col("b")).alias("more"), F.max(F.col("a") < F.col("b")).alias("less"))
    return sides.select("a_id", "b_id", *_verdict(F.col("more"), F.col("less")))


def compare_maps(a: Column, b: Column) -> Column:
    """cmp of two clocks held as maps."""
    both = F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0)))
    return _verdict(F.exists(F.map_values(both), lambda d: d > 0), F.exists(F.map_values(both), lambda d: d < 0))[0]
