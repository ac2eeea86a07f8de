"""Mixing sources to target weights with DataFrame functions only.

Each document gets a hash-random key. Inside a source, documents stand in key
order: the key's leading bits are the range (equal ranges of a uniform key need
no sampling), a window runs inside each range, and the prefix sums of the ranges
before it are added. The source's budget is cut exactly there; what exceeds its
whole size repeats in further epochs.

Defined cases: null texts have 0 words; null sources form one source, last in
order; null or repeated doc_ids are rows like any other; a source without words
has target 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import common

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Leading bits of the 60-bit key that name a range.
RANGE_BITS = 10


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(no_source, source_name, source_size) -> the same with target.

    Shares follow the weights; a target stops at `most` times its source, and
    the excess goes to the others by weight until none is above. That is water
    filling: with sources ordered by most * size / weight, those below the
    level are full and the others get level * weight. One row a source.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    one = sizes.withColumn("nth", F.row_number().over(Window.orderBy("no_source", "source_name"))).withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "nth")
    everything = Window.partitionBy()
    one = one.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    one = one.withColumn("full", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    one = one.withColumn("level", (F.col("total") - F.col("full")) / F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    one = one.withColumn("level", F.max(F.when(F.col("cap") / F.col("w") > F.col("level"), F.col("level"))).over(everything))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("w")))
    return one.select("no_source", "source_name", "source_size", target.alias("target"))


def placing(seed: str) -> list[Column]:
    """size, no_source, source_name, and the 60-bit key that orders a document in its source."""
    size = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long")
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), size.cast("string"))), 1, 15), 16, 10).cast("long")
    return [size.alias("size"), F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_name"), key.alias("key")]


def mix(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """keep, size, source_size, target, taken (words, repeats counted), start (words of the epoch before it), cut (words of the last epoch's budget)."""
    rows = docs.select(*keep, F.col("doc_id").alias("_id"), *placing(seed))
    rows = common.checkpointed(rows.withColumn("range", F.shiftright("key", 60 - RANGE_BITS).cast("int")))
    ranges = rows.groupBy("no_source", "source_name", "range").agg(F.sum("size").alias("n"))
    wanted = targets(ranges.groupBy("no_source", "source_name").agg(F.sum("n").alias("source_size")), weights, share, most)
    before = Window.partitionBy("no_source", "source_name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n").join(wanted, ["no_source", "source_name"])
    inside = Window.partitionBy("no_source", "source_name", "range").orderBy("key", "_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("through", F.sum("size").over(inside)).join(starts, ["no_source", "source_name", "range"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("epochs", epochs).withColumn("cut", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    rows = rows.withColumn("start", F.col("before") + F.col("through") - F.col("size"))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("cut") - F.col("start")))
    return rows.select(*keep, "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).alias("taken"), "start", "cut", "epochs")


def mixed_rows(docs: DataFrame, seed: str = "mix", **shares) -> DataFrame:
    """The rows of docs, each as often as the mix takes it.

    Whole documents only: each full epoch gives one row, and the last epoch goes
    on to the document nearest its budget. Inside a source that is a bound on
    the key, so only one small row a source meets the texts.
    """
    own = docs.select("doc_id", "source", "text")
    plan = mix(own.withColumn("_key", placing(seed)[3]).withColumn("_none", F.col("source").isNull()).withColumn("_name", F.coalesce("source", F.lit(""))), ("_key", "_none", "_name"), seed, **shares)
    taken = F.when((F.col("size") > 0) & (2 * F.col("start") + F.col("size") <= 2 * F.col("cut")), F.col("_key"))
    bounds = common.checkpointed(plan.groupBy("_none", "_name").agg(F.count(F.lit(1)).alias("_n"), F.max("epochs").alias("_epochs"), F.max(taken).alias("_last")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_name"), placing(seed)[3].alias("_key"))
    met = common.lookup(rows, bounds, ["_none", "_name"], "_n", bounds.agg(F.sum("_n")).first()[0] or 0)
    times = F.col("_epochs") + F.coalesce(F.col("_key") <= F.col("_last"), F.lit(False)).cast("long")
    return met.withColumn("_t", times).where("_t > 0").withColumn("_t", F.explode(F.sequence(F.lit(1).cast("long"), "_t"))).select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: Source sizes to targets, as a chain of DuckDB CTEs after one named `sized`.
TARGETS_SQL = r"""
sources AS (SELECT no_source, source_name, sum(size)::BIGINT AS source_size FROM sized GROUP BY ALL),
nths AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY no_source, source_name) - 1) % 3 + 1)::INT] AS w, row_number() OVER (ORDER BY no_source, source_name) AS nth, source_size * 2.0::DOUBLE AS cap FROM sources),
levels AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(w) OVER (ORDER BY cap / w, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM nths),
wanted AS (SELECT no_source, source_name, source_size, CASE WHEN top IS NULL THEN cap ELSE least(cap, top * w) END AS target FROM (SELECT *, max(CASE WHEN cap / w > lv THEN lv END) OVER () AS top FROM levels)),
placed AS (SELECT s.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs,
  sum(size) OVER (PARTITION BY no_source, source_name ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS start FROM sized s JOIN wanted USING (no_source, source_name)),
mixed AS (SELECT *, round(target - epochs * source_size)::BIGINT AS cut FROM placed)
"""
SIZED_SQL = r"""
sized AS (SELECT *, ('0x' || substr(md5(concat_ws('|', 'mix', coalesce(doc_id::VARCHAR, ''), size::VARCHAR)), 1, 15))::BIGINT AS key FROM (
  SELECT *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, source IS NULL AS no_source, coalesce(source, '') AS source_name FROM {docs})),
"""
OP3_SQL = "WITH " + SIZED_SQL.format(docs="documents") + TARGETS_SQL + "SELECT doc_id, size, source_size, target, epochs * size + greatest(0, least(size, cut - start)) AS taken FROM mixed"
