"""Benchmark decontamination: size-partitioned MinHash containment search, with DataFrame functions only.

Test items are partitioned by their number of distinct shingles, from a power of
two to the next. An item's sketch is its bottom-m MinHash: its m smallest shingle
hashes, m fixed by the size partition as twice the shingles that its largest item
may miss, and one more. A document that holds a share t of an item of q shingles
misses q - ceil(t * q) of them at most, and so has all but as many hashes of the
sketch: that many hits make a candidate. Documents of any length are searched
whole through the sketches alone, in one pass for shingles of all widths; the
candidates' documents are read once more and verified by exact containment over
all of the item's shingles. Nothing is approximate.

Words are lower-cased (A-Z); a shingle is five words. An item of fewer words is
one shingle of all its words.

Defined cases: null and empty texts match nothing; repeated items match each on
their own; repeated rows of documents give one pair; a null doc_id pairs like
any other; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

WORDS = 5
SHARE = 0.8
#: Sketches, the index of items and the candidate pairs are each broadcast up to so many rows; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000


def words(text: str) -> str:
    """SQL: the words of a text, lower-cased; none of a null text."""
    return f"filter(split(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x <> '')"


def shingles(w: str, n: int) -> str:
    """SQL: distinct hashes of the runs of n words in array w."""
    cells = ", ' ', ".join(f"{w}[i + {k}]" if k else f"{w}[i]" for k in range(n))
    return f"if(size({w}) < {n}, cast(array() as array<bigint>), array_distinct(transform(sequence(0, size({w}) - {n}), i -> xxhash64({cells}))))"


def item_index(items: DataFrame, item_col: str, text_col: str, n: int = WORDS, share: float = SHARE) -> DataFrame:
    """item, width, q (distinct shingles), need (shingles that make `share`), h, sketch (whether h is in the item's sketch), least (hits in the sketch that make a candidate)."""
    short = "CASE " + " ".join(f"WHEN size(w) = {k} THEN {shingles('w', k)}" for k in range(1, n)) + f" ELSE {shingles('w', n)} END"
    one = items.select(F.col(item_col).alias("item"), F.expr(words(text_col)).alias("w")).withColumn("item_row", F.monotonically_increasing_id())
    one = one.where("size(w) > 0").select("item", F.expr(f"least(size(w), {n})").alias("width"), F.expr(f"array_sort({short})").alias("hs"))
    one = one.dropDuplicates(["item", "hs"]).withColumn("q", F.size("hs")).withColumn("need", F.ceil(F.col("q") * F.lit(share) - F.lit(1e-9)).cast("int"))
    largest = F.expr("cast(2 * pow(2, floor(log2(q))) - 1 as int)")  # of the item's size partition
    m = F.least(F.col("q"), 2 * (largest - F.ceil(largest * F.lit(share) - F.lit(1e-9)).cast("int")) + 1)
    one = one.withColumn("m", m).withColumn("least", F.col("m") - (F.col("q") - F.col("need")))
    return one.withColumn("key", F.xxhash64("item", "hs")).select("item", "key", "width", "q", "need", "least", F.posexplode("hs").alias("nth", "h"), "m").withColumn("sketch", F.expr("nth < m")).drop("nth", "m")


def shared(texts: DataFrame, index: DataFrame, widths: list[int], n: int) -> DataFrame:
    """(doc, h, key and what else index has): the shingles of texts (doc, text) that stand in index."""
    small = index.count() <= BROADCAST_ROWS
    text = texts.select("doc", F.expr(words("text")).alias("w"))
    every = ", ".join(f"transform({shingles('w', k)}, h -> struct(h, {k} as width))" for k in widths or [n])
    grams = text.select("doc", F.explode(F.expr(f"flatten(array({every}))")).alias("g")).select("doc", "g.h", "g.width")
    return grams.join(F.broadcast(index) if small else index, ["h", "width"]).drop("width")


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = WORDS, share: float = SHARE) -> DataFrame:
    """id_col, item_col, hits, item_shingles, containment: the pairs in which a document holds at least `share` of an item."""
    index = common.checkpointed(item_index(items, item_col, item_text, n, share))
    widths = sorted(r[0] for r in index.select("width").distinct().collect())  # at most n values
    texts = common.bounded(docs).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    candidates = common.checkpointed(shared(texts, index.where("sketch").select("width", "h", "key", "least"), widths, n).groupBy("doc", "key").agg(F.countDistinct("h").alias("hits"), F.first("least").alias("least")).where("hits >= least").select("doc", "key"))
    few = candidates.count() <= BROADCAST_ROWS
    dealt = lambda right: F.broadcast(right) if few else right.hint("shuffle_hash")
    # only texts with a candidate are read as words again, before anything is made of them
    own = texts.alias("t").join(dealt(candidates.select("doc").distinct()).alias("c"), F.expr("t.doc <=> c.doc"), "left_semi")
    hits = shared(own, index.drop("sketch", "least"), widths, n).alias("t").join(dealt(candidates).alias("c"), F.expr("t.doc <=> c.doc AND t.key = c.key"), "left_semi")
    pairs = hits.groupBy("doc", "item", "key").agg(F.countDistinct("h").alias("hits"), F.first("q").alias("q"), F.first("need").alias("need"))
    best = pairs.where("hits >= need").groupBy("doc", "item").agg(F.max(F.struct((F.col("hits") / F.col("q")).alias("c"), "hits", "q")).alias("b"))
    return best.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), F.col("b.hits").cast("long").alias("hits"), F.col("b.q").cast("long").alias("item_shingles"), F.col("b.c").alias("containment"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no test item; a text is judged once for all its rows."""
    key = [k.alias(f"k{i}") for i, k in enumerate(common.text_key())]
    texts = docs.select(F.struct(*key).alias("doc"), "text")
    leaks = contained(texts, items, id_col="doc").select("doc.k0", "doc.k1").distinct()
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key)
    return keyed.join(leaks.hint("shuffle_hash"), ["k0", "k1"], "left_anti").select("row.*")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


_W = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
#: DuckDB CTEs that end in `leaks` (doc_id, item_id, hits, item_shingles, containment).
LEAKS_SQL = f"""
iw AS (SELECT item_id, {_W} AS w FROM benchmark),
ig AS (SELECT DISTINCT item_id, k, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM (SELECT item_id, w, least(len(w), 5) AS k FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, {_W} AS w FROM {{docs}}),
dg AS (SELECT DISTINCT doc_id, k, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM dw, (SELECT DISTINCT k FROM ig) WHERE len(w) >= k),
qs AS (SELECT item_id, count(*) AS q FROM ig GROUP BY item_id),
leaks AS (SELECT doc_id, item_id, count(*) AS hits, q AS item_shingles, count(*) / q AS containment FROM dg JOIN ig USING (k, g) JOIN qs USING (item_id) GROUP BY doc_id, item_id, q HAVING count(*) >= ceil(q * 0.8 - 1e-9))
"""
OP8_SQL = "WITH " + LEAKS_SQL.format(docs="documents") + "SELECT * FROM leaks"
