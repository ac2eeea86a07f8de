"""SimHash near-duplicates: a grid join over popcounts of fingerprint segments, verified exactly.

Each distinct fingerprint is embedded as the popcounts of its 2-bit segments.
The Manhattan distance of two embeddings never exceeds the Hamming distance of
the fingerprints. With `parts` = 2, one 32-bit half of a pair at distance 4 or
less differs by 2 at most; both embeddings of that half then lie within 1 of a
common grid cell. Every fingerprint therefore enters its own cell and the cells
one step away, in both halves, and no pair is missed. With `parts` = 1, a
parameter, the whole fingerprint is embedded and the cells within 2 steps are
entered: over 1,000 rows a fingerprint in place of about 50, far fewer
candidates, the same links.

Inside a cell, distances are computed in blocks and only the links of a spanning
forest leave the task, so a group of near copies yields as many links as
members, not pairs. Exact copies are one fingerprint from the start. A cell's
task holds 8 bytes for each distinct fingerprint in it.

Defined cases: null and empty texts have fingerprint zero, linked like any
other; a null doc_id never is the smallest unless all of a component are null;
repeated rows are members like any other; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, runs

WORDS = 4
MOST = 4
SEED = 42
SMALL_RUN = 24
LOW = np.uint64(0x5555555555555555)


def fingerprint(text: bytes | None, n: int = WORDS) -> int:
    """Of whole UTF-8 text: a bit is 1 if set in over half the hashes of the n-word shingles."""
    words = (text or b"").lower().split()  # of bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    k = min(n, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), dtype="<u8", count=len(words) - k + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep and fp, the fingerprint's 64 bits as a long."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t) for t in batch.column("_text").cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], [*keep, "fp"])

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, f"{schema}, fp long")


def steps(keys: np.ndarray, fields: int) -> list[np.ndarray]:
    """For each way of one step in one of the 2-bit fields: (rows, key there)."""
    out = []
    for i in range(fields):
        value = keys >> np.uint64(2 * i) & np.uint64(3)
        for rows, add in ((np.flatnonzero(value < 2), 1), (np.flatnonzero(value > 0), -1)):
            one = np.uint64(1 << 2 * i)
            out.append((rows, keys[rows] + one if add > 0 else keys[rows] - one))
    return out


def cells(fps: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, cells): the grid cells that each fingerprint enters."""
    counts = fps - (fps >> np.uint64(1) & LOW)  # popcounts of the 2-bit segments, in place
    every = np.arange(len(fps))
    rows, keys = [], []
    if parts == 2:
        for part in (0, 1):
            own = counts >> np.uint64(32 * part) & np.uint64(0xFFFFFFFF)
            tag = np.uint64(part << 32)
            for r, k in [(every, own), *steps(own, 16)]:
                rows.append(r)
                keys.append(k | tag)
    else:
        for r, k in [(every, counts), *steps(counts, 32)]:
            rows.append(r)
            keys.append(k)
            for r2, k2 in steps(k, 32):
                rows.append(r[r2])
                keys.append(k2)
    rows, keys = np.concatenate(rows), np.concatenate(keys)
    if parts == 1:  # two steps reach a cell in more than one order
        pairs = np.unique(np.stack((rows.astype(np.uint64), keys), axis=1), axis=0)
        rows, keys = pairs[:, 0].astype(np.int64), pairs[:, 1]
    return rows, keys


def enter(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                fps = batch.column("fp").slice(at, 4096).to_numpy().view(np.uint64)
                rows, keys = cells(fps, parts)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fps[rows].view(np.int64))], ["cell", "fp"])

    return run


def near(most: int):
    """Cells in sorted runs to links (a, b) of fingerprints at most `most` bits apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs.whole_runs(batches, "cell"):
            cell, fp = table.column("cell").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
            first, past = runs.bounds(cell)
            length = past - first
            out = []
            small = np.repeat((length > 1) & (length <= SMALL_RUN), length)
            c, f = cell[small], fp[small]
            for lag in range(1, min(SMALL_RUN, len(c))):
                same = np.flatnonzero(c[lag:] == c[:-lag])
                if not len(same):
                    break
                same = same[np.bitwise_count(f[same] ^ f[same + lag]) <= most]
                out.append(np.stack((f[same], f[same + lag]), axis=1))
            for a, b in zip(first[length > SMALL_RUN], past[length > SMALL_RUN], strict=True):
                g = np.unique(fp[a:b])
                forest = runs.Forest(len(g))
                for at in range(0, len(g), 256):
                    close = np.bitwise_count(g[at : at + 256, None] ^ g[None, : at + 256]) <= most
                    for k in range(len(close)):
                        js = np.flatnonzero(close[k, : at + k])
                        if len(js):
                            forest.add(at + k, js)
                if forest.links:
                    out.append(g[np.array(forest.links)])
            if out:
                links = np.unique(np.sort(np.concatenate(out), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0].copy().view(np.int64)), pa.array(links[:, 1].copy().view(np.int64))], ["a", "b"])

    return run


def links(distinct: DataFrame, most: int = MOST, parts: int = 2) -> DataFrame:
    """(a, b): links that span every component of the distinct fingerprints `fp`."""
    if most > 4:
        raise ValueError("the grid's steps are laid out for 4 bits at most")
    n = common.partitions(distinct.sparkSession)
    entered = distinct.repartition(n, "fp").mapInArrow(enter(parts), "cell long, fp long")
    return entered.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(near(most), "a long, b long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, parts: int = 2) -> DataFrame:
    """id_col, fp, component_id (the smallest id reachable over links): one row a document."""
    rows = common.checkpointed(fingerprints(common.bounded(docs), [id_col], text_col).withColumnRenamed(id_col, "doc"))
    distinct = common.checkpointed(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("copies"), F.min("doc").alias("least")))
    member = common.components(links(distinct.select("fp"), most, parts)).withColumnRenamed("node", "fp")
    known = common.checkpointed(distinct.join(member, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    known = common.lookup(known.drop("least"), least, ["component"], "members", known.count())
    out = common.lookup(rows, known.select("fp", "copies", "component_id"), ["fp"], "copies", rows.count())
    return out.select(F.col("doc").alias(id_col), "fp", "component_id")


def representatives(docs: DataFrame, most: int = MOST) -> DataFrame:
    """The rows of docs, one for each group: the smallest doc_id (nulls last), ties by text; of repeated rows one."""
    key = common.text_key()
    rows = common.checkpointed(fingerprints(common.bounded(docs).select("doc_id", *key, "text"), ["doc_id", "g1", "g2"]).withColumnRenamed("doc_id", "doc"))
    rank = F.struct(F.col("doc").isNull().alias("no"), F.col("doc").alias("doc"), F.col("g1").alias("g1"), F.col("g2").alias("g2"))
    distinct = common.checkpointed(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("copies"), F.min(rank).alias("least")))
    member = common.components(links(distinct.select("fp"), most)).withColumnRenamed("node", "fp")
    known = common.checkpointed(distinct.join(member, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    first = known.groupBy("component").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("members"))
    known = common.lookup(known.drop("least"), first, ["component"], "members", known.count()).select("fp", "copies", "first")
    told = common.checkpointed(common.lookup(rows, known, ["fp"], "copies", rows.count()).withColumn("stays", rank == F.col("first")))
    gone = told.where("NOT stays").select("doc", "g1", "g2").distinct()
    again = told.where("stays").groupBy("doc", "g1", "g2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("d"), *[k.alias(f"k{i}") for i, k in enumerate(key)])
    same = lambda t: (F.col("k0") == t["g1"]) & (F.col("k1") == t["g2"]) & F.col("d").eqNullSafe(t["doc"])
    left = keyed.join(gone.hint("shuffle_hash"), same(gone), "left_anti")
    if not again.isEmpty():  # equal rows of a kept document
        left = left.join(again, same(again), "left_anti").unionByName(left.join(again, same(again), "left_semi").dropDuplicates(["d", "k0", "k1"]))
    return left.select("row.*")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = groups(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
