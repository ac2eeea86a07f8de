"""Substring dedup by recompression: words under repeated windows of `window` words are removed.

Every distinct text is recompressed in rounds: the first names runs of a word,
each round then names pairs of neighbours, left and right partners being told by
a bit of their names. A name is a hash of what it stands for, so all tasks give
equal substrings equal names without a dictionary. A symbol of five words or
more is closed and merges no further; for each symbol the stretch of words is
kept that settled its making. A window that repeats elsewhere holds the same
closed symbols wherever it stands, as far as their stretches lie inside it. So:

1. closed symbols are counted over all texts;
2. windows in which every settled symbol is shared are candidates, and their
   128-bit hashes are counted over all texts;
3. words under windows counted twice or more are removed.

Step 1 only saves work; step 2 decides, over all occurrences. Texts travel once,
as distinct texts with their number of copies (a text with a copy repeats in all
its windows); symbols and windows travel packed by hash range, and names that
repeat within a task's chunk are settled there, so a passage that is everywhere
sends one entry a chunk.

Defined cases: null and empty texts have no words and the hash of the empty
string; texts below `window` words lose nothing; overlapping repeats inside one
text count; repeated rows and null doc_ids are rows like any other; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

WINDOW = 35
CLOSED = 5
ROUNDS = 8
CHUNK = 120_000
#: Rows of a batch that are in hand as words at once.
SLICE = 256
FAR = 1 << 40
SHIPPED = "bucket int, g1 long, g2 long, names binary, texts binary, pos binary"
SETTLED = "dest int, texts binary, pos binary"
FLAGGED = "g1 long, g2 long, flags binary"
#: In the place of positions: the text is to come back even with none.
MARK = b"\xff\xff\xff\xff"
U = np.uint64


def mixed(a: np.ndarray, salt: int) -> np.ndarray:
    a = (a ^ a >> U(31)) * U(0x9E3779B97F4A7C15) + U(salt)
    a = (a ^ a >> U(29)) * U(0xBF58476D1CE4E5B9)
    return a ^ a >> U(32)


def closed_symbols(words: np.ndarray, text: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names, first words, and stretches [lo, hi) of the closed symbols whose stretch fits a window. text: each word's text number, ascending."""
    n = len(words)
    name, first, text = words, np.arange(n), text
    if not n:
        return name, first, first, first
    # runs of a word, settled by the words on both sides
    new = np.concatenate(([True], (name[1:] != name[:-1]) | (text[1:] != text[:-1])))
    first = np.flatnonzero(new)
    end = np.concatenate((first[1:], [n]))
    before = (first > 0) & (text[np.maximum(first - 1, 0)] == text[first])
    after = (end < n) & (text[np.minimum(end, n - 1)] == text[first])
    lo, hi = np.where(before, first - 1, -FAR), np.where(after, end + 1, FAR)
    length = end - first
    name = np.where(length > 1, mixed(name[first] ^ mixed(length.astype(U), 77), 5), name[first])
    text, closed = text[first], length >= CLOSED
    for r in range(ROUNDS):
        side = mixed(name, 1000 + r) >> U(17) & U(1)
        left, right = (side == 0) & ~closed, (side == 1) & ~closed
        same = text[1:] == text[:-1]
        pair = np.flatnonzero(left[:-1] & right[1:] & same)
        merged, gone = np.zeros(len(name), bool), np.zeros(len(name), bool)
        merged[pair], gone[pair + 1] = True, True
        # a symbol that finds no partner is settled by what stands on that side
        new_lo, new_hi = lo.copy(), hi.copy()
        i = np.flatnonzero(left & ~merged)
        new_hi[i] = np.maximum(hi[i], np.concatenate((np.where(same, hi[1:], FAR), [FAR]))[i])
        i = np.flatnonzero(right & ~gone)
        new_lo[i] = np.minimum(lo[i], np.concatenate(([-FAR], np.where(same, lo[:-1], -FAR)))[i])
        new_lo[pair], new_hi[pair] = np.minimum(lo[pair], lo[pair + 1]), np.maximum(hi[pair], hi[pair + 1])
        new_name, new_end = name.copy(), end.copy()
        new_name[pair] = mixed(mixed(name[pair], 11 + r) ^ name[pair + 1] * U(3), 21 + r)
        new_end[pair] = end[pair + 1]
        stay = ~gone
        name, first, end, lo, hi, text, closed = new_name[stay], first[stay], new_end[stay], new_lo[stay], new_hi[stay], text[stay], closed[stay]
        closed |= end - first >= CLOSED
    fits = closed & (hi - lo <= window)
    return name[fits], first[fits], lo[fits], hi[fits]


class Chunk:
    """Distinct texts side by side, as word hashes."""

    def __init__(self, keys: list[tuple[int, int]], texts: list[list[bytes]]):
        digest = xxhash.xxh64_intdigest
        self.keys = np.array(keys, dtype=np.int64).reshape(len(keys), 2)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.begin = np.concatenate(([0], np.cumsum(lengths)))
        self.words = np.fromiter((digest(w) for t in texts for w in t), dtype=U, count=int(self.begin[-1]))
        self.text = np.repeat(np.arange(len(texts)), lengths)

    def inside(self, window: int) -> np.ndarray:
        """Whether a window that starts at the word stays in its text."""
        return np.arange(len(self.words)) + window <= self.begin[1:][self.text] if len(self.words) else np.zeros(0, bool)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield batch.slice(at, SLICE)
        del batch
        pa.default_memory_pool().release_unused()


def chunks(batches: Iterator[pa.RecordBatch], extra: str | None = None) -> Iterator[tuple[Chunk, list]]:
    """Rows (g1, g2, text[, extra]) as chunks of about CHUNK words; with extra, rows where it is null are left out."""
    keys, texts, more, held = [], [], [], 0
    for batch in sliced(batches):
        wanted = batch.column(extra).to_pylist() if extra else [None] * len(batch)
        for g1, g2, text, x in zip(batch.column("g1").to_pylist(), batch.column("g2").to_pylist(), batch.column("text").cast(pa.binary()), wanted, strict=True):
            if extra and x is None:
                continue
            words = (text.as_py() or b"").split()
            keys.append((g1, g2))
            texts.append(words)
            more.append(x)
            held += len(words)
            if held >= CHUNK:
                yield Chunk(keys, texts), more
                keys, texts, more, held = [], [], [], 0
    if keys:
        yield Chunk(keys, texts), more


def by_text(chunk: Chunk, at: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Word numbers of a chunk to (g1, g2, positions in the text), a row a text."""
    at = np.sort(at)
    text = chunk.text[at]
    for a, b in zip(*edges(text), strict=True):
        t = text[a]
        yield int(chunk.keys[t, 0]), int(chunk.keys[t, 1]), (at[a:b] - chunk.begin[t]).astype("<i4").tobytes()


def edges(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(values):
        return np.zeros(0, int), np.zeros(0, int)
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate(([0], cut)), np.concatenate((cut, [len(values)]))


def shipment(chunk: Chunk, names: np.ndarray, at: np.ndarray, buckets: int, marked: np.ndarray) -> pa.RecordBatch:
    """Rows for the buckets: a name that stands once with its place, one that repeats in the chunk once without; and what is settled here.

    names: rows of one or two 64-bit parts; at: word numbers; marked: texts that
    must come back even without a shared name.
    """
    order = np.lexsort(names.T)
    names, at = names[order], at[order]
    new = np.concatenate(([True], (names[1:] != names[:-1]).any(axis=1))) if len(names) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    repeated = (np.bincount(group) > 1)[group] if len(names) else new
    rows = [(int(g1 % buckets), g1, g2, None, None, pos) for g1, g2, pos in by_text(chunk, at[repeated])]
    rows += [(int(chunk.keys[t, 0] % buckets), int(chunk.keys[t, 0]), int(chunk.keys[t, 1]), None, None, b"") for t in marked.tolist()]
    names, at, repeated = names[new], at[new], repeated[new]
    bucket = (names[:, 0] >> U(20)) % U(buckets)
    order = np.lexsort((at, bucket))
    names, at, repeated, bucket = names[order], at[order], repeated[order], bucket[order]
    for a, b in zip(*edges(bucket), strict=True):
        text = chunk.text[at[a:b]]
        pos = np.where(repeated[a:b], -1, at[a:b] - chunk.begin[text]).astype("<i4")
        rows.append((int(bucket[a]), None, None, names[a:b].tobytes(), chunk.keys[text].tobytes(), pos.tobytes()))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in SHIPPED.split(", ")])


def settle(parts: int, buckets: int):
    """A bucket's rows to (dest, texts, pos): the places of names that stand twice or more, and what was settled before, packed by where their texts gather."""

    def run(table: pa.Table) -> pa.Table:
        g1 = table.column("g1").to_pylist()
        texts, places = [np.empty((0, 2), dtype=np.int64)], [np.empty(0, dtype="<i4")]
        for i, (a, b, pos) in enumerate(zip(g1, table.column("g2").to_pylist(), table.column("pos"), strict=True)):
            if a is not None:
                at = np.frombuffer(pos.as_py() or MARK, dtype="<i4")
                places.append(at)
                texts.append(np.tile(np.array([[a, b]], dtype=np.int64), (len(at), 1)))
        packed = [i for i, a in enumerate(g1) if a is None]
        if packed:
            column = lambda c, kind, width: np.frombuffer(b"".join(table.column(c)[i].as_py() for i in packed), dtype=kind).reshape(-1, width)
            names, owner, at = column("names", U, parts), column("texts", np.int64, 2), column("pos", "<i4", 1)[:, 0]
            order = np.lexsort(names.T)
            names = names[order]
            new = np.concatenate(([True], (names[1:] != names[:-1]).any(axis=1)))
            group = np.cumsum(new) - 1
            shared = np.bincount(group, weights=np.where(at[order] < 0, 2, 1)) > 1
            own = order[shared[group] & (at[order] >= 0)]
            texts.append(owner[own])
            places.append(at[own])
        texts, places = np.concatenate(texts), np.concatenate(places)
        dest = texts[:, 0] % buckets
        order = np.lexsort((places, texts[:, 1], texts[:, 0], dest))
        texts, places, dest = texts[order], places[order], dest[order]
        out = [(int(dest[a]), texts[a:b].tobytes(), places[a:b].tobytes()) for a, b in zip(*edges(dest), strict=True)]
        columns = list(zip(*out, strict=True)) if out else [[]] * 3
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["dest", "texts", "pos"])

    return run


def gather(table: pa.Table) -> pa.Table:
    """(dest, texts, pos) to a row a text."""
    column = lambda c, kind, width: np.frombuffer(b"".join(x.as_py() for x in table.column(c)), dtype=kind).reshape(-1, width)
    texts, places = column("texts", np.int64, 2), column("pos", "<i4", 1)[:, 0]
    order = np.lexsort((places, texts[:, 1], texts[:, 0]))
    texts, places = texts[order], places[order]
    cut = np.flatnonzero((texts[1:] != texts[:-1]).any(axis=1)) + 1
    first, past = [0, *cut.tolist()], [*cut.tolist(), len(texts)]
    flags = [(p := places[a:b])[p >= 0].tobytes() for a, b in zip(first, past, strict=True)]
    return pa.table([pa.array(texts[first, 0]), pa.array(texts[first, 1]), pa.array(flags, pa.binary())], names=["g1", "g2", "flags"])


def uncovered(chunk: Chunk, lo: np.ndarray, hi: np.ndarray, window: int) -> np.ndarray:
    """Whether a window that starts at the word holds none of the stretches."""
    n = len(chunk.words)
    steps = np.zeros(n + 1, dtype=np.int64)
    begin = np.maximum(hi - window, 0)
    np.add.at(steps, begin, 1)
    np.add.at(steps, lo + 1, -1)
    return chunk.inside(window) & (np.cumsum(steps)[:n] == 0)


def ship_symbols(window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _ in chunks(batches):
            name, first, lo, hi = closed_symbols(chunk.words, chunk.text, window)
            # windows without a settled symbol are candidates in any case
            marked = np.unique(chunk.text[uncovered(chunk, lo, hi, window)])
            yield shipment(chunk, name[:, None], first, buckets, marked)

    return run


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    out[:1] = 1
    return np.cumprod(out, dtype=U)


BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def window_names(words: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """128-bit hashes of the windows that start at the words `at`: two polynomials modulo 2**64 over differently mixed words."""
    out = np.empty((len(at), 2), dtype=U)
    for k, base in enumerate(BASES):
        up, down = powers(base, len(words)), powers(pow(base, -1, 1 << 64), len(words))
        sums = np.concatenate((np.zeros(1, dtype=U), np.cumsum(mixed(words, 31 + k) * up, dtype=U)))
        out[:, k] = mixed((sums[at + window] - sums[at]) * down[at], 41 + k)
    return out


def ship_windows(window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, flags in chunks(batches, "flags"):
            _, first, lo, hi = closed_symbols(chunk.words, chunk.text, window)
            shared = np.zeros(len(chunk.words), bool)
            for begin, pos in zip(chunk.begin[:-1], flags, strict=True):
                shared[begin + np.frombuffer(pos, dtype="<i4")] = True
            alone = ~shared[first]
            at = np.flatnonzero(uncovered(chunk, lo[alone], hi[alone], window))
            yield shipment(chunk, window_names(chunk.words, at, window), at, buckets, np.zeros(0, int))

    return run


def cut(window: int, with_text: bool):
    """(g1, g2, text, copies, flags) to what is left of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sizes, removed, digests, left = [], [], [], []
            for text, copies, flags in zip(batch.column("text").cast(pa.binary()), batch.column("copies").to_pylist(), batch.column("flags").to_pylist(), strict=True):
                words = kept = (text.as_py() or b"").split()
                if copies > 1 and len(words) >= window:
                    kept = []
                elif flags:
                    steps = np.zeros(len(words) + window + 1, dtype=np.int64)
                    at = np.frombuffer(flags, dtype="<i4")
                    np.add.at(steps, at, 1)
                    np.add.at(steps, at + window, -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(steps)[: len(words)] == 0).tolist()]
                rest = b" ".join(kept)
                sizes.append(len(words))
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(rest).hexdigest())
                left.append(rest.decode() if with_text and len(kept) < len(words) else None)
            yield pa.RecordBatch.from_arrays([batch.column("g1"), batch.column("g2"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(left, pa.string())], ["g1", "g2", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def flagged(shipped: DataFrame, parts: int, buckets: int) -> DataFrame:
    """g1, g2, flags: the shared places of each text, packed."""
    settled = shipped.groupBy("bucket").applyInArrow(settle(parts, buckets), SETTLED)
    return settled.groupBy("dest").applyInArrow(gather, FLAGGED)


def repeated_windows(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(g1, g2, text, copies) of distinct texts to the same with flags: first words of repeated windows, packed.

    All three uses of `texts` read the same columns, so Spark shuffles the texts once.
    """
    buckets = common.partitions(texts.sparkSession)
    symbols = flagged(texts.mapInArrow(ship_symbols(window, buckets), SHIPPED), 1, buckets)
    near = texts.join(symbols, ["g1", "g2"])
    windows = flagged(near.mapInArrow(ship_windows(window, buckets), SHIPPED), 2, buckets)
    return texts.join(windows, ["g1", "g2"], "left")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """id_col, n_words, n_removed, kept_sha256 and, with_text, kept (the text left, null where it is whole): one row a document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc"), *common.text_key(text_col))
    texts = docs.select(*common.text_key(text_col), text.alias("text")).groupBy("g1", "g2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    done = repeated_windows(texts, window).select("g1", "g2", "text", "copies", "flags")
    schema = "g1 long, g2 long, n_words long, n_removed long, kept_sha256 string, kept string"
    left = done.mapInArrow(cut(window, with_text), schema)
    left = common.checkpointed(left if with_text else left.drop("kept"))
    copies = rows.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("copies"))
    rows = common.checkpointed(rows)
    out = common.lookup(rows, left.join(copies, ["g1", "g2"]), ["g1", "g2"], "copies", rows.count())
    return out.select(F.col("doc").alias(id_col), *[c for c in left.columns if c not in ("g1", "g2")])


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(common.table(spark, sf_dir, "documents"), with_text=False)


OP2_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
v AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
f AS (SELECT r, i FROM v WHERE h IN (SELECT h FROM v GROUP BY h HAVING count(*) > 1)),
c AS (SELECT p.r, p.i, word, max(f.i IS NOT NULL) OVER (PARTITION BY p.r ORDER BY p.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM p LEFT JOIN f ON p.r = f.r AND p.i = f.i),
k AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
