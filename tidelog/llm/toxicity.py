"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Every word of an example is a term; no word is left out of a vector. A term's
frequency is its share of the words on a log scale. Its inverse document
frequency is scaled by how far the term tells the labels apart: the root of its
log-likelihood ratio per example, as far as that exceeds `least_g2` (10.83, one
in a thousand by chance for a single term), above a floor that all terms have.
With the plain inverse document frequency the invented words of a topic outweigh
the few toxic ones (README has the figures).

The index keeps postings of all terms that are rare or tell the labels apart, and
for common terms blocks of examples with each block's largest weight. A query
adds up its postings, which bounds each block together with its largest weights
of the common terms; the common terms are added in all blocks whose bound reaches
the k-th neighbour so far, so the neighbours are exact. Their votes weigh by closeness, by how much of the text lies in terms that
tell the labels apart, and by how much each label was thinned in the sample; a logistic curve fitted to the examples' own votes, each without
itself, makes scores of them. Examples of cosine 0 don't vote.

The one bound is a parameter: at most `per_label` examples of each label, whole
texts, the first by a hash of their id. Scoring is one pass without a shuffle
over every whole text.

Defined cases: null, empty and wholly unknown texts get the toxic share of the
labels as their score; ties between neighbours go to the lower example number,
which depends on the sample alone; a null doc_id counts as the empty string in
the fold and never meets a label; repeated rows are scored alike; repeated
labels of a doc_id count as toxic if any is; null labels are not learned from;
without any example every score is 0; other columns are ignored.
"""

from __future__ import annotations

import ctypes
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common
from .language_id import fold

TOKEN = re.compile(r"[^\W_]+")
PER_LABEL = 3000
LEAST_G2 = 10.83
FLOOR = 0.01
NEIGHBOURS = 7
BLOCK = 64
RATE = 200
#: A term that more than one in so many examples holds is common, unless it tells the labels apart.
COMMON = 16
#: Texts that are scored at once.
BATCH = 64
#: Words and texts whose answers are remembered in a task; both are only saved work.
KNOWN_WORDS, KNOWN_TEXTS = 200_000, 20_000


def frequency(n: np.ndarray, words: np.ndarray | int) -> np.ndarray:
    return np.log1p(RATE * n / np.maximum(1, words))


def words_of(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def name(word: str) -> int:
    """64 bits that stand for a word."""
    return xxhash.xxh64_intdigest(word)


def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, toxic, text) to (doc_id, toxic, words, names, counts), names and counts packed."""
    for batch in batches:
        words, names, counts = [], [], []
        for text in batch.column("text").to_pylist():
            all_words = words_of(text)
            bag = Counter(all_words)
            words.append(len(all_words))
            names.append(np.array([name(w) for w in bag], dtype=np.uint64).tobytes())
            counts.append(np.array(list(bag.values()), dtype=np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(words, pa.int64()), pa.array(names, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "toxic", "words", "names", "counts"])


def ratio(a: np.ndarray, b: np.ndarray, n: tuple[int, int]) -> np.ndarray:
    """Log-likelihood ratio of terms in a of n[1] toxic and b of n[0] other examples."""
    total, out = sum(n), np.zeros(len(a))
    for seen, side in ((a, n[1]), (b, n[0])):
        for x, expected in ((seen, (a + b) * side / total), (side - seen, (total - a - b) * side / total)):
            some = x > 0
            out[some] += x[some] * np.log(x[some] / expected[some])
    return 2 * out


def stretches(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for each stretch in turn."""
    past = np.cumsum(length)
    return np.arange(past[-1] if len(past) else 0) + np.repeat(begin - past + length, length)


def keep_pages() -> None:
    """Lets glibc keep freed arrays of some 100 KB to 4 MB; else their pages are mapped anew each time, which costs more than the sums."""
    if hasattr(libc := ctypes.CDLL(None), "mallopt"):
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 32 << 20)  # M_TRIM_THRESHOLD


def logistic(x: np.ndarray, toxic: np.ndarray, mass: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of least loss, with a small pull towards the plain curve."""
    mass, x, w = mass / mass.sum(), np.stack((x, np.ones(len(x))), axis=1), np.array([1.0, 0.0])
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (mass * (p - toxic)) + 1e-3 * (w - (1.0, 0.0))
        bend = (x * (mass * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(bend, slope), -1, 1)
    return max(0.1, float(w[0])), float(w[1])


class Index:
    """Examples in blocks. Postings of the terms that are rare or tell the labels apart; common terms as dense blocks with each block's largest weight."""

    def __init__(self, examples: list[tuple[int, int, int, bytes, bytes]], weight: tuple[float, float], least_g2: float = LEAST_G2):
        """examples: (doc_id, toxic, words, names, counts), in an order that depends on them alone."""
        n = len(examples)
        toxic = np.array([e[1] for e in examples], dtype=np.int64)
        sizes = np.array([len(e[3]) // 8 for e in examples], dtype=np.int64)
        owner = np.repeat(np.arange(n), sizes)
        self.names, term = np.unique(np.frombuffer(b"".join(e[3] for e in examples), dtype=np.uint64), return_inverse=True)
        counts = np.frombuffer(b"".join(e[4] for e in examples), dtype=np.uint32)
        yes, df = np.bincount(term, toxic[owner], len(self.names)), np.bincount(term, minlength=len(self.names))
        labels = int((toxic == 0).sum()), int((toxic == 1).sum())
        g2 = ratio(yes, df - yes, labels) if n else np.zeros(0)
        self.tells = g2 >= least_g2
        self.idf = (1 + np.log((n + 1) / (df + 1))) * (FLOOR + np.sqrt(np.maximum(0, g2 - least_g2) / max(1, n)))
        x = frequency(counts, np.array([e[2] for e in examples], dtype=np.int64)[owner]) * self.idf[term]
        x /= np.sqrt(np.bincount(owner, x * x, n))[owner]
        # like vectors in like blocks, which keeps bounds low: by the term of most weight, then by that weight
        heaviest = np.lexsort((x, owner))[np.cumsum(sizes)[sizes > 0] - 1]
        lead, most = np.full(n, -1), np.zeros(n)
        lead[owner[heaviest]], most[owner[heaviest]] = term[heaviest], x[heaviest]
        order = np.lexsort((np.arange(n), -most, lead))
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        self.docs = np.array([e[0] for e in examples], dtype=np.int64)[order]
        self.toxic = toxic[order]
        self.votes = np.sqrt(np.array(weight))[self.toxic] if n else np.zeros(0)
        self.share = float(np.dot(labels, (0.0, weight[1])) / max(1e-12, np.dot(labels, weight)))
        self.blocks = -(-n // BLOCK)
        entry = place[owner]
        common_term = (df > n / COMMON) & ~self.tells
        self.column = np.where(common_term, np.cumsum(common_term) - 1, -1)
        dense = np.zeros((int(common_term.sum()), self.blocks * BLOCK))
        own = common_term[term]
        dense[self.column[term[own]], entry[own]] = x[own]
        self.dense = np.ascontiguousarray(dense.reshape(len(dense), self.blocks, BLOCK).transpose(1, 0, 2))
        self.bounds = self.dense.max(axis=2, initial=0.0).T  # common terms by blocks
        by = np.flatnonzero(~own)[np.lexsort((entry[~own], term[~own]))]
        self.entry, self.value = entry[by], x[by]
        self.begin = np.searchsorted(term[by], np.arange(len(self.names) + 1))
        self.seen: dict[bytes, tuple] = {}
        self.words: dict[str, int] = {}
        self.curve = (1.0, 0.0)
        if all(labels):
            by = np.argsort(entry, kind="stable")
            self.calibrate(np.split(term[by], np.cumsum(sizes[order])[:-1]), np.split(x[by], np.cumsum(sizes[order])[:-1]), weight)

    def calibrate(self, ids: list[np.ndarray], x: list[np.ndarray], weight: tuple[float, float], k: int = NEIGHBOURS) -> None:
        """Fits the curve: each example's neighbours vote without itself."""
        raw = np.zeros(len(self.docs))
        for first in range(0, len(self.docs), BATCH):
            for e, (at, cosine) in enumerate(self.nearest(ids[first : first + BATCH], x[first : first + BATCH], k + 1), first):
                other = at != e
                raw[e] = self.lean(ids[e], x[e], at[other][:k], cosine[other][:k])
        self.curve = logistic(raw, self.toxic, np.array(weight)[self.toxic])

    def lean(self, ids: np.ndarray, x: np.ndarray, at: np.ndarray, cosine: np.ndarray) -> float:
        """Log odds of the toxic votes; a tenth of a far vote stands on either side.

        A vote weighs by closeness, and by the share of the query's length that
        lies in terms that tell the labels apart, or by the 8th power of the cosine if
        that is more: nearly the same text counts whatever its words.
        """
        telling = float(np.sqrt((x * x) @ self.tells[ids]))
        near = self.votes[at] / (1.1 - np.minimum(cosine, 1.0)) ** 3 * np.maximum(telling, np.clip(cosine, 0, 1) ** 8) * (cosine > 0)
        return float(np.log((near @ self.toxic[at] + 0.1) / (near @ (1 - self.toxic[at]) + 0.1)))

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Terms of the text that an example holds, their weights, and those of them that tell the labels apart."""
        words = words_of(text)
        bag = Counter(words)
        if len(self.words) > KNOWN_WORDS:
            self.words.clear()
        ids = list(map(self.words.get, bag))
        if None in ids:
            new = [w for w in bag if w not in self.words]
            names = np.array([name(w) for w in new], dtype=np.uint64)
            at = np.minimum(np.searchsorted(self.names, names), max(0, len(self.names) - 1))
            there = self.names[at] == names if len(self.names) else np.zeros(len(new), bool)
            self.words.update(zip(new, np.where(there, at, -1).tolist(), strict=True))
            ids = list(map(self.words.get, bag))
        ids, n = np.array(ids, dtype=np.int64), np.fromiter(bag.values(), dtype=np.float64, count=len(bag))
        known = ids >= 0
        distinct, at = list(bag), np.flatnonzero(known)
        ids, n = ids[known], n[known]
        terms = [distinct[i] for i in at[self.tells[ids]].tolist()]
        x = frequency(n, len(words)) * self.idf[ids]
        return ids, x / np.sqrt((x * x).sum()) if len(x) else x, terms

    def nearest(self, ids: list[np.ndarray], x: list[np.ndarray], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the k examples of highest cosine, ties by number, and their cosines."""
        scores, often = np.zeros((len(ids), self.blocks * BLOCK)), np.zeros((len(ids), len(self.bounds)))
        for i, (own, w) in enumerate(zip(ids, x, strict=True)):
            column = self.column[own]
            dense = column >= 0
            often[i, column[dense]] = w[dense]
            length = self.begin[own + 1] - self.begin[own]  # none of common terms
            at = stretches(self.begin[own], length)
            scores[i] = np.bincount(np.take(self.entry, at), np.repeat(w, length) * np.take(self.value, at), scores.shape[1])
        # what stands so far is a least value; a block whose bound lies below the k-th of them holds no neighbour
        least = np.partition(scores[:, : len(self.docs)], -k, axis=1)[:, -k] if len(self.docs) >= k else np.zeros(len(ids))
        open_ = scores.reshape(len(ids), self.blocks, BLOCK).max(axis=2) + often @ self.bounds >= least[:, None] - 1e-9
        for b in range(self.blocks):
            some = np.flatnonzero(open_[:, b])
            if len(some):
                scores[some, b * BLOCK : (b + 1) * BLOCK] += often[some] @ self.dense[b]
        out = []
        for own in scores[:, : len(self.docs)]:
            found = np.flatnonzero(own >= np.partition(own, -k)[-k]) if len(own) > k else np.arange(len(own))
            top = found[np.lexsort((found, -own[found]))[:k]]
            out.append((top, own[top]))
        return out

    def score(self, texts: list[str | None], k: int = NEIGHBOURS) -> list[tuple[float, list[int], list[str]]]:
        """For each text the calibrated score, the ids of the nearest examples, and its terms that tell the labels apart."""
        if not len(self.docs):
            return [(0.0, [], [])] * len(texts)
        keys = [xxhash.xxh128_digest(t or "") for t in texts]
        if len(self.seen) > KNOWN_TEXTS:
            self.seen.clear()
        new = {key: t for key, t in zip(keys, texts, strict=True) if key not in self.seen}
        got = {key: self.vector(t) for key, t in new.items()}
        self.seen.update({key: (self.share, [], []) for key, v in got.items() if not len(v[0])})
        got = {key: v for key, v in got.items() if len(v[0])}
        a, b = self.curve
        for (key, v), (at, cosine) in zip(got.items(), self.nearest([v[0] for v in got.values()], [v[1] for v in got.values()], k) if got else (), strict=True):
            self.seen[key] = float(1 / (1 + np.exp(-np.clip(a * self.lean(v[0], v[1], at, cosine) + b, -30, 30)))), self.docs[at[cosine > 0]].tolist(), v[2]
        return [self.seen[key] for key in keys]


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, least_g2: float = LEAST_G2) -> Index:
    """Learns from up to per_label documents of each label, the first by a hash of their id."""
    one = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") != 0, 1).otherwise(0)).alias("toxic"))
    one = one.withColumn("h", F.xxhash64("doc_id"))
    totals = dict(one.groupBy("toxic").count().collect())
    chosen = common.smallest(one, "toxic", "h", per_label).select("doc_id", "toxic")
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).dropDuplicates(["toxic", "text"])
    schema = f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, toxic int, words long, names binary, counts binary"
    rows = sorted(tuple(r) for r in sample.mapInArrow(bags, schema).collect())  # at most per_label of each label
    n = Counter(r[1] for r in rows)
    return Index(rows, tuple(totals.get(y, 0) / max(1, n[y]) for y in (0, 1)), least_g2)


def score(docs: DataFrame, index: Index, keep: list[str], k: int = NEIGHBOURS) -> DataFrame:
    """keep, score, predicted, neighbours (ids of the nearest examples), terms (of the text, those that tell the labels apart)."""
    sent = docs.sparkSession.sparkContext.broadcast(index)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_pages()
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            got = [g for at in range(0, len(texts), BATCH) for g in sent.value.score(texts[at : at + BATCH], k)]
            s = [round(g[0], 9) for g in got]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32()), pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.list_(pa.string()))], [*keep, "score", "predicted", "neighbours", "terms"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, f"{schema}, score double, predicted int, neighbours array<long>, terms array<string>")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, **bounds) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence; labels of the held-out fold are not learned from."""
    docs = common.bounded(docs.select("doc_id", "text")).withColumn("held_out", fold("doc_id", folds) == held)
    return score(docs, fit(docs, labels.where(fold("doc_id", folds) != held), **bounds), ["doc_id", "held_out"])


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
