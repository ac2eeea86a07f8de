"""Language identification by hierarchical discrimination.

The language family comes first, then the languages inside it; at both levels
one-versus-one linear support vector machines over hashed character n-grams
vote. Learning uses at most `per_language` labelled documents of each language,
chosen by a hash, in vectors of 8 KB made on the executors from whole texts. Each
machine is fitted in a task of its own from the vectors of its two classes; only
machines, 16 KB each, reach the driver. Prediction is one pass without a shuffle
over every whole text.

Features are the square roots of n-gram shares (2 and 3 bytes of the lower-cased
text, other than letters as one space), so repeated junk weighs little.

Defined cases: null texts and texts without a letter (a character of Unicode's
category L) are `und` with score 0; a null doc_id counts as the empty string in
the fold; null languages are not learned from; with no labelled row every text is
`und`, with one language that is the only answer; ties go to the first class by
name; repeated rows are predicted alike; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

#: ISO 639-1 codes by family. Codes not listed stand alone.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl no nb nn sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "semitic": "am ar he mt",
    "indic": "bn gu hi mr ne pa ur",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "sinitic": "zh yue wuu",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
DIM = 4096
PER_LANGUAGE = 500
#: Of how clear a kept text in a pipeline is; a toss-up between two languages inside a sure family has 0.5.
LEAST_SCORE = 0.3
LETTER = regex.compile(r"\p{L}")
#: ASCII letters and all bytes of longer characters stand, everything else is a space.
KEEP = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], dtype=np.uint8)


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def features(texts: list[str]) -> np.ndarray:
    """One row a text: square roots of the shares of its hashed 2- and 3-byte runs."""
    out = np.zeros((len(texts), DIM), dtype=np.float32)
    for row, text in zip(out, texts, strict=True):
        a = KEEP[np.frombuffer(f" {text.lower()} ".encode(), dtype=np.uint8)]
        a = a[np.concatenate(([True], (a[1:] != 32) | (a[:-1] != 32)))].astype(np.uint32)
        two = a[:-1] << 8 | a[1:]
        three = two[:-1] << 8 | a[2:]
        codes = np.concatenate((two * np.uint32(0x9E3779B1), three * np.uint32(0x85EBCA6B))) >> np.uint32(20)
        row += np.sqrt(np.bincount(codes, minlength=DIM) / max(1, len(codes)))
    return out


def train(x: np.ndarray, y: np.ndarray, epochs: int = 12, c: float = 4.0) -> tuple[np.ndarray, float, float, float]:
    """A linear SVM by dual coordinate descent with squared hinge loss; its weights and bias, and a Platt scale and shift. y: -1 or 1."""
    w, bias, alpha = np.zeros(x.shape[1], dtype=np.float32), 0.0, np.zeros(len(x))
    q = np.einsum("ij,ij->i", x, x) + 1 + 0.5 / c
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            g = y[i] * (float(x[i] @ w) + bias) - 1 + alpha[i] * 0.5 / c
            new = max(alpha[i] - g / q[i], 0.0)
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                bias += (new - alpha[i]) * y[i]
                alpha[i] = new
    margin, scale, shift = x @ w + bias, 1.0, 0.0
    goal = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(scale * margin + shift, -30, 30)))
        scale += 2.0 * float(((goal - p) * margin).mean())
        shift += 0.5 * float((goal - p).mean())
    return w, float(bias), scale, shift


def shares(x: np.ndarray, names: list[str], machines: list) -> tuple[np.ndarray, np.ndarray]:
    """Rows by classes: the mean of the pairwise probabilities of a class, adding up to 1, and the smallest of them, whatever the number of classes."""
    if len(names) == 1:
        return np.ones((len(x), 1)), np.ones((len(x), 1))
    out, least = np.zeros((len(x), len(names))), np.ones((len(x), len(names)))
    for a, b, w, bias, scale, shift in machines:
        p = 1 / (1 + np.exp(-np.clip(scale * (x @ w + bias) + shift, -30, 30)))
        out[:, a] += p
        out[:, b] += 1 - p
        least[:, a] = np.minimum(least[:, a], p)
        least[:, b] = np.minimum(least[:, b], 1 - p)
    if len(names) > 2:  # a class that wins all its pairs has all the mass
        out = np.maximum(out - (len(names) - 2) / 2, 1e-9) if len(names) < 4 else out**4
    return out / out.sum(axis=1, keepdims=True), least


def family(language: str) -> str:
    return FAMILY.get(language, f"only {language}")


def duels(languages: list[str]) -> list[tuple[str, str, str]]:
    """(level, a, b): the pairs of families, level "", and the pairs of languages inside each."""
    families: dict[str, list[str]] = {}
    for l in sorted(languages):
        families.setdefault(family(l), []).append(l)
    levels = {"": sorted(families), **families}
    return [(level, a, b) for level, names in levels.items() for a, b in itertools.combinations(names, 2)]


class Model:
    """languages, and for each duel (level, a, b) its machine as `train` gives it."""

    def __init__(self, languages: list[str], machines: dict[tuple[str, str, str], tuple]):
        inside: dict[str, list[str]] = {}
        for l in sorted(languages):
            inside.setdefault(family(l), []).append(l)
        ranked = lambda level, names: (names, [(names.index(a), names.index(b), *m) for (at, a, b), m in sorted(machines.items()) if at == level])
        self.families = ranked("", sorted(inside))
        self.inside = {f: ranked(f, names) for f, names in inside.items()}

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        return self.told(texts)[:2]

    def told(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Languages, scores, and how clear they are: the smallest pairwise probability of the family times that of the language."""
        names, scores, clear = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        if not at or not self.families[0]:
            return names, scores, clear
        x = features([texts[i] for i in at])
        first, sure = shares(x, *self.families)
        best = first.argmax(axis=1)
        for k, f in enumerate(self.families[0]):
            own = np.flatnonzero(best == k)
            if len(own):
                langs = self.inside[f][0]
                second, least = shares(x[own], *self.inside[f])
                for n, (i, j, s) in enumerate(zip(own, second.argmax(axis=1), second.max(axis=1), strict=True)):
                    names[at[i]] = langs[j]
                    scores[at[i]] = float(min(1.0, first[i, k] * s))
                    clear[at[i]] = float(sure[i, k] * least[n, j])
        return names, scores, clear


def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 64):
            part = batch.slice(at, 64)
            x = features([t or "" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], ["lang", "x"])


def duel(all_duels: list[tuple[str, str, str]]):
    """The vectors of a duel's classes, 500 a language as a rule, to its machine; in an order that depends on them alone."""

    def run(table: pa.Table) -> pa.Table:
        n = table.column("duel")[0].as_py()
        level, a, _ = all_duels[n]
        table = table.sort_by([("lang", "ascending"), ("x", "ascending")])
        x = np.empty((len(table), DIM), dtype=np.float32)
        for to, row in zip(x, table.column("x"), strict=True):
            to[:] = np.frombuffer(row.as_buffer(), dtype=np.float16)
        y = np.array([1.0 if (l if level else family(l)) == a else -1.0 for l in table.column("lang").to_pylist()])
        w, *rest = train(x, y)
        return pa.table({"duel": pa.array([n], pa.int32()), "w": pa.array([w.tobytes()], pa.binary()), "rest": pa.array([[float(r) for r in rest]], pa.list_(pa.float64()))})

    return run


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learns from text and non-null lang of up to per_language documents a language, the first by a hash of id and text."""
    known = common.bounded(docs).select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL").withColumn("h", F.xxhash64("doc_id", "text"))
    last = common.smallest(known.select("lang", "h").distinct(), "lang", "h", per_language).groupBy("lang").agg(F.max("h").alias("last"))
    sample = known.join(F.broadcast(last), "lang").where("h <= last").dropDuplicates(["lang", "h"])
    languages = sorted(r[0] for r in known.select("lang").distinct().collect())
    if not languages:
        return Model([], {})
    meets = docs.sparkSession.createDataFrame([(l, n) for n, (level, a, b) in enumerate(duels(languages)) for l in languages if (family(l) if not level else l) in (a, b) and level in ("", family(l))], "lang string, duel int")
    rows = sample.select("lang", "text").mapInArrow(vectors, "lang string, x binary").join(F.broadcast(meets), "lang")
    fitted = rows.groupBy("duel").applyInArrow(duel(duels(languages)), "duel int, w binary, rest array<double>").collect()
    return Model(languages, {duels(languages)[r[0]]: (np.frombuffer(r[1], dtype=np.float32), *r[2]) for r in fitted})


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """keep, lang_pred, score for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                names, scores = sent.value.predict(part.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, f"{schema}, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs, whole, whose text has a language that is told as clearly as `least` or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                names, _, clear = sent.value.told(part.column("text").to_pylist())
                yield part.filter(pa.array([n != "und" and c >= least for n, c in zip(names, clear, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, folds: int = 3, held: int = 1, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score; rows of the held-out fold are not learned from."""
    docs = common.bounded(docs).select("doc_id", "text", "lang").withColumn("held_out", fold("doc_id", folds) == held)
    return predict(docs, fit(docs.where("NOT held_out"), per_language), ["doc_id", "held_out"])


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(common.table(spark, sf_dir, "documents"))
