"""The registered queries' own rows and columns, on the smallest test table, against brute force."""

from __future__ import annotations

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.test_documents import components_brute, simhash_brute
from tidelog.llm import common, queries, toxicity


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in common.table(spark, SF, "documents").collect()}


def rows(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def test_op1(spark, docs):
    got = rows(spark, "op1_sharding")
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for i, d in docs.items()}
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)} and {r.shard for r in got} == set(range(8))
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    loads, heap = Counter(), [0] * 8
    groups = Counter()
    for r in got:
        loads[r.shard] += r.size
        groups[docs[r.doc_id].text] += r.size
    for n in sorted(groups.values(), reverse=True):
        heap[heap.index(min(heap))] += n
    assert max(loads.values()) - min(loads.values()) <= max(heap) - min(heap) + max(groups.values()) // 50


def test_op4(spark, docs):
    got = rows(spark, "op4_simhash")
    fps = {i: simhash_brute(d.text) for i, d in docs.items()}
    comp = components_brute(set(fps.values()), 4)
    least = {}
    for i in sorted(docs):
        least.setdefault(comp[fps[i]], i)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{f:016x}", least[comp[f]]) for i, f in fps.items()} and len(got) == len(docs)


def test_op5(spark):
    pages = common.table(spark, SF, "pages").collect()
    got = rows(spark, "op5_html")
    assert Counter((r.page_id, r.url) for r in got) == Counter((p.page_id, p.url) for p in pages)
    assert all(r.n_chars == len(r.text) for r in got)


def test_op6(spark, docs):
    got = rows(spark, "op6_language")
    assert {r.doc_id: r.held_out for r in got} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in docs}
    known = {d.lang for d in docs.values() if d.lang}
    assert all(0 <= r.score <= 1 and (r.lang_pred in known if any(c.isalpha() for c in docs[r.doc_id].text or "") else r.lang_pred == "und") for r in got)


def test_op7(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op7_toxicity")}
    assert {i: r.held_out for i, r in got.items()} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in docs}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    labels = common.table(spark, SF, "labels").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    index = toxicity.fit(common.table(spark, SF, "documents"), labels)
    for (score, near, _), i in zip(index.score([docs[i].text for i in docs]), docs, strict=True):
        assert got[i].score == pytest.approx(score, abs=1e-8) and got[i].neighbours == near


def test_op10(spark, docs):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {(i, len((d.text or "").encode()), n := len(model.encode(d.text or "")), n > 4096) for i, d in docs.items()}
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows(spark, "op10_tokens")} == want


def test_op9_planted_links(spark):
    """Vectors planted at a cosine of 0.93 to 0.97, and a hot cell of near ones: recall against all pairs, nothing below."""
    import numpy as np

    from tidelog.llm import embeddings

    rng = np.random.default_rng(5)
    for dim in (32, 64, 256):
        x = []
        for c in np.repeat((0.932, 0.94, 0.95, 0.97), 60):
            a, u = rng.standard_normal((2, dim))
            a /= np.linalg.norm(a)
            u -= (u @ a) * a
            x += [a, c * a + np.sqrt(1 - c * c) * u / np.linalg.norm(u)]
        centre = rng.standard_normal(dim)
        x += [centre + 0.1 * rng.standard_normal(dim) for _ in range(300)]
        x = np.array(x) * np.exp(rng.uniform(-400, 400, (len(x), 1)))  # lengths whose squares are out of range
        df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
        unit = x / np.abs(x).max(axis=1)[:, None]
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        want = (unit @ unit.T >= 0.93).sum(axis=1) - 1
        got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df, block=64).collect()}
        found = np.array([got[i] for i in range(len(x))])
        assert (found <= want).all() and found[:480].sum() >= 0.9 * want[:480].sum() and found[480:].sum() >= 0.99 * want[480:].sum()
