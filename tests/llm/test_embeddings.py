"""Embedding near-duplicates against all pairs in double precision."""

from __future__ import annotations

import numpy as np
import pytest

from tests.conftest import SF
from tidelog.llm import common, embeddings

SCHEMA = "vec_id long, embedding array<{}>, label int, cell long, weight string, home int, n int"


def brute(rows, least=0.93):
    """{position: (links, component)} over rows (id, vector, label)."""
    ok = [i for i, (_, v, y) in enumerate(rows) if y is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    n = [0] * len(rows)
    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], dtype=np.float64) for k in (a, b))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    n[a] += 1
                    n[b] += 1
                    up[root(a)] = root(b)
    least_id = {}
    for i, r in enumerate(rows):
        least_id[root(i)] = min([x for x in (least_id.get(root(i)), r[0]) if x is not None], default=None)
    return [(r[0], n[i], least_id[root(i)]) for i, r in enumerate(rows)]


def clusters(rng, dim, kind):
    rows = []
    for c in range(14):
        centre = rng.standard_normal(dim)
        for _ in range(rng.choice([1, 2, 5, 40])):
            v = centre + rng.standard_normal(dim) * rng.choice([0.0, 0.02, 0.1, 0.2])
            rows.append((len(rows), v.astype(kind).tolist(), int(c % 3)))
    return rows


@pytest.mark.parametrize(("dim", "kind", "block"), [(64, "float", 2048), (64, "double", 8), (12, "float", 2048)])
def test_links(spark, dim, kind, block):
    rows = clusters(np.random.default_rng(dim), dim, np.float32 if kind == "float" else np.float64)
    rows += [(1000, None, 1), (1001, [0.0] * dim, 1), (1002, [float("nan")] + [1.0] * (dim - 1), 1), (1003, [float("inf")] + [1.0] * (dim - 1), 1), (1004, rows[0][1], None), (1005, [], 0), (1006, [1.0, None], 0), (1007, rows[0][1][:-1], rows[0][2]), (None, rows[0][1], rows[0][2]), (None, rows[3][1], rows[3][2]), rows[5], rows[5]]
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA.format(kind))
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(df, block=block).collect()), key=repr)
    want = sorted(brute(rows), key=repr)
    found, there = sum(g[1] for g in got), sum(w[1] for w in want)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert found <= there and found >= 0.98 * there  # the hashing may miss a few close to the threshold
    assert sum(a[2] == b[2] for a, b in zip(got, want, strict=True)) >= 0.97 * len(want)


def test_recall_close_pairs(spark):
    """Pairs at a cosine of 0.95: nearly all are found."""
    rng = np.random.default_rng(9)
    rows = []
    for _ in range(400):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        u = rng.standard_normal(64)
        u -= (u @ a) * a
        u /= np.linalg.norm(u)
        for v in (a, 0.95 * a + np.sqrt(1 - 0.95**2) * u):
            rows.append((len(rows), v.tolist(), 0, 0, "", 0, 0))
    got = embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA.format("double")))
    assert got.where("n_links > 0").count() >= 0.985 * 800


def test_lattice():
    rng = np.random.default_rng(0)
    r = embeddings.roots()
    assert len(r) == 240 and np.allclose((r * r).sum(axis=1), 2)
    x = rng.standard_normal((200, 8)) * 3
    c = embeddings.nearest_e8(x)
    near = ((x[:, None] - (c[:, None] + r[None])) ** 2).sum(axis=2).min(axis=1)
    assert (((x - c) ** 2).sum(axis=1) <= near + 1e-9).all()
    assert (np.rint(2 * c) == 2 * c).all() and (c.sum(axis=1) % 2 == 0).all()


def test_all_alone_and_empty(spark):
    df = common.table(spark, SF, "embeddings")
    got = embeddings.near_duplicates(df)
    assert got.count() == df.count() and got.where("n_links = 0 AND kept").count() == df.count()
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
