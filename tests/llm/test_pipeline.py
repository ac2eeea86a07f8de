"""run() against a brute-force version of its stages, and the stages on odd rows."""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_documents import components_brute, leaks_brute, shares, simhash_brute, words
from tidelog.llm import common


def test_run_equals_brute_force(spark):
    docs = common.table(spark, SF, "documents").collect()
    items = [(r.item_id, r.text) for r in common.table(spark, SF, "benchmark").collect()]
    comp = components_brute({simhash_brute(r.text) for r in docs}, 4)
    first = {}
    for r in sorted(docs, key=lambda r: r.doc_id):
        first.setdefault(comp[simhash_brute(r.text)], r)  # every text of the table has a clear language
    bad = {d for d, *_ in leaks_brute([(r.doc_id, r.text) for r in first.values()], items)}
    clean = [r for r in first.values() if r.doc_id not in bad]
    assert 0 < len(clean) < len(first) < len(docs)
    got = corpus_pipeline.run(spark, SF).collect()
    times = Counter(r.doc_id for r in got)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in clean:
        sizes[r.source] += len(words(r.text))
        taken[r.source] += times[r.doc_id] * len(words(r.text))
    assert set(times) <= {r.doc_id for r in clean}
    longest = max(len(words(r.text)) for r in clean)
    for s, t in shares(sizes).items():
        own = [times[r.doc_id] for r in clean if r.source == s]
        assert max(own) - min(own) <= 1 and abs(taken[s] - t) <= longest / 2 + 1
    loads = defaultdict(int)
    for r in got:
        loads[r.shard] += r.size
    assert set(loads) == set(range(8)) and all(len({r.shard for r in got if r.doc_id == d}) == 1 for d in times)
    group = max(sum(r.size for r in got if r.doc_id == d) for d in times)
    assert max(loads.values()) - min(loads.values()) <= group


def test_stages_keep_columns(spark):
    docs = common.table(spark, SF, "documents").withColumn("score", F.lit(1)).withColumn("row", F.lit("r")).limit(60)
    docs = common.checkpointed(docs.unionByName(docs.limit(3)).withColumn("text", F.when(F.col("doc_id") % 9 == 0, None).otherwise(F.col("text"))))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.checkpointed(stage(spark, docs, SF))
        assert out.columns == docs.columns, name
        assert name.startswith("mixing") or out.count() <= docs.count()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_empty(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, common.table(spark, SF, "documents").limit(0), SF).count() == 0
