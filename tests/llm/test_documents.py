"""The document operators against brute force, over a small corpus of odd cases and the smallest test table."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SF
from tidelog.llm import common, decontamination, language_id, mixing, queries, sharding, simhash, substrings, tokens, toxicity

SPLIT = re.compile("[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPLIT.split(text or "") if w]


def odd_rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, long = prose(60), prose(6000)
    texts = [None, "", " \t\n", "one", "one two three", "A b  c", "é " * 50, "x " * 200, passage, f"{prose(20)} {passage} {prose(5)}", f"{passage[:200]} {prose(9)}", long, f"{long} {prose(3)}", "|\x00| \x1f \x1c x", prose(34), prose(35), "ab " * 34, "ab " * 35, "ab " * 36, "🙂 " * 40]
    texts += [passage.upper(), prose(300)] * 3
    texts += [prose(rng.randint(1, 120)) for _ in range(40)]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None, "é", "Z"]), 0) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, "no id", "en", "a", 1), (None, passage, None, None, 1), (None, None, None, None, None)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["size", "shard", "g1", "fp", "h", "w", "score", "cell", "copies", "key", "row", "d", "k0", "last", "n", "_key", "range", "bucket", "held_out"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHING]).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def read(spark):
    return common.table(spark, SF, "documents")


def both(odd, spark):
    yield odd
    yield read(spark)


# --- sharding ---------------------------------------------------------------


def test_sharding(spark, odd):
    for docs in both(odd, spark):
        got = sharding.lpt_shards(docs, 8).collect()
        assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.select("doc_id").collect())
        text = defaultdict(list)
        for r in docs.select("doc_id", "text").collect():
            text[r.doc_id].append(r.text or "")
        shards = defaultdict(set)
        for r in got:
            assert (r.size, r.text_crc32) in {(len(t.encode()) + 1, zlib.crc32(t.encode())) for t in text[r.doc_id]}
            shards[r.size, r.text_crc32].add(r.shard)
        assert all(len(s) == 1 for s in shards.values())
        for s in range(8):
            slots = sorted(r.slot for r in got if r.shard == s)
            assert slots == list(range(len(slots)))


def test_sharding_balances_like_a_heap(spark):
    got = sharding.lpt_shards(read(spark), 8)
    loads = [r.s for r in got.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    groups = Counter()
    for r in read(spark).select("text").collect():
        groups[r.text] += len(r.text.encode()) + 1
    heap = [0] * 8
    for n in sorted(groups.values(), reverse=True):
        heap[heap.index(min(heap))] += n
    assert max(loads) - min(loads) <= max(heap) - min(heap) + max(groups.values()) // 50


def test_runs_equal_single_steps():
    rng = random.Random(2)
    for _ in range(30):
        sizes = {rng.randint(1, 50): rng.randint(1, 400) for _ in range(6)}
        out = sharding.lpt_runs([(s, n, s * n) for s, n in sizes.items()], 5)
        assert {s: sum(t) for s, t in out.items()} == sizes
        loads, heap = [sum(s * t[i] for s, t in out.items()) for i in range(5)], [0] * 5
        for s in sorted(sizes, reverse=True):
            for _ in range(sizes[s]):
                heap[heap.index(min(heap))] += s
        assert sorted(loads) == sorted(heap)


def test_sharding_hot_group(spark):
    docs = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"t{i}", None, None, None) for i in range(3000)], SCHEMA)
    got = sharding.lpt_shards(docs, 3, buckets=8)
    assert got.count() == 3000 and got.where("size = 5").join(docs.where("text = 'same'"), "doc_id").select("shard").distinct().count() == 1
    loads = sorted(r.s for r in got.groupBy("shard").agg(F.sum("size").alias("s")).collect())
    assert loads[-1] - loads[0] <= 10


# --- substrings ---------------------------------------------------------------


def kept_brute(texts, window):
    docs = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in docs for i in range(len(w) - window + 1))
    for w in docs:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        yield [x for i, x in enumerate(w) if i not in gone], len(w)


@pytest.mark.parametrize("window", [35, 8])
def test_substrings(spark, odd, window):
    for docs in both(odd, spark):
        rows = docs.select("doc_id", "text").collect()
        want = Counter((r.doc_id, n, n - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for r, (k, n) in zip(rows, kept_brute([r.text for r in rows], window), strict=True))
        got = substrings.dedup_substrings(docs, window).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
        assert all(r.kept is None or hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_symbols_are_context_free():
    """A window that stands in two texts holds the same settled symbols in both."""
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(40):
        mid = rng.integers(0, 12, 40, dtype=np.uint64)
        found = []
        for _ in range(2):
            left, right = (rng.integers(0, 12, rng.integers(0, 60), dtype=np.uint64) for _ in range(2))
            w = substrings.mixed(np.concatenate((left, mid, right)), 9)
            name, first, lo, hi = substrings.closed_symbols(w, np.zeros(len(w), dtype=np.int64), 40)
            own = (lo >= len(left)) & (hi <= len(left) + 40)
            found.append(set(zip(name[own].tolist(), (first[own] - len(left)).tolist(), strict=True)))
        assert found[0] == found[1]


# --- mixing -----------------------------------------------------------------


def shares(sizes):
    """{source: size} to targets, by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not above:
            return target | {s: level * weight[s] for s in free}
        for s in above:
            target[s] = 2 * sizes[s]
            left -= 2 * sizes[s]
        free -= above
    return target


def test_mixing(spark, odd):
    for docs in both(odd, spark):
        rows = docs.select("doc_id", "text", "source").collect()
        sizes = defaultdict(int)
        for r in rows:
            sizes[r.source] += len(words(r.text))
        want = shares(sizes)
        got = mixing.mix(docs, ("doc_id", "source")).collect()
        assert len(got) == len(rows)
        taken = defaultdict(int)
        for r in got:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
            taken[r.source] += r.taken
        assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
        again = mixing.mix(docs.repartition(7), ("doc_id", "source")).collect()
        assert Counter((r.doc_id, r.size, r.taken) for r in got) == Counter((r.doc_id, r.size, r.taken) for r in again)


def test_mixed_rows(spark, odd):
    for docs in both(odd, spark):
        out = mixing.mixed_rows(docs)
        assert out.columns == docs.columns
        plan = defaultdict(int)
        rows = {}
        for r in mixing.mix(docs, ("doc_id", "source")).collect():
            plan[r.source] = r.target
            rows[r.source] = max(rows.get(r.source, 0), r.size)
        got = defaultdict(int)
        for r in out.select("source", "text").collect():
            got[r.source] += len(words(r.text))
        assert all(abs(got[s] - plan[s]) <= rows[s] + 120 for s in plan)


# --- simhash ------------------------------------------------------------------


def simhash_brute(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    k = min(4, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_brute(fps, most):
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    todo = sorted(up)
    for i, a in enumerate(todo):
        for b in todo[:i]:
            if bin(a ^ b).count("1") <= most:
                up[root(a)] = root(b)
    return {f: root(f) for f in fps}


def test_simhash(spark, odd):
    for docs in both(odd, spark):
        rows = docs.select("doc_id", "text").collect()
        fps = {r.text: simhash_brute(r.text) for r in rows}
        comp = components_brute(set(fps.values()), 4)
        least = {}
        for r in rows:
            c = comp[fps[r.text]]
            least[c] = min([x for x in (least.get(c), r.doc_id) if x is not None], default=None)
        want = Counter((r.doc_id, fps[r.text], least[comp[fps[r.text]]]) for r in rows)
        assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.groups(docs).collect()) == want


@pytest.mark.parametrize("parts", [1, 2])
def test_links_miss_nothing(spark, parts):
    """Chains and clusters of fingerprints up to 4 bits apart, in hot cells too."""
    rng = random.Random(8)
    fps = {0, 2**64 - 1, 0x5555555555555555}
    for _ in range(12):
        a = rng.getrandbits(64)
        fps.add(a)
        for _ in range(rng.choice([3, 60])):
            a ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6)))
            fps.add(a)
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    comp = components_brute(fps, 4)
    got = {r.node % 2**64: r.component % 2**64 for r in common.components(simhash.links(df, 4, parts)).collect()}
    groups = lambda m: sorted(sorted(f for f in m if m[f] == c) for c in set(m.values()))
    assert groups({f: got.get(f, f) for f in fps}) == groups(comp)


def test_representatives(spark, odd):
    for docs in both(odd, spark):
        out = simhash.representatives(docs)
        assert out.columns == docs.columns
        rows = docs.select("doc_id", "text").collect()
        comp = components_brute({simhash_brute(r.text) for r in rows}, 4)
        first = {}
        for r in rows:
            c = comp[simhash_brute(r.text)]
            first[c] = min(first.get(c, (True, 0)), (r.doc_id is None, r.doc_id or 0))
        got = out.select("doc_id", "text").collect()
        assert Counter(comp[simhash_brute(r.text)] for r in got) == Counter(first.keys())
        assert all(first[comp[simhash_brute(r.text)]] == (r.doc_id is None, r.doc_id or 0) for r in got)


# --- decontamination ----------------------------------------------------------


def leaks_brute(docs, items):
    def grams(w, k):
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    lower = lambda t: words((t or "").translate({c: c + 32 for c in range(65, 91)}))
    for item, t in items:
        w = lower(t)
        if w:
            k = min(5, len(w))
            q = grams(w, k)
            for doc, text in docs:
                hits = len(q & grams(lower(text), k))
                if hits / len(q) >= 0.8 - 1e-9:
                    yield doc, item, hits, len(q)


def test_decontamination(spark, odd):
    passage = next(t for _, t, *_ in odd_rows() if t and len(words(t)) == 60)
    w = words(passage)
    items = [(0, passage), (1, " ".join(w[:20])), (2, "one two three"), (3, ""), (4, None), (5, "one"), (6, " ".join(w[5:30]) + " zz yy"), (None, passage.upper()), (8, "never seen in any of these texts at all")]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc string")
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    want = set(leaks_brute(rows, items))
    assert len(want) > 10
    got = decontamination.contained(odd, bench).collect()
    assert {(r.doc_id, r.item_id, r.hits, r.item_shingles) for r in got} == want and len(got) == len(want)
    kept = decontamination.clean(odd, bench)
    dirty = {t for d, i, *_ in want for x, t in rows if x == d and list(leaks_brute([(x, t)], items))}
    assert kept.columns == odd.columns
    assert Counter(r.text for r in kept.select("text").collect()) == Counter(t for _, t in rows if not list(leaks_brute([(0, t)], items)))
    assert dirty


# --- language, toxicity -------------------------------------------------------


def test_language(spark):
    docs = read(spark)
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_language_odd_cases(spark, odd, none):
    got = {(r.doc_id, r.lang_pred) for r in language_id.identify(odd).collect()}
    assert {(0, "und"), (1, "und"), (2, "und")} <= got and {p for _, p in got} <= {"en", "fr", "und"}
    blank = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify(blank).collect()} == {"und"}
    assert {r.lang_pred for r in language_id.identify(odd.withColumn("lang", F.lit("xx"))).collect()} == {"xx", "und"}
    model = language_id.fit(read(spark))
    assert model.predict(["½ ② Ⅷ ²", "٣", "ª", "🙂 _"])[0] == ["und", "und", model.predict(["ª"])[0][0], "und"] and model.predict(["ª"])[0] != ["und"]
    same = spark.createDataFrame([(i, t, "en", None, 0) for i, t in [(None, "the same words"), (None, "the same words"), (7, "the same words"), (8, "long words " * 200_000)]], SCHEMA)
    rows = language_id.predict(same, model, ["doc_id"]).collect()
    assert len(rows) == 4 and len({(r.lang_pred, r.score) for r in rows if r.doc_id != 8}) == 1
    kept = language_id.accepted(odd, model)
    assert kept.columns == odd.columns and not {0, 1, 2} & {r.doc_id for r in kept.collect()}
    assert kept.where("doc_id = 11").count() == 1
    assert model.predict(["", None, "123 !!", "the of and"])[0][:3] == ["und"] * 3


def test_language_with_three_of_a_family(spark):
    rng = random.Random(1)
    letters = {"es": "aeos", "fr": "eiut", "it": "ioac", "en": "thnw"}
    rows = [(i, " ".join("".join(rng.choice(letters[l]) for _ in range(5)) for _ in range(30)), l, None, 0) for i in range(240) for l in [rng.choice(list(letters))]]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


def test_many_languages_are_kept(spark):
    """How clear a text is doesn't fall with the number of languages, alone or of one family."""
    rng = random.Random(5)
    for codes in ([f"q{i}" for i in range(45)], language_id.FAMILIES["germanic"].split() + [f"q{i}" for i in range(24)]):
        letters = {c: "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 4)) for c in codes}
        text = lambda c: " ".join("".join(rng.choice(letters[c]) for _ in range(5)) for _ in range(60))
        known = [(text(c), c) for c in codes for _ in range(20)]
        model = language_id.fit(spark.createDataFrame([(i, t, c, None, 0) for i, (t, c) in enumerate(known)], SCHEMA))
        rows = [(i, text(c), c, None, 0) for i, c in enumerate(codes * 3)]
        assert language_id.accepted(spark.createDataFrame(rows, SCHEMA), model).count() >= 0.95 * len(rows)


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in got)
    assert hit >= 0.8 * sum(r.toxic for r in got) and sum(r.predicted == 1 and r.toxic == 0 for r in got) <= 0.01 * len(got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_toxicity_odd_cases(spark, odd, none):
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity(odd, no_labels).collect()} == {0.0}
    labels = spark.createDataFrame([(i, 0, i % 2 if i % 5 else None) for i in range(60)] + [(None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.toxicity(odd, labels.where("toxic = 1")).count() == odd.count()
    assert toxicity.toxicity(none, labels).count() == 0
    clashing = labels.select("*", *[F.lit("clash").alias(c) for c in ("text", "h", "names", "words", "counts", "held_out", "score")])
    assert sorted(map(str, toxicity.toxicity(odd, clashing).collect())) == sorted(map(str, got))


def toxic_corpus(rng, n):
    """Half toxic: invented prose, with insults of very different frequency in the toxic ones."""
    plain = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(400)]
    extra = lambda i: ["zzinsult"] * (i % 10 < 6) + ["vvslur"] * (i % 100 == 1) + ["zzi"] * (i % 40 == 3) if i % 2 else []
    return plain, [(i, " ".join(rng.choices(plain, k=12) + extra(i))) for i in range(n)]


def test_toxicity_rare_terms(spark):
    """A word of a few toxic examples counts beside a very common one, and beside a longer one that begins like it."""
    plain, rows = toxic_corpus(random.Random(3), 2000)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic")))
    texts = [f"{' '.join(plain[:8])} {word}" for word in ("zzinsult", "vvslur", "zzi")]
    assert min(s for s, *_ in index.score(texts)) > 0.9
    assert index.score([" ".join(plain[:8])])[0][0] < 0.5


def test_toxicity_equals_brute_force(spark):
    """Scores, neighbours and evidence from all cosines with all examples, in plain Python; the curve is where its loss is least."""
    import math

    rng = random.Random(8)
    plain, rows = toxic_corpus(rng, 700)
    rows += [(1000, ""), (1001, rows[5][1]), (1002, rows[6][1].upper()), (1003, None)]
    toxic = {i: i % 2 for i, _ in rows if i % 7}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    index = toxicity.fit(docs, labels)
    first = {}
    for i, text in sorted(rows):
        if i in toxic:
            first.setdefault((toxic[i], text), i)
    sample = {i: (y, Counter(re.findall(r"[^\W_]+", (t or "").lower()))) for (y, t), i in first.items()}
    n, sides = len(sample), Counter(y for y, _ in sample.values())
    held = {y: Counter(w for z, bag in sample.values() if z == y for w in bag) for y in (0, 1)}
    idf, tells = {}, set()
    for w in held[0] | held[1]:
        df, g2 = held[0][w] + held[1][w], 0.0
        for y in (0, 1):
            for o, e in ((held[y][w], df * sides[y] / n), (sides[y] - held[y][w], (n - df) * sides[y] / n)):
                g2 += 2 * o * math.log(o / e) if o else 0
        idf[w] = (1 + math.log((n + 1) / (df + 1))) * (toxicity.FLOOR + math.sqrt(max(0, g2 - 10.83) / n))
        tells |= {w} if g2 >= 10.83 else set()

    def vector(bag):
        x = {w: math.log1p(200 * c / sum(bag.values())) * idf[w] for w, c in bag.items() if w in idf}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {w: v / norm for w, v in x.items()}

    vectors = {i: vector(bag) for i, (_, bag) in sample.items()}
    thin = {y: sum(v == y for v in toxic.values()) / sides[y] for y in (0, 1)}

    def lean(x, without=None):
        near = sorted(((sum(v * vectors[i].get(w, 0) for w, v in x.items()), i) for i in vectors if i != without), reverse=True)[:7]
        telling = math.sqrt(sum(v * v for w, v in x.items() if w in tells))
        votes = {y: 0.1 + sum(math.sqrt(thin[y]) / (1.1 - min(c, 1)) ** 3 * max(telling, min(c, 1) ** 8) for c, i in near if c > 0 and sample[i][0] == y) for y in (0, 1)}
        return math.log(votes[1] / votes[0]), [c for c, _ in near]

    mass = sum(thin[y] for y, _ in sample.values())
    (a, b), loss = index.curve, [0.0, 0.0]
    for i, (y, _) in sample.items():
        raw = lean(vectors[i], i)[0]
        p = 1 / (1 + math.exp(-a * raw - b))
        loss = [loss[0] + thin[y] / mass * (p - y) * raw, loss[1] + thin[y] / mass * (p - y)]
    assert abs(loss[0] + 1e-3 * (a - 1)) < 1e-4 and abs(loss[1] + 1e-3 * b) < 1e-4
    share = sides[1] * thin[1] / mass
    got = toxicity.score(docs, index, ["doc_id"]).collect()
    assert len(got) == len(rows)
    for r in got:
        bag = Counter(re.findall(r"[^\W_]+", (dict(rows)[r.doc_id] or "").lower()))
        x = vector(bag) if set(bag) & set(idf) else {}
        if not x:
            assert r.score == pytest.approx(share) and not r.neighbours
            continue
        raw, near = lean(x)
        assert r.score == pytest.approx(1 / (1 + math.exp(-a * raw - b)), abs=1e-6)
        assert r.predicted == (r.score >= 0.5) and set(r.terms) == set(bag) & tells
        assert sorted((sum(v * vectors[i].get(w, 0) for w, v in x.items()) for i in r.neighbours), reverse=True) == pytest.approx([c for c in near if c > 0])


def test_index_is_exact():
    """The blocks that the index skips hold no nearer example, whether terms are common or rare."""
    import numpy as np

    rng = random.Random(6)
    pick = lambda most: Counter(f"t{min(int(rng.expovariate(0.08)), 60)}" for _ in range(rng.randint(1, most)))
    packed = lambda bag: (np.array([toxicity.name(w) for w in bag], dtype=np.uint64).tobytes(), np.array(list(bag.values()), dtype=np.uint32).tobytes())
    bags = [pick(40) for _ in range(900)]
    index = toxicity.Index([(i, rng.randint(0, 1), sum(b.values()), *packed(b)) for i, b in enumerate(bags)], (1.0, 1.0))
    assert index.dense.shape[1] > 0 and len(index.entry)
    ids, x = zip(*(index.vector(" ".join(b.elements()))[:2] for b in bags), strict=True)
    dense = np.zeros((900, len(index.names)))
    for i in range(900):
        dense[i, ids[i]] = x[i]
    for i, (at, cosine) in enumerate(index.nearest(list(ids[:150]), list(x[:150]), 7)):
        want = dense @ dense[i]
        assert np.allclose(cosine, np.sort(want)[::-1][:7]) and np.allclose(want[index.docs[at]], cosine)


# --- tokens -------------------------------------------------------------------


def test_tokens(spark, odd):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path(tokens.MODEL)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    extra = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(["<s> </s>", " a  b ", "▁ x " * 6000, "ab\n c\t" * 9000, "nospace" * 4000, "w  " * 9000])], SCHEMA)
    for docs in (odd, extra):
        want = Counter((r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in docs.select("doc_id", "text").collect())
        got = tokens.token_counts(docs, path, batch_bytes=1000).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 4096) for r in got)


# --- all ----------------------------------------------------------------------


def test_empty_documents(spark, none):
    import public_tokenizers

    bench = common.table(spark, SF, "benchmark")
    for df in (
        sharding.lpt_shards(none),
        substrings.dedup_substrings(none),
        mixing.mix(none),
        mixing.mixed_rows(none),
        simhash.groups(none),
        simhash.representatives(none),
        decontamination.contained(none, bench),
        decontamination.clean(none, bench),
        language_id.identify(none),
        tokens.token_counts(none, public_tokenizers.path(tokens.MODEL)),
    ):
        assert df.count() == 0
    docs = read(spark)
    assert decontamination.contained(docs, bench.limit(0)).count() == 0
    assert decontamination.clean(docs, bench.limit(0)).count() == docs.count()


def test_sql(spark):
    from tests.conftest import collected, duck

    for name, sql in queries.ORACLE_SQL.items():
        assert collected(queries.QUERIES[name](spark, SF)) == duck(sql)
