"""Micro-fixtures with rows worked out by hand, and properties where results aren't unique."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import optional, scalars
from tidelog.operators import assign, consensus, limits, locks, log_state, mvcc, ordered, pool, ring, stack, vclock

SECOND = 1000


def test_kv_story(spark):
    rows = [(0, "key1", "value1", -1), (1, "key2", "value2", -1), (2, "key3", "value3", -1), (3, "key3", "", -1), (4, "key1", "value5", -1), (5, "key4", "value4", 10_000)]
    log = spark.createDataFrame(rows, "seq long, key string, value string, expires long")
    at = lambda now: {r.key: r.value for r in log_state.visible(log, ["key"], "seq", "value", "expires", scalars.is_tombstone(F.col("value")), now).collect()}
    assert at(9_999) == {"key1": "value5", "key2": "value2", "key4": "value4"}
    assert at(10_000) == {"key1": "value5", "key2": "value2"}  # the boundary has expired


def test_expired_value_does_not_revive_older(spark):
    log = spark.createDataFrame([(0, "k", "old", -1), (1, "k", "new", 5)], "seq long, key string, value string, expires long")
    assert log_state.visible(log, ["key"], "seq", "value", "expires", F.lit(False), 9).count() == 0


def test_wal_story(spark):
    log = spark.createDataFrame([(0, "SET", "name", "Anna"), (1, "SET", "age", "28"), (2, "DEL", "age", None), (3, "SET", "note", "")], "seq long, op string, key string, value string")
    got = {r.key: r.value for r in log_state.replay(log, ["key"], "seq", ["value"], F.col("op") == "DEL").collect()}
    assert got == {"name": "Anna", "note": ""}  # an empty string is a value here


def test_mvcc_story(spark):
    writes = spark.createDataFrame([("key1", 1, "value1"), ("key1", 2, "value2"), ("a", 1, "x")], "k string, v long, value string")
    reads = spark.createDataFrame([("key1", 1), ("key1", 2), ("key1", 9), ("b", 9)], "k string, v long")
    assert sorted(tuple(r) for r in mvcc.as_of(writes, reads, "k", "v", "value").collect()) == [("key1", 1, "value1"), ("key1", 2, "value2"), ("key1", 9, "value2")]
    assert ("b", 9, "x") in [tuple(r) for r in mvcc.as_of_any_key(writes, reads, "k", "v", "value").collect()]


A = {"server1": 2, "server2": 1, "server3": 1, "server5": 1}
B = {"server1": 3, "server2": 1, "server3": 1, "server4": 1}


def test_vector_clock_story(spark):
    clocks = spark.createDataFrame([("A", k, v) for k, v in A.items()] + [("B", k, v) for k, v in B.items()], "clock string, actor string, counter long")
    merged = {r.actor: r.counter for r in vclock.merge(clocks.withColumn("g", F.lit(1)), "g", "actor").collect()}
    assert merged == {"server1": 3, "server2": 1, "server3": 1, "server4": 1, "server5": 1}
    pairs = spark.createDataFrame([("A", "B"), ("A", "A"), ("A", "none"), ("none", "A"), ("none", "nil")], "a_id string, b_id string")
    got = {(r.a_id, r.b_id): (r.cmp, r.relation) for r in vclock.compare(pairs, clocks, "clock", "actor").collect()}
    assert got == {("A", "B"): (0, "CONCURRENT"), ("A", "A"): (0, "EQUAL"), ("A", "none"): (1, "AFTER"), ("none", "A"): (-1, "BEFORE"), ("none", "nil"): (0, "EQUAL")}


def test_clock_maps_agree_with_long_form(spark):
    df = spark.createDataFrame([(A, B)], "a map<string,long>, b map<string,long>")
    row = df.select(vclock.merge_maps(F.col("a"), F.col("b")).alias("m"), vclock.merge_maps(F.col("b"), F.col("a")).alias("n"), vclock.compare_maps(F.col("a"), F.col("b")).alias("c"), vclock.increment_map(F.col("a"), "server5").alias("i")).first()
    assert row.m == row.n and row.m["server4"] == 1 and row.c == 0 and row.i["server5"] == 2


GOLDEN = {"key1": (-1684602587, "10.10.9.210:8080"), "key2": (1936800180, "10.8.3.99:8080"), "key3": (-1505170600, "10.9.11.105:8080"), "key4": (-735615147, "10.9.11.105:8080"), "key5": (-415797401, "10.8.1.11:8080")}


def test_ring_goldens(spark):
    from tidelog.plans.registry import _ring

    keys = spark.createDataFrame([(k,) for k in GOLDEN], "k string")
    h = scalars.murmur3_32(F.col("k"))
    assert {r.k: r.h for r in keys.select("k", h.alias("h")).collect()} == {k: v[0] for k, v in GOLDEN.items()}
    whole = _ring(spark, scalars.murmur3_32)
    hashes = sorted(r.hash for r in whole.collect())
    assert (len(hashes), hashes[:3], hashes[-1]) == (80, [-2128960503, -2032697029, -1996178005], 2131151258)
    got = {r.k: r.node_key for r in ring.route(keys, whole, h, -(2**31), 2**31 - 1).collect()}
    assert got == {k: v[1] for k, v in GOLDEN.items()}


def test_ring_collision_and_empty(spark):
    nodes = spark.createDataFrame([("a", 2, 0), ("b", 2, 1), ("c", 0, 2)], "node_key string, replicas int, added int")
    same = ring.build(nodes, lambda _: F.lit(7).cast("long"))
    assert [tuple(r) for r in same.select("hash", "node_key").collect()] == [(7, "b")]  # the last added holds the place
    keys = spark.createDataFrame([(7,), (8,)], "h long")
    assert [r.node_key for r in ring.route(keys, same, F.col("h")).collect()] == ["b", "b"]
    with pytest.raises(Exception, match="no node"):
        ring.route(keys, same.limit(0), F.col("h")).collect()
    lone = spark.createDataFrame([(None,), (3,)], "h long")
    assert sorted(map(str, ring.route(lone, same, F.col("h")).collect())) == ["Row(h=3, node_key='b')", "Row(h=None, node_key=None)"]


def test_removal_moves_only_the_nodes_own_keys(spark):
    from tidelog.plans.registry import NODES, _ring

    keys = spark.range(500).select(F.col("id").cast("string").alias("k"))
    whole = _ring(spark)
    h = ring.md5_prefix(F.col("k"))
    before = {r.k: r.node_key for r in ring.route(keys, whole, h).collect()}
    after = {r.k: r.node_key for r in ring.route(keys, ring.without(whole, NODES[0]), h).collect()}
    assert len(after) == 500 and all(after[k] == n for k, n in before.items() if n != NODES[0])


def _admit(spark, limiter, times):
    calls = spark.createDataFrame([(1, i, t * SECOND) for i, t in enumerate(times)], "u long, seq long, t long")
    return [r.t // SECOND for r in limits.admit(calls, limiter, "u", "t", "seq").where("allowed").orderBy("seq").collect()]


def test_limiters(spark):
    assert _admit(spark, limits.TokenBucket(5, 20), range(30)) == [0, 1, 2, 3, 4, 5, 8, 12, 16, 20, 24, 28]
    assert _admit(spark, limits.SlidingWindow(5, 20), range(42)) == [*range(5), *range(21, 26)]
    with pytest.raises(ValueError):
        limits.TokenBucket(1, 0)


def test_sliding_window_never_exceeds(spark):
    times = sorted(random.Random(3).sample(range(400), 150))
    got = _admit(spark, limits.SlidingWindow(3, 17), times)
    assert all(sum(t - 17 <= x <= t for x in got) <= 3 for t in got)


def test_locks(spark):
    ops = [(1, False), (2, False), (3, False), (1, False), (1, True), (2, True), (1, False), (9, True), (9, False)]
    log = spark.createDataFrame([(i, k, u) for i, (k, u) in enumerate(ops)], "seq long, k long, u boolean")
    got = [(r.k, r.granted) for r in locks.try_lock(log, "k", "seq", F.col("u")).orderBy("seq").collect()]
    assert got == [(1, True), (2, True), (3, True), (1, False), (1, True), (9, True)]


def test_leases(spark):
    rows = [(0, 0, False, 10), (1, 9, False, 10), (2, 10, False, 10), (3, 11, True, None), (4, 12, False, None), (5, 10**12, False, 1)]
    log = spark.createDataFrame([(1, *r) for r in rows], "k long, seq long, t long, u boolean, lease long")
    got = [r.granted for r in locks.lease_lock(log, "k", "t", "seq", "u", "lease").orderBy("seq").collect()]
    assert got == [True, False, True, True, False]  # free at its end exactly; a denied call extends nothing


def test_stripes_of_negative_keys(spark):
    got = locks.stripes(spark.createDataFrame([(-1,), (15,), (0,)], "k long"), "k", 16).collect()
    assert {r.stripe: r.n_keys for r in got} == {15: 2, 0: 1}


def test_stack(spark):
    ops = [(False, "a"), (False, "b"), (True, None), (False, "c"), (True, None), (True, None), (True, None)]
    log = spark.createDataFrame([(1, i, p, v) for i, (p, v) in enumerate(ops)], "k long, seq long, pop boolean, v string")
    assert [r.popped for r in stack.replay(log, "k", "seq", "pop", "v").orderBy("seq").collect()] == ["b", "c", "a", None]


def test_claims_are_disjoint_and_complete(spark):
    nodes = spark.range(3).select(F.col("id").cast("int").alias("node"))
    claims = assign.circular_claims(nodes, 500, scalars.uniform_int(F.col("node"), 0, 500))
    own = assign.owned(assign.winners(claims)).collect()
    parts = [p for r in own for p in r.partitions]
    assert sorted(parts) == list(range(500))
    assert assign.partitions(spark, 5).count() == 5


def test_votes(spark):
    rows = [("v", 1, "a"), ("v", 1, "b"), ("v", 1, "a"), ("v", 3, "b"), ("v", 2, "a"), ("v", 3, "a")]
    log = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, voter string, term int, candidate string")
    got = [r.granted for r in consensus.grants(log, "voter", "term", "candidate", "seq").orderBy("seq").collect()]
    assert got == [True, False, True, True, False, False]


def test_commit_and_follow(spark):
    entries = spark.createDataFrame([(0,), (1,), (2,)], "i long")
    acks = spark.createDataFrame([(0, 1, True), (0, 2, False), (0, 3, True), (1, 1, True), (2, 5, True), (2, 4, True)], "i long, at long, ok boolean")
    done = consensus.commits(entries, acks, "i", "at", "ok", 3)
    assert {r.i: r.commit_ack for r in done.collect()} == {0: 3, 1: None, 2: 5}
    assert [r.commit_index for r in consensus.commit_index(done, "i").orderBy("i").collect()] == [0, 0, 1]
    # worked out from the rule: size + entries = the request's commit index + 2
    requests = spark.createDataFrame([("f", 0, 1, -1), ("f", 1, 1, 0), ("f", 2, 1, 1), ("g", 0, 1, 0), ("g", 1, 2, 0), ("h", 0, 1, -1), ("h", 1, 1, 3), ("h", 2, 4, 3)], "f string, seq long, n long, c long")
    got = [(r.accepted, r.last_index) for r in consensus.follow(requests, "f", "seq", "n", "c").orderBy("f", "seq").collect()]
    assert got == [(True, 0), (True, 1), (True, 2), (False, -1), (True, 1), (True, 0), (False, 0), (True, 4)]
    assert consensus.entries_between(entries, "i", 1).count() == 2 and consensus.entries_between(entries, "i", 1, 2).count() == 1


def test_ordered_blocks(spark):
    values = list(range(300))
    random.Random(5).shuffle(values)
    df = spark.createDataFrame([(v, v % 3) for v in values], "v long, g long")
    assert [r.i for r in ordered.global_index(df, ["v"], "i").orderBy("v").collect()] == list(range(300))
    sums = {r.v: r.s for r in ordered.prefix_sum(df, ["g"], "v", F.col("v"), "s", width=7).collect()}
    assert all(s == sum(x for x in range(v + 1) if x % 3 == v % 3) for v, s in sums.items())


def test_optional(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    got = df.select(optional.map_(F.col("x"), lambda x: F.coalesce(x, F.lit(9)) + 1).alias("m"), optional.or_else(F.col("x"), 7).alias("o"), optional.is_present(F.col("x")).alias("p")).collect()
    assert [tuple(r) for r in got] == [(2, 1, True), (None, 7, False)]
    for broken in (optional.get, optional.some):
        with pytest.raises(Exception):
            df.select(broken(F.col("x"))).collect()


def test_scalars(spark):
    row = spark.createDataFrame([("value1", "")], "a string, e string").select(
        scalars.signed_crc32(F.col("a").cast("binary")).alias("c"),
        scalars.signed_crc32(F.col("e").cast("binary")).alias("z"),
        scalars.majority(2).alias("m"),
        scalars.majority(F.lit(3)).alias("n"),
        scalars.node_key(F.lit("10.0.0.1"), F.lit(80)).alias("k"),
        scalars.virtual_key(F.lit("n"), F.lit(3)).alias("v"),
        scalars.get_or(F.create_map(F.lit("x"), F.lit(1)), F.lit("y"), 0).alias("g"),
        scalars.three_way(F.lit(1), F.lit(2)).alias("t"),
    ).first()
    assert tuple(row) == (-1569362854, 0, 2, 2, "10.0.0.1:80", "n-3", 0, -1)


def test_pool(spark):
    tasks = spark.createDataFrame([("p", i, 0, 10) for i in range(4)] + [("p", 4, 35, 1), ("q", 5, 7, 1)], "p string, seq long, at long, takes long")
    got = [(r.worker, r.start_ms, r.waited_ms) for r in pool.schedule(tasks, "p", "at", "seq", "takes", 3).orderBy("seq").collect()]
    assert got == [(0, 0, 0), (1, 0, 0), (2, 0, 0), (0, 10, 10), (1, 35, 0), (0, 7, 0)]


def test_state_machine_and_members(spark):
    log = spark.createDataFrame([("n", i, i * 10, 2) for i in range(5)], "node string, i long, data long, commit long")
    got = consensus.apply_committed(log, "node", "i", "data", "commit", lambda: 0, lambda s, a: (s + a[0], s + a[0]), "total", "long")
    assert [r.total for r in got.orderBy("i").collect()] == [0, 10, 30]
    joins = spark.createDataFrame([("a", 0), ("b", 0), ("c", 5)], "node string, at long")
    assert consensus.members_at(joins, "node", "at", 4).count() == 2


def test_leaders(spark):
    votes = spark.createDataFrame([(1, "a", 1, "x"), (2, "b", 1, "x"), (3, "c", 2, "y"), (4, "d", 3, "x"), (5, "d", 3, "y"), (6, "x", 3, "x"), (7, "e", 3, "x"), (8, "f", 4, "x"), (9, "g", 4, "y")], "seq long, voter string, term int, candidate string")
    lead = lambda names, quorum: sorted((r.term, r.leader, r.votes) for r in consensus.leaders(votes, "voter", "term", "candidate", "seq", spark.createDataFrame([(n,) for n in names], "n string"), quorum).collect())
    assert lead("abcde", "peers") == [(1, "x", 3), (3, "x", 3)]  # one vote of five, beside its own, is no majority
    assert lead("abcd", "strict") == [(1, "x", 3), (3, "x", 3)]
    assert lead("abcd", "peers") == [(1, "x", 3), (2, "y", 2), (3, "x", 3), (4, "x", 2), (4, "y", 2)]


def test_silence_and_step_down(spark):
    beats = spark.createDataFrame([("a", 0, 0), ("a", 1, 9), ("b", 2, 1), ("b", 3, 95), ("c", 4, 120)], "n string, seq long, t long")
    assert sorted((r.n, r.seq, r.gap_ms) for r in consensus.gaps(beats, "n", "t", "seq", 50, 100).collect()) == [("a", None, 91), ("b", 3, 94)]
    replies = spark.createDataFrame([("l", 0, 5, 5, 1), ("l", 0, 5, 5, 2), ("l", 0, 5, 9, 3), ("l", 1, 5, 6, 1), ("l", 1, 5, 5, 2)], "l string, beat long, term int, r int, seq long")
    assert [tuple(r) for r in consensus.step_downs(replies, "l", "beat", "term", "r", "seq", 4).collect()] == [("l", 1, 6)]


def test_guards(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i long, node string")
    assert [r.appended for r in consensus.leader_appends(df, F.col("node") == "a", "flag").orderBy("i").collect()] == [True, False]
    with pytest.raises(Exception, match="only a leader"):
        consensus.leader_appends(df, F.col("node") == "a").collect()
    nodes = spark.createDataFrame([("a",)], "name string")
    with pytest.raises(Exception, match="no node b"):
        consensus.known_node(df, nodes, "node", "name").count()
    assert consensus.known_node(df.where("i = 1"), nodes, "node", "name").count() == 1


def test_catch_up_counts_entries(spark):
    log = spark.createDataFrame([(i, f"e{i}") for i in (0, 1, 5, 9)], "i long, data string")
    followers = spark.createDataFrame([("a", 1), ("b", -1), ("c", 9), ("d", 3)], "follower string, last_index long")
    got = sorted(tuple(r) for r in consensus.catch_up(log, followers, "i").collect())
    assert got == [("a", 2, 5, 9), ("b", 4, 0, 9), ("d", 2, 5, 9)]
    sent = sorted((r.follower, r.i, r.data) for r in consensus.resend(log, followers, "i", 2).collect())
    assert sent == [("a", 5, "e5"), ("a", 9, "e9"), *[("b", i, f"e{i}") for i in (0, 1, 5, 9)], ("d", 5, "e5"), ("d", 9, "e9")]
    assert tuple(consensus.log_ends(log, "i").first()) == (4, 9) and tuple(consensus.log_ends(log.limit(0), "i").first()) == (0, -1)


def test_prefix_sum_of_far_values(spark):
    df = spark.createDataFrame([(i * 10**15, i) for i in range(-50, 50)], "o long, v long")
    got = {r.o: r.s for r in ordered.prefix_sum(df, [], "o", F.col("v"), "s").collect()}
    assert all(got[i * 10**15] == sum(range(-50, i + 1)) for i in range(-50, 50))


def test_stripes_of_text(spark):
    got = locks.stripes(spark.createDataFrame([("a",), ("b",), ("a",)], "k string"), "k", 4).collect()
    assert sum(r.n_keys for r in got) == 2 and sum(r.n_calls for r in got) == 3


def test_strict_map(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    assert optional.if_present(df, F.col("x")).count() == 1
    assert [r.m for r in df.select(optional.map_strict(F.col("x"), lambda x: x + 1).alias("m")).collect()] == [2, None]
    with pytest.raises(Exception, match="a value is required"):
        df.select(optional.map_strict(F.col("x"), lambda x: F.lit(None).cast("int"))).collect()


def test_pool_before_the_epoch(spark):
    tasks = spark.createDataFrame([("p", 0, -500, 10)], "p string, seq long, at long, takes long")
    assert [(r.start_ms, r.waited_ms) for r in pool.schedule(tasks, "p", "at", "seq", "takes", 2).collect()] == [(-500, 0)]
