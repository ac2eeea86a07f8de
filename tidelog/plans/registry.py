"""All queries over the test tables and their DuckDB SQL, by name.

`events` stands for whatever log an operator reads: event_id is its order,
user_id its key, event_type its command.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import optional, scalars
from ..operators import assign, consensus, limits, locks, log_state, mvcc, pool, ring, stack, vclock
from ..sources import binary

#: Late enough that some last signups have expired and some have not.
NOW_MS = 1_707_264_000_000
DAY_MS = 86_400_000
#: The nodes of the micro-fixtures.
NODES = ["10.8.1.11:8080", "10.8.3.99:8080", "10.9.11.105:8080", "10.10.9.210:8080"]
REPLICAS = 20

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumn("t", scalars.epoch_ms(e["ts"]))


def is_(kind: str):
    return F.col("event_type") == kind


# --- latest state -----------------------------------------------------------


@query("SELECT user_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'error'")
def kv_latest_state(spark, sf_dir):
    return log_state.replay(table(spark, sf_dir, "events"), ["user_id"], "event_id", ["value"], is_("error"))


_TTL = "CASE WHEN event_type = 'signup' THEN epoch_us(ts) // 1000 + 86400000 ELSE -1 END"


def _with_ttl(spark, sf_dir):
    return events(spark, sf_dir).withColumn("expires", F.when(is_("signup"), F.col("t") + DAY_MS).otherwise(F.lit(-1).cast("long")))


@query(f"SELECT user_id, value FROM (SELECT user_id, value, event_type, {_TTL} AS expires FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_type <> 'error' AND (expires = -1 OR expires > {NOW_MS})")
def kv_get_ttl(spark, sf_dir):
    return log_state.visible(_with_ttl(spark, sf_dir), ["user_id"], "event_id", "value", "expires", is_("error"), NOW_MS)


@query(f"SELECT user_id, count(*) FILTER (expires <> -1 AND expires <= {NOW_MS}) AS expired_before FROM (SELECT *, {_TTL} AS expires FROM events) GROUP BY user_id HAVING arg_max(expires, event_id) = -1 AND expired_before > 0")
def kv_overwrite_clears_ttl(spark, sf_dir):
    return log_state.ttl_cleared(_with_ttl(spark, sf_dir), "user_id", "event_id", "expires", NOW_MS)


@query("SELECT user_id, event_id FROM (SELECT *, min(CASE WHEN event_type <> 'error' THEN event_id END) OVER (PARTITION BY user_id) AS first_put FROM events) WHERE event_type = 'error' AND (first_put IS NULL OR event_id < first_put)")
def kv_delete_noop(spark, sf_dir):
    return log_state.idle_deletes(table(spark, sf_dir, "events"), "user_id", "event_id", is_("error"))


@query("SELECT c_custkey, value FROM customer LEFT JOIN (SELECT user_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'error') ON c_custkey = user_id")
def kv_point_lookup(spark, sf_dir):
    return log_state.point_lookup(table(spark, sf_dir, "customer").select("c_custkey"), kv_latest_state(spark, sf_dir), "c_custkey", "user_id")


@query("SELECT user_id AS k, props AS v FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'click'")
def wal_replay(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "event_id", F.col("props").alias("v"), "event_type")
    return log_state.replay(log, ["k"], "event_id", ["v"], is_("click"))


@query("SELECT user_id % 10 AS store, 'KVStore[kv={' || string_agg(user_id || '=' || props, ', ' ORDER BY user_id) || '}]' AS rendered FROM (SELECT user_id, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'click') GROUP BY ALL")
def wal_render(spark, sf_dir):
    entries = wal_replay(spark, sf_dir).groupBy((F.col("k") % 10).alias("store")).agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("kv"))
    return entries.select("store", scalars.render_store(F.col("kv.k"), F.col("kv.v")).alias("rendered"))


# --- versions ---------------------------------------------------------------

_WRITES = "(SELECT user_id AS k, event_id AS ver, value FROM events WHERE event_type = 'purchase')"
_READS = "(SELECT user_id AS k, event_id AS ver FROM events WHERE event_type = 'view')"


def _versions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("ver"), "value", "event_type")
    return e.where(is_("purchase")).drop("event_type"), e.where(is_("view")).select("k", "ver")


@query(f"SELECT q.k, q.ver, w.value FROM {_READS} q ASOF JOIN {_WRITES} w ON q.k = w.k AND q.ver >= w.ver")
def mvcc_asof_get(spark, sf_dir):
    return mvcc.as_of(*_versions(spark, sf_dir), "k", "ver", "value")


@query(f"SELECT q.k, q.ver, w.value FROM (SELECT *, k * 100000000 + ver AS o FROM {_READS}) q ASOF JOIN (SELECT *, k * 100000000 + ver AS o FROM {_WRITES}) w ON q.o >= w.o")
def mvcc_literal_floor(spark, sf_dir):
    return mvcc.as_of_any_key(*_versions(spark, sf_dir), "k", "ver", "value")


@query(f"SELECT k, ver, row_number() OVER (ORDER BY ver) AS version FROM {_WRITES}")
def mvcc_versions(spark, sf_dir):
    out = mvcc.versions(_versions(spark, sf_dir)[0].select("k", "ver"), "ver")
    return out.withColumn("version", F.col("version").cast("long"))


# --- vector clocks ----------------------------------------------------------


def _clocks(spark, sf_dir):
    return vclock.increments(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("SELECT user_id, event_type, count(*) AS counter FROM events GROUP BY ALL")
def vclock_increment(spark, sf_dir):
    return _clocks(spark, sf_dir)


@query("SELECT grp, event_type, max(counter) AS counter FROM (SELECT user_id % 10 AS grp, user_id, event_type, count(*) AS counter FROM events GROUP BY ALL) GROUP BY ALL")
def vclock_merge(spark, sf_dir):
    return vclock.merge(_clocks(spark, sf_dir).withColumn("grp", F.col("user_id") % 10), "grp", "event_type")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
p AS (SELECT DISTINCT a.user_id AS a_id, b.user_id AS b_id FROM c a JOIN c b ON b.user_id = a.user_id + 1),
k AS (SELECT a_id, b_id, event_type FROM p, (SELECT DISTINCT event_type FROM c)),
s AS (SELECT a_id, b_id, max(coalesce(x.n, 0) > coalesce(y.n, 0)) AS more, max(coalesce(x.n, 0) < coalesce(y.n, 0)) AS less FROM k LEFT JOIN c x ON x.user_id = a_id AND x.event_type = k.event_type LEFT JOIN c y ON y.user_id = b_id AND y.event_type = k.event_type GROUP BY a_id, b_id)
SELECT a_id, b_id, (CASE WHEN more AND NOT less THEN 1 WHEN less AND NOT more THEN -1 ELSE 0 END)::INT AS cmp, CASE WHEN more AND less THEN 'CONCURRENT' WHEN more THEN 'AFTER' WHEN less THEN 'BEFORE' ELSE 'EQUAL' END AS relation FROM s""")
def vclock_compare(spark, sf_dir):
    clocks = _clocks(spark, sf_dir)
    ids = clocks.select("user_id").distinct()
    nxt = ids.select((F.col("user_id") - 1).alias("a_id"), F.col("user_id").alias("b_id"))
    pairs = nxt.join(ids, F.col("a_id") == ids["user_id"]).drop("user_id")
    return vclock.compare(pairs, clocks, "user_id", "event_type")


# --- consistent hashing -----------------------------------------------------

_RING = "ring AS (SELECT ('0x' || substr(md5(n || '-' || v), 1, 8))::BIGINT AS h, arg_max(n, i * 1000 + v) AS n FROM (SELECT unnest([" + ", ".join(f"'{n}'" for n in NODES) + f"]) AS n, unnest(range({len(NODES)})) AS i), (SELECT unnest(range({REPLICAS})) AS v) GROUP BY h)"
_KEYS = "o AS (SELECT event_id, ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT AS h FROM events)"
_ROUTED = "SELECT event_id, coalesce(r.n, (SELECT arg_min(n, h) FROM {ring})) AS {name} FROM o ASOF LEFT JOIN {ring} r ON o.h <= r.h"


def _ring(spark, hash_fn=ring.md5_prefix):
    nodes = spark.createDataFrame([(n, REPLICAS, i) for i, n in enumerate(NODES)], "node_key string, replicas int, added int")
    return ring.build(nodes, hash_fn)


def _routed(spark, sf_dir, on=None):
    keys = table(spark, sf_dir, "events").select("event_id")
    return ring.route(keys, on or _ring(spark), ring.md5_prefix(F.col("event_id").cast("string")))


@query(f"WITH {_RING}, {_KEYS} {_ROUTED.format(ring='ring', name='node_key')}")
def ring_route(spark, sf_dir):
    return _routed(spark, sf_dir)


@query(f"WITH {_RING}, {_KEYS}, less AS (SELECT * FROM ring WHERE n <> '{NODES[1]}'), a AS ({_ROUTED.format(ring='ring', name='before')}), b AS ({_ROUTED.format(ring='less', name='after')}) SELECT event_id, before, after FROM a JOIN b USING (event_id) WHERE before <> after")
def ring_remove_node(spark, sf_dir):
    """The keys that move when a node leaves: its own and no others, so only those are routed again."""
    whole = _ring(spark)
    moved = _routed(spark, sf_dir, whole).where(F.col("node_key") == NODES[1]).withColumnRenamed("node_key", "before")
    again = ring.route(moved, ring.without(whole, NODES[1]), ring.md5_prefix(F.col("event_id").cast("string")))
    return again.withColumnRenamed("node_key", "after")


@query(f"WITH {_RING}, {_KEYS} SELECT node_key, count(*) AS n_keys FROM ({_ROUTED.format(ring='ring', name='node_key')}) GROUP BY ALL")
def ring_load(spark, sf_dir):
    return _routed(spark, sf_dir).groupBy("node_key").agg(F.count(F.lit(1)).alias("n_keys"))


#: MurmurHash3 x86 32-bit by its definition, in 128-bit integers so that products don't overflow.
_M32 = "4294967296::HUGEINT"


def _rotl(x: str, r: int) -> str:
    return f"(({x} * {1 << r}) % {_M32} + {x} // {1 << 32 - r})"


def _x(a: str, b: str) -> str:
    return f"xor(({a})::BIGINT, ({b})::BIGINT)::HUGEINT"


def _murmur(text: str) -> str:
    """SQL: the signed hash of a text whose length is of ASCII characters."""
    byte = lambda i, j: f"coalesce(ascii(nullif(substr({text}, (4 * {i} + {j} + 1)::INT, 1), '')), 0)"
    block = lambda i: f"({byte(i, 0)} + {byte(i, 1)} * 256 + {byte(i, 2)} * 65536 + {byte(i, 3)}::HUGEINT * 16777216)"
    stir = lambda k: "((" + _rotl(f"(({k} * 3432918353) % {_M32})", 15) + f") * 461845907) % {_M32}"
    blocks = f"list_transform(range(length({text}) // 4), lambda i: {stir(block('i'))})"
    body = f"list_reduce(list_prepend(0::HUGEINT, {blocks}), lambda h, k: ({_rotl(_x('h', 'k'), 13)} * 5 + 3864292196) % {_M32})"
    rest = f"CASE WHEN length({text}) % 4 > 0 THEN {stir(block(f'(length({text}) // 4)'))} ELSE 0::HUGEINT END"
    steps = [(16, 2246822507), (13, 3266489909)]
    out = f"list_prepend({_x(_x(body, rest), f'length({text})')}, [0::HUGEINT])"
    value = f"{out}[1]"
    for shift, times in steps:
        value = f"list_transform([{value}], lambda z: ({_x('z', f'z // {1 << shift}')} * {times}) % {_M32})[1]"
    value = f"list_transform([{value}], lambda z: {_x('z', 'z // 65536')})[1]"
    return f"(({value} + 2147483648) % {_M32} - 2147483648)::BIGINT"


_RING_M = f"ring AS (SELECT {_murmur('key')} AS h, arg_max(n, i * 1000 + v) AS n FROM (SELECT n, i, v, n || '-' || v AS key FROM (SELECT unnest([" + ", ".join(f"'{n}'" for n in NODES) + f"]) AS n, unnest(range({len(NODES)})) AS i), (SELECT unnest(range({REPLICAS})) AS v)) GROUP BY h)"


@query(f"WITH {_RING_M}, o AS (SELECT event_id, {_murmur('key')} AS h FROM (SELECT event_id, event_id::VARCHAR AS key FROM events)) {_ROUTED.format(ring='ring', name='node_key')}")
def ring_route_murmur(spark, sf_dir):
    keys = table(spark, sf_dir, "events").select("event_id")
    return ring.route(keys, _ring(spark, scalars.murmur3_32), scalars.murmur3_32(F.col("event_id").cast("string")), -(2**31), 2**31 - 1)


# --- admission --------------------------------------------------------------

_B = "b AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"
_W = 43_200_000


@query(f"""WITH RECURSIVE {_B}, r AS (SELECT user_id, event_id, rn, true AS allowed, [t] AS q FROM b WHERE rn = 1
UNION ALL SELECT b.user_id, b.event_id, b.rn, len(list_filter(r.q, lambda z: z >= b.t - {_W})) < 2,
CASE WHEN len(list_filter(r.q, lambda z: z >= b.t - {_W})) < 2 THEN list_append(list_filter(r.q, lambda z: z >= b.t - {_W}), b.t) ELSE list_filter(r.q, lambda z: z >= b.t - {_W}) END
FROM r JOIN b ON b.user_id = r.user_id AND b.rn = r.rn + 1) SELECT user_id, event_id, allowed FROM r""")
def rate_sliding(spark, sf_dir):
    calls = events(spark, sf_dir).select("user_id", "event_id", "t")
    return limits.admit(calls, limits.SlidingWindow(2, 43_200), "user_id", "t", "event_id").drop("t")


_GAIN = "((b.t - r.last)::DOUBLE / 1000.0 * (3.0::DOUBLE / 43200.0))"


@query(f"""WITH RECURSIVE {_B}, r AS (SELECT user_id, event_id, rn, true AS allowed, 2::BIGINT AS tokens, t AS last FROM b WHERE rn = 1
UNION ALL SELECT user_id, event_id, rn, have > 0, have - (have > 0)::BIGINT, last FROM (SELECT b.user_id, b.event_id, b.rn,
CASE WHEN floor({_GAIN}) > 0 THEN floor(least(3.0::DOUBLE, r.tokens + {_GAIN}))::BIGINT ELSE r.tokens END AS have, CASE WHEN floor({_GAIN}) > 0 THEN b.t ELSE r.last END AS last
FROM r JOIN b ON b.user_id = r.user_id AND b.rn = r.rn + 1)) SELECT user_id, event_id, allowed FROM r""")
def rate_token_bucket(spark, sf_dir):
    calls = events(spark, sf_dir).select("user_id", "event_id", "t")
    return limits.admit(calls, limits.TokenBucket(3, 43_200), "user_id", "t", "event_id").drop("t")


# --- locks ------------------------------------------------------------------

_L = "l AS (SELECT event_id, user_id % 20 AS key, event_type = 'error' AS u, epoch_us(ts) // 1000 AS t FROM events)"


def _locks(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", (F.col("user_id") % 20).alias("key"), is_("error").alias("u"), "t")


@query(f"WITH {_L}, g AS (SELECT *, sum(u::INT) OVER (PARTITION BY key ORDER BY event_id) AS turn FROM l) SELECT event_id, key, row_number() OVER (PARTITION BY key, turn ORDER BY event_id) = 1 AS granted FROM g WHERE NOT u")
def lock_try(spark, sf_dir):
    return locks.try_lock(_locks(spark, sf_dir), "key", "event_id", F.col("u")).select("event_id", "key", "granted")


@query(f"""WITH RECURSIVE {_L}, b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, event_id) AS rn FROM l),
r AS (SELECT event_id, key, rn, u, NOT u AS granted, CASE WHEN u THEN -1 ELSE t + 21600000 END AS ends FROM b WHERE rn = 1
UNION ALL SELECT b.event_id, b.key, b.rn, b.u, NOT b.u AND r.ends <= b.t, CASE WHEN b.u THEN -1 WHEN r.ends <= b.t THEN b.t + 21600000 ELSE r.ends END
FROM r JOIN b ON b.key = r.key AND b.rn = r.rn + 1) SELECT event_id, key, granted FROM r WHERE NOT u""")
def lock_lease(spark, sf_dir):
    log = _locks(spark, sf_dir).withColumn("lease", F.lit(21_600_000).cast("long"))
    return locks.lease_lock(log, "key", "t", "event_id", "u", "lease").select("event_id", "key", "granted")


@query("SELECT (user_id % 16)::INT AS stripe, count(DISTINCT user_id) AS n_keys, count(*) AS n_calls FROM events GROUP BY ALL")
def lock_stripes(spark, sf_dir):
    return locks.stripes(table(spark, sf_dir, "events"), "user_id", 16)


@query("SELECT event_id, user_id, sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS depth FROM events")
def lock_queue_depth(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return locks.queue_depth(log, "user_id", "event_id", F.when(is_("error"), -1).otherwise(1)).drop("event_type")


# --- claims -----------------------------------------------------------------

_CLAIMS = "claims AS (SELECT n AS node, ((n * 167 + i) % 500)::INT AS part, i * 3 + n AS seq FROM (SELECT unnest(range(3)) AS n), (SELECT unnest(range(500)) AS i))"


def _claims(spark):
    nodes = spark.range(3).select(F.col("id").cast("int").alias("node"))
    return assign.circular_claims(nodes, 500, F.col("node") * 167)


@query(f"WITH {_CLAIMS} SELECT part AS partition, arg_min(node, seq)::INT AS node FROM claims GROUP BY part")
def partition_claims(spark, sf_dir):
    return assign.winners(_claims(spark))


@query(f"WITH {_CLAIMS}, w AS (SELECT part, arg_min(node, seq)::INT AS node FROM claims GROUP BY part) SELECT node, count(*) AS n_partitions, min(part) AS first_partition FROM w GROUP BY node")
def partition_owners(spark, sf_dir):
    own = assign.owned(assign.winners(_claims(spark)))
    return own.select("node", F.size("partitions").cast("long").alias("n_partitions"), F.col("partitions")[0].alias("first_partition"))


# --- elections and heartbeats -----------------------------------------------

_VOTES = "v AS (SELECT event_id, user_id, day(ts)::INT AS term, (json_extract_string(props, '$.k')::BIGINT % 2)::INT AS candidate FROM events)"


def _votes(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.dayofmonth("ts").alias("term"), (k % 2).cast("int").alias("candidate"))


@query(f"WITH {_VOTES}, f AS (SELECT term, user_id, arg_min(candidate, event_id) AS candidate FROM v GROUP BY ALL), c AS (SELECT term, candidate, 1 + count(*) FILTER (user_id <> candidate) AS votes FROM f GROUP BY ALL) SELECT term, candidate AS leader, votes FROM c WHERE votes >= (SELECT (count(*) - 1) // 2 + 1 FROM (SELECT DISTINCT user_id FROM v WHERE user_id % 4 > 0))")
def election_leader(spark, sf_dir):
    """Of a cluster of three in four users, by the majority that a candidate takes of its peers."""
    votes = _votes(spark, sf_dir)
    return consensus.leaders(votes, "user_id", "term", "candidate", "event_id", votes.select("user_id").distinct().where("user_id % 4 > 0"))


@query(f"WITH {_VOTES}, f AS (SELECT term, user_id, arg_min(candidate, event_id) AS candidate FROM v GROUP BY ALL), c AS (SELECT term, candidate, 1 + count(*) FILTER (user_id <> candidate) AS votes FROM f GROUP BY ALL) SELECT term, candidate AS leader, votes FROM c WHERE votes >= (SELECT count(*) // 2 + 1 FROM (SELECT DISTINCT user_id FROM v WHERE user_id % 4 > 0))")
def election_leader_strict(spark, sf_dir):
    votes = _votes(spark, sf_dir)
    return consensus.leaders(votes, "user_id", "term", "candidate", "event_id", votes.select("user_id").distinct().where("user_id % 4 > 0"), "strict")


@query(f"WITH {_VOTES}, w AS (SELECT *, max(term) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, first(candidate) OVER (PARTITION BY user_id, term ORDER BY event_id) AS f FROM v) SELECT event_id, seen IS NULL OR term > seen OR (term = seen AND candidate = f) AS granted FROM w")
def vote_grants(spark, sf_dir):
    return consensus.grants(_votes(spark, sf_dir), "user_id", "term", "candidate", "event_id").select("event_id", "granted")


@query(f"""WITH RECURSIVE {_VOTES}, b AS (SELECT event_id, user_id, term, CASE WHEN event_id % 3 > 0 THEN candidate END AS candidate, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM v),
r AS (SELECT event_id, user_id, rn, term, candidate AS voted, CASE WHEN candidate IS NOT NULL THEN true END AS granted FROM b WHERE rn = 1
UNION ALL SELECT b.event_id, b.user_id, b.rn, greatest(b.term, r.term), CASE WHEN b.term > r.term THEN b.candidate ELSE r.voted END, CASE WHEN b.candidate IS NULL THEN NULL WHEN b.term < r.term THEN false WHEN b.term > r.term THEN true ELSE coalesce(r.voted = b.candidate, false) END
FROM r JOIN b ON b.user_id = r.user_id AND b.rn = r.rn + 1) SELECT event_id, granted FROM r""")
def vote_grants_heartbeats(spark, sf_dir):
    """Every third message is a heartbeat: it brings its term and clears the vote."""
    log = _votes(spark, sf_dir).withColumn("candidate", F.when(F.col("event_id") % 3 > 0, F.col("candidate")))
    return consensus.grants(log, "user_id", "term", "candidate", "event_id").select("event_id", "granted")


@query(f"WITH {_VOTES}, w AS (SELECT *, max(term) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM v) SELECT event_id, greatest(term, coalesce(seen, term)) AS node_term, term > coalesce(seen, 0) AS stepped_down FROM w")
def heartbeat_terms(spark, sf_dir):
    return consensus.terms(_votes(spark, sf_dir), "user_id", "term", "event_id").select("event_id", "node_term", "stepped_down")


@query("SELECT user_id, event_id, gap_ms FROM (SELECT user_id, event_id, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_ms FROM events) WHERE gap_ms > 86400000")
def heartbeat_gaps(spark, sf_dir):
    return consensus.gaps(events(spark, sf_dir), "user_id", "t", "event_id", DAY_MS)


@query(f"SELECT user_id, event_id, gap_ms FROM (SELECT user_id, event_id, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_ms FROM events) WHERE gap_ms > 86400000 UNION ALL SELECT user_id, NULL, {NOW_MS} - max(epoch_us(ts) // 1000) AS gap_ms FROM events WHERE epoch_us(ts) // 1000 <= {NOW_MS} GROUP BY user_id HAVING gap_ms > 86400000")
def heartbeat_silent(spark, sf_dir):
    """Timeouts up to an instant, of nodes that have stopped for good too."""
    return consensus.gaps(events(spark, sf_dir), "user_id", "t", "event_id", DAY_MS, NOW_MS)


@query("""WITH q AS (SELECT user_id % 7 AS leader, event_id // 70 AS beat, 20 AS term, day(ts)::INT AS reply, row_number() OVER (PARTITION BY user_id % 7, event_id // 70 ORDER BY event_id) AS nth FROM events)
SELECT leader, beat, max(reply) AS highest FROM q WHERE nth <= 2 GROUP BY ALL HAVING max(reply) > 20""")
def leader_steps_down(spark, sf_dir):
    """Replies of five nodes' four peers: a leader hears two, and a higher term among them ends its lead."""
    replies = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("leader"), F.expr("event_id div 70").alias("beat"), F.lit(20).alias("term"), F.dayofmonth("ts").alias("reply"), "event_id")
    return consensus.step_downs(replies, "leader", "beat", "term", "reply", "event_id", 4)


@query("""WITH s AS (SELECT DISTINCT user_id, epoch_us(ts) // 1000 // 86400000 AS d FROM events), n AS (SELECT *, lead(d) OVER (PARTITION BY user_id ORDER BY d) AS e FROM s)
SELECT user_id, unnest(range(d + 1, e)) * 86400000 AS slot_ms FROM n WHERE e > d + 1""")
def heartbeat_missed(spark, sf_dir):
    return consensus.missed(events(spark, sf_dir), "user_id", "t", DAY_MS)


_ROLE = "CASE event_type WHEN 'purchase' THEN 'LEADER' WHEN 'signup' THEN 'CANDIDATE' WHEN 'error' THEN 'FOLLOWER' END"


@query(f"SELECT user_id, event_id, role, previous FROM (SELECT *, lag(role) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM (SELECT user_id, event_id, {_ROLE} AS role FROM events) WHERE role IS NOT NULL) WHERE previous <> role")
def role_changes(spark, sf_dir):
    return consensus.role_changes(table(spark, sf_dir, "events"), "user_id", "event_id", F.expr(_ROLE))


# --- replicated log ---------------------------------------------------------

_COMMITS = """a AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS rn FROM lineitem WHERE l_returnflag <> 'R'),
c AS (SELECT o_orderkey, l_orderkey IS NOT NULL AS committed, l_linenumber AS commit_ack FROM orders LEFT JOIN a ON o_orderkey = l_orderkey AND rn = 2)"""


def _commits(spark, sf_dir):
    entries = table(spark, sf_dir, "orders").select("o_orderkey")
    acks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_shipdate", "l_linenumber").alias("at"), (F.col("l_returnflag") != "R").alias("success"))
    return consensus.commits(entries, acks, "o_orderkey", "at", "success", 3)


@query(f"WITH {_COMMITS} SELECT o_orderkey, committed, commit_ack FROM c")
def log_commit(spark, sf_dir):
    return _commits(spark, sf_dir).select("o_orderkey", "committed", F.col("commit_ack.l_linenumber").alias("commit_ack"))


@query(f"WITH {_COMMITS} SELECT o_orderkey, (sum(committed::INT) OVER (ORDER BY o_orderkey) - 1)::BIGINT AS commit_index FROM c")
def log_commit_index(spark, sf_dir):
    return consensus.commit_index(_commits(spark, sf_dir).select("o_orderkey", "committed"), "o_orderkey").select("o_orderkey", "commit_index")


_FOLLOWERS = "(SELECT f, f * 250 - 1 AS last FROM (SELECT unnest(range(8)) AS f))"


def _behind(spark, sf_dir):
    """A log with holes, and how far eight followers have come."""
    followers = spark.range(8).select(F.col("id").alias("follower"), (F.col("id") * 250 - 1).alias("last_index"))
    return table(spark, sf_dir, "events").where(~is_("view")).select("event_id", "user_id"), followers


@query(f"SELECT f AS follower, count(*) AS n_missing, min(event_id) AS first_missing, max(event_id) AS last_missing FROM {_FOLLOWERS} JOIN events ON event_id > last WHERE event_type <> 'view' GROUP BY f")
def log_catchup(spark, sf_dir):
    return consensus.catch_up(*_behind(spark, sf_dir), "event_id")


@query(f"SELECT f AS follower, event_id, user_id FROM {_FOLLOWERS} JOIN events ON event_id > last WHERE event_type <> 'view'")
def log_resend(spark, sf_dir):
    return consensus.resend(*_behind(spark, sf_dir), "event_id", 1000)


@query("SELECT count(*) AS size, coalesce(max(event_id), -1) AS last_index FROM events")
def log_ends(spark, sf_dir):
    return consensus.log_ends(table(spark, sf_dir, "events"), "event_id")


@query("SELECT event_id, user_id % 3 = 0 AS appended FROM events")
def log_append_guard(spark, sf_dir):
    """Entries that node user_id % 3 appends where node 0 leads."""
    return consensus.leader_appends(table(spark, sf_dir, "events").select("event_id", "user_id"), F.col("user_id") % 3 == 0, "flag").select("event_id", "appended")


@query("SELECT event_id, user_id FROM events WHERE event_id >= 100 AND event_id < 300")
def log_slice(spark, sf_dir):
    return consensus.entries_between(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id", 100, 300)


@query("""WITH RECURSIVE b AS (SELECT event_id, user_id, 1 + json_extract_string(props, '$.k')::BIGINT % 3 AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
m AS (SELECT event_id, user_id, n, rn, rn - 2 AS leader_commit FROM b),
r AS (SELECT event_id, user_id, rn, 0 + n = leader_commit + 2 AS accepted, CASE WHEN n = leader_commit + 2 THEN n ELSE 0 END::BIGINT AS size FROM m WHERE rn = 1
UNION ALL SELECT event_id, user_id, rn, ok, size + CASE WHEN ok THEN n ELSE 0 END FROM (SELECT m.*, r.size, r.size + m.n = m.leader_commit + 2 AS ok FROM r JOIN m ON m.user_id = r.user_id AND m.rn = r.rn + 1))
SELECT event_id, user_id, accepted, size - 1 AS last_index FROM r""")
def log_follow(spark, sf_dir):
    """The i-th request to a follower (from 0) comes when its leader has committed entries up to i - 1, with one to three entries."""
    k = F.get_json_object("props", "$.k").cast("long")
    log = table(spark, sf_dir, "events").select("event_id", "user_id", (k % 3 + 1).alias("n"))
    sent = log.withColumn("sent", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long") - 2)
    return consensus.follow(sent, "user_id", "event_id", "n", "sent").select("event_id", "user_id", "accepted", "last_index")


# --- stack, nulls, checksums --------------------------------------------------


@query("""WITH RECURSIVE b AS (SELECT event_id, user_id, event_type IN ('error', 'view') AS pop, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
r AS (SELECT event_id, user_id, rn, pop, NULL::BIGINT AS popped, CASE WHEN pop THEN []::BIGINT[] ELSE [event_id] END AS st FROM b WHERE rn = 1
UNION ALL SELECT b.event_id, b.user_id, b.rn, b.pop, CASE WHEN b.pop AND len(r.st) > 0 THEN r.st[-1] END, CASE WHEN NOT b.pop THEN list_append(r.st, b.event_id) WHEN len(r.st) > 0 THEN r.st[:-2] ELSE r.st END
FROM r JOIN b ON b.user_id = r.user_id AND b.rn = r.rn + 1) SELECT event_id, user_id, popped FROM r WHERE pop""")
def stack_replay(spark, sf_dir):
    ops = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").isin("error", "view").alias("pop"), F.col("event_id").alias("v"))
    return stack.replay(ops, "user_id", "event_id", "pop", "v").select("event_id", "user_id", "popped")


@query("SELECT event_id, CASE WHEN event_type = 'purchase' THEN value * 2 END AS mapped, event_type = 'purchase' AS present, CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END AS or_else, CASE WHEN event_type = 'purchase' AND value > 50 THEN value END AS flat FROM events")
def null_semantics(spark, sf_dir):
    x = F.when(is_("purchase"), F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", optional.map_(x, lambda v: v * 2).alias("mapped"), optional.is_present(x).alias("present"), optional.or_else(x, 0.0).alias("or_else"), optional.flat_map(x, lambda v: F.when(v > 50, v)).alias("flat"))


#: CRC-32 by its definition: a table of 256 remainders of the reflected polynomial 0xEDB88320, then a byte a step.
_STEP = "CASE WHEN {x} & 1 = 1 THEN xor({x} >> 1, 3988292384) ELSE {x} >> 1 END"
_CRC_TABLE = "t AS MATERIALIZED (SELECT list(x ORDER BY n) AS tbl FROM (SELECT n, x0 AS x FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda x, i: " + _STEP.format(x="x") + ") AS x0 FROM (SELECT unnest(range(256)) AS n))))"


def _bytes(text: str) -> str:
    """SQL: the UTF-8 bytes of a text, or of what is hex if it begins so."""
    digits = f"hex({text})"
    return f"list_transform(range(length({digits}) // 2), lambda i: ('0x' || substr({digits}, 2 * i + 1, 2))::BIGINT)"


def _crc(text: str) -> str:
    """SQL: the signed CRC-32 of a text's UTF-8 bytes, beside _CRC_TABLE."""
    value = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {_bytes(text)}), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295)"
    return f"(({value} + 2147483648) % 4294967296 - 2147483648)"


@query(f"WITH {_CRC_TABLE} SELECT event_id, {_crc('props')}::BIGINT AS checksum FROM events, t")
def crc_audit(spark, sf_dir):
    """Signed checksums of props, as a data file holds them."""
    return table(spark, sf_dir, "events").select("event_id", scalars.signed_crc32(F.col("props")).alias("checksum"))


@query("SELECT event_type, count(*) AS attempts FROM events GROUP BY ALL")
def stack_attempts(spark, sf_dir):
    return stack.attempts(table(spark, sf_dir, "events"), "event_type")


# --- worker pool --------------------------------------------------------------


@query("""WITH RECURSIVE b AS (SELECT event_id, user_id % 7 AS pool, epoch_us(ts) // 1000 AS t, 3600000 + event_id % 5 * 7200000 AS d, row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT event_id, pool, rn, t AS start_ms, 0::BIGINT AS waited_ms, list_sort([t + d, 0, 0]::BIGINT[]) AS free FROM b WHERE rn = 1
UNION ALL SELECT b.event_id, b.pool, b.rn, greatest(b.t, r.free[1]), greatest(b.t, r.free[1]) - b.t, list_sort([greatest(b.t, r.free[1]) + b.d, r.free[2], r.free[3]]) FROM r JOIN b ON b.pool = r.pool AND b.rn = r.rn + 1)
SELECT event_id, pool, start_ms, waited_ms FROM r""")
def pool_schedule(spark, sf_dir):
    tasks = events(spark, sf_dir).select("event_id", (F.col("user_id") % 7).alias("pool"), "t", (F.col("event_id") % 5 * 7_200_000 + 3_600_000).alias("d"))
    return pool.schedule(tasks, "pool", "t", "event_id", "d", 3).select("event_id", "pool", "start_ms", "waited_ms")


# --- binary files ---------------------------------------------------------------

_FILES = 8
_KV_ROWS = f"SELECT 'f' || user_id % {_FILES} AS file, event_id, user_id::VARCHAR AS key, CASE WHEN event_type = 'error' THEN '' ELSE props END AS value, CASE WHEN event_type = 'signup' THEN epoch_us(ts) // 1000 ELSE -1 END AS ttl FROM events"
_KV_PLACED = f"kv AS (SELECT *, 17 + strlen(key) + strlen(value) AS size, (sum(17 + strlen(key) + strlen(value)) OVER (PARTITION BY file ORDER BY event_id) - 17 - strlen(key) - strlen(value))::BIGINT AS seq FROM ({_KV_ROWS}))"


def _kv_records(spark, sf_dir):
    """The events as records of eight data files, with their bytes."""
    e = events(spark, sf_dir).select(
        F.concat(F.lit("f"), (F.col("user_id") % _FILES).cast("string")).alias("file"),
        "event_id",
        F.encode(F.col("user_id").cast("string"), "UTF-8").alias("key"),
        F.encode(F.when(is_("error"), "").otherwise(F.col("props")), "UTF-8").alias("value"),
        F.when(is_("signup"), F.col("t")).otherwise(F.lit(-1).cast("long")).alias("ttl"),
    )
    return e.withColumn("record", binary.kv_record(F.col("key"), F.col("value"), F.col("ttl")))


def _text(*names: str) -> list:
    return [F.decode(F.col(n), "UTF-8").alias(n) for n in names]


@query(f"WITH {_CRC_TABLE}, {_KV_PLACED} SELECT file, seq, {_crc('value')}::INT AS checksum, ttl, key, value, value = '' AS deleted FROM kv, t")
def kv_file_scan(spark, sf_dir):
    """Data files, encoded and read again with their checksums verified."""
    files = binary.file_of(_kv_records(spark, sf_dir), "file", ["event_id"], "record")
    out = binary.decode(files.withColumnRenamed("file", "path"), "kv", verify=True)
    return out.select("file", "seq", "checksum", "ttl", *_text("key", "value"), scalars.is_tombstone(F.col("value")).alias("deleted"))


@query(f"WITH {_KV_PLACED} SELECT file, key, seq::INT AS record_offset, size::INT AS record_size, value FROM kv QUALIFY row_number() OVER (PARTITION BY file, key ORDER BY seq DESC) = 1")
def kv_file_lookup(spark, sf_dir):
    """Index files over the data files: the last entry of a key says where its record stands, which is read there."""
    files = binary.file_of(_kv_records(spark, sf_dir), "file", ["event_id"], "record")
    found = binary.decode(files.withColumnRenamed("file", "path"), "kv")
    entries = found.select("file", F.col("seq").alias("at"), "key", F.col("seq").cast("int").alias("o"), (F.octet_length("key") + F.octet_length("value") + 17).cast("int").alias("s"))
    index_files = binary.file_of(entries.withColumn("record", binary.index_entry(F.col("key"), F.col("o"), F.col("s"))), "file", ["at"], "record")
    index = log_state.latest(binary.decode(index_files.withColumnRenamed("file", "path"), "index"), ["file", "key"], "seq", ["record_offset", "record_size"])
    read = binary.record_at(files, index, "file")
    one = binary.decode(read.select("record", F.to_json(F.struct("file", F.decode("key", "UTF-8").alias("key"), "record_offset", "record_size")).alias("path")), "kv", verify=True, content="record")
    at = F.from_json("file", "file string, key string, record_offset int, record_size int").alias("at")
    return one.select(at, *_text("value")).select("at.*", "value")


@query("SELECT user_id::VARCHAR AS key, props AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'click'")
def wal_file_replay(spark, sf_dir):
    """Write-ahead logs, encoded, read again and replayed."""
    log = table(spark, sf_dir, "events").select((F.col("user_id") % _FILES).alias("file"), "event_id", binary.wal_command(F.when(is_("click"), "DEL").otherwise("SET"), F.col("user_id").cast("string"), F.col("props")).alias("record"))
    out = binary.decode(binary.file_of(log, "file", ["event_id"], "record").withColumnRenamed("file", "path"), "wal")
    return log_state.replay(out, ["key"], "seq", ["value"], F.col("op") == "DEL")
