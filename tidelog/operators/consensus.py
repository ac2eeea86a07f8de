"""Elections, heartbeats and replicated logs, read from their message logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import majority
from .ordered import fold, global_index, last_before, prefix_sum


def grants(requests: DataFrame, voter: str, term: str, candidate: str, seq: str) -> DataFrame:
    """Vote requests with granted: a lower term than any seen is denied; a new one is granted; the same one only to the candidate that had it.

    A row without a candidate is a heartbeat: a higher term is adopted and the vote
    cleared, so no request of that term is granted any more; its granted is null.
    """
    before = Window.partitionBy(voter).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    first = F.first(candidate).over(Window.partitionBy(voter, term).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    out = requests.withColumn("_seen", F.max(term).over(before)).withColumn("_first", first)
    new = F.col("_seen").isNull() | (F.col(term) > F.col("_seen"))
    same = (F.col(term) == F.col("_seen")) & F.coalesce(F.col(candidate) == F.col("_first"), F.lit(False))
    return out.withColumn("granted", F.when(F.col(candidate).isNotNull(), new | same)).drop("_seen", "_first")


def leaders(votes: DataFrame, voter: str, term: str, candidate: str, seq: str, members: DataFrame, quorum: str = "peers") -> DataFrame:
    """term, leader, votes: the candidates whose votes of a term make a majority of the cluster.

    A voter's first vote of a term counts, and a candidate has its own vote whether
    the log holds it or not. members has one row a node. The majority is taken of a
    candidate's peers, own vote included (`peers`: in an even cluster two may lead),
    or of all members (`strict`).
    """
    if quorum not in ("peers", "strict"):
        raise ValueError("quorum is peers or strict")
    first = votes.groupBy(term, voter).agg(F.min_by(candidate, seq).alias("candidate"))
    tally = first.groupBy(term, "candidate").agg((F.count_if(F.col(voter) != F.col("candidate")) + 1).alias("votes"))
    others = F.count(F.lit(1)) - (1 if quorum == "peers" else 0)
    need = members.agg(majority(others).alias("_need"))  # one row
    return tally.join(F.broadcast(need)).where("votes >= _need").select(term, F.col("candidate").alias("leader"), "votes")


def known_node(rows: DataFrame, nodes: DataFrame, name: str, node: str) -> DataFrame:
    """rows; reading one whose name is no node raises."""
    there = nodes.select(F.col(node).alias("_node")).distinct()
    lost = F.raise_error(F.concat(F.lit("no node "), F.coalesce(F.col(name).cast("string"), F.lit("null"))))
    return rows.join(there, F.col(name) == F.col("_node"), "left").where(F.when(F.col("_node").isNull(), lost.cast("boolean")).otherwise(True)).drop("_node")


def leader_appends(entries: DataFrame, leads: Column, refused: str = "fail") -> DataFrame:
    """Appends to a log: only a leader may. With refused `fail`, reading another's raises; with `flag`, appended says which went in."""
    if refused not in ("fail", "flag"):
        raise ValueError("refused is fail or flag")
    ok = F.coalesce(leads, F.lit(False))
    if refused == "flag":
        return entries.withColumn("appended", ok)
    return entries.where(F.when(ok, True).otherwise(F.raise_error(F.lit("only a leader appends to the log")).cast("boolean")))


def step_downs(replies: DataFrame, leader: str, beat: str, term: str, reply_term: str, seq: str, peers: int) -> DataFrame:
    """leader, beat, highest: heartbeats whose first replies, one fewer than a majority has votes, name a higher term than the leader's; it becomes a follower and keeps its term."""
    heard = F.row_number().over(Window.partitionBy(leader, beat).orderBy(seq)) <= peers // 2
    first = replies.withColumn("_heard", heard).where("_heard")
    return first.groupBy(leader, beat).agg(F.max(reply_term).alias("highest"), F.max(term).alias("_own")).where("highest > _own").drop("_own")


def gaps(beats: DataFrame, node: str, t_ms: str, seq: str, most_ms: int, until_ms: int | None = None) -> DataFrame:
    """Beats that came more than most_ms after the node's one before: an election timeout. node, seq, gap_ms.

    With until_ms, the instant of observation, a node that has been silent for
    longer than most_ms then gives a row too, without a seq.
    """
    before = F.lag(t_ms).over(Window.partitionBy(node).orderBy(t_ms, seq))
    out = beats.select(node, seq, (F.col(t_ms) - before).alias("gap_ms")).where(F.col("gap_ms") > most_ms)
    if until_ms is None:
        return out
    last = beats.where(F.col(t_ms) <= until_ms).groupBy(node).agg((F.lit(until_ms) - F.max(t_ms)).alias("gap_ms"))
    return out.unionByName(last.where(F.col("gap_ms") > most_ms).withColumn(seq, F.lit(None).cast(beats.schema[seq].dataType)))


def missed(beats: DataFrame, node: str, t_ms: str, period_ms: int) -> DataFrame:
    """Periods between a node's first and last beat without any: node, slot_ms."""
    slots = beats.select(node, (F.floor(F.col(t_ms) / period_ms) * period_ms).alias("slot_ms")).distinct()
    nxt = F.lead("slot_ms").over(Window.partitionBy(node).orderBy("slot_ms"))
    return slots.withColumn("_next", nxt).where(F.col("_next") > F.col("slot_ms") + period_ms).select(node, F.explode(F.sequence(F.col("slot_ms") + period_ms, F.col("_next") - period_ms, F.lit(period_ms).cast("long"))).alias("slot_ms"))


def terms(beats: DataFrame, node: str, term: str, seq: str) -> DataFrame:
    """Messages with the node's term after each, and whether it adopted a new one (and stepped down)."""
    before = F.max(term).over(Window.partitionBy(node).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1))
    out = beats.withColumn("_before", before)
    return out.withColumn("node_term", F.greatest(F.col(term), F.coalesce("_before", F.col(term)))).withColumn("stepped_down", F.col(term) > F.coalesce("_before", F.lit(0))).drop("_before")


def commits(entries: DataFrame, acks: DataFrame, entry: str, ack_seq: str, success: str, quorum: int) -> DataFrame:
    """entries with committed and commit_ack, the place among successes order of the one that reached the quorum (self counts one)."""
    nth = F.row_number().over(Window.partitionBy(entry).orderBy(ack_seq))
    reached = acks.where(F.col(success)).withColumn("_nth", nth).where(F.col("_nth") == quorum - 1).select(entry, F.col(ack_seq).alias("commit_ack"))
    if quorum <= 1:
        return entries.withColumn("committed", F.lit(True)).withColumn("commit_ack", F.lit(None).cast(acks.schema[ack_seq].dataType))
    return entries.join(reached, entry, "left").withColumn("committed", F.col("commit_ack").isNotNull())


def commit_index(committed: DataFrame, entry: str, out: str = "commit_index") -> DataFrame:
    """The index after each entry: entries without a majority stay in the log and don't advance it; -1 before the first."""
    return prefix_sum(committed, [], entry, F.col("committed").cast("long"), out).withColumn(out, F.col(out) - 1)


def catch_up(log: DataFrame, followers: DataFrame, index: str) -> DataFrame:
    """follower, n_missing, first_missing, last_missing of followers (follower, last_index) behind the log.

    The log's indexes may have holes: places are counted, and a follower looks up
    the place after its own; no other row of the log meets it.
    """
    placed = global_index(log.select(F.col(index).cast("long").alias("_at")), ["_at"], "_nth", first=1)
    ends = placed.agg(F.max("_nth").alias("_all"), F.max("_at").alias("last_missing"))
    behind = _places(placed, followers)
    first = behind.join(placed, F.col("_place") + 1 == F.col("_nth")).join(F.broadcast(ends))  # one row
    return first.select("follower", (F.col("_all") - F.col("_place")).alias("n_missing"), F.col("_at").alias("first_missing"), "last_missing")


def _places(placed: DataFrame, followers: DataFrame) -> DataFrame:
    """followers with _place, how many entries stand at or before their last index."""
    kind = followers.schema["follower"].dataType
    own = followers.select(F.col("last_index").cast("long").alias("_at"), F.lit(2).alias("_side"), F.lit(None).cast("long").alias("_nth"), "follower")
    both = placed.select("_at", F.lit(1).alias("_side"), F.col("_nth").cast("long"), F.lit(None).cast(kind).alias("follower")).unionByName(own)
    return last_before(both, ["_at", "_side"], "_nth", "_place").where("_side = 2").select("follower", F.coalesce("_place", F.lit(0)).alias("_place"))


def resend(log: DataFrame, followers: DataFrame, index: str, slice_rows: int = 1 << 16) -> DataFrame:
    """follower and the log's columns: the entries that each follower (follower, last_index) lacks, which a leader sends after a refusal.

    A follower's stretch of places is cut into slices and met slice by slice, an
    equi-join whose rows are the result's.
    """
    placed = global_index(log.withColumn("_at", F.col(index).cast("long")), ["_at"], "_nth", first=1).withColumn("_slice", F.expr(f"_nth div {slice_rows}"))
    last = placed.agg(F.max("_nth").alias("_all"))
    behind = _places(placed.select("_at", "_nth"), followers).join(F.broadcast(last)).where("_place < _all")  # one row
    slices = behind.select("follower", "_place", F.explode(F.expr(f"sequence((_place + 1) div {slice_rows}, _all div {slice_rows})")).alias("_slice"))
    return slices.join(placed, "_slice").where("_nth > _place").select("follower", *log.columns)


def log_ends(log: DataFrame, index: str) -> DataFrame:
    """One row: size and last_index (-1 of an empty log)."""
    return log.agg(F.count(F.lit(1)).alias("size"), F.coalesce(F.max(index).cast("long"), F.lit(-1).cast("long")).alias("last_index"))


def entries_between(log: DataFrame, index: str, start: int, end: int | None = None) -> DataFrame:
    """The slice from start, end exclusive."""
    return log.where((F.col(index) >= start) & (F.lit(True) if end is None else F.col(index) < end))


def apply_committed(log: DataFrame, node: str, index: str, data: str, commit: str, start, step, out: str, kind) -> DataFrame:
    """Committed entries (index up to the node's commit) with what a state machine, step(state, (data,)), answers to each in log order."""
    return fold(log.where(F.col(index) <= F.col(commit)), [node], [index], [data], start, step, out, kind)


def members_at(joins: DataFrame, node: str, joined_seq: str, seq: int) -> DataFrame:
    """The cluster's members once the log has come to seq."""
    return joins.where(F.col(joined_seq) <= seq).select(node).distinct()


def _follower_start() -> int:
    return 0


def _follower_step(size: int, args: tuple) -> tuple[int, dict]:
    n, commit_sent = args
    ok = size + n == commit_sent + 2
    size += n if ok else 0
    return size, {"accepted": ok, "last_index": size - 1}


def follow(requests: DataFrame, follower: str, seq: str, n_entries: str, commit: str) -> DataFrame:
    """Append requests with accepted and last_index, the follower's after it.

    A follower takes a request iff its log then has one entry more than the sender
    has committed (the request's commit index + 1 entries); else it answers where
    its log ends, from which the sender starts again.
    """
    run = fold(requests, [follower], [seq], [n_entries, commit], _follower_start, _follower_step, "_answer", "accepted boolean, last_index long")
    return run.select(*requests.columns, "_answer.*")


def role_changes(events: DataFrame, node: str, seq: str, role: Column) -> DataFrame:
    """Events at which a node's role differs from the one before: node, seq, role, previous."""
    before = F.lag("role").over(Window.partitionBy(node).orderBy(seq))
    out = events.select(node, seq, role.alias("role")).where("role IS NOT NULL").withColumn("previous", before)
    return out.where("previous IS NOT NULL AND previous <> role")
