"""Streaming forms of the ordered folds and of the latest state.

A log streams in its order: rows of a later micro-batch are later rows. Inside a
batch they are sorted by (t_ms, seq) for each key, so a run over any cut into
batches gives the batch answer. State is kept as JSON text for each key.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.limits import SlidingWindow, TokenBucket
from ..operators.locks import Lease


def fold(stream: DataFrame, key: str, order: list[str], args: list[str], start: Callable[[], Any], step: Callable, out: str, kind: str, load: Callable = lambda s: s) -> DataFrame:
    """stream with out = step's answer, as tidelog.operators.ordered.fold over the whole log."""
    schema = StructType(list(stream.schema.fields)).add(out, kind)

    def run(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = load(json.loads(state.get[0])) if state.exists else start()
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        answers = []
        for a in zip(*(rows[c].tolist() for c in args), strict=True):
            now, answer = step(now, tuple(None if x is pd.NaT or x != x else x for x in a))
            answers.append(answer)
        state.update((json.dumps(list(now) if isinstance(now, deque) else now),))
        yield rows.assign(**{out: answers})

    return stream.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)


def admit(calls: DataFrame, limiter: SlidingWindow | TokenBucket, key: str, t_ms: str, seq: str, out: str = "allowed") -> DataFrame:
    load = deque if isinstance(limiter, SlidingWindow) else lambda s: s
    return fold(calls, key, [t_ms, seq], [t_ms], limiter.start, limiter.step, out, "boolean", load)


def lease_lock(log: DataFrame, key: str, t_ms: str, seq: str, unlock: str, lease_ms: str) -> DataFrame:
    return fold(log, key, [t_ms, seq], [t_ms, unlock, lease_ms], Lease.start, Lease.step, "granted", "boolean").where(~F.col(unlock))


def latest(log: DataFrame, key: str, seq: str, values: list[str]) -> DataFrame:
    """The running latest state, for output mode `update` or `complete`."""
    return log.groupBy(key).agg(F.max_by(F.struct(*values), seq).alias("s")).select(key, "s.*")


def silences(beats: DataFrame, node: str, ts: str, timeout: str, delay: str) -> DataFrame:
    """Sessions of beats no further apart than timeout: node, session start and end, beats; a session's end is an election timeout."""
    own = beats.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    return own.groupBy(node, F.session_window("_ts", timeout).alias("w")).agg(F.count(F.lit(1)).alias("beats")).select(node, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "beats")
