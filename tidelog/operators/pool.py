"""What a fixed pool of workers with one first-in-first-out queue does with a log of submitted tasks."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, functions as F

from .ordered import fold


class Pool:
    """Each task starts on the worker that is free first, no sooner than it was submitted; ties go to the lower worker."""

    def __init__(self, workers: int):
        if workers < 1:
            raise ValueError("a pool has one worker or more")
        self.workers = workers

    def start(self) -> list:
        return [(-(1 << 62), i) for i in range(self.workers)]  # free before any task

    def step(self, free: list, args: tuple) -> tuple[list, dict]:
        at, takes = args
        when, worker = heapq.heappop(free)
        begin = max(at, when)
        heapq.heappush(free, (begin + takes, worker))
        return free, {"worker": worker, "start_ms": begin, "end_ms": begin + takes}


def schedule(tasks: DataFrame, pool: str, submit_ms: str, seq: str, takes_ms: str, workers: int) -> DataFrame:
    """tasks with worker, start_ms, end_ms and waited_ms, for each pool in order of (submit_ms, seq)."""
    p = Pool(workers)
    run = fold(tasks, [pool], [submit_ms, seq], [submit_ms, takes_ms], p.start, p.step, "_run", "worker int, start_ms long, end_ms long")
    return run.select(*tasks.columns, "_run.*").withColumn("waited_ms", F.col("start_ms") - F.col(submit_ms))
