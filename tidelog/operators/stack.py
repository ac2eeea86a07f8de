"""Replay of pushes and pops on one stack a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ordered import fold


def start() -> list:
    return []


def step(stack: list, args: tuple) -> tuple[list, object]:
    pop, value = args
    if not pop:
        stack.append(value)
        return stack, None
    return stack, stack.pop() if stack else None


def replay(ops: DataFrame, key: str, seq: str, pop: str, value: str, out: str = "popped") -> DataFrame:
    """The pops of ops with what each removes: the newest value left, null from an empty stack."""
    return fold(ops, [key], [seq], [pop, value], start, step, out, ops.schema[value].dataType).where(pop)


def attempts(ops: DataFrame, key: str) -> DataFrame:
    """Attempts a stack, retries included, from a log of compare-and-set attempts."""
    return ops.groupBy(key).agg(F.count(F.lit(1)).alias("attempts"))
