"""Helpers for tasks that read rows sorted by a key: whole runs from a stream of Arrow batches, and links of a forest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows gathered before complete runs are handed on.
GATHER = 1 << 16


def whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of complete runs of equal `key`; the rows must come sorted by it."""
    held: list[pa.RecordBatch] = []
    rows, enough = 0, GATHER
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows < enough:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy()
        last = int(np.searchsorted(keys, keys[-1], side="left"))
        if last == 0:  # one run so far; it is looked at again when twice as long
            enough = 2 * rows
            continue
        yield table.slice(0, last)
        held = table.slice(last).to_batches()
        rows, enough = rows - last, max(GATHER, 2 * (rows - last))
    if rows:
        yield pa.Table.from_batches(held)


def bounds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last rows of the runs."""
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate(([0], cut)), np.concatenate((cut, [len(keys)]))


class Forest:
    """Components of n nodes under links that come one by one; keeps the links that joined two components."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def add(self, i: int, js: np.ndarray) -> None:
        for j in js.tolist():
            a, b = self.root(i), self.root(j)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                self.links.append((i, j))
