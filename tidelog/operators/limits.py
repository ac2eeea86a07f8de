"""Admission by sliding-window log and by token bucket, one limiter a key, as ordered folds."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame

from .ordered import fold


def checked(requests: int, seconds: float) -> None:
    if requests < 0 or seconds <= 0:
        raise ValueError("requests must be 0 or more and seconds above 0")


class SlidingWindow:
    """Admits while fewer than `requests` admitted calls lie in the last `seconds`; one aged exactly that still counts, denied calls never do."""

    def __init__(self, requests: int, seconds: float):
        checked(requests, seconds)
        self.requests, self.span = requests, seconds * 1000

    def start(self) -> deque:
        return deque()

    def step(self, state: deque, args: tuple) -> tuple[deque, bool]:
        t = args[0]
        while state and state[0] < t - self.span:
            state.popleft()
        if len(state) >= self.requests:
            return state, False
        state.append(t)
        return state, True


class TokenBucket:
    """Starts full at the first call; whole tokens accrue at requests/seconds and reset the clock, fractions below one wait, others are lost."""

    def __init__(self, requests: int, seconds: float):
        checked(requests, seconds)
        self.requests, self.rate = requests, requests / seconds

    def start(self) -> None:
        return None

    def step(self, state: tuple | None, args: tuple) -> tuple[tuple, bool]:
        t = args[0]
        tokens, last = state or (self.requests, t)
        gained = (t - last) / 1000 * self.rate
        if int(gained) > 0:
            tokens, last = int(min(self.requests, tokens + gained)), t
        return ((tokens - 1, last), True) if tokens > 0 else ((tokens, last), False)


def admit(calls: DataFrame, limiter: SlidingWindow | TokenBucket, key: str, t_ms: str, seq: str, out: str = "allowed") -> DataFrame:
    """calls with whether each is admitted, in order of (t_ms, seq) for each key."""
    return fold(calls, [key], [t_ms, seq], [t_ms], limiter.start, limiter.step, out, "boolean")
