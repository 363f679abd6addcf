"""State of a service: a cache with age and size limits, and a circuit breaker, both also over logged events."""

from __future__ import annotations

import random
import time
from collections import OrderedDict
from collections.abc import Callable, Hashable
from typing import Any, TypeVar

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


T = TypeVar("T")


class TTLCache:
    """The most recently used values, up to a number and an age; expired ones go when asked for."""

    def __init__(self, size: int = 500, seconds: float = 300, clock: Callable[[], float] = time.monotonic) -> None:
        self.most, self.seconds, self.clock = size, seconds, clock
        self._held: OrderedDict[Hashable, tuple[float, Any]] = OrderedDict()

    def get(self, key: Hashable) -> Any:
        if key not in self._held:
            return None
        at, value = self._held[key]
        if self.clock() - at > self.seconds:
            del self._held[key]
            return None
        self._held.move_to_end(key)
        return value

    def set(self, key: Hashable, value: Any) -> None:
        self._held[key] = (self.clock(), value)
        self._held.move_to_end(key)
        while len(self._held) > self.most:
            self._held.popitem(last=False)

    def clear(self) -> None:
        self._held.clear()

    @property
    def size(self) -> int:
        return len(self._held)


class CircuitBreaker:
    """Open while there were so many failures in a row, and the last is not so long ago."""

    def __init__(self, failures: int = 5, seconds: float = 60, clock: Callable[[], float] = time.monotonic) -> None:
        self.limit, self.seconds, self.clock = failures, seconds, clock
        self.failures, self.last = 0, float("-inf")

    @property
    def is_open(self) -> bool:
        return self.failures >= self.limit and self.clock() - self.last <= self.seconds

    def record_failure(self) -> None:
        self.failures += 1
        self.last = self.clock()

    def record_success(self) -> None:
        self.failures = 0


def retried(call: Callable[[], T], attempts: int = 3, first: float = 0.5, most: float = 8.0, on: tuple[type[Exception], ...] = (OSError,), sleep: Callable[[float], None] = time.sleep, spread: Callable[[], float] = random.random) -> T:
    """What ``call`` gives, asked again after a failure; the last failure is raised.

    The wait doubles each time, up to ``most`` seconds, and is drawn between that and one and a half times that, so that many callers don't come back at once.
    """
    for k in range(attempts):
        try:
            return call()
        except on:
            if k == attempts - 1:
                raise
            sleep(min(first * 2**k, most) * (1 + spread() / 2))
    raise ValueError("attempts must be 1 at least")


def breaker_states(attempts: DataFrame, failures: int = 5, seconds: float = 60) -> DataFrame:
    """Logged attempts (service, at in seconds, ok) with ``open``: whether the breaker is open just before each."""
    order = Window.partitionBy("service").orderBy("at")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    runs = attempts.withColumn("_run", F.coalesce(F.sum(F.col("ok").cast("int")).over(past), F.lit(0)))
    same = Window.partitionBy("service", "_run").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.when(~F.col("ok"), 1).otherwise(0)
    state = runs.withColumn("_n", F.coalesce(F.sum(failed).over(same), F.lit(0))).withColumn("_last", F.max(F.when(~F.col("ok"), F.col("at"))).over(past))
    return state.withColumn("open", F.coalesce((F.col("_n") >= failures) & (F.col("at") - F.col("_last") <= seconds), F.lit(False))).drop("_run", "_n", "_last")
