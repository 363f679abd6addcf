"""Extensions, which have no counterpart in batch: hits that arrive as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleaner.functions import urls as U
from gleaner.operators import grounding


def fresh_hits(hits: DataFrame, time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Streaming hits (query_id, url, content, time) not seen by query and canonical URL within the delay, with tier, markers and densities."""
    once = hits.withColumn("key", U.normalize_url(F.col("url"))).withWatermark(time, delay).dropDuplicatesWithinWatermark(["query_id", "key"])
    rows = once.filter(~U.is_blacklisted(F.col("url"))).withColumn("source_tier", U.source_tier(F.col("url")))
    return grounding.signals(grounding.detect_contradictions(rows))


def domain_rates(hits: DataFrame, time: str = "ts", window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Hits by window and domain."""
    return hits.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), U.netloc(F.col("url")).alias("domain")).agg(F.count("*").alias("hits")).select("w.start", "w.end", "domain", "hits")


def breaker_stream(attempts: DataFrame, failures: int = 5, seconds: float = 60) -> DataFrame:
    """Streaming attempts (service, at in seconds, ok) with ``open``, the circuit breaker's state just before each, kept by service."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, -1e18)
        for frame in frames:
            frame = frame.sort_values("at", kind="stable")
            opened = []
            for at, ok in zip(frame["at"], frame["ok"], strict=True):
                opened.append(bool(n >= failures and at - last <= seconds))
                n, last = (0, last) if ok else (n + 1, float(at))
            yield pd.DataFrame({"service": key[0], "at": frame["at"], "ok": frame["ok"], "open": opened})
        state.update((n, last))

    return attempts.select("service", "at", "ok").groupBy("service").applyInPandasWithState(step, "service string, at double, ok boolean, open boolean", "n int, last double", "append", GroupStateTimeout.NoTimeout)
