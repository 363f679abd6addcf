"""The streaming extensions, each driven to completion over landed files."""

import datetime as dt

import pytest

from gleaner.catalogue import ATTEMPTS
from gleaner.operators.resilience import breaker_states
from gleaner.streaming import hits as S

SCHEMA = "query_id long, url string, content string, ts timestamp"


def drained(spark, stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


@pytest.fixture
def landed(spark, tmp_path):
    at = dt.datetime(2026, 1, 1)
    rows = [(1, "https://A.org/x/", "no longer supported", at), (1, "https://a.org/x#f", "again", at + dt.timedelta(minutes=1)), (1, "https://x.com/1", "blocked", at), (2, "https://a.org/x", "other query", at), (1, "https://github.com/y", "fine", at + dt.timedelta(minutes=2))]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(str(tmp_path / "hits"))
    return spark.readStream.schema(SCHEMA).json(str(tmp_path / "hits"))


def test_fresh_hits(spark, landed):
    got = drained(spark, S.fresh_hits(landed), "fresh_hits", "append")
    assert sorted((r.query_id, r.key, r.source_tier) for r in got) == [(1, "https://a.org/x", 3), (1, "https://github.com/y", 2), (2, "https://a.org/x", 3)]


def test_domain_rates(spark, landed):
    got = drained(spark, S.domain_rates(landed), "domain_rates", "complete")
    assert {r.domain: r.hits for r in got} == {"a.org": 3, "x.com": 1, "github.com": 1}


def test_breaker_stream_is_as_the_log_says(spark, tmp_path):
    log = spark.createDataFrame(ATTEMPTS, "service string, at double, ok boolean")
    log.coalesce(1).write.json(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).json(str(tmp_path / "log"))
    got = drained(spark, S.breaker_stream(stream), "breaker", "append")
    assert sorted(map(tuple, got)) == sorted((r.service, r.at, r.ok, r.open) for r in breaker_states(log).collect())
