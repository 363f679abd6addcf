import __spark_entry__
import corpus_pipeline
import pyarrow as pa
import pytest
from cases import empty, table
from conftest import DATA

from gleaner.llm import decontaminate, near_dedup
from gleaner.llm.queries import ORACLES, QUERIES


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    now, before = docs, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, DATA).collect(), docs.schema)
        assert now.columns == docs.columns, name
        rows = {r.doc_id: r for r in now.collect()}
        assert set(rows) <= set(before) and len(rows) == now.count()
        gone = set(before) - set(rows)
        if name == "language_id":
            assert len(gone) <= 0.01 * len(before)
        elif name == "near_dedup":
            ids = sorted(before)
            sig, has = near_dedup.signatures(pa.array([before[i] for i in ids]))
            place = {i: k for k, i in enumerate(ids)}
            for i in gone:  # each has a smaller one within reach, by links
                d = near_dedup.hamming(sig, sig[place[i]])
                assert ((d <= 56) & (sig != sig[place[i]]).any(axis=1)).any() or (d == 0).sum() > 1
        elif name == "substring_dedup":
            assert not gone and all(r.n_chars == len(r.text) for r in rows.values())
        else:
            items = [(r.item_id, decontaminate.plain(pa.array([r.text])).to_pylist()[0]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            held = {i for i, t in before.items() if any(p in decontaminate.plain(pa.array([t])).to_pylist()[0] for _, p in items if len(p) >= 40)}
            assert held <= gone
        before = {i: r.text for i, r in rows.items()}
    bins = corpus_pipeline.STAGES[-1][1](spark, now, DATA).collect()
    assert sum(b.n_tokens for b in bins) == sum(len(t.split()) for t in before.values())


def test_run_gives_the_stages_rows(spark):
    got = corpus_pipeline.run(spark, DATA)
    assert got.count() > 0 and got.columns == ["bin_id", "n_tokens", "doc_ids", "pieces"]


@pytest.mark.parametrize("make", [table, empty])
def test_stages_bear_odd_rows(spark, make):
    docs = make(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        out.collect()
    corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()


def test_registered():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES) and {*QUERIES, "pipeline"} <= set(__spark_entry__.queries())
