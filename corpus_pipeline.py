"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes all that the stage before kept and returns the columns of documents, but for the last, which returns bins. ``run`` writes
each stage's rows to compressed Parquet in the shared folder, which cuts lineage: a lost executor costs one stage's tasks at most.

Defined cases, by stage: null, empty and letterless texts go at language ID, as they have no language. A row with a null doc_id, or one that is no integer, is
treated like any other; in bins its id is null. Rows alike in doc_id and text are copies, of which near-dedup keeps one; rows that share a doc_id only are told
apart. Of equal copies the least doc_id stays, and the first passage in its order. A text that is cut to nothing keeps its row and is in no bin. Texts of any length are
read whole, and packing cuts those longer than a bin. An empty table gives no bins. Other columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import decontaminate, language_id, near_dedup, packing, substring_dedup
from gleaner.llm._spark import written


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those that language ID rejects go."""
    return language_id.drop_rejected(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the least doc_id."""
    return near_dedup.drop_near_duplicates(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut from the texts."""
    return substring_dedup.drop_repeated_passages(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, within its edit budget, go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 2,048 words with the documents' pieces in them."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_languages),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL can express neither trained classifiers nor an LSH forest; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
