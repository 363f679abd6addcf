"""Session helpers shared by the operators: the shared folder, lineage cuts, free names and bounded samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a new one in local mode if that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext.getCheckpointDir()
        if known:
            return known
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, read from a reliable checkpoint, so that lost executors cost no long recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to compressed Parquet in the shared folder and read again."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name based on ``name`` that no column of ``df`` has, in any case."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def pick(df: DataFrame, *names: str) -> list[Column]:
    """The named columns of ``df``; a missing one is null text. Names are quoted, so dots in them do no harm."""
    have = {c.lower(): c for c in df.columns}
    return [(F.col(f"`{have[n]}`") if n in have else F.lit(None).cast("string")).alias(n) for n in names]


def ident(df: DataFrame, name: str = "doc_id") -> Column:
    """The named id column as bigint, under its name. Ids that are no integers, such as other text, count as null, and so does a missing column."""
    return pick(df, name)[0].try_cast("bigint").alias(name)


def filtered(df: DataFrame, column: str, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows for whose texts ``keep`` holds, with all columns, in one scan and without an exchange; a missing column is null text."""
    plain = [f"c{i}" for i in range(len(df.columns))]  # mapInArrow resolves columns by name, and names may clash or hold dots
    at = next((p for p, c in zip(plain, df.columns, strict=True) if c.lower() == column.lower()), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, at) if at else [batch]:
                text = part.column(at).cast(pa.string()) if at else pa.nulls(part.num_rows, pa.string())
                yield part.filter(pa.array(keep(text), pa.bool_()))

    schema = T.StructType([T.StructField(p, f.dataType, f.nullable) for p, f in zip(plain, df.schema, strict=True)])
    return df.toDF(*plain).mapInArrow(run, schema).toDF(*df.columns)


def pieces(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch that hold up to ``limit`` bytes of the text column, one row at least."""
    size = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(size):
        if total + n > limit and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def mapped(df: DataFrame, column: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``work`` over slices of bounded text size, by mapInArrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, column):
                out = work(piece)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
