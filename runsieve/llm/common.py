"""What several operators share: tables, folds, staging, Arrow columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runsieve.sources.staging import stage

__all__ = [
    "arrow_batches", "held_out", "labels_of", "map_batches", "score_column", "stage", "table", "text_bytes", "text_slices",
]

_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Characters that a task works on at once.
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def arrow_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """What runs within hands Arrow batches of about ``size`` bytes to Python tasks.

    Spark's own limit is 64 MB, held once in the executor and twice in the task, and
    the executor's allocator keeps much of what such buffers took.
    """
    before = spark.conf.get(_BATCH_SETTING)
    spark.conf.set(_BATCH_SETTING, f"{size}b")
    try:
        yield
    finally:
        spark.conf.set(_BATCH_SETTING, before)


def held_out(key: str | Column, remainder: int, folds: int = 5) -> Column:
    """Whether crc32 of the key as text leaves ``remainder``; false for a null key."""
    column = F.col(key) if isinstance(key, str) else key
    digest = F.crc32(column.cast("string").cast("binary"))
    return F.coalesce(digest % folds == remainder, F.lit(False))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def text_slices(column: pa.Array) -> Iterator[list[str]]:
    """Texts in order, in slices of bounded size; null counts as empty."""
    texts, size = [], 0
    for value in column:
        texts.append(value.as_py() or "")
        size += len(texts[-1])
        if size > SLICE_CHARS:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def labels_of(labels: DataFrame, label: str, key: str = "doc_id") -> DataFrame:
    """One ``label`` 0 or 1 per key, ``labelled``; of several the mean, half up."""
    return (
        labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("labelled"))
        .agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("label"))
    )


def score_column(score: Callable[[list[str]], np.ndarray]):
    """A column function that scores texts, whatever other columns a row has."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        parts = [score(part) for part in text_slices(pa.array(texts, type=pa.string()))]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return scored


def map_batches(
    frame: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """Apply a function to every Arrow batch; ``make`` builds it once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                yield work(batch)

    return frame.mapInArrow(run, schema)
