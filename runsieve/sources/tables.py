"""Catalog tables and files: run metadata, study runs, lists, sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runsieve.functions.report import as_cells
from runsieve.sources import schemas


def read_run_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Run metadata files; columns outside the schema are ignored."""
    return spark.read.schema(schemas.RUN_METADATA).parquet(path)


def read_study_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.STUDY_RUNS).parquet(path)


def read_anchor_studies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ANCHOR_STUDIES).parquet(path)


def from_table(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` from a catalog table; an error names those missing."""
    found = spark.table(table)
    missing = [name for name in schema.names if name not in found.columns]
    if missing:
        raise ValueError(f"table {table} has no column {', '.join(missing)}")
    return found.select(*schema.names)


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated genomic intervals with a header line."""
    return spark.read.csv(path, schema=schemas.INTERVALS, sep="\t", header=True)


def create_schema(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}")


def write_table(
    frame: DataFrame,
    table: str,
    cluster_by: Sequence[str | Column] = (),
    sort_by: Sequence[str | Column] = (),
    buckets: int = 0,
) -> DataFrame:
    """Create or replace ``table`` from ``frame`` and return a scan of it.

    ``cluster_by`` brings rows of equal keys together before writing, so that
    later filters on those keys skip most files; the rebalance hint splits a key
    that holds too many rows over several. Within a file rows are sorted by
    ``cluster_by``, then ``sort_by``.

    With ``buckets`` the table is bucketed by the columns of ``cluster_by``:
    aggregates and joins on them need no shuffle, and a filter on one key reads
    one bucket. A bucket is read by one task then, so choose so many that the
    largest key fits a task, or leave it at 0 where one key holds a large share.
    """
    if cluster_by:
        frame = frame.repartition(buckets, *cluster_by) if buckets else frame.hint("rebalance", *cluster_by)
    if cluster_by or sort_by:
        frame = frame.sortWithinPartitions(*cluster_by, *sort_by)
    writer = frame.write.mode("overwrite")
    if buckets:
        writer = writer.bucketBy(buckets, *cluster_by).sortBy(*cluster_by, *sort_by)
    writer.saveAsTable(table)
    return frame.sparkSession.table(table)


def write_accession_list(runs: DataFrame, bioproject: str, path: str) -> None:
    """Run accessions of one study as plain text, one per line."""
    accession_list(runs, bioproject).write.mode("overwrite").text(path)


def accession_list(runs: DataFrame, bioproject: str) -> DataFrame:
    return runs.filter(F.col("bioproject") == bioproject).select("acc")


def read_sheet(
    spark: SparkSession, path: str, multi_line: bool = True, position: str | None = None
) -> DataFrame:
    """A CSV sheet with a header; every cell is text, empty cells are ``''``.

    A byte order mark is skipped. The sheet must have rows, a ``bioproject``
    column and no two equal headings. ``multi_line`` allows line breaks inside
    quoted cells, at the price of one task per file; switch it off for large
    files without such cells. ``position`` names a column to add that orders
    rows as they lie in the files, for :func:`write_sheet` to sort by.
    """
    options = {
        "inferSchema": False, "multiLine": multi_line, "quote": '"', "escape": '"', "encoding": "UTF-8"
    }
    sheet = spark.read.csv(path, header=True, **options)
    heading = spark.read.csv(path, header=False, **options).first()
    names = [(name or "").lstrip("\ufeff") for name in heading or ()]
    equal = sorted({name for name in names if name and names.count(name) > 1})
    if equal:
        raise ValueError(f"input CSV has equal headings: {', '.join(equal)}")
    if "bioproject" not in sheet.columns:
        if not sheet.columns or sheet.isEmpty():
            raise ValueError("input CSV is empty")
        raise ValueError("input CSV has no 'bioproject' column")
    if sheet.isEmpty():
        raise ValueError("input CSV is empty")
    cells = sheet.na.fill("")
    if position is None:
        return cells
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
    )
    return sheet.select("*", place.alias(position)).na.fill("")


def write_sheet(
    frame: DataFrame,
    path: str,
    order_by: Sequence[str | Column] = (),
    position: str | None = None,
) -> None:
    """Write CSV with a header; arrays and timestamps become text cells.

    Quotes are doubled as spreadsheets expect, cells keep blanks at their ends,
    and NULL is an empty cell. ``position`` names a column to sort by that is
    not written.
    """
    if position is not None:
        frame = frame.orderBy(position, *order_by).drop(position)
    elif order_by:
        frame = frame.orderBy(*order_by)
    as_cells(frame).write.mode("overwrite").csv(
        path,
        header=True,
        quote='"',
        escape='"',
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )
