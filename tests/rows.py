"""Hand-written runs: only the fields a test cares about need to be given."""

from __future__ import annotations

import datetime as dt
import itertools

from pyspark.sql import DataFrame, SparkSession

from runsieve.operators.anchor import with_text_columns
from runsieve.sources import schemas

_counter = itertools.count(1)


def run(attributes=(), **fields) -> dict:
    number = next(_counter)
    row = dict.fromkeys(schemas.RUN_METADATA.names)
    row.update(
        bioproject="PRJ1",
        sra_study="SRP1",
        acc=f"SRR{number}",
        biosample=f"SAM{number}",
        organism="Homo sapiens",
        consent="public",
        assay_type="RNA-Seq",
        librarysource="TRANSCRIPTOMIC",
        platform="ILLUMINA",
        avgspotlen=100,
        mbytes=1024,
        releasedate=dt.datetime(2020, 11, 5),
    )
    row.update(fields)
    row["attributes"] = None if attributes is None else list(attributes)
    return row


def metadata(spark: SparkSession, rows: list[dict]) -> DataFrame:
    values = [tuple(r[c] for c in schemas.RUN_METADATA.names) for r in rows]
    return spark.createDataFrame(values, schemas.RUN_METADATA)


def study_runs(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return with_text_columns(metadata(spark, rows))
