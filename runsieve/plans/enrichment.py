"""The enrichment run: a sheet and record documents in, a sheet in input order out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from runsieve.operators import enrich
from runsieve.sources import records
from runsieve.sources.staging import stage
from runsieve.sources.tables import read_sheet, write_sheet

_POSITION = "_sheet_position"


class Unresolved(NamedTuple):
    """What a run could not find or read."""

    #: Accessions of the sheet without a record.
    missing: DataFrame
    #: File and place of the documents that could not be read.
    unreadable: DataFrame


def enrich_sheet(
    spark: SparkSession,
    sheet_path: str,
    records_path: str,
    out_path: str,
    multi_line: bool = True,
    one_per_line: bool = False,
) -> Unresolved:
    """Write the sheet with titles and flags; return what was missing or unreadable."""
    sheet = read_sheet(spark, sheet_path, multi_line, position=_POSITION)
    documents = records.read_documents(spark, records_path, one_per_line)
    parsed = stage(records.parse_documents(documents, "value"), "parsed-documents")
    raw = stage(records.records_of(parsed), "raw-records")
    known = stage(enrich.normalise_records(raw), "records")
    write_sheet(enrich.enrich(sheet, known), out_path, position=_POSITION)
    return Unresolved(
        enrich.missing_records(sheet, known),
        records.unreadable(parsed).select("document.file", "document.start", "document.line"),
    )
