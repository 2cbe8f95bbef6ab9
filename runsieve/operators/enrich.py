"""Titles and descriptions for a sheet of studies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsieve.functions.vocabulary import TITLE_ASSAY_WORDS, TITLE_DISEASE_WORDS

# Names of the added columns and the length of a description.
RECORD_COLUMNS = (
    "study_title",
    "study_description",
    "submitter",
    "registration_date",
    "project_data_type",
)
DISEASE_FLAG = "title_mentions_alzheimer"
ASSAY_FLAG = "title_mentions_mirna"
DESCRIPTION_LENGTH = 1200
# End of the fixed values.

# White space of any script, and the four separator control characters.
_SPACE = r"[\s\x1c-\x1f]"


def strip(value: Column) -> Column:
    """Text without white space at its ends; ``''`` for NULL."""
    text = F.coalesce(value, F.lit(""))
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+|{_SPACE}+\z", "")


def collapse(value: Column) -> Column:
    """Words of a text joined by single blanks."""
    text = F.coalesce(value, F.lit(""))
    return F.trim(F.regexp_replace(text, rf"(?U){_SPACE}+", " "))


def normalise_records(
    records: DataFrame, description_length: int | None = DESCRIPTION_LENGTH
) -> DataFrame:
    """One row per accession with cleaned fields; the last arrival wins.

    ``records`` has the raw fields and ``seq``, the arrival position, which is there
    and differs between the records of an accession. The last position is found
    first, over accessions and positions alone; texts are read again for the winners
    only, and only those are cleaned. No cut of descriptions with
    ``description_length`` None.
    """
    named = records.filter(F.col("project_acc") != "")
    last = named.groupBy("project_acc").agg(F.max("seq").alias("seq"))
    description = collapse(F.col("project_description"))
    if description_length is not None:
        description = F.substring(description, 1, description_length)
    return named.join(last, ["project_acc", "seq"], "left_semi").select(
        "project_acc",
        strip(F.col("project_title")).alias("study_title"),
        description.alias("study_description"),
        strip(F.col("submitter_organization")).alias("submitter"),
        strip(F.col("registration_date")).alias("registration_date"),
        strip(F.col("project_data_type")).alias("project_data_type"),
    )


def accessions(sheet: DataFrame) -> DataFrame:
    """Distinct non-empty accessions of a sheet."""
    return (
        sheet.select(strip(F.col("bioproject")).alias("bioproject"))
        .filter(F.col("bioproject") != "")
        .distinct()
    )


def missing_records(sheet: DataFrame, records: DataFrame) -> DataFrame:
    """Accessions of the sheet that have no record."""
    known = records.select(F.col("project_acc").alias("bioproject"))
    return accessions(sheet).join(known, "bioproject", "left_anti")


def _mentions(text: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return F.when(found, "True").otherwise("False")


def enrich(
    sheet: DataFrame,
    records: DataFrame,
    disease_words: Sequence[str] = TITLE_DISEASE_WORDS,
    assay_words: Sequence[str] = TITLE_ASSAY_WORDS,
) -> DataFrame:
    """The sheet with the fields of its study records and two keyword flags.

    All input columns stay in place; a column of the same name is overwritten.
    Rows without a record get empty fields and ``False`` flags. ``records`` is
    the outcome of :func:`normalise_records`.
    """
    names = {c: f"_record_{c}" for c in RECORD_COLUMNS}
    known = records.select(
        F.col("project_acc").alias("_record_acc"),
        *(F.col(c).alias(n) for c, n in names.items()),
    )
    joined = sheet.join(
        known, strip(F.col("bioproject")) == F.col("_record_acc"), "left"
    )
    text = F.lower(F.concat_ws(" ", names["study_title"], names["study_description"]))
    added = {c: F.coalesce(F.col(n), F.lit("")) for c, n in names.items()}
    added[DISEASE_FLAG] = _mentions(text, disease_words)
    added[ASSAY_FLAG] = _mentions(text, assay_words)
    kept = [
        added.pop(c).alias(c) if c in added else F.col(c) for c in sheet.columns
    ]
    return joined.select(*kept, *(value.alias(c) for c, value in added.items()))
