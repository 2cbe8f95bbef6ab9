"""Study records from JSON summary documents.

A document holds ``{"result": {"uids": [...], "<uid>": {...}, ...}}``. Only the
objects named in ``uids`` count, and only with a non-empty ``project_acc``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a record that are read, all as text.
RAW_FIELDS = (
    "project_acc",
    "project_title",
    "project_description",
    "submitter_organization",
    "registration_date",
    "project_data_type",
)


def read_study_records(
    spark: SparkSession, path: str, one_per_line: bool = False
) -> DataFrame:
    """Raw study records of the JSON documents under ``path``.

    One document per file, or one per line: then files can be split. Documents
    arrive in the order of their files' modification times, then paths, then
    places in the file.
    """
    return records_from_documents(read_documents(spark, path, one_per_line), "value")


def read_documents(
    spark: SparkSession, path: str, one_per_line: bool = False
) -> DataFrame:
    """``value`` and ``document_seq``, the arrival position, of each document."""
    files = spark.read.text(path, wholetext=not one_per_line)
    order = F.struct(
        F.col("_metadata.file_modification_time").alias("modified"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
    )
    return files.select("value", order.alias("document_seq"))


def parse_documents(documents: DataFrame, text: str, order: str = "document_seq") -> DataFrame:
    """``document``, its content ``v`` as a variant, and whether it was ``given`` a text.

    A document is parsed here, once; stage the outcome where both its records and
    the unreadable documents are wanted. Text that is no JSON, that repeats a name
    in an object, or that exceeds the size of a variant, has no content.
    """
    return documents.select(
        F.col(order).alias("document"),
        F.col(text).isNotNull().alias("given"),
        # A generator, so that later projections do not parse once per use.
        F.explode(F.array(F.try_parse_json(text))).alias("v"),
    )


def unreadable(parsed: DataFrame) -> DataFrame:
    """The ``document`` of those that could not be read, which give no records."""
    return parsed.filter(F.col("given") & F.col("v").isNull()).select("document")


def unreadable_documents(
    documents: DataFrame, text: str, order: str = "document_seq"
) -> DataFrame:
    """:func:`unreadable` of documents that are not parsed yet."""
    return unreadable(parse_documents(documents, text, order)).withColumnRenamed("document", order)


def records_of(parsed: DataFrame) -> DataFrame:
    """Raw records of parsed documents, with ``seq``, the arrival position.

    ``seq`` is the document, then the place in its ``uids`` list.
    """
    listed = parsed.select(
        "document",
        F.try_variant_get("v", "$.result.uids", "array<string>").alias("uids"),
        F.try_variant_get("v", "$.result", "variant").alias("result"),
    )
    entries = listed.lateralJoin(
        parsed.sparkSession.tvf.variant_explode(F.col("result").outer())
    ).filter(F.array_contains("uids", F.col("key")))
    place = (F.array_position("uids", F.col("key")) - 1).cast("int")
    return entries.select(
        F.struct("document", place.alias("place")).alias("seq"),
        *(F.try_variant_get("value", f"$.{name}", "string").alias(name) for name in RAW_FIELDS),
    ).filter(F.col("project_acc") != "")


def records_from_documents(
    documents: DataFrame, text: str, order: str = "document_seq"
) -> DataFrame:
    """Raw records of the JSON documents in column ``text``."""
    return records_of(parse_documents(documents, text, order))
