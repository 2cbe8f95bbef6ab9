"""Schemas of the tables the screens read and write."""

from __future__ import annotations

from pyspark.sql import types as T

ATTRIBUTES = T.ArrayType(
    T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())])
)

_STRING, _LONG, _TIME = T.StringType(), T.LongType(), T.TimestampType()

#: Columns carried unchanged from the run metadata to the study-run table.
CARRIED = T.StructType(
    [
        T.StructField("bioproject", _STRING),
        T.StructField("sra_study", _STRING),
        T.StructField("acc", _STRING),
        T.StructField("biosample", _STRING),
        T.StructField("sample_acc", _STRING),
        T.StructField("organism", _STRING),
        T.StructField("assay_type", _STRING),
        T.StructField("librarysource", _STRING),
        T.StructField("libraryselection", _STRING),
        T.StructField("librarylayout", _STRING),
        T.StructField("library_name", _STRING),
        T.StructField("platform", _STRING),
        T.StructField("instrument", _STRING),
        T.StructField("avgspotlen", _LONG),
        T.StructField("mbases", _LONG),
        T.StructField("mbytes", _LONG),
        T.StructField("releasedate", _TIME),
    ]
)

#: One row per sequencing run.
RUN_METADATA = T.StructType(
    [
        *CARRIED.fields,
        T.StructField("consent", _STRING),
        T.StructField("attributes", ATTRIBUTES),
    ]
)

#: Distinct accessions of the studies that mention the disease.
ANCHOR_STUDIES = T.StructType([T.StructField("bioproject", _STRING)])

#: Every run of the anchored studies, with its text columns.
STUDY_RUNS = T.StructType(
    [
        *CARRIED.fields,
        T.StructField("lib_lc", _STRING),
        T.StructField("libsel_lc", _STRING),
        T.StructField("attr_blob", _STRING),
        T.StructField("label_blob", _STRING),
    ]
)

#: Genomic intervals.
INTERVALS = T.StructType(
    [
        T.StructField("GeneID", _STRING),
        T.StructField("Chr", _STRING),
        T.StructField("Start", _LONG),
        T.StructField("End", _LONG),
        T.StructField("Strand", _STRING),
    ]
)

STUDY_KEYS = ("bioproject", "sra_study", "organism")
