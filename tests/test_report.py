"""Report columns recomputed from the counters of published screens."""

from __future__ import annotations

import datetime as dt

import pytest

from pyspark.sql import functions as F

from runsieve.functions import report

SMALL_COLUMNS = (
    "bioproject string, n_biosamples long, case_only long, control_only long, unlabeled long, "
    "n_runs long, n_prefrontal long, n_brain_any long, n_tissue_unannotated long, n_csf long, "
    "n_biofluid long, line string, tissue string, arm long"
)
SMALL_ROWS = [
    ("PRJEB59990", 45, 33, 12, 0, 45, 45, 45, 0, 0, 0, "45 samples: 33 AD-like / 12 control", "PREFRONTAL", 12),
    ("PRJNA641912", 10, 6, 4, 0, 10, 10, 10, 0, 0, 0, "10 samples: 6 AD-like / 4 control", "PREFRONTAL", 4),
    ("PRJNA1162507", 30, 15, 15, 0, 30, 0, 30, 0, 0, 0, "30 samples: 15 AD-like / 15 control", "brain (other region)", 15),
    ("PRJNA646349", 240, 82, 364, 46, 492, 0, 0, 0, 0, 492, "240 samples: 82 AD-like / 364 control / 46 other", "biofluid/CSF only", 82),
    ("PRJNA201039", 70, 48, 22, 0, 70, 0, 0, 0, 0, 70, "70 samples: 48 AD-like / 22 control", "biofluid/CSF only", 22),
    ("PRJEB49130", 9, 3, 3, 3, 9, 0, 0, 0, 0, 9, "9 samples: 3 AD-like / 3 control / 3 other", "biofluid/CSF only", 3),
    ("unannotated", 9, 3, 3, 0, 9, 0, 0, 9, 1, 0, "9 samples: 3 AD-like / 3 control", "unannotated - CHECK STUDY", 3),
    ("other", 9, 3, 3, 0, 9, 0, 0, 8, 0, 0, "9 samples: 3 AD-like / 3 control", "other", 3),
]
TARGET_COLUMNS = (
    "bioproject string, n_target_biosamples long, case_only long, control_only long, "
    "unlabeled long, n_target_runs long, n_random_declared long, n_ribodep_declared long, "
    "n_long_read long, n_random_text long, verdict string, evidence string, line string"
)
TARGET_ROWS = [
    ("PRJEB54589", 12, 12, 12, 0, 24, 24, 0, 0, 0, "PASSES - real contrast", "libraryselection = RANDOM", "12 target samples: 12 AD-like / 12 control"),
    ("PRJNA625487", 12, 6, 6, 0, 12, 0, 0, 0, 12, "PASSES - real contrast", "free text only - VERIFY", "12 target samples: 6 AD-like / 6 control"),
    ("PRJNA719114", 6, 3, 3, 0, 6, 0, 0, 6, 0, "PASSES - real contrast", "long-read platform", "6 target samples: 3 AD-like / 3 control"),
    ("PRJNA981131", 47, 27, 0, 0, 47, 0, 0, 47, 0, "single-arm or too small", "long-read platform", "47 target samples: 27 AD-like / 0 control"),
    ("PRJNA1482722", 46, 24, 0, 22, 46, 0, 46, 0, 0, "single-arm or too small", "libraryselection = Inverse rRNA", "46 target samples: 24 AD-like / 0 control / 22 other"),
    ("PRJNA224740", 8, 1, 4, 3, 8, 0, 0, 8, 0, "single-arm or too small", "long-read platform", "8 target samples: 1 AD-like / 4 control / 3 other"),
    ("PRJNA1307787", 10, 0, 0, 10, 10, 10, 0, 0, 0, "target arm unlabeled - CHECK BY HAND", "libraryselection = RANDOM", "10 target samples: 0 AD-like / 0 control / 10 other"),
    ("thin", 4, 2, 2, 0, 4, 0, 0, 0, 0, "thin - 2v2, underpowered", "weak", "4 target samples: 2 AD-like / 2 control"),
    ("one arm", 5, 5, 0, 0, 5, 0, 0, 0, 0, "single-arm or too small", "weak", "5 target samples: 5 AD-like / 0 control"),
]


def test_small_rna_report_columns(spark):
    frame = spark.createDataFrame(SMALL_ROWS, SMALL_COLUMNS)
    found = frame.select(
        report.cohort_line().alias("a"),
        report.tissue_verdict().alias("b"),
        report.smaller_arm().alias("c"),
    ).collect()
    assert [tuple(r) for r in found] == [row[-3:] for row in SMALL_ROWS]


def test_target_report_columns(spark):
    frame = spark.createDataFrame(TARGET_ROWS, TARGET_COLUMNS)
    found = frame.select(
        report.verdict().alias("a"),
        report.evidence().alias("b"),
        report.cohort_line("n_target_biosamples", "target samples").alias("c"),
    ).collect()
    assert [tuple(r) for r in found] == [row[-3:] for row in TARGET_ROWS]


def test_links(spark):
    frame = spark.createDataFrame([("PRJ1", None)], "bioproject string, sra_study string")
    row = frame.select(report.bioproject_url(), report.run_selector_url()).first()
    assert tuple(row) == ("https://www.ncbi.nlm.nih.gov/bioproject/PRJ1", None)


def test_cells(spark):
    moment = dt.datetime(2020, 11, 5)
    frame = spark.createDataFrame(
        [(["a", "b"], moment, moment, 1), ([], None, None, 2), (None, None, None, 3)],
        "l array<string>, t timestamp, n timestamp_ntz, i int",
    )
    stamp = "2020-11-05 00:00:00.000000 UTC"
    expected = [("[a,b]", stamp, stamp, 1), ("[]", None, None, 2), (None, None, None, 3)]
    assert [tuple(r) for r in report.as_cells(frame).collect()] == expected
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        cells = report.as_cells(frame.limit(1).select("t", F.col("n"))).first()
        assert tuple(cells) == (stamp, stamp)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_timestamp_cells_in_any_zone(spark, zone):
    """Hours that a zone skips or repeats, and instants before the epoch."""
    instants = ["2020-03-08 02:30:00", "2020-03-08 07:30:00.000001", "2020-11-01 05:30:00", "2020-11-01 06:30:00", "1969-12-31 23:59:59.5"]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        frame = spark.createDataFrame([(x,) for x in instants], "x string").selectExpr(
            "to_timestamp(x || 'Z') AS a", "to_timestamp_ntz(x) AS b"
        )
        found = [tuple(row) for row in report.as_cells(frame).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    wanted = [(x if "." in x else x + ".").ljust(26, "0") + " UTC" for x in instants]
    assert found == [(text, text) for text in wanted]
