from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runsieve.operators import enrich

RAW = (
    "project_acc string, project_title string, project_description string, "
    "submitter_organization string, registration_date string, project_data_type string, seq int"
)

SPACES = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0    　"


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=SPACES + "abé日", max_size=12), min_size=20, max_size=60))
def test_white_space_rules(spark, values):
    frame = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    found = frame.select(
        "i", enrich.strip(F.col("t")).alias("s"), enrich.collapse(F.col("t")).alias("c")
    ).orderBy("i").collect()
    assert [r.s for r in found] == [v.strip() for v in values]
    assert [r.c for r in found] == [" ".join(v.split()) for v in values]


def test_normalised_records(spark):
    rows = [
        ("PRJ1", "first", "x", "u", "d", "t", 1),
        ("PRJ1", " last\t", "a  b\n" + "word " * 400, None, " 2020 ", None, 2),
        ("", "skipped", "", "", "", "", 3),
        (None, "skipped", "", "", "", "", 4),
        ("PRJ2", None, None, None, None, None, 5),
    ]
    frame = spark.createDataFrame(rows, RAW)
    found = {r.project_acc: tuple(r)[1:] for r in enrich.normalise_records(frame).collect()}
    long_text = ("a b " + "word " * 400)[:1200]
    assert found == {
        "PRJ1": ("last", long_text, "", "2020", ""),
        "PRJ2": ("", "", "", "", ""),
    }
    assert len(found["PRJ1"][1]) == 1200


@pytest.fixture
def records(spark):
    rows = [
        ("PRJ1", "Unique small RNA modifications in Alzheimer's disease", "", "s", "d", "t", 1),
        ("PRJ2", "smRNA-sequencing of frontal lobe", "Frontotemporal Dementia", "s", "d", "t", 2),
        ("PRJ3", "A platform", "MicroRNA profiling", "s", "d", "t", 3),
    ]
    return enrich.normalise_records(spark.createDataFrame(rows, RAW))


def test_enriched_sheet(spark, records):
    sheet = spark.createDataFrame(
        [("PRJ1", "a", "old"), (" PRJ2 ", "b", "old"), ("PRJ3", "c", ""), ("PRJ9", "d", "old"), ("", "e", "")],
        "bioproject string, note string, study_title string",
    )
    found = enrich.enrich(sheet, records)
    assert found.columns == [
        "bioproject",
        "note",
        "study_title",
        "study_description",
        "submitter",
        "registration_date",
        "project_data_type",
        "title_mentions_alzheimer",
        "title_mentions_mirna",
    ]
    by_note = {r.note: tuple(r) for r in found.collect()}
    assert by_note["a"][2:] == (
        "Unique small RNA modifications in Alzheimer's disease", "", "s", "d", "t", "True", "True",
    )
    assert by_note["b"][0] == " PRJ2 " and by_note["b"][-2:] == ("True", "False")
    assert by_note["c"][-2:] == ("False", "True")
    assert by_note["d"][2:] == ("", "", "", "", "", "False", "False")
    assert by_note["e"][2:] == ("", "", "", "", "", "False", "False")


def test_missing_records(spark, records):
    sheet = spark.createDataFrame(
        [(" PRJ9",), ("PRJ9",), ("PRJ1",), ("",), (" ",)], "bioproject string"
    )
    assert [r.bioproject for r in enrich.missing_records(sheet, records).collect()] == ["PRJ9"]
    assert {r.bioproject for r in enrich.accessions(sheet).collect()} == {"PRJ1", "PRJ9"}
