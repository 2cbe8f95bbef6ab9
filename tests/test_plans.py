"""Physical plans: what is read, broadcast and shuffled."""

from __future__ import annotations

import re

import pytest

import fixture_views
from runsieve.operators import anchor, labels, studies
from runsieve.plans import screens, workflow
from runsieve.sources import staging

from .rows import metadata, run


@pytest.fixture(scope="module")
def stored(spark):
    rows = [
        run(
            [("disease", "alzheimer" if i % 2 else "control"), ("tissue", f"t{i % 9}")],
            bioproject=f"PRJ{0 if i % 3 == 0 else i % 7}",
            assay_type="miRNA-Seq",
        )
        for i in range(120)
    ]
    return staging.stage(metadata(spark, rows), "metadata")


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_no_cross_joins_and_no_udfs(stored):
    anchors, runs = workflow.anchored_runs(stored)
    frames = [
        anchor.anchor_scan(stored),
        anchor.stage_audit(anchors, runs),
        screens.screen_small_rna(runs),
        screens.screen_total_long(runs),
    ]
    for frame in frames:
        assert not re.search("NestedLoop|Cartesian|Python|ArrowEval", plan(frame))


def test_anchor_scan_reads_four_columns_and_pushes_filters(stored):
    text = plan(anchor.anchor_scan(stored))
    assert "FileScan parquet [bioproject" in text
    scanned = re.search(r"FileScan parquet \[([^\]]*)\]", text).group(1)
    assert re.sub(r"#\d+L?", "", scanned) == "bioproject,organism,consent,attributes"
    assert "EqualTo(consent,public)" in text and "In(organism" in text
    # The label text is made once per row, below the generator.
    assert text.index("Generate explode") < text.index("regexp_replace")
    assert text.count("negctrl") <= 2


def test_semi_join_broadcasts_only_below_the_threshold(spark, stored):
    anchors = staging.stage(anchor.anchor_scan(stored), "anchors")
    small = anchor.extract_study_runs(stored, anchors)
    assert "BroadcastHashJoin" in plan(small)
    rows = small.orderBy("acc").collect()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = anchor.extract_study_runs(stored, anchors)
        assert "Broadcast" not in plan(large) and "SortMergeJoin" in plan(large)
        assert large.orderBy("acc").collect() == rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_bloom_filter_of_the_anchors_comes_before_the_shuffle(spark, stored):
    anchors = staging.stage(anchor.anchor_scan(stored), "anchors")
    rows = anchor.extract_study_runs(stored, anchors).orderBy("acc").collect()
    options = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        # Sizes that the generated tables do not reach.
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1b",
    }
    before = {name: spark.conf.get(name) for name in options}
    for name, value in options.items():
        spark.conf.set(name, value)
    try:
        large = anchor.extract_study_runs(stored, anchors)
        text = plan(large)
        assert "SortMergeJoin" in text and "might_contain" in text
        # Below the exchange of the nested attributes: the filter stands nearer to the scan.
        exchanges = [m.start() for m in re.finditer("Exchange", text)]
        assert exchanges[0] < text.index("might_contain") < text.index("FileScan")
        assert large.orderBy("acc").collect() == rows and rows
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_figures_of_a_bucketed_run_table_need_no_shuffle_over_runs(spark, stored):
    anchors, plain = workflow.build_study_tables(stored, "flat_studies")
    expected = {tuple(r) for r in plan_rows(plain)}
    anchors, runs = workflow.build_study_tables(stored, "bucketed_studies", buckets=4)
    files = runs.selectExpr("bioproject", "_metadata.file_path AS f").distinct()
    assert files.count() == files.select("bioproject").distinct().count()  # one file per study
    assert files.select("f").distinct().count() <= 4
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        arms = studies.disjoint_arms(labels.label_small_rna(runs))
        assert "Exchange" not in plan(arms)
        figures = plan(studies.aggregate_small_rna(labels.label_small_rna(runs)))
        assert "Exchange" not in figures and "SelectedBucketsCount: 4 out of 4" in figures
        assert "Exchange" not in plan(anchor.restrict_to_studies(runs, anchors))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {tuple(r) for r in plan_rows(runs)} == expected and expected


def plan_rows(runs):
    arms = studies.disjoint_arms(labels.label_small_rna(runs)).collect()
    return arms + [r[:3] for r in screens.screen_small_rna(runs).collect()]


def test_open_ended_values_are_cut_before_a_group_meets(stored):
    _, runs = workflow.anchored_runs(stored)
    text = plan(studies.tissue_detail(labels.with_tissue_text(runs)))
    partial = text.index("Partial")
    assert text.index("Final") < text.rindex("Exchange", 0, partial) < partial
    # Distinct first, and that shuffle is spread over the values too.
    assert re.search(r"hashpartitioning\(bioproject#\d+, sra_study#\d+, tissue_attrs#\d+", text)


@pytest.mark.parametrize("kind", ["small_rna", "target"])
def test_study_figures_take_one_aggregate_over_runs(stored, kind):
    """Runs meet in one hash aggregate spread over the values; nothing is joined."""
    _, runs = workflow.anchored_runs(stored)
    if kind == "target":
        frame = studies.aggregate_target(staging.stage(screens.labelled_target_runs(runs), "labelled"))
    else:
        frame = studies.aggregate_small_rna(labels.label_small_rna(runs))
    text = plan(frame)
    assert "percentile" not in text and "coalesce(bioproject" not in text
    assert not re.search("Join|SortAggregate", text)
    # Arrays are collected from the few rows of a study that are left, two shuffles later.
    lines = text.splitlines()
    arrays = [i for i, line in enumerate(lines) if "ObjectHashAggregate" in line]
    shuffles = [i for i, line in enumerate(lines) if "Exchange" in line]
    assert arrays and max(arrays) < min(shuffles)
    # The shuffle over runs has the value in its key, after a partial aggregate in each task.
    over_runs = re.search(
        r"hashpartitioning\(bioproject#\d+, sra_study#\d+, organism#\d+, fact#\d+, label#\d+, text#\d+, number#\d+L.*\n.*HashAggregate.*partial_count\(1\)",
        text,
    )
    assert over_runs
    below = text[over_runs.end() :]
    assert "Exchange" not in below[: below.index("FileScan")]


def test_tissue_details_read_few_columns_of_kept_studies(stored):
    _, runs = workflow.anchored_runs(stored)
    text = re.sub(r"#\d+L?", "", plan(screens.screen_small_rna(runs)))
    assert "FileScan parquet [bioproject,sra_study,attr_blob]" in text
    assert "LeftSemi" in text


def test_code_of_the_run_view_is_small_enough_to_be_compiled(spark, tmp_path):
    spark.range(40).selectExpr(
        "id AS o_orderkey", "id % 7 AS o_custkey", "id * 1.5D AS o_totalprice",
        "TIMESTAMP_NTZ '2020-01-01' AS o_orderdate",
        "if(id % 3 = 0, NULL, '1-URGENT') AS o_orderpriority",
    ).write.parquet(f"{tmp_path}/orders.parquet")
    runs = fixture_views.run_metadata(spark, str(tmp_path))
    text = spark._jvm.PythonSQLUtils.explainString(runs._jdf.queryExecution(), "codegen")
    sizes = [int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000  # beyond, the JVM interprets the method for every run
    keys = {tuple(a["k"] for a in row["attributes"]) for row in runs.collect()}
    assert keys == {("disease_state", "strain", "tissue", "growth_media")}
