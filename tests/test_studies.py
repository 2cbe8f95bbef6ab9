"""Study aggregates against plain Python, with a hot study and NULL keys."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from runsieve.functions import report
from runsieve.functions.vocabulary import DEFAULT
from runsieve.operators import groups, labels, studies
from runsieve.plans import screens

from .rows import run, study_runs

DISEASES = ["Alzheimer's disease", "control", "dementia control", "none", "non-demented"]
TISSUES = ["prefrontal cortex", "csf", "plasma", "liver", None, "hippocampus", "x" * 80]


def many_runs(seed: int = 7, n: int = 600) -> list[dict]:
    """A third of the runs belong to one study; keys and values may be NULL."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        study = "PRJ0" if i % 3 == 0 else f"PRJ{rng.randint(1, 9)}"
        rows.append(
            run(
                [
                    ("disease", rng.choice(DISEASES)),
                    ("tissue", rng.choice(TISSUES)),
                    ("isolate", f"cor-{rng.randint(1, 40)}"),
                ],
                bioproject=None if study == "PRJ9" else study,
                sra_study=None if study in ("PRJ8", "PRJ9") else f"S{study}",
                organism=rng.choice(["Homo sapiens", "Mus musculus", None]),
                biosample=rng.choice([None, f"SAM{rng.randint(1, 200)}"]),
                assay_type=rng.choice(["miRNA-Seq", "RNA-Seq", None]),
                libraryselection=rng.choice(["RANDOM", "PolyA", None, "Inverse rRNA"]),
                library_name=rng.choice([None, f"lib {rng.randint(1, 60)}"]),
                avgspotlen=rng.choice([None, rng.randint(10, 700)]),
                mbytes=rng.choice([None, rng.randint(1, 5000)]),
                releasedate=dt.datetime(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 900)),
            )
        )
    return rows


def grouped(frame, keys):
    found = defaultdict(list)
    for row in frame.collect():
        found[tuple(row[k] for k in keys)].append(row)
    return found


def median(values):
    ordered = sorted(v for v in values if v is not None)
    return ordered[(len(ordered) - 1) // 2] if ordered else None


def distinct(values):
    return sorted({v for v in values if v is not None})


def total(values):
    known = [v for v in values if v is not None]
    return sum(known) if known else None


KEYS = list(studies.STUDY_KEYS)


def arms(rows):
    return {
        "case_only": sum(r.ad_hit and not r.ctrl_hit for r in rows),
        "control_only": sum(r.ctrl_hit and not r.ad_hit for r in rows),
        "ambiguous": sum(r.ad_hit and r.ctrl_hit for r in rows),
        "unlabeled": sum(not r.ad_hit and not r.ctrl_hit for r in rows),
    }


@pytest.fixture(scope="module")
def runs(spark):
    return study_runs(spark, many_runs()).cache()


def test_small_rna_aggregate(spark, runs):
    labelled = labels.label_small_rna(runs)
    expected = grouped(labelled, KEYS)
    rows = studies.aggregate_small_rna(labelled).collect()
    assert len(rows) == len(expected)
    for row in rows:
        members = expected[tuple(row[k] for k in KEYS)]
        assert row.n_runs == len(members)
        assert row.n_biosamples == len(distinct(m.biosample for m in members))
        for name, count in arms(members).items():
            assert row[name] == count
        assert sum(row[name] for name in arms(members)) == row.n_runs
        assert row.n_assay_declared == sum(
            m.srna_evidence == "assay_declared" for m in members
        )
        assert row.n_brain_any == sum(m.tissue_class.startswith("brain") for m in members)
        tissue_counts = [c for c in row.asDict() if c in TISSUE_COUNTS]
        assert sum(row[c] for c in tissue_counts) == row.n_runs
        assert row.ad_terms == distinct(m.ad_term for m in members)
        assert row.assay_types == distinct(m.assay_type for m in members)
        assert row.median_readlen == median(m.avgspotlen for m in members)
        size = total(m.mbytes for m in members)
        assert row.gb_per_run == (
            None if size is None else pytest.approx(size / len(members) / 1024, abs=6e-4)
        )
        assert row.latest_release == max(m.releasedate for m in members)


TISSUE_COUNTS = {
    "n_prefrontal",
    "n_hippocampal",
    "n_brain_other",
    "n_csf",
    "n_biofluid",
    "n_cell_model",
    "n_tissue_unannotated",
    "n_tissue_other",
}


def test_target_aggregate(spark, runs):
    flagged = labels.label_target(runs)
    expected = grouped(flagged, KEYS)
    rows = studies.aggregate_target(flagged).collect()
    assert len(rows) == len(expected)
    for row in rows:
        members = expected[tuple(row[k] for k in KEYS)]
        arm = [m for m in members if m.is_target]
        assert row.n_runs_total == len(members)
        assert row.n_target_runs == len(arm)
        assert row.n_target_biosamples == len(distinct(m.biosample for m in arm))
        for name, count in arms(arm).items():
            assert row[name] == count
        assert row.target_library_names == distinct(m.library_name for m in arm)[:8]
        assert row.target_selections == distinct(m.libraryselection for m in arm)
        assert row.ctrl_terms == distinct(m.ctrl_term for m in members)
        assert row.median_target_readlen == median(m.avgspotlen for m in arm)
        classes = ["total_rna_random", "polya_mrna", "small_rna", "rna_unspecified", "not_rna"]
        assert sum(row[f"n_{c}"] for c in classes) == row.n_runs_total


def test_terms_and_hits_agree(runs):
    for build in (labels.label_small_rna, labels.label_target):
        odd = build(runs).filter(
            (F.col("ad_hit") != F.col("ad_term").isNotNull())
            | (F.col("ctrl_hit") != F.col("ctrl_term").isNotNull())
        )
        assert odd.isEmpty()


def test_tissue_detail(spark, runs):
    frame = labels.with_tissue_text(runs)
    expected = defaultdict(set)
    for row in frame.collect():
        parts = row.tissue_blob.split(" | ")
        expected[row.bioproject, row.sra_study] |= {p for p in parts if 0 < len(p) < 70}
    found = {
        (r.bioproject, r.sra_study): r.tissue_attrs
        for r in studies.tissue_detail(frame).collect()
    }
    assert found == {k: ", ".join(sorted(v)[:6]) for k, v in expected.items() if v}


def test_smallest_distinct_and_null_keys(spark):
    rows = [("a", "x", None)] + [("a", None, f"v{i:02}") for i in range(30)] * 3
    frame = spark.createDataFrame(rows, "k1 string, k2 string, v string")
    found = groups.smallest_distinct(frame, ("k1", "k2"), "v", 4).collect()
    assert [tuple(r) for r in found] == [("a", None, ["v00", "v01", "v02", "v03"])]
    facts = groups.group_facts(frame, ("k1", "k2"), (F.lit(1).alias("one"),), texts={"v": F.col("v")})
    counted = facts.groupBy("k1", "k2").agg(groups.count_where(F.col("one") == 1), groups.distinct_in("v"))
    assert {tuple(r) for r in counted.collect()} == {("a", "x", 1, 0), ("a", None, 90, 30)}


@pytest.mark.parametrize("seed", range(3))
def test_medians_are_exact(spark, seed):
    """Against sorting, for groups of every size and heavy ties; two facts side by side."""
    rng = random.Random(seed)
    rows = []
    for size in [1, 2, 3, 4, 5, 10, 101, 4000]:
        spread = rng.choice([3, 50, 10**12])
        values = [rng.choice([None, rng.randint(-spread, spread)]) for _ in range(size)]
        rows += [(None if size == 4 else f"g{size}", v, None if v is None else v // 7) for v in values]
    frame = spark.createDataFrame(rows, "k string, v long, w long")
    one = F.lit(1).alias("one")
    facts = groups.group_facts(frame, ("k",), (one,), numbers={"v": F.col("v"), "w": F.col("w")})
    facts = groups.with_medians(facts, ("k",), ("v", "w"))
    found = {r.k: (r.v, r.w) for r in facts.groupBy("k").agg(F.min("v").alias("v"), F.min("w").alias("w")).collect()}
    assert found == {
        k: (median(v for g, v, _ in rows if g == k), median(w for g, _, w in rows if g == k)) for k in {r[0] for r in rows}
    }


def study(**counts):
    base = dict(
        case_only=3,
        control_only=3,
        n_assay_declared=1,
        n_library_declared=0,
        n_attr_mentioned=0,
        median_readlen=50,
        gb_per_run=0.1,
        n_single_cell=0,
    )
    return {**base, **counts}


def test_thresholds_and_their_relaxation(spark):
    cases = [
        study(),
        study(case_only=2),
        study(gb_per_run=0.015),
        study(median_readlen=120),
        study(median_readlen=150),
        study(median_readlen=14),
        study(n_assay_declared=0, n_attr_mentioned=4),
        study(n_single_cell=1),
        study(median_readlen=None),
        study(gb_per_run=None),
        study(case_only=2, control_only=2, n_assay_declared=0, n_library_declared=1),
    ]
    schema = "i int, " + ", ".join(
        f"{c} {'double' if c == 'gb_per_run' else 'int'}" for c in cases[0]
    )
    frame = spark.createDataFrame([(i, *c.values()) for i, c in enumerate(cases)], schema)

    def kept(thresholds):
        return {r.i for r in studies.keep_small_rna(frame, thresholds).collect()}

    assert kept(studies.SMALL_RNA) == {0, 3}
    assert [kept(t) for t in studies.RELAXED_SMALL_RNA] == [
        {0, 2, 3, 9},
        {0, 2, 3, 4, 9},
        {0, 2, 3, 4, 6, 9},
        {0, 1, 2, 3, 4, 6, 9, 10},
    ]


def test_target_screen_keeps_studies_with_null_keys(spark, runs):
    report = screens.screen_total_long(runs, screens.TargetRules(organisms=None)).collect()
    null_study = [r for r in report if r.sra_study is None]
    assert null_study and all(r.tissue_attrs is None for r in null_study)
    assert all(r.run_selector_url is None for r in null_study)
    order = [
        (
            0 if min(r.case_only, r.control_only) >= 3 else 1,
            -r.n_prefrontal,
            -r.n_brain_any,
            -r.smaller_arm,
            -r.n_target_runs,
        )
        for r in report
    ]
    assert order == sorted(order)


def test_restricting_a_screen_to_listed_studies(spark, runs):
    listed = ["PRJ0", "PRJ3", "absent"]
    table = spark.createDataFrame([(s,) for s in listed], "bioproject string")
    whole = screens.screen_total_long(runs).collect()
    expected = [r for r in whole if r.bioproject in listed]
    assert screens.screen_total_long(runs, among=listed).collect() == expected
    assert screens.screen_total_long(runs, among=table).collect() == expected
    assert {r.bioproject for r in studies.matched_design(
        screens.screen_total_long(runs)
    ).collect()} == {r.bioproject for r in whole if r.n_small_rna > 0}


def test_small_rna_screen_is_ranked(spark, runs):
    loose = studies.SmallRnaThresholds(1, (0, 10_000), None, True)
    report = screens.screen_small_rna(runs, loose).collect()
    order = [
        (-r.n_prefrontal, -r.n_brain_any, -r.smaller_arm, *((r[k] is not None, r[k] or "") for k in KEYS))
        for r in report
    ]
    assert len(report) > 5 and order == sorted(order)


def test_ladders_give_the_rows_of_the_single_screens(spark, runs):
    small = (
        studies.SmallRnaThresholds(20, (0, 300), 1.5),
        studies.SmallRnaThresholds(12, (0, 400), None),
        studies.SmallRnaThresholds(2, (0, 400), None, True),
    )
    whole = screens.ladder_small_rna(runs, small).drop("tissue_attrs").collect()
    seen = set()
    for rung, thresholds in enumerate(small):
        rows = {tuple(r)[:3]: r for r in screens.screen_small_rna(runs, thresholds).drop("tissue_attrs").collect()}
        fresh = {k: tuple(v) for k, v in rows.items() if k not in seen}
        assert {tuple(r)[1:4]: tuple(r)[1:] for r in whole if r.rung == rung} == fresh
        seen |= set(rows)
    assert len({r.rung for r in whole}) > 1
    target = (
        screens.TargetRules(("Mus musculus",)),
        screens.TargetRules(("Mus musculus",), True, True),
        screens.TargetRules(None, True, True),
    )
    whole = screens.ladder_total_long(runs, target).collect()
    seen = set()
    for rung, rules in enumerate(target):
        rows = {(r.bioproject, r.sra_study, r.organism): tuple(r) for r in screens.screen_total_long(runs, rules).collect()}
        fresh = {k: v for k, v in rows.items() if k not in seen}
        found = {(r.bioproject, r.sra_study, r.organism): tuple(r)[1:] for r in whole if r.rung == rung}
        assert found == fresh
        seen |= set(rows)
    assert {r.rung for r in whole} >= {0, 2}


def test_other_classes_lengths_and_limits_reach_the_reports(spark, runs):
    vocabulary = replace(
        DEFAULT,
        tissue_classes=(("liver", "liver"), *DEFAULT.tissue_classes[3:]),
        inferred_length=(300, 400),
        long_read_from=650,
    )
    labelled = labels.label_small_rna(runs, vocabulary)
    inferred = labelled.filter("srna_evidence = 'readlen_inferred'").select("avgspotlen").collect()
    assert inferred and all(300 <= r.avgspotlen <= 400 for r in inferred)
    row = studies.aggregate_small_rna(labelled, vocabulary).agg(
        F.sum("n_liver").alias("liver"), F.sum("n_prefrontal").alias("none"), F.sum("n_runs").alias("runs")
    ).first()
    assert row.liver == labelled.filter("tissue_class = 'liver'").count() > 0 and row.none == 0
    flagged = labels.label_target(runs, vocabulary)
    long_reads = flagged.filter("read_class = 'long_inferred'").select("avgspotlen").collect()
    assert long_reads and all(r.avgspotlen >= 650 for r in long_reads)
    limits = report.Limits(enough=9, thin=5, library_names=2, tissue_fragments=1, fragment_length=12)
    found = screens.screen_total_long(runs, vocabulary=vocabulary, limits=limits)
    assert found.columns[-1] == "n_liver"
    rows = found.collect()
    assert any(r.verdict == "thin - 5v5, underpowered" for r in rows)
    for r in rows:
        assert (r.verdict == "PASSES - real contrast") == (r.smaller_arm >= 9)
        assert len(r.target_library_names) <= 2 and len(r.tissue_attrs or "") < 12
