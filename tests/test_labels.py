"""One row per rule of the run classifiers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from runsieve.functions import text
from runsieve.functions.vocabulary import LABEL_KEYS
from runsieve.operators import labels

from .rows import metadata, run, study_runs


def labelled(spark, build, rows, *columns):
    frame = build(study_runs(spark, rows)).select("acc", *columns)
    by_acc = {r["acc"]: tuple(r)[1:] for r in frame.collect()}
    return [by_acc[r["acc"]] for r in rows]


def one_attribute(key, value):
    return run([(key, value)])


def texts(spark, rows):
    frame = metadata(spark, rows).select(
        "acc",
        text.attribute_text(F.col("attributes")).alias("all"),
        text.scoped_text(F.col("attributes"), LABEL_KEYS).alias("scoped"),
        text.label_text(F.col("attributes")).alias("label"),
    )
    by_acc = {r["acc"]: tuple(r)[1:] for r in frame.collect()}
    return [by_acc[r["acc"]] for r in rows]


def test_attribute_texts(spark):
    rows = [
        run([("tissue", "Cortex"), ("Disease", "AD"), ("age", "9")]),
        run([("group", None), ("group", "x"), (None, "y")]),
        run(None),
        run([]),
        run([("tissue", "b"), ("tissue", "a")]),
        run([("group", "b"), ("cohort", "a")]),
    ]
    assert texts(spark, rows) == [
        ("disease=ad | age=9 | tissue=cortex", "disease=ad", "disease=ad"),
        ("group=x", "group=x", "group=x"),
        ("", "", ""),
        ("", "", ""),
        ("tissue=a | tissue=b", "", ""),
        ("cohort=a | group=b", "group=b | cohort=a", "group=b | cohort=a"),
    ]


def test_negation_and_blanked_phrase(spark):
    values = {
        "disease_state=non-demented": "disease_state= negctrl ",
        "diagnosis=nonalzheimer's": "diagnosis= negctrl ",
        "treatment=ad libitum": "treatment= ",
        "genotype=Non-Tg": "genotype= negctrl ",
        "group=non carrier": "group= negctrl ",
        "group=nonadherent": "group=nonadherent",
    }
    rows = [run([tuple(pair.split("="))]) for pair in values]
    assert [label for _, _, label in texts(spark, rows)] == list(values.values())
    hits = labelled(spark, labels.label_small_rna, rows, "ad_hit", "ctrl_hit")
    assert hits == [
        (False, True),
        (False, True),
        (False, False),
        (False, True),
        (False, True),
        (False, False),
    ]


def test_negation_rewrite_is_idempotent(spark):
    rows = [one_attribute("group", s) for s in ("non-ad", "nonnon-tg", "non_dementia b")]
    frame = metadata(spark, rows).select(
        text.label_text(F.col("attributes")).alias("once")
    )
    again = frame.select("once", text.rewrite_negation(F.col("once")).alias("twice"))
    assert all(r.once == r.twice for r in again.collect())


def test_tissue_text_is_scoped_to_keys(spark):
    rows = [
        run([("growth_media", "fetal bovine serum")]),
        run([("source_name", "serum"), ("tissue", "b"), ("age", "3")]),
        run([("brainid", "frontal-12")]),
        run([("tissue", "a | cell_type=z")]),
    ]
    assert labelled(
        spark, labels.label_small_rna, rows, "tissue_blob", "tissue_class"
    ) == [
        ("", "unannotated"),
        ("source_name=serum | tissue=b", "biofluid"),
        ("brainid=frontal-12", "brain_prefrontal"),
        ("cell_type=z | tissue=a", "other"),
    ]


@pytest.mark.parametrize("build", [labels.label_small_rna, labels.label_target])
def test_tissue_classes(spark, build):
    expected = {
        "prefrontal cortex and hippocampus": "brain_prefrontal",
        "BA 9": "brain_prefrontal",
        "dentate gyrus": "brain_hippocampal",
        "temporal cortex": "brain_other",
        "whole brain": "brain_other",
        "csf": "csf",
        "plasma EVs": "biofluid",
        "SH-SY5Y": "cell_model",
        "liver": "other",
    }
    rows = [one_attribute("tissue", value) for value in expected]
    assert labelled(spark, build, rows, "tissue_class") == [
        (c,) for c in expected.values()
    ]


def test_case_control_and_terms(spark):
    rows = [
        run([("disease", "alzheimer"), ("group", "control")]),
        run([("genotype", "APP/PS1")]),
        run([("group", "healthy")]),
        run([("tissue", "alzheimer")]),
        run([("group", "éwt")]),
        run([("group", "s11_control")]),
    ]
    assert labelled(spark, labels.label_small_rna, rows, "ad_term", "ctrl_term") == [
        ("alzheimer", "control"),
        ("app/ps1", None),
        (None, "healthy"),
        (None, None),
        (None, "wt"),
        (None, None),
    ]


def test_small_rna_evidence_tiers(spark):
    mention = [("protocol", "miRNA kit")]
    rows = [
        run(mention, assay_type="miRNA-Seq", library_name="small RNA"),
        run(mention, library_name="Small-RNA 3"),
        run(mention, libraryselection="size fractionation"),
        run(mention),
        run(avgspotlen=15),
        run(avgspotlen=51, assay_type="OTHER"),
        run(avgspotlen=52),
        run(avgspotlen=None),
        run(avgspotlen=20, assay_type="WGS"),
        run(avgspotlen=20, assay_type=None),
    ]
    assert [e for (e,) in labelled(spark, labels.label_small_rna, rows, "srna_evidence")] == [
        "assay_declared",
        "library_declared",
        "library_declared",
        "attribute_mentioned",
        "readlen_inferred",
        "readlen_inferred",
        None,
        None,
        None,
        None,
    ]


def test_single_cell_versions(spark):
    rows = [
        run(librarysource="TRANSCRIPTOMIC SINGLE CELL"),
        run(library_name="Smart-seq2 plate"),
        run([("protocol", "10x Genomics")], librarysource=None),
        run(),
    ]
    first = labelled(spark, labels.label_small_rna, rows, "single_cell")
    second = labelled(spark, labels.label_target, rows, "single_cell")
    assert first == [(False,), (True,), (True,), (False,)]
    assert second == [(True,), (True,), (True,), (False,)]


def test_library_name_fallback(spark):
    rows = [
        run(library_name="WT-107"),
        run(library_name="WT3.R1"),
        run(library_name="PREC_S11_control"),
        run([("disease", "alzheimer")], library_name="wt-1"),
        run([("group", "control")], library_name="5xFAD"),
        run(library_name="5xFAD"),
        run(library_name="non-demented 4"),
    ]
    assert labelled(
        spark, labels.label_target, rows, "label_eff", "ad_term", "ctrl_term"
    ) == [
        (" wt-107", None, "wt"),
        (" wt3.r1", None, None),
        (" prec_s11_control", None, None),
        ("disease=alzheimer", "alzheimer", None),
        ("group=control", None, "control"),
        (" 5xfad", "5xfad", None),
        (" non-demented 4", None, "non-demented"),
    ]


def test_strain_is_a_conditional_control(spark):
    rows = [
        one_attribute("strain", "C57BL/6J"),
        one_attribute("strain", "5xFAD on C57BL/6J"),
        run([("strain", "C57BL/6J"), ("genotype", "wild type")]),
        run(library_name="b6129 2"),
    ]
    assert labelled(
        spark, labels.label_target, rows, "ad_hit", "ctrl_hit", "ctrl_term"
    ) == [
        (False, True, "c57bl"),
        (True, False, None),
        (False, True, "wild type"),
        (False, True, "b6129"),
    ]
    assert labelled(spark, labels.label_small_rna, rows[:1], "ctrl_hit") == [(False,)]


def test_priming_read_and_rna_classes(spark):
    rows = [
        run(libraryselection="RANDOM"),
        run(libraryselection="cDNA_randomPriming"),
        run(libraryselection="Inverse rRNA selection"),
        run(libraryselection="PolyA"),
        run(libraryselection=None),
        run(libraryselection="PCR"),
        run(library_name="Ribo-Zero prep"),
        run([("protocol", "oligo-dT")]),
        run([("protocol", "total RNA was extracted")]),
        run(libraryselection="size fractionation", library_name="ribo-zero"),
        run(assay_type="WGS", librarysource=None, libraryselection="RANDOM"),
        run(assay_type="ncRNA-Seq", libraryselection="RANDOM"),
    ]
    assert labelled(
        spark, labels.label_target, rows, "priming_class", "rna_class", "is_target"
    ) == [
        ("random_declared", "total_rna_random", True),
        ("random_declared", "total_rna_random", True),
        ("ribodep_declared", "total_rna_random", True),
        ("polya_declared", "polya_mrna", False),
        ("unspecified", "rna_unspecified", False),
        ("other_selection", "rna_unspecified", False),
        ("random_or_ribodep_text", "total_rna_random", True),
        ("polya_text", "polya_mrna", False),
        ("unspecified", "rna_unspecified", False),
        ("random_or_ribodep_text", "small_rna", False),
        ("random_declared", "not_rna", False),
        ("random_declared", "small_rna", False),
    ]


def test_long_reads(spark):
    rows = [
        run(platform="PacBio_SMRT", libraryselection="PolyA"),
        run(instrument="MinION", platform=None),
        run([("protocol", "Iso-Seq")]),
        run(avgspotlen=600, platform=None),
        run(avgspotlen=599),
        run(platform="OXFORD_NANOPORE", assay_type="miRNA-Seq"),
        run(platform="OXFORD_NANOPORE", librarysource="TRANSCRIPTOMIC SINGLE CELL"),
    ]
    assert labelled(spark, labels.label_target, rows, "read_class", "is_target") == [
        ("long_declared", True),
        ("long_text", True),
        ("long_text", True),
        ("long_inferred", False),
        ("short_read", False),
        ("long_declared", False),
        ("long_declared", False),
    ]


def test_relaxed_target(spark):
    rows = [
        run(avgspotlen=700),
        run(),
        run(librarysource="TRANSCRIPTOMIC SINGLE CELL"),
        run(assay_type=None),
        run(librarysource=None),
    ]

    def targets(**rules):
        build = lambda runs: labels.label_target(runs, **rules)
        return [t for (t,) in labelled(spark, build, rows, "is_target")]

    assert targets() == [False] * 5
    assert targets(long_inferred=True) == [True, False, False, False, False]
    assert targets(unspecified_rna=True) == [True, True, False, False, False]
