"""Run-level labelling: every classifier a screen needs, as columns.

The labels come in few layers of columns. Each layer reads texts of the one
before, so every text is built once, and every pattern is matched once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsieve.functions import classify
from runsieve.functions.regex import found_term
from runsieve.functions.text import tissue_text
from runsieve.functions.vocabulary import DEFAULT, Vocabulary


def with_tissue_text(runs: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    return runs.withColumn("tissue_blob", tissue_text(F.col("attr_blob"), vocabulary))


def with_match_texts(runs: DataFrame) -> DataFrame:
    return runs.withColumns(classify.match_texts())


def _some(term: str) -> Column:
    """Whether a found term is there; never NULL."""
    return F.coalesce(F.col(term) != "", F.lit(False))


def label_small_rna(runs: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Study runs with the labels of the small-RNA screen."""
    label = "label_blob"
    read = runs.withColumns(
        {
            **classify.match_texts(),
            "tissue_blob": tissue_text(F.col("attr_blob"), vocabulary),
            "_case": found_term(label, vocabulary.case_terms),
            "_control": found_term(label, vocabulary.control_terms),
        }
    )
    return read.withColumns(
        {
            "ad_term": F.when(_some("_case"), F.col("_case")),
            "ctrl_term": F.when(_some("_control"), F.col("_control")),
            "ad_hit": _some("_case"),
            "ctrl_hit": _some("_control"),
            "single_cell": classify.single_cell_by_text(vocabulary),
            "srna_evidence": classify.small_rna_evidence(vocabulary),
            "tissue_class": classify.tissue_class(vocabulary),
        }
    ).drop("_case", "_control", *classify.match_texts())


def label_target(
    runs: DataFrame,
    vocabulary: Vocabulary = DEFAULT,
    long_inferred: bool = False,
    unspecified_rna: bool = False,
) -> DataFrame:
    """Study runs with the labels of the total / long-read screen.

    ``label_eff`` is the label text, with the library name added where the
    labels carry neither a case nor a control term. A text is matched only as
    far as its outcome is open: NULL texts are not tried on any pattern.
    """
    label, named = "label_blob", "_named_label"
    case, control = vocabulary.case_terms, vocabulary.control_terms
    read = runs.withColumns(
        {
            **classify.match_texts(),
            "tissue_blob": tissue_text(F.col("attr_blob"), vocabulary),
            "_case": found_term(label, case),
            "_control": found_term(label, control),
        }
    )
    classed = read.withColumns(
        {
            named: F.when(
                ~_some("_case") & ~_some("_control"), classify.words(label, "lib_lc")
            ),
            "priming_class": classify.priming_class(vocabulary),
            "read_class": classify.read_class(vocabulary),
            "single_cell": classify.single_cell(vocabulary),
            "tissue_class": classify.tissue_class(vocabulary),
            "_small_library": classify.small_rna_library(vocabulary),
        }
    )
    named_too = classed.withColumns(
        {
            "label_eff": F.coalesce(named, label),
            "rna_class": classify.rna_class(vocabulary),
            "_named_case": found_term(named, case),
            "_named_control": found_term(named, control),
        }
    )
    # Disease models are kept on the same strains, so a case term vetoes the
    # strain; without one the strain alone marks a control animal.
    terms = ("_case", "_named_case", "_control", "_named_control")
    unmarked = ~reduce(Column.__or__, map(_some, terms))
    strained = named_too.withColumn(
        "_strain", F.when(unmarked, found_term("label_eff", vocabulary.strain_terms))
    )

    def first_of(*names: str) -> Column:
        return F.coalesce(*(F.when(_some(n), F.col(n)) for n in names))

    return strained.withColumns(
        {
            "ad_term": first_of("_case", "_named_case"),
            "ctrl_term": first_of("_control", "_named_control", "_strain"),
            "ad_hit": _some("_case") | _some("_named_case"),
            "ctrl_hit": _some("_control") | _some("_named_control") | _some("_strain"),
            "is_target": classify.is_target(
                vocabulary, long_inferred, unspecified_rna
            ),
        }
    ).drop(*terms, named, "_strain", "_small_library", *classify.match_texts())
