"""Run classifiers: column expressions over the columns of a study-run table.

Each classifier is an ordered chain, the first matching branch wins. They read
the columns of :data:`runsieve.sources.schemas.STUDY_RUNS` and
:func:`match_texts`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from runsieve.functions.regex import matches
from runsieve.functions.text import lower_or_empty
from runsieve.functions.vocabulary import DEFAULT, Vocabulary


def words(*parts: Column) -> Column:
    """The parts of a text to match, with blanks between them."""
    return F.concat_ws(" ", *parts)


def match_texts() -> dict[str, Column]:
    """The texts that patterns are tried on, over the columns of a run.

    Project them before classifying, else every pattern builds its text anew.
    """
    library, selection = F.col("lib_lc"), F.col("libsel_lc")
    attributes, instrument = F.col("attr_blob"), lower_or_empty(F.col("instrument"))
    return {
        "_run_text": words(attributes, library, selection),
        "_declared_text": words(library, selection),
        "_library_text": words(library, attributes),
        "_instrument_text": words(instrument, library, attributes),
    }


def single_cell_by_text(vocabulary: Vocabulary = DEFAULT) -> Column:
    return matches("_run_text", vocabulary.single_cell_terms)


def single_cell(vocabulary: Vocabulary = DEFAULT) -> Column:
    """Single cell by declared library source or by keyword."""
    declared = lower_or_empty(F.col("librarysource")) == vocabulary.single_cell_source
    return declared | single_cell_by_text(vocabulary)


def small_rna_library(vocabulary: Vocabulary = DEFAULT) -> Column:
    """Whether the library name or selection speaks of small RNA."""
    return matches("_declared_text", vocabulary.small_rna_terms)


def small_rna_evidence(vocabulary: Vocabulary = DEFAULT) -> Column:
    """Strongest tier of small-RNA evidence, NULL if there is none."""
    assay = F.lower(F.col("assay_type"))
    short = F.col("avgspotlen").between(*vocabulary.inferred_length)
    return (
        F.when(assay.isin(*vocabulary.small_rna_assays), "assay_declared")
        .when(small_rna_library(vocabulary), "library_declared")
        .when(
            matches("attr_blob", vocabulary.small_rna_terms), "attribute_mentioned"
        )
        .when(assay.isin(*vocabulary.general_rna_assays) & short, "readlen_inferred")
    )


def tissue_class(vocabulary: Vocabulary = DEFAULT) -> Column:
    """First tissue class whose pattern occurs in the tissue text."""
    text = "tissue_blob"
    # An empty text matches no class; testing it first saves all the patterns.
    chain = reduce(
        lambda branch, item: branch.when(matches(text, item[1]), item[0]),
        vocabulary.tissue_classes,
        F.when(F.col(text) == "", "unannotated"),
    )
    return chain.otherwise("other")


def priming_class(vocabulary: Vocabulary = DEFAULT) -> Column:
    """How the library was primed: declared selection first, then free text."""
    selection = F.col("libsel_lc")
    text = "_library_text"
    return (
        F.when(selection.isin(*vocabulary.random_selections), "random_declared")
        .when(
            selection.startswith(vocabulary.depletion_selection_prefix),
            "ribodep_declared",
        )
        .when(selection.isin(*vocabulary.polya_selections), "polya_declared")
        .when(matches(text, vocabulary.depletion_terms), "random_or_ribodep_text")
        .when(matches(text, vocabulary.polya_terms), "polya_text")
        .when(selection.isin(*vocabulary.open_selections), "unspecified")
        .otherwise("other_selection")
    )


def read_class(vocabulary: Vocabulary = DEFAULT) -> Column:
    """Long read by platform, by text, by mean length; else short read."""
    text = "_instrument_text"
    return (
        F.when(
            F.upper(F.col("platform")).isin(*vocabulary.long_read_platforms),
            "long_declared",
        )
        .when(matches(text, vocabulary.long_read_terms), "long_text")
        .when(F.col("avgspotlen") >= vocabulary.long_read_from, "long_inferred")
        .otherwise("short_read")
    )


def rna_class(vocabulary: Vocabulary = DEFAULT) -> Column:
    """Library class; small RNA claims a run first.

    Needs ``priming_class``, and :func:`small_rna_library` as ``_small_library``.
    """
    assay = lower_or_empty(F.col("assay_type"))
    source = lower_or_empty(F.col("librarysource"))
    priming = F.col("priming_class")
    return (
        F.when(
            assay.isin(*vocabulary.small_rna_assays) | F.col("_small_library"),
            "small_rna",
        )
        .when(
            ~source.startswith(vocabulary.rna_source_prefix)
            & ~assay.isin(*vocabulary.general_rna_assays),
            "not_rna",
        )
        .when(
            priming.isin(
                "random_declared", "ribodep_declared", "random_or_ribodep_text"
            ),
            "total_rna_random",
        )
        .when(priming.isin("polya_declared", "polya_text"), "polya_mrna")
        .otherwise("rna_unspecified")
    )


def is_long_read(read: Column, with_inferred: bool = False) -> Column:
    accepted = ["long_declared", "long_text"]
    return read.isin(*accepted, *(["long_inferred"] if with_inferred else []))


def is_target(
    vocabulary: Vocabulary = DEFAULT,
    long_inferred: bool = False,
    unspecified_rna: bool = False,
) -> Column:
    """Randomly primed or depleted RNA, or long-read RNA; never single cell.

    ``long_inferred`` also lets read length alone make a long-read run, and
    ``unspecified_rna`` takes bulk RNA-seq of unstated priming as a candidate.
    """
    rna = F.col("rna_class")
    wanted = (rna == "total_rna_random") | (
        is_long_read(F.col("read_class"), long_inferred)
        & ~rna.isin("small_rna", "not_rna")
    )
    if unspecified_rna:
        bulk = F.col("librarysource").eqNullSafe(vocabulary.bulk_rna_source) & F.col(
            "assay_type"
        ).eqNullSafe(vocabulary.bulk_rna_assay)
        wanted = wanted | ((rna == "rna_unspecified") & bulk)
    return wanted & ~F.col("single_cell")
