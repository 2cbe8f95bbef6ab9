"""From run metadata to the complete run inventory of the studies of interest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsieve.functions.regex import matches
from runsieve.functions.text import attribute_text, label_text, lower_or_empty
from runsieve.functions.vocabulary import DEFAULT, ORGANISMS, Vocabulary
from runsieve.sources import schemas


def _public(metadata: DataFrame) -> DataFrame:
    return metadata.filter(F.col("consent") == "public")


def anchor_scan(
    metadata: DataFrame,
    vocabulary: Vocabulary = DEFAULT,
    organisms: Sequence[str] | None = ORGANISMS,
) -> DataFrame:
    """Distinct accessions of the studies whose labels mention the disease.

    Anchors on the disease because its terms are rare, control terms are not.
    """
    runs = _public(metadata)
    if organisms is not None:
        runs = runs.filter(F.col("organism").isin(*organisms))
    label = label_text(F.col("attributes"), vocabulary)
    labelled = runs.select("bioproject", label.alias("label_blob"))
    # A filter would move below the projection and make the label text anew for
    # each literal of the pattern; a generator stays above it.
    hit = matches("label_blob", vocabulary.case_terms)
    return labelled.select(
        F.explode(F.when(hit, F.array("bioproject"))).alias("bioproject")
    ).distinct()


def with_text_columns(
    metadata: DataFrame, vocabulary: Vocabulary = DEFAULT
) -> DataFrame:
    """The carried columns and the four text columns of a study-run table."""
    attributes = F.col("attributes")
    return metadata.select(
        *schemas.CARRIED.names,
        lower_or_empty(F.col("library_name")).alias("lib_lc"),
        lower_or_empty(F.col("libraryselection")).alias("libsel_lc"),
        attribute_text(attributes).alias("attr_blob"),
        label_text(attributes, vocabulary).alias("label_blob"),
    )


def extract_study_runs(
    metadata: DataFrame, anchors: DataFrame, vocabulary: Vocabulary = DEFAULT
) -> DataFrame:
    """Every public run of the anchored studies, of any organism and assay.

    Give ``anchors`` as a stored or staged table: the optimizer then knows its
    size, and broadcasts it only below the broadcast threshold. Beyond it the runs
    are shuffled with their attributes; then a Bloom filter of the anchors, made at
    run time, keeps most runs of other studies out of that shuffle, as long as the
    anchors stay below ``spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold``.
    """
    # Always true for a key that can match. The optimizer makes a run-time filter
    # only from a side that it takes for a selection.
    keys = anchors.select("bioproject").filter(F.col("bioproject") >= "")
    runs = _public(metadata).join(keys, "bioproject", "left_semi")
    return with_text_columns(runs, vocabulary)


def stage_audit(anchors: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: anchored studies, studies with runs, total runs."""
    anchored = anchors.agg(
        F.count_distinct("bioproject").alias("anchored_bioprojects"),
        F.lit(0).cast("bigint").alias("with_runs_pulled"),
        F.lit(0).cast("bigint").alias("total_runs"),
    )
    pulled = runs.agg(
        F.lit(0).cast("bigint").alias("anchored_bioprojects"),
        F.count_distinct("bioproject").alias("with_runs_pulled"),
        F.count(F.lit(1)).alias("total_runs"),
    )
    return anchored.union(pulled).agg(*(F.sum(c).alias(c) for c in anchored.columns))


def restrict_to_studies(
    runs: DataFrame, studies: Sequence[str] | DataFrame
) -> DataFrame:
    """The runs of a supplied accession list, or of a table of accessions."""
    if isinstance(studies, DataFrame):
        return runs.join(studies.select("bioproject"), "bioproject", "left_semi")
    return runs.filter(F.col("bioproject").isin(*studies))


def inspect_studies(
    runs: DataFrame, studies: Sequence[str] | DataFrame
) -> DataFrame:
    """Raw label and attribute text of each run of the chosen studies."""
    return (
        restrict_to_studies(runs, studies)
        .select(
            "bioproject",
            "sra_study",
            "acc",
            "biosample",
            "assay_type",
            "libraryselection",
            "library_name",
            "avgspotlen",
            F.round(F.col("mbytes") / 1024, 3).alias("gb"),
            "label_blob",
            "attr_blob",
        )
        .orderBy("bioproject", "acc")
    )
