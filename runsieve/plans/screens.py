"""The two screens: study runs in, one ranked row per study out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsieve.functions import classify, report
from runsieve.functions.vocabulary import DEFAULT, ORGANISMS, Vocabulary
from runsieve.operators import labels, studies
from runsieve.operators.anchor import restrict_to_studies
from runsieve.sources.schemas import STUDY_KEYS
from runsieve.sources.staging import stage

_TIE_BREAKERS = STUDY_KEYS

# The columns of both reports, in their order.
_SMALL_RNA_COLUMNS = (
    *STUDY_KEYS,
    "cohort_line",
    "tissue_verdict",
    "n_prefrontal",
    "n_hippocampal",
    "n_brain_other",
    "n_brain_any",
    "n_csf",
    "n_biofluid",
    "n_cell_model",
    "n_tissue_unannotated",
    "n_tissue_other",
    "tissue_attrs",
    "smaller_arm",
    "case_only",
    "control_only",
    "ambiguous",
    "unlabeled",
    "n_runs",
    "n_biosamples",
    "n_assay_declared",
    "n_library_declared",
    "ad_terms",
    "ctrl_terms",
    "assay_types",
    "median_readlen",
    "gb_per_run",
    "total_gb",
    "latest_release",
    "bioproject_url",
    "run_selector_url",
)

_TARGET_COLUMNS = (
    "verdict",
    *STUDY_KEYS,
    "cohort_line",
    "evidence",
    "tissue_verdict",
    "smaller_arm",
    "n_target_runs",
    "n_target_biosamples",
    "n_runs_total",
    "n_total_rna_random",
    "n_long_read",
    "n_long_inferred",
    "n_polya_mrna",
    "n_small_rna",
    "n_rna_unspecified",
    "n_not_rna",
    "n_random_declared",
    "n_ribodep_declared",
    "n_random_text",
    "n_priming_unspecified",
    "n_prefrontal",
    "n_hippocampal",
    "n_brain_other",
    "n_brain_any",
    "n_csf",
    "n_biofluid",
    "n_cell_model",
    "n_tissue_unannotated",
    "tissue_attrs",
    "case_only",
    "control_only",
    "ambiguous",
    "unlabeled",
    "n_single_cell",
    "target_librarysources",
    "target_selections",
    "target_assay_types",
    "target_platforms",
    "target_instruments",
    "target_library_names",
    "ad_terms",
    "ctrl_terms",
    "median_target_readlen",
    "target_gb",
    "latest_release",
    "bioproject_url",
    "run_selector_url",
)

# End of the fixed values.

#: What the target screen needs of a labelled run once its texts are matched.
_LABELLED_TARGET_COLUMNS = (
    *STUDY_KEYS,
    "biosample",
    "library_name",
    "librarysource",
    "libraryselection",
    "assay_type",
    "platform",
    "instrument",
    "avgspotlen",
    "mbytes",
    "releasedate",
    "tissue_blob",
    "ad_term",
    "ctrl_term",
    "ad_hit",
    "ctrl_hit",
    "priming_class",
    "read_class",
    "rna_class",
    "tissue_class",
    "single_cell",
    "is_target",
)


def _further(vocabulary: Vocabulary, columns: Sequence[str], absent: Sequence[str] = ()) -> list[str]:
    """Counters of tissue classes that a report has no fixed column for."""
    return [c for c in studies.tissue_counters(vocabulary) if c not in (*columns, *absent)]


def report_small_rna(
    kept: DataFrame,
    tissues: DataFrame,
    carried: Sequence[str] = (),
    vocabulary: Vocabulary = DEFAULT,
) -> DataFrame:
    """Report columns and rank of the kept studies of the small-RNA screen.

    Counters of further tissue classes of the vocabulary come last.
    """
    return (
        kept.join(tissues, ["bioproject", "sra_study"], "left")
        .withColumns(
            {
                "cohort_line": report.cohort_line(),
                "tissue_verdict": report.tissue_verdict(),
                "smaller_arm": report.smaller_arm(),
                "bioproject_url": report.bioproject_url(),
                "run_selector_url": report.run_selector_url(),
            }
        )
        .select(*carried, *_SMALL_RNA_COLUMNS, *_further(vocabulary, _SMALL_RNA_COLUMNS))
        .orderBy(
            *carried,
            F.desc("n_prefrontal"),
            F.desc("n_brain_any"),
            F.desc("smaller_arm"),
            *_TIE_BREAKERS,
        )
    )


def report_target(
    kept: DataFrame,
    tissues: DataFrame,
    carried: Sequence[str] = (),
    vocabulary: Vocabulary = DEFAULT,
    limits: report.Limits = report.LIMITS,
) -> DataFrame:
    """Report columns and rank of the studies of the total / long-read screen.

    Counters of further tissue classes of the vocabulary come last.
    ``carried`` columns are part of the key of ``tissues`` too.
    """
    return (
        kept.join(tissues, ["bioproject", "sra_study", *carried], "left")
        .withColumns(
            {
                "verdict": report.verdict(enough=limits.enough, thin=limits.thin),
                "cohort_line": report.cohort_line(
                    "n_target_biosamples", "target samples"
                ),
                "evidence": report.evidence(),
                "tissue_verdict": report.tissue_verdict("n_target_runs"),
                "smaller_arm": report.smaller_arm(),
                "bioproject_url": report.bioproject_url(),
                "run_selector_url": report.run_selector_url(),
            }
        )
        .select(*carried, *_TARGET_COLUMNS, *_further(vocabulary, _TARGET_COLUMNS, ["n_tissue_other"]))
        .orderBy(
            *carried,
            F.when(report.passes(limits.enough), 0).otherwise(1),
            F.desc("n_prefrontal"),
            F.desc("n_brain_any"),
            F.desc("smaller_arm"),
            F.desc("n_target_runs"),
            *_TIE_BREAKERS,
        )
    )


def in_organisms(runs: DataFrame, organisms: Sequence[str] | None) -> DataFrame:
    if organisms is None:
        return runs
    return runs.filter(F.col("organism").isin(*organisms))


def _among(runs: DataFrame, listed: Sequence[str] | DataFrame | None) -> DataFrame:
    return runs if listed is None else restrict_to_studies(runs, listed)


def screen_small_rna(
    runs: DataFrame,
    thresholds: studies.SmallRnaThresholds = studies.SMALL_RNA,
    vocabulary: Vocabulary = DEFAULT,
    organisms: Sequence[str] | None = None,
    among: Sequence[str] | DataFrame | None = None,
    limits: report.Limits = report.LIMITS,
) -> DataFrame:
    """Studies with a case/control contrast in small-RNA sequencing.

    ``runs`` is a study-run table, ``among`` restricts it to given accessions.
    The kept studies are staged: they are few, and their known size lets the
    optimizer broadcast them into the second, narrow scan for tissue details.
    """
    runs = _among(in_organisms(runs, organisms), among)
    labelled = labels.label_small_rna(runs, vocabulary)
    kept = stage(
        studies.keep_small_rna(studies.aggregate_small_rna(labelled, vocabulary), thresholds),
        "kept-studies",
    )
    tissues = _tissues_of(kept, runs, vocabulary, limits)
    return report_small_rna(kept, tissues, vocabulary=vocabulary)


def _tissues_of(
    kept: DataFrame, runs: DataFrame, vocabulary: Vocabulary, limits: report.Limits
) -> DataFrame:
    kept_runs = restrict_to_studies(
        runs.select("bioproject", "sra_study", "attr_blob"), kept
    )
    return studies.tissue_detail(labels.with_tissue_text(kept_runs, vocabulary), limits=limits)


def ladder_small_rna(
    runs: DataFrame,
    ladder: Sequence[studies.SmallRnaThresholds] = (
        studies.SMALL_RNA,
        *studies.RELAXED_SMALL_RNA,
    ),
    vocabulary: Vocabulary = DEFAULT,
    organisms: Sequence[str] | None = None,
    among: Sequence[str] | DataFrame | None = None,
    limits: report.Limits = report.LIMITS,
) -> DataFrame:
    """The report of every study some rung keeps, with ``rung``, the first that does.

    The rows up to a rung are those of :func:`screen_small_rna` with its
    thresholds, if each rung loosens the one before. Runs are labelled and
    counted once, whatever the number of rungs.
    """
    runs = _among(in_organisms(runs, organisms), among)
    counted = studies.aggregate_small_rna(labels.label_small_rna(runs, vocabulary), vocabulary)
    rung = studies.first_rung([studies.passes(thresholds) for thresholds in ladder])
    kept = stage(counted.withColumn("rung", rung).filter("rung IS NOT NULL"), "kept-studies")
    tissues = _tissues_of(kept, runs, vocabulary, limits)
    return report_small_rna(kept, tissues, ("rung",), vocabulary)


@dataclass(frozen=True)
class TargetRules:
    """What counts as a target run, and in which organisms."""

    organisms: tuple[str, ...] | None = ORGANISMS
    long_inferred: bool = False
    unspecified_rna: bool = False


TARGET = TargetRules()
#: Loosenings in the order they should be tried, each on top of the one before.
RELAXED_TARGET = (
    TargetRules(long_inferred=True),
    TargetRules(long_inferred=True, unspecified_rna=True),
    TargetRules(organisms=None, long_inferred=True, unspecified_rna=True),
)


def labelled_target_runs(
    runs: DataFrame, rules: TargetRules = TARGET, vocabulary: Vocabulary = DEFAULT
) -> DataFrame:
    """Labelled runs without their long texts, ready for the study aggregates."""
    runs = in_organisms(runs, rules.organisms)
    return labels.label_target(
        runs, vocabulary, rules.long_inferred, rules.unspecified_rna
    ).select(*_LABELLED_TARGET_COLUMNS)


def screen_total_long(
    runs: DataFrame,
    rules: TargetRules = TARGET,
    vocabulary: Vocabulary = DEFAULT,
    among: Sequence[str] | DataFrame | None = None,
    limits: report.Limits = report.LIMITS,
) -> DataFrame:
    """Studies with total or long-read RNA, each with a verdict on its cohort.

    The labelled runs are staged without their texts: matching the patterns is
    the costly part, and four aggregates read its outcome.
    """
    runs = _among(runs, among)
    flagged = stage(labelled_target_runs(runs, rules, vocabulary), "labelled-runs")
    kept = studies.keep_with_target(studies.aggregate_target(flagged, vocabulary, limits))
    tissues = studies.tissue_detail(flagged.filter("is_target"), limits=limits)
    return report_target(kept, tissues, vocabulary=vocabulary, limits=limits)


def ladder_total_long(
    runs: DataFrame,
    ladder: Sequence[TargetRules] = (TARGET, *RELAXED_TARGET),
    vocabulary: Vocabulary = DEFAULT,
    among: Sequence[str] | DataFrame | None = None,
    limits: report.Limits = report.LIMITS,
) -> DataFrame:
    """The report of every study at ``rung``, the first rules that find a target run.

    What a study shows is what :func:`screen_total_long` reports for it under
    those rules. Runs are labelled once: each keeps the number of the first rules
    that take it, and a study counts the runs of its own first rules.
    """
    labelled = labels.label_target(_among(runs, among), vocabulary)
    takes = [
        classify.is_target(vocabulary, rules.long_inferred, rules.unspecified_rna)
        & (F.lit(True) if rules.organisms is None else F.col("organism").isin(*rules.organisms))
        for rules in ladder
    ]
    narrow = [c for c in _LABELLED_TARGET_COLUMNS if c != "is_target"]
    flagged = stage(
        labelled.withColumn("run_rung", studies.first_rung(takes)).select(*narrow, "run_rung"),
        "labelled-runs",
    )
    # One row per study, staged so that the optimizer knows its size.
    first = stage(
        flagged.filter("run_rung IS NOT NULL")
        .groupBy(*(F.col(k).alias(f"_{k}") for k in STUDY_KEYS))
        .agg(F.min("run_rung").alias("rung")),
        "first-rungs",
    )
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in STUDY_KEYS]
    chosen = flagged.join(first, same).withColumn(
        "is_target", F.coalesce(F.col("run_rung") == F.col("rung"), F.lit(False))
    )
    kept = studies.aggregate_target(chosen, vocabulary, limits).join(first, same)
    # Organisms of one study share tissues, of all runs that the rules of a rung take.
    rungs = first.select("_bioproject", "_sra_study", "rung").distinct()
    of_rung = flagged.join(
        rungs,
        (F.col("bioproject") == F.col("_bioproject"))
        & (F.col("sra_study") == F.col("_sra_study"))
        & (F.col("run_rung") <= F.col("rung")),
    )
    tissues = studies.tissue_detail(of_rung, ("bioproject", "sra_study", "rung"), limits)
    return report_target(kept, tissues, ("rung",), vocabulary, limits)
