"""Study-level aggregates, filters and tissue details.

The figures of a study are read from the facts of :mod:`runsieve.operators.groups`:
runs are first counted per combination of their labels, and samples, lengths and
names are made distinct beside them, all in one shuffle that is spread over the
values. So a study holding a large share of all runs never meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsieve.functions.classify import is_long_read
from runsieve.functions.report import LIMITS, Limits
from runsieve.functions.text import fragments
from runsieve.functions.vocabulary import DEFAULT, Vocabulary
from runsieve.operators.groups import (
    LABELS,
    count_where,
    distinct_in,
    distinct_values,
    group_facts,
    smallest_distinct,
    smallest_rows,
    texts_in,
    with_medians,
    with_rows,
)
from runsieve.sources.schemas import STUDY_KEYS

#: Counters that are not named after their tissue class.
_SHORT_COUNTERS = {
    "brain_prefrontal": "n_prefrontal",
    "brain_hippocampal": "n_hippocampal",
    "unannotated": "n_tissue_unannotated",
    "other": "n_tissue_other",
}


def _arms(within: Column | None = None) -> dict[str, Column]:
    """Conditions of the four disjoint arms, optionally inside an arm."""
    case, control = F.col("ad_hit"), F.col("ctrl_hit")
    arms = {
        "case_only": case & ~control,
        "control_only": control & ~case,
        "ambiguous": case & control,
        "unlabeled": ~case & ~control,
    }
    if within is not None:
        arms = {name: within & arm for name, arm in arms.items()}
    return arms


def disjoint_arms(labelled: DataFrame) -> DataFrame:
    """Case, control, ambiguous and unlabeled runs per study."""
    facts = group_facts(labelled, STUDY_KEYS, ("ad_hit", "ctrl_hit"))
    return facts.groupBy(*STUDY_KEYS).agg(*_counts(_arms()))


def _counts(conditions: dict[str, Column]) -> list[Column]:
    return [count_where(c).alias(name) for name, c in conditions.items()]


def tissue_counters(vocabulary: Vocabulary = DEFAULT) -> dict[str, str]:
    """Counter of every tissue class: those of reports, then further ones of the vocabulary."""
    names = dict.fromkeys(name for name, _ in (*DEFAULT.tissue_classes, *vocabulary.tissue_classes))
    return {_SHORT_COUNTERS.get(name, f"n_{name}"): name for name in (*names, "unannotated", "other")}


def _tissues(vocabulary: Vocabulary, within: Column | None = None) -> dict[str, Column]:
    kind = F.col("tissue_class")
    tissues = {counter: kind == name for counter, name in tissue_counters(vocabulary).items()}
    tissues["n_brain_any"] = kind.startswith("brain")
    if within is not None:
        del tissues["n_tissue_other"]
        tissues = {name: within & tissue for name, tissue in tissues.items()}
    return tissues


def evidence_kinds(labelled: DataFrame) -> DataFrame:
    """Small-RNA runs, tissue-relevant runs and evidence tiers per study."""
    facts = group_facts(labelled, STUDY_KEYS, ("srna_evidence", "tissue_class"))
    relevant = F.col("tissue_class").startswith("brain") | F.col("tissue_class").isin(
        "csf", "biofluid"
    )
    return facts.groupBy(*STUDY_KEYS).agg(
        count_where(F.col("srna_evidence").isNotNull()).alias("n_smallrna"),
        count_where(relevant).alias("n_tissue_relevant"),
        distinct_values(F.col("srna_evidence")).alias("srna_evidence_kinds"),
    )


_SMALL_RNA_LABELS = (
    "ad_hit",
    "ctrl_hit",
    "ad_term",
    "ctrl_term",
    "single_cell",
    "srna_evidence",
    "tissue_class",
    "assay_type",
)


def aggregate_small_rna(labelled: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """One row per study with the counters of the small-RNA screen."""
    facts = group_facts(
        labelled,
        STUDY_KEYS,
        _SMALL_RNA_LABELS,
        texts={"sample": F.col("biosample")},
        numbers={"length": F.col("avgspotlen")},
        added=("mbytes",),
        latest=("releasedate",),
    )
    tier = F.col("srna_evidence")
    size, runs = F.sum("mbytes"), count_where(F.col("fact") == LABELS)
    return with_medians(facts, STUDY_KEYS, ("length",)).groupBy(*STUDY_KEYS).agg(
        runs.alias("n_runs"),
        *_counts(_arms()),
        *_counts(
            {
                "n_assay_declared": tier == "assay_declared",
                "n_library_declared": tier == "library_declared",
                "n_attr_mentioned": tier == "attribute_mentioned",
                "n_readlen_inferred": tier == "readlen_inferred",
                "n_single_cell": F.col("single_cell"),
            }
        ),
        *_counts(_tissues(vocabulary)),
        distinct_values(F.col("ad_term")).alias("ad_terms"),
        distinct_values(F.col("ctrl_term")).alias("ctrl_terms"),
        distinct_values(F.col("tissue_class")).alias("tissue_classes"),
        distinct_values(F.col("assay_type")).alias("assay_types"),
        F.min("length").alias("median_readlen"),
        # Runs of unknown size count in the denominator.
        F.round(size / runs / 1024, 3).alias("gb_per_run"),
        F.round(size / 1024, 1).alias("total_gb"),
        F.max("releasedate").alias("latest_release"),
        distinct_in("sample").alias("n_biosamples"),
    )


@dataclass(frozen=True)
class SmallRnaThresholds:
    """Bounds a study must meet; ``None`` switches a bound off."""

    min_arm: int = 3
    median_readlen: tuple[int, int] = (15, 120)
    min_gb_per_run: float | None = 0.015
    attribute_evidence: bool = False


SMALL_RNA = SmallRnaThresholds()
#: Loosenings in the order they should be tried, each on top of the one before.
RELAXED_SMALL_RNA = (
    relaxed_1 := replace(SMALL_RNA, min_gb_per_run=None),
    relaxed_2 := replace(relaxed_1, median_readlen=(15, 150)),
    relaxed_3 := replace(relaxed_2, attribute_evidence=True),
    replace(relaxed_3, min_arm=2),
)


def passes(thresholds: SmallRnaThresholds = SMALL_RNA) -> Column:
    """Whether a study has two real arms, declared small RNA and no single cells."""
    declared = F.col("n_assay_declared") + F.col("n_library_declared")
    if thresholds.attribute_evidence:
        declared = declared + F.col("n_attr_mentioned")
    kept = (
        (F.col("case_only") >= thresholds.min_arm)
        & (F.col("control_only") >= thresholds.min_arm)
        & (declared > 0)
        & F.col("median_readlen").between(*thresholds.median_readlen)
        & (F.col("n_single_cell") == 0)
    )
    if thresholds.min_gb_per_run is not None:
        kept = kept & (F.col("gb_per_run") > thresholds.min_gb_per_run)
    return kept


def keep_small_rna(
    studies: DataFrame, thresholds: SmallRnaThresholds = SMALL_RNA
) -> DataFrame:
    """The studies that pass the thresholds."""
    return studies.filter(passes(thresholds))


def first_rung(conditions: Sequence[Column]) -> Column:
    """Number of the first condition that holds; NULL if none does."""
    return F.coalesce(*(F.when(holds, F.lit(at)) for at, holds in enumerate(conditions)))


_TARGET_LABELS = (
    "is_target",
    "ad_hit",
    "ctrl_hit",
    "ad_term",
    "ctrl_term",
    "single_cell",
    "rna_class",
    "read_class",
    "priming_class",
    "tissue_class",
    "librarysource",
    "libraryselection",
    "assay_type",
    "platform",
    "instrument",
)


def aggregate_target(
    flagged: DataFrame, vocabulary: Vocabulary = DEFAULT, limits: Limits = LIMITS
) -> DataFrame:
    """One row per study with the counters of the total / long-read screen.

    Arms, priming tiers, tissues and lists count target runs only; the library
    inventory counts all runs of the study.
    """
    target = F.col("is_target")
    rna, read, priming = F.col("rna_class"), F.col("read_class"), F.col("priming_class")
    facts = group_facts(
        flagged,
        STUDY_KEYS,
        _TARGET_LABELS,
        texts={"sample": F.when(target, F.col("biosample"))},
        numbers={"length": F.when(target, F.col("avgspotlen"))},
        added=("mbytes",),
        latest=("releasedate",),
    )
    names = smallest_rows(flagged.filter(target), STUDY_KEYS, "library_name", limits.library_names)
    facts = with_rows(facts, "name", names, "library_name")

    def listed(name: str) -> Column:
        return distinct_values(F.when(target, F.col(name)))

    runs = F.col("fact") == LABELS
    size = F.sum(F.when(target, F.col("mbytes")).when(runs, 0))
    return with_medians(facts, STUDY_KEYS, ("length",)).groupBy(*STUDY_KEYS).agg(
        count_where(runs).alias("n_runs_total"),
        count_where(target).alias("n_target_runs"),
        *_counts(_arms(target)),
        *_counts(
            {
                "n_total_rna_random": rna == "total_rna_random",
                "n_polya_mrna": rna == "polya_mrna",
                "n_small_rna": rna == "small_rna",
                "n_rna_unspecified": rna == "rna_unspecified",
                "n_not_rna": rna == "not_rna",
                "n_long_read": is_long_read(read),
                "n_long_inferred": read == "long_inferred",
                "n_single_cell": F.col("single_cell"),
                "n_random_declared": target & (priming == "random_declared"),
                "n_ribodep_declared": target & (priming == "ribodep_declared"),
                "n_random_text": target & (priming == "random_or_ribodep_text"),
                "n_priming_unspecified": target & (priming == "unspecified"),
            }
        ),
        *_counts(_tissues(vocabulary, target)),
        listed("librarysource").alias("target_librarysources"),
        listed("libraryselection").alias("target_selections"),
        listed("assay_type").alias("target_assay_types"),
        listed("platform").alias("target_platforms"),
        listed("instrument").alias("target_instruments"),
        distinct_values(F.col("ad_term")).alias("ad_terms"),
        distinct_values(F.col("ctrl_term")).alias("ctrl_terms"),
        F.min("length").alias("median_target_readlen"),
        F.round(size / 1024, 1).alias("target_gb"),
        F.max("releasedate").alias("latest_release"),
        distinct_in("sample").alias("n_target_biosamples"),
        texts_in("name").alias("target_library_names"),
    )


def keep_with_target(studies: DataFrame) -> DataFrame:
    return studies.filter(F.col("n_target_runs") > 0)


def matched_design(report: DataFrame) -> DataFrame:
    """Studies that ran both assays: small RNA and the target."""
    return report.filter((F.col("n_small_rna") > 0) & (F.col("n_target_runs") > 0))


def tissue_detail(
    runs: DataFrame,
    keys: Sequence[str] = ("bioproject", "sra_study"),
    limits: Limits = LIMITS,
) -> DataFrame:
    """The smallest distinct short tissue fragments per study.

    Needs ``tissue_blob``. The key leaves out the organism, so the organisms of
    one study share the text.
    """
    fragment = F.col("tissue_attrs")
    pieces = runs.select(
        *keys, F.explode(fragments(F.col("tissue_blob"))).alias("tissue_attrs")
    ).filter((fragment != "") & (F.length(fragment) < limits.fragment_length))
    return smallest_distinct(pieces, keys, "tissue_attrs", limits.tissue_fragments).withColumn(
        "tissue_attrs", F.array_join("tissue_attrs", ", ")
    )
