"""The two preparing stages that every screen starts from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from runsieve.functions.vocabulary import DEFAULT, ORGANISMS, Vocabulary
from runsieve.operators.anchor import anchor_scan, extract_study_runs
from runsieve.sources.staging import stage
from runsieve.sources.tables import create_schema, write_table

ANCHOR_TABLE = "anchor_studies"
RUNS_TABLE = "study_runs"


def anchored_runs(
    metadata: DataFrame,
    vocabulary: Vocabulary = DEFAULT,
    organisms: Sequence[str] | None = ORGANISMS,
    stage_runs: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Anchors and study runs for use within one session.

    Both are staged, so that a screen may read the runs several times. Without
    ``stage_runs`` the runs are planned on top of the anchors, for a single read.
    """
    anchors = stage(anchor_scan(metadata, vocabulary, organisms), "anchors")
    runs = extract_study_runs(metadata, anchors, vocabulary)
    return anchors, stage(runs, "study-runs") if stage_runs else runs


def build_study_tables(
    metadata: DataFrame,
    schema: str,
    vocabulary: Vocabulary = DEFAULT,
    organisms: Sequence[str] | None = ORGANISMS,
    buckets: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Create or replace the anchor and study-run tables in ``schema``.

    The two scans of the nested attributes happen here, once. Runs are written
    clustered by study, so that screens, inspections and list filters read few
    row groups and few studies per task. With ``buckets`` both tables are bucketed
    by study: restricting runs to the anchors and counting them per study is done
    without a shuffle (see :func:`runsieve.sources.tables.write_table`).
    """
    create_schema(metadata.sparkSession, schema)
    anchors = write_table(
        anchor_scan(metadata, vocabulary, organisms),
        f"{schema}.{ANCHOR_TABLE}",
        cluster_by=("bioproject",) if buckets else (),
        buckets=buckets,
    )
    runs = write_table(
        extract_study_runs(metadata, anchors, vocabulary),
        f"{schema}.{RUNS_TABLE}",
        cluster_by=("bioproject",),
        sort_by=("acc",),
        buckets=buckets,
    )
    return anchors, runs
