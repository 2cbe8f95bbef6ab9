"""Report columns: verdicts and one-line summaries of an aggregated study."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Addresses of the public study pages. The texts of verdicts,
# tissues, evidence and cohort lines below are fixed values too.
BIOPROJECT_URL = "https://www.ncbi.nlm.nih.gov/bioproject/"
RUN_SELECTOR_URL = "https://www.ncbi.nlm.nih.gov/Traces/study/?acc="
# End of the fixed values.


@dataclass(frozen=True)
class Limits:
    """Sizes and lengths of a report."""

    #: Runs of the smaller arm that make a real contrast, and a thin one.
    enough: int = 3
    thin: int = 2
    #: Library names and tissue fragments shown per study; fragments are shorter than the last.
    library_names: int = 8
    tissue_fragments: int = 6
    fragment_length: int = 70


LIMITS = Limits()


def cohort_line(samples: str = "n_biosamples", noun: str = "samples") -> Column:
    """``"<n> <noun>: <n> AD-like / <n> control[ / <n> other]"``.

    Samples are distinct biosamples while the arms count runs.
    """
    others = F.when(
        F.col("unlabeled") > 0,
        F.concat(F.lit(" / "), F.col("unlabeled").cast("string"), F.lit(" other")),
    ).otherwise("")
    return F.concat(
        F.col(samples).cast("string"),
        F.lit(f" {noun}: "),
        F.col("case_only").cast("string"),
        F.lit(" AD-like / "),
        F.col("control_only").cast("string"),
        F.lit(" control"),
        others,
    )


def tissue_verdict(total: str = "n_runs") -> Column:
    """Best tissue seen; ``total`` names the run count of the judged arm."""
    return (
        F.when(F.col("n_prefrontal") > 0, "PREFRONTAL")
        .when(F.col("n_brain_any") > 0, "brain (other region)")
        .when(
            F.col("n_tissue_unannotated") == F.col(total), "unannotated - CHECK STUDY"
        )
        .when((F.col("n_csf") > 0) | (F.col("n_biofluid") > 0), "biofluid/CSF only")
        .otherwise("other")
    )


def smaller_arm() -> Column:
    return F.least("case_only", "control_only")


def _arms_of(size: int) -> Column:
    return (F.col("case_only") >= size) & (F.col("control_only") >= size)


def passes(enough: int = 3) -> Column:
    return _arms_of(enough)


def verdict(total: str = "n_target_runs", enough: int = 3, thin: int = 2) -> Column:
    """Whether the target arm holds a real case/control contrast.

    ``enough`` and ``thin`` are the sizes of the smaller arm for either verdict.
    """
    return (
        F.when(passes(enough), "PASSES - real contrast")
        .when(_arms_of(thin), f"thin - {thin}v{thin}, underpowered")
        .when(
            F.col("unlabeled") == F.col(total), "target arm unlabeled - CHECK BY HAND"
        )
        .otherwise("single-arm or too small")
    )


def evidence() -> Column:
    """Most trustworthy sign that the arm is total or long-read RNA."""
    return (
        F.when(F.col("n_random_declared") > 0, "libraryselection = RANDOM")
        .when(F.col("n_ribodep_declared") > 0, "libraryselection = Inverse rRNA")
        .when(F.col("n_long_read") > 0, "long-read platform")
        .when(F.col("n_random_text") > 0, "free text only - VERIFY")
        .otherwise("weak")
    )


def bioproject_url() -> Column:
    return F.concat(F.lit(BIOPROJECT_URL), F.col("bioproject"))


def run_selector_url() -> Column:
    return F.concat(F.lit(RUN_SELECTOR_URL), F.col("sra_study"))


def array_cell(values: Column) -> Column:
    """An array as one text cell, ``[a,b]``; ``[]`` for an empty one."""
    return F.concat(F.lit("["), F.array_join(values, ","), F.lit("]"))


_DAY = 86_400_000_000


def timestamp_cell(value: Column, kind: T.DataType) -> Column:
    """A timestamp as UTC text with microseconds, in any session time zone.

    The text is computed from the microseconds since the epoch, since the wall
    clock of the session skips an hour where daylight saving begins.
    """
    if isinstance(kind, T.TimestampType):
        micros = F.unix_micros(value)
        rest = F.pmod(micros, F.lit(_DAY))
        day = F.date_add(F.lit("1970-01-01").cast("date"), ((micros - rest) / _DAY).cast("int"))
        second = F.floor(rest / 1_000_000)
        parts = [F.floor(second / 3600), F.floor(second % 3600 / 60), second % 60]
        fraction = (rest % 1_000_000).cast("string")
    else:
        day = value.cast("date")
        parts = [F.hour(value), F.minute(value), F.second(value)]
        exact = F.extract(F.lit("SECOND"), value)
        fraction = F.floor((exact - F.floor(exact)) * 1_000_000).cast("string")
    two = [F.lpad(part.cast("string"), 2, "0") for part in parts]
    return F.concat(
        day.cast("string"),
        F.lit(" "),
        F.concat_ws(":", *two),
        F.lit("."),
        F.lpad(fraction, 6, "0"),
        F.lit(" UTC"),
    )


def as_cells(frame: DataFrame) -> DataFrame:
    """The frame with its arrays and timestamps rendered as text cells."""

    def cell(field: T.StructField) -> Column:
        value = F.col(field.name)
        if isinstance(field.dataType, T.ArrayType):
            value = array_cell(value)
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            value = timestamp_cell(value, field.dataType)
        return value.alias(field.name)

    return frame.select(*map(cell, frame.schema.fields))
