"""Helpers for per-group results that stay bounded under skew.

A group's figures come from tagged rows: each row of the input becomes one row of
closed labels and one per open value, told apart by ``fact``. One aggregate over
(group, fact, label, value) makes all of them distinct and counts them; it combines
in every task and its shuffle is spread over the values, so that a group with a
large share of the rows meets nowhere. What remains are few rows per group, from
which its counters, lists, numbers of distinct values and medians are read without
a join. Groups may have NULL keys all the while.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LABELS = "labels"


def distinct_values(value: Column) -> Column:
    """Sorted array of the distinct non-NULL values, for closed vocabularies."""
    return F.array_sort(F.collect_set(value))


def group_facts(
    frame: DataFrame,
    keys: Sequence[str],
    labels: Sequence[str],
    texts: dict[str, Column] | None = None,
    numbers: dict[str, Column] | None = None,
    added: Sequence[str] = (),
    latest: Sequence[str] = (),
) -> DataFrame:
    """Few rows per group, by ``fact``.

    Rows of fact ``LABELS`` have one combination of ``labels`` each, with the
    number of rows ``n``, the sums of ``added`` and the maxima of ``latest``. A
    row of a text fact has in ``distinct`` how many non-NULL texts there are; a
    number fact has one row per ``number``, with ``n``. Other columns are NULL.
    """
    texts, numbers = texts or {}, numbers or {}
    label = F.struct(*labels)
    none = {
        "label": F.when(F.lit(False), label),
        "text": F.lit(None).cast("string"),
        "number": F.lit(None).cast("long"),
        **{name: F.when(F.lit(False), F.col(name)) for name in (*added, *latest)},
    }

    def row(fact: str, **columns: Column) -> Column:
        filled = {"fact": F.lit(fact), **none, **columns}
        return F.struct(*(value.alias(name) for name, value in filled.items()))

    rows = [row(LABELS, label=label, **{name: F.col(name) for name in (*added, *latest)})]
    rows += [row(fact, text=value) for fact, value in texts.items()]
    rows += [row(fact, number=value) for fact, value in numbers.items()]
    measures = [F.sum(c).alias(c) for c in added] + [F.max(c).alias(c) for c in latest]
    tagged = frame.select(*keys, F.inline(F.array(*rows)))
    found = tagged.groupBy(*keys, "fact", "label", "text", "number").agg(
        F.count(F.lit(1)).alias("n"), *measures
    )
    if texts:
        found = found.groupBy(*keys, "fact", "label", "number").agg(
            F.sum("n").alias("n"), F.count("text").alias("distinct"), *measures
        )
    return found.select("*", "label.*").drop("label", *(() if texts else ("text",)))


def count_where(condition: Column) -> Column:
    """Rows behind the facts for which a condition on the labels holds."""
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def distinct_in(fact: str) -> Column:
    """Distinct non-NULL texts of a fact."""
    return F.coalesce(F.sum(F.when(F.col("fact") == fact, F.col("distinct"))), F.lit(0))


def with_medians(facts: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Add per number fact a column that holds the lower median of its group.

    A running sum over the ordered numbers of a group; the column is NULL but on
    the numbers that half of the rows reach, so its minimum is the median.
    """
    group = Window.partitionBy(*keys)
    ordered = group.orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for name in names:
        own = (F.col("fact") == name) & F.col("number").isNotNull()
        count = F.when(own, F.col("n")).otherwise(0)
        reached = 2 * F.sum(count).over(ordered) >= F.sum(count).over(group)
        facts = facts.withColumn(name, F.when(own & reached, F.col("number")))
    return facts


def smallest_rows(
    frame: DataFrame, keys: Sequence[str], value: str, limit: int
) -> DataFrame:
    """Per group the ``limit`` smallest distinct non-NULL values, a row each.

    For open-ended values: the distinct step shuffles on the value as well, so
    a large group spreads over all tasks, and the rank filter keeps ``limit``
    rows per group in each task before the rows of a group meet.
    """
    distinct = (
        frame.filter(F.col(value).isNotNull()).select(*keys, value).distinct()
    )
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    return distinct.withColumn("_place", place).filter(F.col("_place") <= limit).drop("_place")


def smallest_distinct(
    frame: DataFrame, keys: Sequence[str], value: str, limit: int
) -> DataFrame:
    """Per group the values of :func:`smallest_rows` as one sorted array."""
    rows = smallest_rows(frame, keys, value, limit)
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(value))


def with_rows(facts: DataFrame, fact: str, rows: DataFrame, value: str) -> DataFrame:
    """The facts and, as rows of ``fact``, more texts of the same groups."""
    more = rows.withColumnRenamed(value, "text").withColumn("fact", F.lit(fact))
    parts = [facts, more]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def texts_in(fact: str) -> Column:
    """Sorted array of the texts that :func:`with_rows` added."""
    return F.array_sort(F.collect_list(F.when(F.col("fact") == fact, F.col("text"))))
