"""Multi-party dialogues rendered from the perspective of each participant.

For every participant of a conversation the whole dialogue is written with that
speaker as ``assistant`` and the others as users who carry their names. A turn
is trained on where its speaker is the one whose perspective it is.

The rendered dialogue is the concatenation of its segments: one row per
conversation, perspective and turn, with text, mask and start in the dialogue.
So a conversation of any length is many small rows and never one large one.
Starts are running sums. Turns are dealt by range, each range sums its own
stretch of a conversation, and what lies before it is added from one row per
range and perspective, so a conversation that holds much of the table is split.

Defined cases: a null speaker is the participant with the empty name, null text
is empty, a null turn comes first; turns of equal number follow in order of
speaker and of a digest of the text; equal rows are segments one after another;
rows with a null conversation are one conversation; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runsieve.llm.common import stage

ASSISTANT = "<|assistant|>\n"
USER_BEFORE, USER_AFTER = "<|user name=", "|>\n"
END = "\n<|end|>\n"

_ORDER = ["conv", "turn", "speaker", "digest"]


def rotate(
    chats: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text"
) -> DataFrame:
    """Segments of every perspective, numbered from 0 by ``position``.

    ``start`` and ``length`` count code points of the rendered dialogue;
    ``mask`` is 1 for the turns of the perspective's own speaker, and the
    characters to train on are those from ``mask_start`` to ``mask_end``: text
    and end mark, not the header.
    """
    distinct = (
        chats.select(
            F.col(conv).alias("conv"),
            F.col(turn).alias("turn"),
            F.coalesce(F.col(speaker).cast("string"), F.lit("")).alias("speaker"),
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"),
        )
        .groupBy("conv", "turn", "speaker", "body")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("digest", F.sha2("body", 256))
    )
    parts = int(chats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(
        distinct.repartitionByRange(parts, *_ORDER).withColumn("part", F.spark_partition_id()),
        "turns",
    )
    people = dealt.select(F.col("conv").alias("c"), F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    header = F.when(own, F.lit(ASSISTANT)).otherwise(F.concat(F.lit(USER_BEFORE), "speaker", F.lit(USER_AFTER)))
    seen = dealt.join(people, F.col("conv").eqNullSafe(F.col("c"))).select(
        "conv", "perspective", "part", "turn", "speaker", "digest", "copies",
        F.concat(header, "body", F.lit(END)).alias("segment"),
        own.cast("int").alias("mask"),
        F.length(header).cast("long").alias("header"),
    ).withColumn("length", F.length("segment").cast("long"))

    key = ["conv", "perspective", "part"]
    before = W.partitionBy(*key).orderBy("turn", "speaker", "digest").rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy("conv", "perspective").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    chars = F.col("copies") * F.col("length")
    ranges = (
        seen.groupBy(*key)
        .agg(F.sum(chars).alias("chars"), F.sum("copies").alias("turns"))
        .select(
            F.col("conv").alias("rc"),
            F.col("perspective").alias("rp"),
            F.col("part").alias("rr"),
            F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("base_chars"),
            F.coalesce(F.sum("turns").over(earlier), F.lit(0)).alias("base_turns"),
        )
    )
    inside = seen.withColumn("chars", F.coalesce(F.sum(chars).over(before), F.lit(0))).withColumn(
        "turns", F.coalesce(F.sum("copies").over(before), F.lit(0))
    )
    same = (
        F.col("conv").eqNullSafe(F.col("rc"))
        & (F.col("perspective") == F.col("rp"))
        & (F.col("part") == F.col("rr"))
    )
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    placed = inside.join(ranges, same).select("*", copy).withColumn(
        "start", F.col("base_chars") + F.col("chars") + F.col("copy") * F.col("length")
    )
    return placed.select(
        F.col("conv").alias(conv),
        "perspective",
        (F.col("base_turns") + F.col("turns") + F.col("copy")).alias("position"),
        F.col("turn").alias(turn),
        "speaker",
        "segment",
        "mask",
        "start",
        "length",
        F.when(F.col("mask") == 1, F.col("start") + F.col("header")).alias("mask_start"),
        F.when(F.col("mask") == 1, F.col("start") + F.col("length")).alias("mask_end"),
    )


#: Rendering of the conversations table.
ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS speaker, coalesce(text, '') AS body FROM conversations
), people AS (
  SELECT DISTINCT conv_id AS c, speaker AS perspective FROM t
), seen AS (
  SELECT conv_id, perspective, turn, speaker, body, (speaker = perspective)::INT AS mask,
    CASE WHEN speaker = perspective THEN '<|assistant|>' || chr(10)
         ELSE '<|user name=' || speaker || '|>' || chr(10) END AS header
  FROM t JOIN people ON conv_id IS NOT DISTINCT FROM c
), placed AS (
  SELECT *, header || body || chr(10) || '<|end|>' || chr(10) AS segment,
    row_number() OVER w - 1 AS position,
    coalesce(sum(length(header) + length(body) + 9) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM seen
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, sha256(body))
)
SELECT conv_id, perspective, position, turn, speaker, segment, mask, start,
  length(segment) AS length,
  CASE WHEN mask = 1 THEN start + length(header) END AS mask_start,
  CASE WHEN mask = 1 THEN start + length(segment) END AS mask_end
FROM placed
"""
