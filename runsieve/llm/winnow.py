"""Winnowing fingerprints with DataFrame functions only.

Tokens are runs without white space, cut after eight characters. Runs longer than
``LONG`` characters, as in texts without spaces, are first cut by content: after
every character whose hash is below that of the one before and not above that of
the one after. So where a passage lies in its run does not matter: from its first
such cut on it has the same tokens everywhere. Every ``k`` tokens in a row are hashed, rolling
pairwise over the array of token hashes. Of every ``w`` neighbouring hashes the
smallest is chosen, the rightmost of equal ones; a passage of ``w + k - 1``
tokens that two texts share thus gives both a common choice. Hash and position
live in one long, the hash above and the reversed position below, so the
smallest long is the smallest hash at its rightmost place.

Defined cases: null counts as the empty text, which has no choices; a text of
fewer than ``k`` tokens has one hash of all of them; two empty fingerprints are
alike to 1. Rows of equal key and text are one document for the order of
documents and get equal results; a null key comes last. A table of one document
is its own successor, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runsieve.llm.common import stage

K = 3
WINDOW = 4
#: Longest run that counts as a word.
LONG = 16
_PLACES = (1 << 32) - 1
_NO_KEY = -(1 << 63)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shifted(values: Column, by: int) -> Column:
    return F.slice(values, by + 1, F.size(values))


def _rolling(values: Column, width: int, join: Callable[[Column, Column], Column]) -> Column:
    """Join each element with the ``width - 1`` after it; shorter at the end."""
    if width == 1:
        return values

    # A second parameter of the function would be the index, also one with a default.
    def by(step: int) -> Callable[[Column], Column]:
        return lambda v: F.zip_with(v, _shifted(v, step), join)

    half = 1
    while half * 2 <= width:
        values = _let(values, by(half))
        half *= 2
    if half < width:
        return _let(values, by(width - half))
    return values


def _cut_by_content(run: Column) -> Column:
    def marked(chars: Column) -> Column:
        return _let(
            F.transform(chars, lambda c: F.hash(c)),
            lambda h: F.transform(
                chars,
                lambda c, i: F.when(
                    (F.get(h, i) < F.get(h, i - 1)) & (F.get(h, i) <= F.get(h, i + 1)), F.concat(c, F.lit("\n"))
                ).otherwise(c),
            ),
        )

    return F.array_join(_let(F.split(run, ""), marked), "")


def spaced(text: Column) -> Column:
    """The text with line ends at the cuts of its long runs."""
    runs = F.regexp_extract_all(text, F.lit(r"\s+|[^\s]+"), F.lit(0))
    cut = F.transform(runs, lambda run: F.when(F.length(run) > LONG, _cut_by_content(run)).otherwise(run))
    return F.when(text.rlike(rf"[^\s]{{{LONG + 1}}}"), F.array_join(cut, "")).otherwise(text)


def choices(text: Column, k: int = K, w: int = WINDOW) -> Column:
    """Chosen hashes of a text with their places, as sorted-by-place longs."""
    tokens = F.regexp_extract_all(spaced(text), F.lit(r"[^\s]{1,8}"), F.lit(0))
    hashes = F.transform(tokens, lambda token: F.hash(token))

    def grams(h: Column) -> Column:
        rolled = h
        for step in range(1, k):
            rolled = F.zip_with(rolled, _shifted(h, step), lambda x, y: F.hash(x, y))
        return F.slice(rolled, 1, F.greatest(F.least(F.size(h), F.lit(1)), F.size(h) - (k - 1)))

    placed = F.transform(
        _let(hashes, grams),
        lambda x, i: F.shiftleft(x.cast("long"), 32) + (F.lit(_PLACES) - i.cast("long")),
    )

    def smallest(g: Column) -> Column:
        least = _rolling(g, w, lambda x, y: F.least(x, y))
        whole = F.greatest(F.least(F.size(g), F.lit(1)), F.size(g) - (w - 1))
        return F.array_distinct(F.slice(least, 1, whole))

    return _let(placed, smallest)


def positions(chosen: Column) -> Column:
    """Token positions of the choices, from 0."""
    return F.transform(chosen, lambda x: (F.lit(_PLACES) - x.bitwiseAND(F.lit(_PLACES))).cast("int"))


def hash_set(chosen: Column) -> Column:
    return F.array_distinct(F.transform(chosen, lambda x: F.shiftright(x, 32).cast("int")))


def digest(chosen: Column) -> Column:
    """Sixteen hex digits over hashes and places."""
    return F.lpad(F.lower(F.hex(F.xxhash64(chosen))), 16, "0")


def likeness(common: Column, a: Column, b: Column) -> Column:
    """Jaccard likeness from sizes: of the common part, of ``a`` and of ``b``."""
    union = a + b - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union.cast("double"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, w: int = WINDOW) -> DataFrame:
    """Key, chosen hashes and their token positions of every document."""
    chosen = docs.select(
        F.col(key), choices(F.coalesce(F.col(text).cast("string"), F.lit("")), k, w).alias("chosen")
    )
    hashes = F.transform("chosen", lambda x: F.shiftright(x, 32).cast("int"))
    return chosen.select(key, hashes.alias("hashes"), positions(F.col("chosen")).alias("positions"))


def successors(source: DataFrame) -> DataFrame:
    """``(k, g)`` of every document with ``(next_k, next_g)`` in descending order of k.

    Ids alone are dealt by range; inside a range the next row is a window away,
    and the first rows of the ranges, one for each partition, join the rest.
    """
    order = [F.col("k").desc(), F.col("g").asc()]
    ids = source.groupBy("k", "g", "n").agg(F.count(F.lit(1)).alias("copies"))
    parts = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(
        ids.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ids"
    )
    inside = dealt.withColumn(
        "after", F.lead(F.struct("k", "g")).over(W.partitionBy("part").orderBy(*order))
    )
    first = F.max(F.struct("k", F.bitwise_not("g").alias("r")))
    heads = dealt.groupBy("part").agg(first.alias("s")).select(
        "part", F.struct(F.col("s.k").alias("k"), F.bitwise_not(F.col("s.r")).alias("g")).alias("head")
    )
    around = W.orderBy("part")
    whole = around.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    turned = heads.select(
        "part",
        F.coalesce(F.lead("head").over(around), F.first("head").over(whole)).alias("wrap"),
    )
    joined = inside.join(turned, "part").withColumn("after", F.coalesce("after", "wrap"))
    return joined.select(
        "k", "g", "n", F.col("after.k").alias("next_k"), F.col("after.g").alias("next_g")
    )


def compare_edited(
    docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, w: int = WINDOW
) -> DataFrame:
    """Fingerprints of documents, of their edited texts, and their likenesses.

    The edited text has its second half replaced by the beginning of the next
    document. Both joins read texts through one shuffle on key and text hash,
    which Spark reuses as both sides ask for the same columns; what travels on
    is the beginning that is needed and the hash set of the next document. The
    key must be an integer; the smallest long stands for null.
    """
    source = docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(_NO_KEY)).alias("k"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"),
    ).select("k", F.xxhash64("t").alias("g"), "t")
    after = successors(source.select("k", "g", F.length("t").alias("n")))
    sent = (
        after.select(F.col("k").alias("ck"), F.col("g").alias("cg"), "n", F.col("next_k").alias("k"), F.col("next_g").alias("g"))
        .join(source, ["k", "g"])
        .select(
            F.col("ck").alias("k"),
            F.col("cg").alias("g"),
            F.expr("substring(t, 1, n div 2)").alias("begin"),
            hash_set(choices(F.col("t"), k, w)).alias("next_set"),
        )
        .groupBy("k", "g")
        .agg(F.any_value("begin").alias("begin"), F.any_value("next_set").alias("next_set"))
    )
    texts = source.join(sent, ["k", "g"]).select(
        F.when(F.col("k") != _NO_KEY, F.col("k")).alias("own"),
        "t",
        F.length("t").cast("long").alias("n_chars"),
        F.expr("concat(substring(t, 1, length(t) - length(t) div 2), begin)").alias("edited"),
        "next_set",
    )
    chosen = texts.select(
        "own",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        choices(F.col("t"), k, w).alias("c"),
        choices(F.col("edited"), k, w).alias("e"),
        "next_set",
    )
    sets = chosen.select(
        "*", hash_set(F.col("c")).alias("own_set"), hash_set(F.col("e")).alias("edited_set")
    )
    sizes = sets.select(
        "*",
        F.size(F.array_intersect("own_set", "edited_set")).alias("with_edited"),
        F.size(F.array_intersect("own_set", "next_set")).alias("with_next"),
    )
    n_own, n_edited, n_next = (F.size(f"{name}_set") for name in ("own", "edited", "next"))
    return sizes.select(
        F.col("own").cast(docs.schema[key].dataType).alias(key),
        "n_chars",
        "edited_sha256",
        digest(F.col("c")).alias("fingerprint"),
        digest(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("with_edited"), n_own, n_edited).alias("near_edited"),
        likeness(F.col("with_next"), n_own, n_next).alias("near_next"),
    )
