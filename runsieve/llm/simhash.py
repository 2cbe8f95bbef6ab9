"""Near-duplicate documents by SimHash and meet-in-the-middle ball hashing.

Two 64-bit fingerprints at distance 3 or less have a value between them that
one reaches with at most two flipped bits and the other with at most one. So
every fingerprint emits its variants, rows meet on the variant, and no pair is
ever compared with a pair of buckets. Three choices keep that lean:

* Of any three bits two lie in the same half of the word, so only the 992
  two-bit flips within a half are needed, not all 2,016.
* Whoever emits a variant is at most three bits from everyone who emits it with
  one flip or none. A group of colliding rows is therefore linked as a star to
  its smallest such member: as many links as rows, never all pairs of a group,
  and no link between different texts is lost to the components.
* Before that, a cheaper ball removes fingerprints that have no partner at all.
  With three differing bits, one of four 16-bit blocks holds at least one of
  them; with that block masked each side needs one flip at most. Fingerprints
  that share none of these 196 keys with another one cannot have a partner.

Both shuffles carry two or three longs per row. Components are found by
alternating large-star and small-star steps, each written to the shared folder.

Defined cases: null and empty texts have fingerprint zero and are linked like
any other; repeated rows and equal texts share a component; an empty table
gives no rows; a null key never becomes a component id unless every key of the
component is null; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runsieve.llm.common import map_batches, stage, text_bytes

RADIUS = 3
_BITS = 64
_SEED = 42


def _signed(value: int) -> int:
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def _masked_ball() -> list[tuple[int, int]]:
    """(bits to keep, bits to flip) of the four masked balls of radius one."""
    out = []
    for block in range(4):
        mask = 0xFFFF << (16 * block)
        tag = (block + 1) << (16 * block)
        free = [bit for bit in range(_BITS) if not mask >> bit & 1]
        out += [(~mask, tag)] + [(~mask, tag ^ 1 << bit) for bit in free]
    return [(_signed(keep), _signed(flip)) for keep, flip in out]


def _ball() -> list[tuple[int, int]]:
    """(bits to flip, how many) of the variants within half the radius."""
    halves = (range(32), range(32, 64))
    pairs = [(1 << i | 1 << j, 2) for h in halves for i in h for j in h if i < j]
    ones = [(1 << i, 1) for i in range(_BITS)]
    return [(_signed(flip), n) for flip, n in [(0, 0), *ones, *pairs]]


def shingles(text: bytes, width: int) -> np.ndarray:
    """Hashes of the word shingles of a text, as UTF-8; none of a blank text."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], _SEED) for a, b in zip(starts, ends)], dtype="<u8")


def _majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, _BITS)
    majority = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def simhash(text: bytes, width: int) -> int:
    """Unsigned fingerprint of the word shingles of a text, as UTF-8."""
    return _majority(shingles(text, width))


def fingerprints(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3
) -> DataFrame:
    """``key``, ``bits`` (the fingerprint as a signed long), text ``digest`` per row."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = text_bytes(batch.column(1))
            found = ([simhash(t, width) for t in texts], [xxhash.xxh64_intdigest(t, _SEED) for t in texts])
            bits, digest = (pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in found)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), bits, digest], names=["key", "bits", "digest"]
            )

        return work

    kind = docs.schema[key].dataType.simpleString()
    lean = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t"))
    return map_batches(lean, make, f"key {kind}, bits long, digest long")


def _dealt(values: DataFrame) -> DataFrame:
    """Spread ``bits`` over all shuffle partitions before each becomes many rows.

    Adaptive execution sees a few bytes per value and would join partitions.
    """
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return values.select("bits").repartition(parts, F.hash("bits"))


def with_partner(distinct: DataFrame) -> DataFrame:
    """Those ``bits`` that share a masked variant with another value."""
    ball = F.explode(
        F.array(*(F.struct(F.lit(k).alias("k"), F.lit(f).alias("f")) for k, f in _masked_ball()))
    )
    meet = (
        _dealt(distinct).select("bits", ball.alias("m"))
        .select("bits", F.col("bits").bitwiseAND(F.col("m.k")).bitwiseXOR(F.col("m.f")).alias("v"))
        .withColumn("n", F.count(F.lit(1)).over(W.partitionBy("v")))
    )
    return meet.filter("n > 1").select("bits").distinct()


def links(candidates: DataFrame) -> DataFrame:
    """Star links ``(a, b)``, b < a or b > a, between values within the radius."""
    ball = F.explode(
        F.array(*(F.struct(F.lit(f).alias("f"), F.lit(n).alias("n")) for f, n in _ball()))
    )
    near = F.when(F.col("flips") <= RADIUS // 2, F.col("bits"))
    meet = (
        _dealt(candidates).select("bits", ball.alias("m"))
        .select(
            "bits",
            F.col("m.n").cast("byte").alias("flips"),
            F.col("bits").bitwiseXOR(F.col("m.f")).alias("v"),
        )
        .withColumn("hub", F.min(near).over(W.partitionBy("v")))
    )
    found = meet.filter("hub IS NOT NULL AND hub <> bits").select(
        F.col("bits").alias("a"), F.col("hub").alias("b")
    )
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return found.distinct().filter(apart <= RADIUS)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, root)`` of every node with a link; root is the smallest node.

    Large-star and small-star steps alternate until the links stop changing;
    every round is written to the shared folder, so no lineage grows.
    """
    current, before = stage(edges.select("a", "b"), name), None
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.join(least, "a")
            .filter("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        down = large.filter("a <> b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            down.join(least, "a")
            .select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        current = stage(small, name)
        mark = current.agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")
        ).first()
        if mark == before:
            return current.select(
                F.col("a").alias("node"), F.col("b").alias("root")
            ).union(current.select("b", "b").distinct())
        before = mark


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3
) -> DataFrame:
    """One row per document: key, ``fingerprint``, ``component_id``, ``root``, ``digest``.

    ``fingerprint`` is 16 hex digits; ``component_id`` is the smallest key that
    can be reached over links, the document's own included. ``root`` names the
    component even where keys repeat, ``digest`` is a hash of the text.
    """
    prints = stage(fingerprints(docs, key, text, width), "fingerprints")
    distinct = prints.groupBy("bits").agg(F.min("key").alias("first"))
    candidates = stage(with_partner(distinct.select("bits")), "candidates")
    roots = components(links(candidates), "components")
    grouped = distinct.join(roots, distinct["bits"] == roots["node"])
    smallest = grouped.groupBy("root").agg(F.min("first").alias("least"))
    linked = grouped.join(smallest, "root").select(
        F.col("node").alias("bits"), "least", "root"
    )
    classes = distinct.join(linked, "bits", "left").select(
        "bits",
        F.coalesce("least", "first").alias("component_id"),
        F.coalesce("root", "bits").alias("root"),
    )
    return prints.join(classes, "bits").select(
        F.col("key").alias(key),
        F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"),
        "component_id",
        "root",
        "digest",
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The document with the smallest key of every component, all columns kept.

    A null key stays only if its component has no other; where a key repeats,
    the row with the smallest text digest stays, and one of equal rows.
    """
    found = near_duplicates(docs, key, text)
    order = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col("digest").alias("d"))
    found = found.withColumn("o", order)
    per_text = found.groupBy("root", "o").agg(F.count(F.lit(1)).alias("rows"))
    kept = stage(
        per_text.groupBy("root")
        .agg(F.min(F.struct("o", "rows")).alias("s"))
        .select(
            F.col("s.o.k").alias("kept_key"),
            F.col("s.o.d").alias("kept_digest"),
            F.col("s.rows").alias("kept_rows"),
        ),
        "kept",
    )
    digest = F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit("")))
    same = docs[key].eqNullSafe(kept["kept_key"]) & (digest == kept["kept_digest"])
    single = docs.join(kept.filter("kept_rows = 1"), same, "left_semi")
    again = docs.join(kept.filter("kept_rows > 1"), same, "left_semi")
    return single.union(again.dropDuplicates([key, text]))
