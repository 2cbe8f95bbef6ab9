"""Merkle fixity audit of record archives.

Archives hold records in key order, each at a byte offset. The leaf hash of a
record covers its headers and payload. Ordered ranges of keys, which are ranges
of offsets, are hashed into nodes, and the nodes of an archive into its root.
Replicas are compared root by root; only below roots that differ are ranges
compared, and only in ranges that differ are leaves. As ranges follow keys, a
lost record changes one range and not all that follow.

Texts never travel: tasks reduce a page to digests and a length. Archives cover
a fixed number of keys; where more records than an archive should hold share
them, a hash of key and address splits them into volumes, so every node is made
from a group of bounded size.

Defined cases: null address and payload count as empty; records with a null key
form one archive, split into volumes; equal rows are one record with a count of
copies, which its leaf covers; a record on one side only is missing or extra,
and one whose copies or content differ is altered; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runsieve.llm.common import stage

#: Keys per archive and per range; records per volume on average at most.
ARCHIVE_KEYS = 256
RANGE_KEYS = 16
VOLUME_RECORDS = 4096

_AT = ["archive", "volume"]
_HEAD = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: "


def records(
    pages: DataFrame, side: int, key: str = "page_id", url: str = "url", payload: str = "html"
) -> DataFrame:
    """Distinct records of one replica with digest, length in bytes and copies."""
    lean = pages.select(
        F.col(key).cast("long").alias("k"),
        F.coalesce(F.col(url).cast("string"), F.lit("")).alias("address"),
        F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("p"),
    )
    whole = F.concat(
        F.lit(_HEAD),
        F.coalesce(F.col("k").cast("string"), F.lit("")),
        F.lit("\r\nWARC-Target-URI: "),
        "address",
        F.lit("\r\nContent-Length: "),
        F.octet_length("p").cast("string"),
        F.lit("\r\n\r\n"),
        "p",
        F.lit("\r\n\r\n"),
    )
    return (
        lean.select("k", F.sha2("address", 256).alias("address"), whole.alias("w"))
        .select("k", "address", F.sha2("w", 256).alias("record"), F.octet_length("w").cast("long").alias("size"))
        .groupBy("k", "address", "record", "size")
        .agg(F.count(F.lit(1)).alias("copies"))
        .select(
            F.lit(side).alias("side"),
            "*",
            F.floor(F.col("k") / ARCHIVE_KEYS).cast("long").alias("archive"),
            F.floor(F.col("k") / RANGE_KEYS).cast("long").alias("range"),
        )
    )


def leaves(
    primary: DataFrame, replica: DataFrame, capacity: int = VOLUME_RECORDS, **columns: str
) -> DataFrame:
    """Leaves of both replicas, placed in volumes, with offsets and leaf hashes."""
    found = stage(records(primary, 0, **columns).union(records(replica, 1, **columns)), "records")
    volumes = (
        found.groupBy("archive", "side")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(F.col("archive").alias("a"))
        .agg(F.ceil(F.max("n") / F.lit(capacity)).cast("long").alias("volumes"))
    )
    order = W.partitionBy("side", *_AT).orderBy("k", "address", "record")
    before = F.sum(F.col("size") * F.col("copies")).over(order.rowsBetween(W.unboundedPreceding, -1))
    leaf = F.sha2(F.concat(F.col("copies").cast("string"), F.lit("|"), "record"), 256)
    return (
        found.join(volumes, F.col("archive").eqNullSafe(F.col("a")))
        .withColumn("volume", F.pmod(F.xxhash64("k", "address"), F.col("volumes")))
        .select(
            "side", "archive", "volume", "range", "k", "address", "record", "size", "copies",
            leaf.alias("leaf"),
            F.coalesce(before, F.lit(0)).alias("start"),
        )
    )


def _hashed(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("v"))))
    joined = F.array_join(F.transform(listed, lambda x: x["v"]), "")
    return rows.groupBy("side", *keys).agg(F.sha2(joined, 256).alias("hash"), F.count(F.lit(1)).alias("n"))


def nodes(placed: DataFrame) -> DataFrame:
    """Hashes of ordered ranges of leaves."""
    return _hashed(placed, [*_AT, "range"], ["k", "address", "record"], "leaf")


def roots(ranges: DataFrame) -> DataFrame:
    return _hashed(ranges, _AT, ["range"], "hash")


def _of(side: int, column: str) -> Column:
    return F.max(F.when(F.col("side") == side, F.col(column)))


def _faced(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Both replicas' hashes of a branch in one row."""
    return rows.groupBy(*keys).agg(_of(0, "hash").alias("ours"), _of(1, "hash").alias("theirs"))


def _below(rows: DataFrame, branches: DataFrame, keys: list[str]) -> DataFrame:
    """Rows under the given branches."""
    renamed = branches.select(*(F.col(key).alias(f"b_{key}") for key in keys))
    same = F.lit(True)
    for key in keys:
        same = same & rows[key].eqNullSafe(renamed[f"b_{key}"])
    return rows.join(renamed, same, "left_semi")


def audit(primary: DataFrame, replica: DataFrame, **columns: str) -> dict[str, DataFrame]:
    """``volumes``: both roots of every volume; ``damage``: records that differ."""
    placed = stage(leaves(primary, replica, **columns), "leaves")
    ranges = stage(nodes(placed), "ranges")
    differ = ~F.col("ours").eqNullSafe(F.col("theirs"))
    volumes = stage(_faced(roots(ranges), _AT), "volumes")
    bad_ranges = _faced(_below(ranges, volumes.filter(differ), _AT), [*_AT, "range"]).filter(differ)
    suspects = _below(placed, bad_ranges, [*_AT, "range"])
    nth = W.partitionBy("side", *_AT, "k", "address").orderBy("record")
    numbered = suspects.withColumn("nth", F.row_number().over(nth)).withColumnRenamed("leaf", "hash")
    damage = (
        numbered.groupBy(*_AT, "range", "k", "address", "nth")
        .agg(
            _of(0, "hash").alias("ours"),
            _of(1, "hash").alias("theirs"),
            F.coalesce(_of(0, "start"), _of(1, "start")).alias("start"),
            F.coalesce(_of(0, "size"), _of(1, "size")).alias("size"),
        )
        .filter(differ)
        .withColumn(
            "status",
            F.when(F.col("theirs").isNull(), "missing").when(F.col("ours").isNull(), "extra").otherwise("altered"),
        )
    )
    return {"volumes": volumes, "damage": damage}


def report(primary: DataFrame, replica: DataFrame, **columns: str) -> DataFrame:
    """One row per volume: roots and the damage in it, as text in offset order."""
    found = audit(primary, replica, **columns)
    item = F.concat(
        "status", F.lit(":"), F.coalesce(F.col("k").cast("string"), F.lit("")),
        F.lit("@"), F.col("start").cast("string"), F.lit("+"), F.col("size").cast("string"),
    )
    listed = F.array_sort(F.collect_list(F.struct("start", "status", item.alias("i"))))
    damage = (
        found["damage"]
        .groupBy(F.col("archive").alias("a"), F.col("volume").alias("v"))
        .agg(
            F.count(F.lit(1)).alias("damaged"),
            F.countDistinct("range").alias("damaged_ranges"),
            F.array_join(F.transform(listed, lambda x: x["i"]), ",").alias("damage"),
        )
    )
    volumes = found["volumes"]
    same = volumes["archive"].eqNullSafe(damage["a"]) & (volumes["volume"] == damage["v"])
    return volumes.join(damage, same, "left").select(
        "archive",
        "volume",
        F.col("ours").alias("root"),
        F.col("theirs").alias("replica_root"),
        F.coalesce("damaged", F.lit(0)).alias("damaged"),
        F.coalesce("damaged_ranges", F.lit(0)).alias("damaged_ranges"),
        F.coalesce("damage", F.lit("")).alias("damage"),
    )


def damaged_replica(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """A replica of the pages in which some records are altered, lost or added."""
    rest = F.pmod(F.col(key), F.lit(97))
    kept = pages.select(key, url, payload).filter((rest != 1) | rest.isNull())
    altered = kept.withColumn(
        payload, F.when(rest == 0, F.concat(F.col(payload), F.lit("\x00"))).otherwise(F.col(payload))
    )
    added = pages.filter(rest == 2).select(key, F.concat(F.col(url), F.lit("#copy")).alias(url), payload)
    return altered.union(added)


#: The audit of pages against their damaged replica. Dense keys need one volume.
ORACLE_SQL = r"""
WITH raw AS (
  SELECT 0 AS side, page_id AS k, coalesce(url, '') AS u, coalesce(html, '') AS p FROM pages
  UNION ALL
  SELECT 1, page_id, coalesce(url, ''),
         CASE WHEN page_id % 97 = 0 THEN coalesce(html || chr(0), '') ELSE coalesce(html, '') END
  FROM pages WHERE page_id % 97 <> 1
  UNION ALL
  SELECT 1, page_id, url || '#copy', coalesce(html, '') FROM pages WHERE page_id % 97 = 2
), whole AS (
  SELECT side, k, sha256(u) AS address,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
         || 'WARC-Record-ID: ' || k || chr(13) || chr(10) || 'WARC-Target-URI: ' || u
         || chr(13) || chr(10) || 'Content-Length: ' || strlen(p)
         || chr(13) || chr(10) || chr(13) || chr(10) || p
         || chr(13) || chr(10) || chr(13) || chr(10) AS w
  FROM raw
), record AS (
  SELECT side, k, address, sha256(w) AS record, strlen(w) AS size, count(*) AS copies,
         floor(k / 256)::BIGINT AS archive, floor(k / 16)::BIGINT AS range
  FROM whole GROUP BY ALL
), leaf AS (
  SELECT *, sha256(copies || '|' || record) AS leaf,
         coalesce(sum(size * copies) OVER (PARTITION BY side, archive ORDER BY k, address, record
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM record
), node AS (
  SELECT side, archive, range, sha256(string_agg(leaf, '' ORDER BY k, address, record)) AS hash
  FROM leaf GROUP BY ALL
), root AS (
  SELECT side, archive, sha256(string_agg(hash, '' ORDER BY range)) AS hash FROM node GROUP BY ALL
), pair AS (
  SELECT archive, max(hash) FILTER (side = 0) AS root, max(hash) FILTER (side = 1) AS replica_root
  FROM root GROUP BY ALL
), faced AS (
  SELECT archive, range, k, address, max(leaf) FILTER (side = 0) AS ours, max(leaf) FILTER (side = 1) AS theirs,
         coalesce(max(start) FILTER (side = 0), max(start) FILTER (side = 1)) AS start,
         coalesce(max(size) FILTER (side = 0), max(size) FILTER (side = 1)) AS size
  FROM leaf GROUP BY ALL
), damage AS (
  SELECT archive, count(*) AS damaged, count(DISTINCT range) AS damaged_ranges,
         string_agg(status || ':' || k || '@' || start || '+' || size, ',' ORDER BY start, status) AS damage
  FROM (SELECT *, CASE WHEN theirs IS NULL THEN 'missing' WHEN ours IS NULL THEN 'extra' ELSE 'altered' END AS status
        FROM faced WHERE ours IS DISTINCT FROM theirs)
  GROUP BY archive
)
SELECT archive, 0::BIGINT AS volume, root, replica_root, coalesce(damaged, 0) AS damaged,
       coalesce(damaged_ranges, 0) AS damaged_ranges, coalesce(damage, '') AS damage
FROM pair LEFT JOIN damage USING (archive)
"""
