"""Ranked lexical search over bit-sliced Bloom signatures.

A document's signature holds its terms as a Bloom filter: two bits per element.
A term that occurs often is there once for every frequency level it reaches, so a
signature tells not only that a term may be there but how often it may be. Blocks
of documents with signatures of one width are stored as slices: for every bit of
the signature a bitmap with one bit per document.

For the terms of a query the slices of its elements are fetched and joined by AND.
They overestimate presence and level, never under; what a term can add to the score
of a document at the highest level shown, summed over its terms with their weights,
is an upper bound of the score. Documents whose bound reaches the k-th best score
found so far are scored exactly from their terms, which lie in the block beside the
slices; no others are. The first blocks of one task are searched before the others,
and the k-th scores found there start the bounds of all tasks.

The plan: one pass over the documents writes the blocks; one counts how many
documents hold each query term; one searches and returns at most k rows per query
and task, ranked by a window. No text is shuffled and no pair of query and document
leaves a task unless it is among its best. Queries are read in blocks of bounded
size; each block of queries meets all documents, and its best are staged. Memory does
not follow the input: row groups, pages and Arrow batches hold a few blocks, bounds
are made tile by tile.

Defined cases: null and empty texts, and those without a term, are not ranked and
count nowhere; a query without terms has no rows; of equal query keys the smallest
text is the query; repeated documents rank each for itself; equal scores are in the
order of keys, null keys last; terms that all documents hold may weigh nothing, and
scores of 0 are no results; widths stop at ``MAX_BITS``, so the signatures of very
long texts are fuller and those texts scored more often, whole as all others; empty
tables give no rows; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from runsieve.llm.common import arrow_batches, stage

K = 50
#: Bits of a signature per element, and the least and most bits of a width, as powers of 2.
BITS_PER_ELEMENT, MIN_BITS, MAX_BITS = 12, 8, 20
#: A block ends at so many documents, cells of slices or bytes of terms.
BLOCK_DOCUMENTS, BLOCK_CELLS, BLOCK_BYTES = 2048, 1 << 23, 2_000_000
#: Blocks of the first task that are searched first, for the k-th scores all tasks start with.
PILOT_BLOCKS = 16
#: A block of queries ends at so many of them, or so many terms.
BLOCK_QUERIES, BLOCK_TERMS = 1000, 50_000
_CACHE_TERMS = 300_000
#: Bounds are made for so many pairs of term and document at once, and a block's scores
#: join the best when there are so many.
TILE_CELLS, FRESH_SCORES = 1 << 21, 50_000
#: Bytes of an Arrow batch: a block or two.
BATCH_BYTES = 4 << 20
#: Blocks are rows of megabytes. Parquet looks at the size of a page or row group after a
#: hundred rows, if not told otherwise, and holds all of them until then; so do its readers.
_BLOCK_FILES = {
    "parquet.block.size": str(8 << 20),
    "parquet.block.size.row.check.min": "1",
    "parquet.page.size.row.check.min": "1",
}
#: Least frequencies of the levels: 1, 2, 3, 4, 6, 8, 12, 16, 24 and so on.
_LEVELS = np.array(sorted({1, 2} | {f for e in range(31) for f in (3 << e, 4 << e)}), dtype=np.int64)
_SEED = 42

# Term characters are ASCII letters, digits and all beyond ASCII.
_TERM_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
# End of the fixed values.


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, with A to Z in lower case."""
    return text.translate(_TERM_BYTES).split()


def elements(hashes: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """Hashes of the terms at every level that they reach."""
    reached = np.searchsorted(_LEVELS, frequency, side="right")
    level = np.arange(reached.sum()) - np.repeat(np.cumsum(reached) - reached, reached)
    return at_level(np.repeat(hashes, reached), level)


def at_level(hashes: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    mixed = hashes + np.asarray(level).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29))


def slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each element in a signature of 2^bits bits."""
    mask = np.uint64((1 << bits) - 1)
    return (hashes & mask).astype(np.int64), (hashes >> np.uint64(32) & mask).astype(np.int64)


def width_of(n: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, (BITS_PER_ELEMENT * n - 1).bit_length()))


class Hashes:
    """Hashes of terms, those met before from memory."""

    def __init__(self):
        self._known: dict[bytes, int] = {}

    def __call__(self, terms: list[bytes]) -> np.ndarray:
        if len(self._known) > _CACHE_TERMS:
            self._known = {}
        known, digest = self._known, xxhash.xxh64_intdigest
        for term in terms:
            if term not in known:
                known[term] = digest(term, _SEED)
        return np.fromiter(map(known.__getitem__, terms), dtype=np.uint64, count=len(terms))


class Building:
    """Documents of one width until they make a block."""

    def __init__(self, bits: int):
        self.bits, self.bytes = bits, 0
        self.keys, self.sizes, self.texts, self.elements = [], [], [], []

    def add(self, key, size: int, text: bytes, found: np.ndarray) -> bool:
        """Take a document; whether the block is complete now."""
        for column, value in zip((self.keys, self.sizes, self.texts, self.elements), (key, size, text, found)):
            column.append(value)
        self.bytes += len(text)
        n = len(self.keys)
        return n >= BLOCK_DOCUMENTS or (n + 1) << self.bits > BLOCK_CELLS or self.bytes > BLOCK_BYTES

    def slices(self) -> np.ndarray:
        """One row of packed document bits for every bit of the signature."""
        cells = np.zeros((1 << self.bits, len(self.keys)), dtype=np.uint8)
        owner = np.repeat(np.arange(len(self.keys)), [len(e) for e in self.elements])
        for bit in slots(np.concatenate(self.elements), self.bits):
            cells[bit, owner] = 1
        return np.packbits(cells, axis=1)

    def batch(self, key_type: pa.DataType, pilot: bool) -> pa.RecordBatch:
        columns = [
            pa.array([pilot]),
            pa.array([self.bits], pa.int32()),
            pa.array([self.keys], pa.list_(key_type)),
            pa.array([self.sizes], pa.list_(pa.int64())),
            pa.array([self.slices().tobytes()], pa.binary()),
            pa.array([self.texts], pa.list_(pa.binary())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["pilot", "bits", "k", "n", "slices", "terms"])


def index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks ``(pilot, bits, k, n, slices, terms)`` of all documents that hold a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, open_blocks, key_type = Hashes(), {}, None
        pilots = PILOT_BLOCKS if TaskContext.get().partitionId() == 0 else 0
        for batch in batches:
            key_type = batch.schema.field(0).type
            for own, value in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                terms = terms_of(value.as_py() or b"")
                if not terms:
                    continue
                counts = Counter(terms)
                frequency = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
                found = elements(hashes(list(counts)), frequency)
                bits = width_of(len(found))
                block = open_blocks.setdefault(bits, Building(bits))
                if block.add(own.as_py(), len(terms), b" ".join(terms), found):
                    yield open_blocks.pop(bits).batch(key_type, pilots > 0)
                    pilots -= 1
        for block in open_blocks.values():
            yield block.batch(key_type, pilots > 0)
            pilots -= 1

    kind = docs.schema[key].dataType.simpleString()
    lean = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return lean.mapInArrow(run, f"pilot boolean, bits int, k array<{kind}>, n array<long>, slices binary, terms array<binary>")


@dataclass
class Queries:
    """A block of queries: their terms by number, without repeats, and all terms."""

    keys: list
    terms: list[bytes]
    of_query: list[np.ndarray]

    @classmethod
    def of(cls, rows: list[tuple[object, list[bytes]]]) -> Queries:
        number: dict[bytes, int] = {}
        own = [np.array([number.setdefault(t, len(number)) for t in dict.fromkeys(terms)], np.int64) for _, terms in rows]
        return cls([key for key, _ in rows], list(number), own)


def query_blocks(items: DataFrame, key: str, text: str) -> Iterator[Queries]:
    """The queries in blocks of bounded size, read one by one."""
    rows = items.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    held, size = [], 0
    for row in stage(rows.groupBy("k").agg(F.min("t").alias("t")), "queries").toLocalIterator():
        terms = list(dict.fromkeys(terms_of((row.t or "").encode())))
        if terms:
            held.append((row.k, terms))
            size += len(terms)
        if len(held) >= BLOCK_QUERIES or size >= BLOCK_TERMS:
            yield Queries.of(held)
            held, size = [], 0
    if held:
        yield Queries.of(held)


def document_frequencies(blocks: DataFrame, terms: list[bytes]) -> np.ndarray:
    """How many documents hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {term: at for at, term in enumerate(terms)}
        wanted, counts = frozenset(number), Counter()
        for batch in batches:
            for documents in batch.column(0):
                for text in documents.values:
                    counts.update(wanted.intersection(text.as_py().split()))
        found = [pa.array([number[t] for t in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(found, names=["term", "n"])

    out = np.zeros(len(terms), dtype=np.int64)
    counted = blocks.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    # At most one row per term of a block of queries.
    for row in counted.collect():
        out[row.term] = row.n
    return out


def term_weights(n: int, frequency: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for df in frequency.tolist()], np.int64)


def share(frequency: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What a term adds per weight, from its frequency and the relative size of the text."""
    return (1_000_000_000 * frequency) // (1000 * frequency + 20 * size)


class Search:
    """Searches blocks for the best documents of every query."""

    def __init__(self, queries: Queries, weights: np.ndarray, documents: int, total: int, k: int, least: np.ndarray):
        self.queries, self.weights, self.k = queries, weights, k
        self.documents, self.total = documents, total
        self.hashes = Hashes()(queries.terms)
        self.number = {term: at for at, term in enumerate(queries.terms)}
        self.least = least.copy()
        self.best: list[list[tuple]] = [[] for _ in queries.keys]
        self.scored = self.passed = 0
        # Sums of a query's terms in single precision are off by no more than this.
        self.slack = [1 + 1e-5 + 1.2e-7 * len(own) for own in queries.of_query]

    def sizes(self, n: np.ndarray) -> np.ndarray:
        return 50 + (50 * n * self.documents) // self.total

    def bounds(self, bits: int, n: np.ndarray, slices: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores, a row per query and a column per document."""
        # A tile of documents begins with a byte of the slices.
        step = max(8, TILE_CELLS // len(self.hashes) // 8 * 8)
        tiles = [self._bounds(bits, n[a : a + step], slices[:, a // 8 : (a + step) // 8]) for a in range(0, len(n), step)]
        return np.concatenate(tiles, axis=1)

    def _bounds(self, bits: int, n: np.ndarray, slices: np.ndarray) -> np.ndarray:
        size = self.sizes(n)
        most = np.zeros((len(self.hashes), len(n)), dtype=np.float32)
        held = np.arange(len(self.hashes))
        shown, before = None, np.zeros(len(n), np.int64)
        for level, above in enumerate([*_LEVELS[1:], 1 << 40]):
            one, two = slots(at_level(self.hashes[held], level), bits)
            here = slices[one] & slices[two]
            shown = here if shown is None else shown & here
            some = shown.any(axis=1)
            if not some.any():
                break
            shown, held = shown[some], held[some]
            after = share(np.minimum(above - 1, n), size)
            most[held] += np.unpackbits(shown, axis=1, count=len(n)) * (after - before).astype(np.float32)
            before = after
        most *= self.weights[:, None].astype(np.float32)
        return np.stack([most[own].sum(axis=0) * slack for own, slack in zip(self.queries.of_query, self.slack)])

    def block(self, bits: int, keys: list, n: np.ndarray, slices: np.ndarray, terms: pa.Array) -> None:
        upper = self.bounds(bits, n, slices)
        open_pairs = (upper >= self.least[:, None]) & (upper > 0)
        wanted = np.flatnonzero(open_pairs.any(axis=0))
        self.scored += len(wanted)
        self.passed += len(n) - len(wanted)
        if not len(wanted):
            return
        first = np.cumsum([0, *map(len, self.queries.of_query[:-1])])
        flat = np.concatenate(self.queries.of_query)
        fresh: dict[int, list[tuple]] = {}
        held = 0
        for at in wanted.tolist():
            counts = Counter(map(self.number.get, terms[at].as_py().split()))
            counts.pop(None, None)
            frequency = np.zeros(len(self.weights), np.int64)
            frequency[list(counts)] = list(counts.values())
            added = self.weights * share(frequency, self.sizes(n[at]))
            scores = np.add.reduceat(added[flat], first)
            key = keys[at]
            for query in np.flatnonzero((scores >= self.least) & (scores > 0)).tolist():
                fresh.setdefault(query, []).append((-int(scores[query]), key is None, key))
                held += 1
            if held >= FRESH_SCORES:
                self._settle(fresh)
                fresh, held = {}, 0
        self._settle(fresh)

    def _settle(self, fresh: dict[int, list[tuple]]) -> None:
        """Keep the k best of every query, which raise what it takes to be among them."""
        for query, found in fresh.items():
            best = self.best[query] = sorted([*self.best[query], *found], key=_order)[: self.k]
            if len(best) == self.k:
                self.least[query] = max(self.least[query], -best[-1][0])


def _order(found: tuple) -> tuple:
    # A null key is not compared.
    return found[:2] if found[1] else found


def best_of(blocks: DataFrame, make, item_type, key: str) -> DataFrame:
    """Rows ``(item, k, score)``: the best documents of every query in each task."""
    kind = blocks.schema["k"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = make()
        for batch in batches:
            for at in range(batch.num_rows):
                bits, keys, n, slices, terms = (batch.column(c)[at] for c in range(5))
                n = n.values.to_numpy()
                cells = np.frombuffer(slices.as_buffer(), np.uint8).reshape(1 << bits.as_py(), -1)
                search.block(bits.as_py(), keys.as_py(), n, cells, terms.values)
        rows = [(search.queries.keys[q], key, -score) for q, found in enumerate(search.best) for score, _, key in found]
        item, own, score = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, to_arrow_type(item_type)), pa.array(own, to_arrow_type(kind)), pa.array(score, pa.int64())],
            names=["item", "k", "score"],
        )

    schema = f"item {item_type.simpleString()}, k {kind.simpleString()}, score long"
    return blocks.select("bits", "k", "n", "slices", "terms").mapInArrow(run, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.desc("score"), F.col("k").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``item_key``, ``rank``, ``key`` and ``score`` of the k best documents of every item."""
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        found = _found(docs, items, k, key, text, item_key, item_text)
    if not found:
        columns = f"item {items.schema[item_key].dataType.simpleString()}, k {docs.schema[key].dataType.simpleString()}, score long, rank int"
        found = [docs.sparkSession.createDataFrame([], columns)]
    return reduce(DataFrame.union, found).select(F.col("item").alias(item_key), "rank", F.col("k").alias(key), "score")


def _found(docs: DataFrame, items: DataFrame, k: int, key: str, text: str, item_key: str, item_text: str) -> list[DataFrame]:
    """Staged rows ``(item, k, score, rank)`` of every block of queries."""
    blocks = stage(index(docs, key, text), "signatures", **_BLOCK_FILES)
    item_type = items.schema[item_key].dataType
    sums = blocks.agg(
        F.sum(F.size("n").cast("long")).alias("documents"),
        F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"),
    ).first()
    documents, total = sums.documents or 0, sums.total or 1
    pilot = blocks.filter("pilot")
    found = []
    for queries in query_blocks(items, item_key, item_text):
        weights = term_weights(documents, document_frequencies(blocks, queries.terms))
        zero = np.zeros(len(queries.keys), np.int64)

        def make(least, queries=queries, weights=weights):
            return lambda: Search(queries, weights, documents, total, k, least)

        tried = _ranked(best_of(pilot, make(zero), item_type, key), k).filter(F.col("rank") == k)
        # One row per query of the block at most.
        kth = {row.item: row.score for row in tried.select("item", "score").collect()}
        least = np.array([kth.get(item, 0) for item in queries.keys], np.int64)
        found.append(stage(_ranked(best_of(blocks, make(least), item_type, key), k), "found"))
    return found


#: The fifty best documents of every benchmark item.
ORACLE_SQL = r"""
WITH lowered AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL
), d AS (
  SELECT r, doc_id, terms, len(terms) AS n FROM lowered WHERE len(terms) > 0
), totals AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM d),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), s AS (
  SELECT q.item_id, tf.r,
    sum(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT
      * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN d USING (r), totals GROUP BY ALL
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM s JOIN d USING (r) WHERE score > 0
) WHERE rank <= 50
"""
