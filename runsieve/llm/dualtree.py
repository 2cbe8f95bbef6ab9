"""Codes of vector parts by Lloyd's rounds on two trees.

Vectors become integers and are cut into equal parts; every part position has a
codebook. A round assigns each part to the nearest entry and replaces the entries
by the floored means of their parts.

Vectors lie in blocks of bounded size. For every part position a block has a
balanced tree over its parts, halved along the widest side; each node knows its
box, its count and the sum of its parts. The entries have such a tree too. A round
walks both from their roots: a pair of nodes goes on only if the least distance of
their boxes does not exceed the smallest of the largest distances that the part
node has to any entry node. Where one entry is left, the whole node is its, by the
cached sum. Leaves that keep several entries compare their parts by integers.

The trees are made once and written to the shared folder; each round is one pass
over them that returns the sums of the entries, a number of rows that depends on
the codebooks alone. Those sums are all that the driver sees besides the entries.

Defined cases: components become ``floor(scale * x)``, at the limits of a long;
vectors that are null or hold null or non-finite components take no part; shorter
vectors and a width that is no multiple of the parts count as padded by zeros; with
fewer vectors than entries the codebooks are as short; of equal keys the smaller
vector is the earlier entry, and null keys come last; repeated rows count each for
itself; errors beyond a long stop at its limit; null labels are one label; an
empty table gives no rows; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsieve.llm.common import stage

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Vectors of a block, and parts of a leaf.
BLOCK, LEAF = 2048, 16
_LONG = (1 << 63) - 1

#: Entries of one part position: rows of Python integers.
Book = list[list[int]]


def _edges(n: int, level: int) -> np.ndarray:
    return (np.arange(2**level + 1, dtype=np.int64) * n) >> level


def _limit(values: np.ndarray) -> int:
    return max(int(values.max(initial=0)), -int(values.min(initial=0)))


def _halved(points: np.ndarray, deep: int) -> np.ndarray:
    """An order of the rows in which the nodes of every level lie side by side."""
    order = np.arange(len(points))
    for level in range(deep):
        edges, own = _edges(len(points), level), points[order]
        spread = np.maximum.reduceat(own, edges[:-1]) - np.minimum.reduceat(own, edges[:-1])
        node = np.repeat(np.arange(2**level), np.diff(edges))
        value = own[np.arange(len(own)), spread.argmax(axis=1)[node]]
        order = order[np.lexsort((value, node))]
    return order


def _levels(function: np.ufunc, points: np.ndarray, deep: int) -> np.ndarray:
    """``function`` over the rows of every node, from the root down."""
    return np.concatenate([function.reduceat(points, _edges(len(points), level)[:-1]) for level in range(deep + 1)])


@dataclass
class PartTree:
    """Parts in the order of their tree; nodes of level l are rows 2^l - 1 and on."""

    points: np.ndarray
    deep: int
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    def sizes(self, level: int) -> np.ndarray:
        return np.diff(_edges(len(self.points), level))


class EntryTree:
    """Levels of nodes over the entries: boxes, and the range of nodes below.

    The last level has the entries themselves, ``place`` in the codebook.
    """

    def __init__(self, entries: np.ndarray):
        deep = len(entries).bit_length() - 1
        self.place = _halved(entries.astype(np.float64), deep)
        own = entries[self.place]
        self.low, self.high, self.below = [], [], []
        for level in range(deep + 1):
            edges = _edges(len(own), level)
            self.low.append(np.minimum.reduceat(own, edges[:-1]))
            self.high.append(np.maximum.reduceat(own, edges[:-1]))
            self.below.append(2 * np.arange(2**level + 1) if level < deep else edges)
        if 2**deep < len(own):
            self.low.append(own)
            self.high.append(own)
        self.last = len(self.low) - 1


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _first(groups: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(groups, prepend=-1))


def walk(tree: PartTree, entries: np.ndarray) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Whole nodes ``(level, nodes, entries)``, and pairs of leaves and entries left open."""
    books = EntryTree(entries)
    parts, nodes = np.zeros(1, np.int64), np.zeros(1, np.int64)
    level = depth = 0
    whole = []
    while len(parts):
        if depth == books.last:
            first = _first(parts)
            alone = np.diff(np.append(first, len(parts))) == 1
            if alone.any():
                done = first[alone]
                whole.append((level, parts[done], books.place[nodes[done]]))
                rest = np.ones(len(parts), bool)
                rest[done] = False
                parts, nodes = parts[rest], nodes[rest]
            if level == tree.deep:
                break
        if depth < books.last:
            start, end = books.below[depth][nodes], books.below[depth][nodes + 1]
            parts, nodes = np.repeat(parts, end - start), _ranges(start, end - start)
            depth += 1
        if level < tree.deep:
            both = np.concatenate([2 * parts, 2 * parts + 1])
            order = np.argsort(both, kind="stable")
            parts, nodes = both[order], np.tile(nodes, 2)[order]
            level += 1
        if not len(parts):
            break
        at = 2**level - 1 + parts
        low, high = tree.low[at], tree.high[at]
        near, far = books.low[depth][nodes], books.high[depth][nodes]
        gap = np.maximum(np.maximum(low - far, near - high), 0)
        reach = np.maximum(high - near, far - low)
        first = _first(parts)
        best = np.minimum.reduceat((reach * reach).sum(axis=1), first)
        sizes = np.diff(np.append(first, len(parts)))
        kept = ((gap * gap).sum(axis=1) <= np.repeat(best, sizes)).astype(bool)
        parts, nodes = parts[kept], nodes[kept]
    return whole, parts, books.place[nodes]


def _compared(tree: PartTree, entries: np.ndarray, leaves: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the parts of open leaves, and the nearest of the entries left to them."""
    starts, sizes = _edges(len(tree.points), tree.deep)[:-1], tree.sizes(tree.deep)
    own = np.unique(leaves)
    places = _ranges(starts[own], sizes[own])
    row = np.zeros(len(tree.points), np.int64)
    row[places] = np.arange(len(places))
    point = _ranges(starts[leaves], sizes[leaves])
    entry = np.repeat(nodes, sizes[leaves])
    apart = tree.points[point] - entries[entry]
    wide = entries.dtype == object
    distance = np.full((len(places), len(entries)), 1 << 200 if wide else _LONG, dtype=entries.dtype)
    distance[row[point], entry] = (apart * apart).sum(axis=1)
    return places, distance.argmin(axis=1)


def nearest(tree: PartTree, entries: np.ndarray) -> np.ndarray:
    """The nearest entry of every part, in the order of the tree; the lower of equals."""
    whole, leaves, nodes = walk(tree, entries)
    out = np.empty(len(tree.points), np.int64)
    for level, parts, chosen in whole:
        sizes = tree.sizes(level)[parts]
        out[_ranges(_edges(len(out), level)[parts], sizes)] = np.repeat(chosen, sizes)
    if len(leaves):
        places, chosen = _compared(tree, entries, leaves, nodes)
        out[places] = chosen
    return out


def gathered(tree: PartTree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the parts nearest to every entry."""
    whole, leaves, nodes = walk(tree, entries)
    total, count = np.zeros_like(entries), np.zeros(len(entries), np.int64)
    for level, parts, chosen in whole:
        np.add.at(total, chosen, tree.sums[2**level - 1 + parts])
        np.add.at(count, chosen, tree.sizes(level)[parts])
    if len(leaves):
        places, chosen = _compared(tree, entries, leaves, nodes)
        np.add.at(total, chosen, tree.points[places])
        np.add.at(count, chosen, 1)
    return total, count


class Block:
    """Vectors of a stored block with the trees of every part position."""

    def __init__(self, points: np.ndarray, orders: np.ndarray, boxes: np.ndarray):
        self.points, self.orders, self.boxes = points, orders, boxes
        self.parts = len(orders)
        self.deep = max(0, (len(points) // LEAF).bit_length() - 1)

    @classmethod
    def of(cls, points: np.ndarray, parts: int) -> Block:
        deep = max(0, (len(points) // LEAF).bit_length() - 1)
        cut = np.split(points, parts, axis=1)
        orders = np.array([_halved(part, deep) for part in cut], dtype=np.int32)
        boxes = [
            [_levels(f, part[order], deep) for f in (np.minimum, np.maximum, np.add)]
            for part, order in zip(cut, orders)
        ]
        return cls(points, orders, np.array(boxes))

    def tree(self, part: int, book: Book) -> tuple[PartTree, np.ndarray]:
        """The tree of a part position and its entries, in numbers wide enough."""
        wide = self.points.shape[1] // self.parts
        points = self.points[self.orders[part], part * wide : (part + 1) * wide]
        largest = max([_limit(points), *(abs(x) for entry in book for x in entry)])
        low, high, sums = self.boxes[part]
        # Squared distances and sums of a block stay below 2^62, or Python's integers do.
        if max(4 * largest**2 * wide, len(points) * largest) >= 1 << 62:
            points, low, high = (x.astype(object) for x in (points, low, high))
            sums = _levels(np.add, points, self.deep)
        return PartTree(points, self.deep, low, high, sums), np.array(book, dtype=points.dtype)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), dtype=np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    limit = F.lit(float("inf"))
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < limit), F.lit(False)))
    return vector.isNotNull() & finite


def forest(vectors: DataFrame, width: int, parts: int, block: int = BLOCK) -> DataFrame:
    """Rows of ``(k, label, v)`` as stored blocks with their trees."""
    key, label = (vectors.schema[name].dataType.simpleString() for name in ("k", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(batch: pa.RecordBatch) -> pa.RecordBatch:
            built = Block.of(_matrix(batch.column(2), width), parts)
            lists = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(at)) for at in (0, 1)]
            stored = [pa.array([x.tobytes()], pa.binary()) for x in (built.points, built.orders, built.boxes)]
            return pa.RecordBatch.from_arrays([*lists, *stored], names=["k", "label", "points", "orders", "boxes"])

        held, rows = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, block - rows))
                at += held[-1].num_rows
                rows += held[-1].num_rows
                if rows == block:
                    yield made(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, rows = [], 0
        if rows:
            yield made(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    schema = f"k array<{key}>, label array<{label}>, points binary, orders binary, boxes binary"
    return vectors.select("k", "label", "v").mapInArrow(run, schema)


def _blocks(batch: pa.RecordBatch, width: int, parts: int) -> Iterator[Block]:
    at = batch.schema.get_field_index
    stored = [batch.column(at(name)) for name in ("points", "orders", "boxes")]
    for points, orders, boxes in zip(*stored):
        points = np.frombuffer(points.as_buffer(), np.int64).reshape(-1, width)
        orders = np.frombuffer(orders.as_buffer(), np.int32).reshape(parts, -1)
        yield Block(points, orders, np.frombuffer(boxes.as_buffer(), np.int64).reshape(parts, 3, -1, width // parts))


def next_books(trees: DataFrame, books: list[Book], width: int) -> list[Book]:
    """The entries after one round."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.array([[[0] * len(entry) for entry in book] for book in books], dtype=object)
        count = np.zeros(total.shape[:2], np.int64)
        for batch in batches:
            for block in _blocks(batch, width, parts):
                for part, book in enumerate(books):
                    found, n = gathered(*block.tree(part, book))
                    total[part] += found
                    count[part] += n
        where = np.indices(total.shape).reshape(3, -1)
        yield pa.RecordBatch.from_arrays(
            [
                *(pa.array(x, pa.int32()) for x in where),
                pa.array([Decimal(int(x)) for x in total.ravel()], pa.decimal128(38, 0)),
                pa.array(np.repeat(count.ravel(), total.shape[2])),
            ],
            names=["part", "entry", "place", "total", "n"],
        )

    sums = trees.select("points", "orders", "boxes").mapInArrow(
        run, "part int, entry int, place int, total decimal(38,0), n long"
    )
    after = [[list(entry) for entry in book] for book in books]
    # One row per component of the codebooks.
    for row in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        if row.n:
            after[row.part][row.entry][row.place] = int(row.total) // row.n
    return after


def _coded(trees: DataFrame, books: list[Book], width: int) -> DataFrame:
    """``(k, label, code, error)`` of every vector."""
    key, label = (trees.schema[name].dataType.elementType.simpleString() for name in ("k", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{at:02x}" for at in range(max(map(len, books)))])
        for batch in batches:
            for row, block in enumerate(_blocks(batch, width, len(books))):
                error, code = [0] * len(block.points), np.full(len(block.points), "")
                for part, book in enumerate(books):
                    tree, entries = block.tree(part, book)
                    chosen = nearest(tree, entries)
                    apart = tree.points - entries[chosen]
                    back = np.argsort(block.orders[part])
                    code = np.char.add(code, digits[chosen[back]])
                    error = [a + b for a, b in zip(error, (apart * apart).sum(axis=1)[back].tolist())]
                columns = [batch.column(at)[row].values for at in (0, 1)]
                columns += [pa.array(code.tolist()), pa.array([min(x, _LONG) for x in error], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "label", "code", "error"])

    return trees.mapInArrow(run, f"k {key}, label {label}, code string, error long")


def digest_of(books: list[Book]) -> str:
    """sha256 of all components by part, entry and place."""
    numbers = ",".join(str(x) for book in books for entry in book for x in entry)
    return hashlib.sha256(numbers.encode()).hexdigest()


def compress(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    block: int = BLOCK,
) -> DataFrame:
    """``key``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` of every kept vector."""
    x = F.col("x")
    vectors = (
        rows.select(F.col(key).alias("k"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("x"))
        .filter(usable(x))
        .select("k", "label", F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))
    )
    widest = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, -(-widest // parts)) * parts
    first = vectors.orderBy(F.col("k").asc_nulls_last(), "v").limit(entries).collect()
    seeds = [row.v + [0] * (width - len(row.v)) for row in first]
    if not seeds:
        empty = vectors.select(F.col("k").alias(key), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty.withColumns({"label_error": F.col("error"), "codebooks_sha256": F.lit(digest_of([]))})
    wide = width // parts
    books = [[seed[part * wide : (part + 1) * wide] for seed in seeds] for part in range(parts)]
    trees = stage(forest(vectors, width, parts, block), "part-trees")
    for _ in range(rounds):
        books = next_books(trees, books, width)
    coded = stage(_coded(trees, books, width), "codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"))
    totals = stage(by_label.select("of", F.least("s", F.lit(_LONG).cast("decimal(38,0)")).cast("long").alias("label_error")), "label-errors")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("k").alias(key), "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256")
    )


def _oracle(parts: int, entries: int, rounds: int, scale: int) -> str:
    """The same rounds as statements over rows of one component, for DuckDB."""
    steps = [
        f"""kept AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT r, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS x
  FROM kept, range({parts}) AS t(part)
), seed AS (
  SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS entry FROM kept QUALIFY entry < {entries}
), b0 AS MATERIALIZED (SELECT part, entry, x FROM p JOIN seed USING (r))"""
    ]
    distance = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for at in range(rounds + 1):
        steps.append(f"""a{at} AS MATERIALIZED (
  SELECT r, part, min(struct_pack(d := d, entry := entry)) AS m FROM (
    SELECT p.r, p.part, b.entry, {distance} AS d FROM p JOIN b{at} b ON p.part = b.part)
  GROUP BY r, part)""")
        if at < rounds:
            steps.append(f"""b{at + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.x, b.x) AS x FROM b{at} b LEFT JOIN (
    SELECT part, entry, list(y ORDER BY place) AS x FROM (
      SELECT part, entry, place, (s - ((s % n) + n) % n) // n AS y FROM (
        SELECT p.part, a.m.entry AS entry, g.place, sum(p.x[g.place])::BIGINT AS s, count(*)::BIGINT AS n
        FROM p JOIN a{at} a USING (r, part), range(1, len(p.x) + 1) AS g(place) GROUP BY ALL))
    GROUP BY part, entry) m USING (part, entry))""")
    return f"""WITH {", ".join(steps)}, coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', m.entry), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error
  FROM a{rounds} JOIN kept USING (r) GROUP BY r, vec_id, label
), books AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS h FROM b{rounds}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM coded, books"""


ORACLE_SQL = _oracle(PARTS, ENTRIES, ROUNDS, SCALE)
