"""Exact top-k by inner product with the threshold algorithm.

Vectors lie in blocks of bounded size. A block has one sorted list of rows per
dimension. The lists are walked side by side from both ends, once for all queries
of a group; every row that comes up is scored in full, for all open queries by one
matrix product. The sum of what the lists show last, at the end that the sign of a
query's component favours and weighted by the query, bounds all rows not yet seen, so
a query leaves a block as soon as its k-th result beats that bound. The best of all
blocks are ranked per query.

Queries lie in blocks too. Each block of queries meets each block of vectors in
one group; neither side is broadcast, and a group is bounded by both block sizes.

Defined cases: components become ``floor(scale * x)``; vectors that are null or
hold null or non-finite components, and rows with a null id, take no part; short
vectors count as padded by zeros; a query is the smallest vector of its id, and
rows of the same id are not its candidates; repeated rows rank each for itself;
scores beyond a long stop at its limits; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runsieve.llm.common import stage

SCALE = 1024
BLOCK_VECTORS = 8192
BLOCK_QUERIES = 4096
_LONG = (-(1 << 63), (1 << 63) - 1)
_NONE = float("-inf")
#: Rows walked of each end of a list before the first bound; then twice as many each time.
_FIRST_STEP = 16
#: Scores that a task holds at once.
_SCORES_AT_ONCE = 1 << 20
_SCHEMA = "query_id long, vec_id long, score long"


def quantised(rows: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """``(id, v)`` of the rows that take part, ``v`` as array of longs."""
    limit = F.lit(float("inf"))
    usable = F.forall(
        F.col("x"),
        lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < limit), F.lit(False)),
    )
    return (
        rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
        .filter(F.col("id").isNotNull() & F.col("x").isNotNull() & usable)
        .select("id", F.transform("x", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))
    )


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    rows = column.combine_chunks()
    if isinstance(rows, pa.ChunkedArray):
        rows = pa.concat_arrays(rows.chunks) if rows.num_chunks else pa.array([], column.type)
    lengths = np.diff(rows.offsets.to_numpy())
    values = rows.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return values.reshape(len(rows), width)
    out = np.zeros((len(rows), width), dtype=np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out


def _width(*tables: pa.Table) -> int:
    return max((pc.max(pc.list_value_length(t.column("v"))).as_py() or 0 for t in tables), default=0)


def _reach(lists: np.ndarray) -> np.ndarray:
    """Per row the place, from the nearer end, at which a list shows it first."""
    places = np.arange(len(lists))
    nearer = np.minimum(places, places[::-1])
    reach = np.full(len(lists), len(lists))
    for shown in lists.T:
        reach[shown] = np.minimum(reach[shown], nearer)
    return reach


class _Best:
    """The k best rows found so far of every query, by score, then by smaller id."""

    def __init__(self, queries: int, k: int, exact: type):
        self.k = k
        self.scores = np.full((queries, k), _NONE, dtype=exact)
        self.ids = np.full((queries, k), _LONG[1], dtype=np.int64)

    def add(self, of: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take in new rows: ``scores`` of the queries ``of`` by those of ``ids``."""
        k, worst = self.k, self.scores[of, -1]
        least = worst
        if len(ids) > k:
            least = np.maximum(worst, np.partition(scores, len(ids) - k, axis=1)[:, -k]) if (worst == _NONE).any() else worst
        at, row = np.nonzero(scores >= least[:, None])
        score, vec = scores[at, row], ids[row]
        better = (score > worst[at]) | ((score == worst[at]) & (score > _NONE) & (vec < self.ids[of, -1][at]))
        if not better.any():
            return
        at, score, vec = at[better], score[better], vec[better]
        changed, at = np.unique(at, return_inverse=True)
        kept = of[changed]
        at = np.concatenate([np.repeat(np.arange(len(kept)), k), at])
        score = np.concatenate([self.scores[kept].ravel(), score])
        vec = np.concatenate([self.ids[kept].ravel(), vec])
        order = np.lexsort((vec, -score, at))
        starts = np.searchsorted(at[order], np.arange(len(kept)))
        first = order[(starts[:, None] + np.arange(k)[None, :])]
        self.scores[kept], self.ids[kept] = score[first], vec[first]


def threshold_topk_block(
    vectors: np.ndarray, ids: np.ndarray, lists: np.ndarray, queries: np.ndarray, owners: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and ids of the k best rows of a block for each query, a row of each per query.

    ``lists`` has in each column the rows in ascending order of that dimension. They
    are walked once for all queries, from both ends, and what comes up is scored for
    every open query by one matrix product. A query is closed when its k-th result
    beats its bound; ties with the bound go on, as an unseen row of equal score may
    have a smaller id. Places without a result have the score ``-inf``. The last
    value is the number of scores that were computed.
    """
    rows = len(ids)
    best = _Best(len(queries), k, vectors.dtype)
    reach = _reach(lists)
    order = np.argsort(reach, kind="stable")
    reach, walked, walked_ids = reach[order], vectors[order], ids[order]
    rising, falling = np.maximum(queries, 0), np.minimum(queries, 0)
    every = np.arange(vectors.shape[1])
    open_, scored = np.arange(len(queries)), 0
    # Without dimensions no list shows a row: all are scored at once.
    seen, depth, step = 0, 0, _FIRST_STEP if len(every) else rows + 1
    while seen < rows and len(open_):
        depth, step = depth + step, step * 2
        shown = int(np.searchsorted(reach, depth)) if len(every) else rows
        fresh, fresh_ids = walked[seen:shown].T, walked_ids[seen:shown]
        size = max(1, _SCORES_AT_ONCE // max(1, shown - seen))
        for start in range(0, len(open_), size):
            of = open_[start : start + size]
            scores = queries[of] @ fresh
            owned = np.flatnonzero(np.isin(fresh_ids, owners[of]))
            own = owners[of][:, None] == fresh_ids[owned][None, :]
            scores[:, owned] = np.where(own, _NONE, scores[:, owned])
            best.add(of, scores, fresh_ids)
            scored += scores.size
        seen = shown
        if seen < rows:
            low, high = vectors[lists[depth - 1], every], vectors[lists[rows - depth], every]
            bound = rising[open_] @ high + falling[open_] @ low
            open_ = open_[best.scores[open_, -1] <= bound]
    return best.scores, best.ids, scored


def threshold_topk(
    vectors: np.ndarray, ids: np.ndarray, lists: np.ndarray, query: np.ndarray, own: int, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows of a block for one query."""
    scores, found, _ = threshold_topk_block(vectors, ids, lists, query[None, :], np.array([own]), k)
    kept = scores[0] > _NONE
    return found[0][kept], scores[0][kept]


def _block_search(k: int):
    def search(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        width = _width(candidates, queries)
        vectors, wanted = (_matrix(t.column("v"), width) for t in (candidates, queries))
        ids, owners = (t.column("id").to_numpy() for t in (candidates, queries))
        size = max(1, width) * float(np.abs(vectors.astype(float)).max(initial=0)) * float(
            np.abs(wanted.astype(float)).max(initial=0)
        )
        # Doubles hold these sums exactly up to 2^53; beyond, Python's integers do.
        exact = float if size < 2**53 else object
        lists = np.argsort(vectors, axis=0, kind="stable")
        vectors, wanted = vectors.astype(exact), wanted.astype(exact)
        scores, found, _ = threshold_topk_block(vectors, ids, lists, wanted, owners, k)
        of, place = np.nonzero(scores > _NONE)
        best = scores[of, place]
        if exact is object:
            best = np.array([min(max(int(score), _LONG[0]), _LONG[1]) for score in best], dtype=np.int64)
        columns = {"query_id": owners[of], "vec_id": found[of, place], "score": best.astype(np.int64)}
        return pa.table({name: pa.array(values, type=pa.int64()) for name, values in columns.items()})

    return search


def _blocks(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def top_k(
    rows: DataFrame,
    is_query: Column,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: int = SCALE,
    block_vectors: int = BLOCK_VECTORS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best other rows of each query.

    ``is_query`` is a condition on ``id``.
    """
    vectors = quantised(rows, key, vector, scale)
    queries = stage(vectors.filter(is_query).groupBy("id").agg(F.min("v").alias("v")), "queries")
    n_vectors = _blocks(vectors.count(), block_vectors)
    n_queries = _blocks(queries.count(), block_queries)
    row = F.monotonically_increasing_id()
    other = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.withColumn("vb", (row % n_vectors).cast("int")).withColumn("qb", other(n_queries))
    right = queries.withColumn("qb", (row % n_queries).cast("int")).withColumn("vb", other(n_vectors))
    found = (
        left.groupBy("qb", "vb")
        .cogroup(right.groupBy("qb", "vb"))
        .applyInArrow(_block_search(k), _SCHEMA)
    )
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return (
        found.withColumn("rank", rank)
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


#: Ten best rows for every hundredth vector.
ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 10
"""
