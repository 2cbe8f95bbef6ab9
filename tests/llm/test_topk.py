from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from runsieve.llm import topk

SCHEMA = "vec_id long, embedding array<float>, id int, v int, qb int, score int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in rows], SCHEMA)


def plain(rows, k):
    usable = [
        (i, [math.floor(1024 * x) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    queries = {}
    for i, v in usable:
        if i % 100 == 0:
            queries[i] = min(queries.get(i, v), v)
    out = set()
    for q, v in queries.items():
        scored = sorted(
            (-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q
        )
        out |= {(q, rank, i, min(-s, 2**63 - 1)) for rank, (s, i) in enumerate(scored[:k], 1)}
    return out


def test_against_brute_force_with_ties_and_odd_rows(spark):
    draw = random.Random(5)
    rows = [(i, [draw.choice([-0.5, -0.25, 0.0, 0.25, 0.5, 0.75]) for _ in range(6)]) for i in range(350)]
    rows += [(400, [0.0] * 6), (401, [0.25] * 6), (402, None), (403, [1.0, None]), (404, [float("nan")] * 6)]
    rows += [(405, [float("inf")] * 6), (None, [1.0] * 6), (407, [9.0]), (408, []), (500, [1e9] * 6), (501, [1e9] * 6)]
    found = topk.top_k(frame(spark, rows), F.col("id") % 100 == 0, block_vectors=64, block_queries=2)
    assert {tuple(r) for r in found.collect()} == plain(rows, 10)


def test_threshold_stops_early_and_is_exact():
    import numpy as np

    generator = np.random.default_rng(1)
    vectors = generator.integers(-50, 50, (500, 3))
    ids = np.arange(500)
    lists = np.argsort(vectors, axis=0, kind="stable")
    query = np.array([3.0, -1.0, 2.0])
    found, scores = topk.threshold_topk(vectors.astype(float), ids, lists, query, -1, 5)
    order = np.lexsort((ids, -(vectors @ query)))[:5]
    assert found.tolist() == ids[order].tolist()
    assert scores.tolist() == (vectors @ query)[order].tolist()


def test_a_block_is_walked_once_for_all_queries():
    import time

    import numpy as np
    import pyarrow as pa

    generator = np.random.default_rng(2)
    vectors = generator.integers(-400, 400, (8192, 64))
    rows = pa.table({"id": np.arange(8192), "v": vectors.tolist()})
    queries = pa.table({"id": np.arange(0, 8192, 32), "v": vectors[::32].tolist()})
    begun = time.process_time()
    found = topk._block_search(10)(rows, queries)
    spent = time.process_time() - begun
    scores = vectors[::32] @ vectors.T
    scores[np.arange(256), np.arange(0, 8192, 32)] = -(1 << 40)
    want = {
        (q * 32, int(i), int(scores[q, i]))
        for q in range(256)
        for i in np.lexsort((np.arange(8192), -scores[q]))[:10]
    }
    assert {tuple(r.values()) for r in found.to_pylist()} == want
    assert spent < 1.5, "a walk per query takes over 3 CPU seconds"


def test_closed_queries_are_not_scored_further_and_ties_are():
    import numpy as np

    spread = np.arange(-2000, 2000)
    vectors = np.stack([spread, np.zeros_like(spread)], axis=1).astype(float)
    ids = np.arange(4000)[::-1].copy()
    lists = np.argsort(vectors, axis=0, kind="stable")
    queries, owners = np.array([[1.0, 0.0], [-2.0, 0.0]]), np.array([0, 5])
    scores, found, scored = topk.threshold_topk_block(vectors, ids, lists, queries, owners, 3)
    assert found.tolist() == [[1, 2, 3], [3999, 3998, 3997]]
    assert scores.tolist() == [[1998, 1997, 1996], [4000, 3998, 3996]]
    assert scored < 200
    scores, found, scored = topk.threshold_topk_block(vectors, ids, lists, np.array([[0.0, 1.0]]), np.array([1]), 3)
    assert found.tolist() == [[0, 2, 3]] and scores.tolist() == [[0, 0, 0]] and scored == 4000


def test_few_candidates_and_empty_table(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 1.0])]
    found = topk.top_k(frame(spark, rows), F.col("id") % 100 == 0).collect()
    assert [tuple(r) for r in found] == [(0, 1, 1, 1024 * 1024 * 3)]
    assert topk.top_k(frame(spark, []), F.col("id") % 100 == 0).count() == 0
