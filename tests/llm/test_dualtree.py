from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from runsieve.llm import dualtree

SCHEMA = "vec_id long, embedding array<float>, label int, k string, v long, error string"


def table(spark, rows):
    return spark.createDataFrame([(i, x, l, "clash", 1, "clash") for i, x, l in rows], SCHEMA)


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """The rounds of the contract over all pairs of parts and entries."""
    def whole(x):
        return x is not None and all(c is not None and math.isfinite(c) for c in x)

    kept = [(i, [math.floor(float(np.float32(c)) * scale) for c in x], l) for i, x, l in rows if whole(x)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    kept = [(i, v + [0] * (width - len(v)), l) for i, v, l in kept]
    wide = width // parts
    cut = [[v[p * wide : (p + 1) * wide] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))[:entries]
    books = [[cut[r][p] for r in first] for p in range(parts)]

    def assigned(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), at) for at, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for row in cut:
                own[assigned(row[p], books[p])[1]].append(row[p])
            books[p] = [[sum(c) // len(c) for c in zip(*group)] if group else entry for group, entry in zip(own, books[p])]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, by_label = [], {}
    for (i, _, l), row in zip(kept, cut):
        found = [assigned(part, book) for part, book in zip(row, books)]
        error = sum(d for d, _ in found)
        by_label[l] = by_label.get(l, 0) + error
        out.append((i, "".join(f"{at:02x}" for _, at in found), error, l))
    top = (1 << 63) - 1
    return sorted(((i, code, min(e, top), min(by_label[l], top), digest) for i, code, e, l in out), key=repr)


def found(spark, rows, **options):
    return sorted(map(tuple, dualtree.compress(table(spark, rows), **options).collect()), key=repr)


def vectors(n, width, seed, clusters=0):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(width)] for _ in range(clusters)]
    rows = []
    for i in range(n):
        base = draw.choice(centres) if clusters else [0.0] * width
        rows.append((i, [c + draw.gauss(0, 0.02 if clusters else 0.3) for c in base], draw.choice([0, 0, 0, 1, 2, None])))
    return rows


@pytest.mark.parametrize("n, width, clusters, block", [(400, 16, 0, 64), (500, 16, 9, 2048), (130, 64, 0, 50)])
def test_rounds_against_all_pairs(spark, n, width, clusters, block):
    rows = vectors(n, width, n, clusters)
    assert found(spark, rows, block=block) == plain(rows)


def test_ties_copies_and_odd_rows(spark):
    draw = random.Random(1)
    grid = [(i, [float(draw.randint(-1, 1)) / 4096 for _ in range(16)], 3) for i in range(200)]
    odd = [
        (200, None, 1), (201, [1.0, None] * 8, 1), (202, [float("nan")] * 16, None), (203, [float("inf")] * 16, 2),
        (204, [], None), (205, [0.5], None), (None, [0.25] * 16, None), (5, [0.125] * 16, 4), (5, [0.125] * 16, 4),
    ]
    rows = grid + odd + [(300 + i, [0.001] * 16, 7) for i in range(90)]
    result = found(spark, rows, block=40)
    assert result == plain(rows)
    assert len(result) == len(rows) - 4


def test_huge_components_use_wide_numbers(spark):
    rows = [(i, [s * 3e9, -s * 2e9, s * 1e4, 0.0], i % 3) for i, s in enumerate([1, -1, 2, 2, -3, 0.5, 9, 0.1] * 5)]
    assert found(spark, rows, parts=2, entries=3, block=7) == plain(rows, parts=2, entries=3)


def test_few_and_no_vectors(spark):
    rows = vectors(5, 8, 3)
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows[:1]) == plain(rows[:1])
    empty = dualtree.compress(table(spark, rows).limit(0))
    assert empty.count() == 0 and empty.columns == dualtree.compress(table(spark, rows)).columns


def test_bounds_settle_whole_nodes():
    """On vectors in clusters most parts are never compared with an entry."""
    draw = np.random.default_rng(4)
    centres = draw.integers(-4000, 4000, (16, 8))
    points = (centres[draw.integers(0, 16, 2048)] + draw.integers(-60, 60, (2048, 8))).astype(np.int64)
    block = dualtree.Block.of(points, 1)
    tree, entries = block.tree(0, centres.tolist())
    whole, leaves, _ = dualtree.walk(tree, entries)
    settled = sum(int(tree.sizes(level)[parts].sum()) for level, parts, _ in whole)
    assert settled > 0.8 * len(points)
    assert any(level < tree.deep for level, _, _ in whole)
    exact = ((points[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (dualtree.nearest(tree, entries)[np.argsort(block.orders[0])] == exact).all()
    total, count = dualtree.gathered(tree, entries)
    assert (count == np.bincount(exact, minlength=16)).all()
    assert (total == np.stack([points[exact == e].sum(axis=0) for e in range(16)])).all()


def test_a_lost_block_is_built_alike():
    """Trees depend on the vectors of a block alone."""
    points = np.random.default_rng(1).integers(-9, 9, (300, 8))
    one, two = (dualtree.Block.of(points, 2) for _ in range(2))
    assert (one.orders == two.orders).all() and (one.boxes == two.boxes).all()
