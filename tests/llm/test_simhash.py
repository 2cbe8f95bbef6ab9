from __future__ import annotations

import random
from collections import Counter

import xxhash

from runsieve.llm import simhash

from .samples import TEXTS, documents


def plain_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    counts = Counter()
    for shingle in shingles:
        digest = xxhash.xxh64_intdigest(shingle, 42)
        counts.update(bit for bit in range(64) if digest >> bit & 1)
    return sum(1 << bit for bit, n in counts.items() if 2 * n > len(shingles))


def plain_components(values):
    """Smallest value reachable over links of at most three bits."""
    values = sorted(set(values))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def test_documents_against_plain_python(spark):
    found = simhash.near_duplicates(documents(spark)).collect()
    prints = {i: plain_fingerprint(t) for i, t in TEXTS}
    roots = plain_components(prints.values())
    least = {}
    for i, v in prints.items():
        if i is not None:
            least[roots[v]] = min(i, least.get(roots[v], i))
    assert len(found) == len(TEXTS)
    for row in found:
        value = prints[row.doc_id]
        assert row.fingerprint == f"{value:016x}"
        assert row.component_id == least.get(roots[value])


def test_links_and_components_of_random_words(spark):
    draw = random.Random(3)
    values = [draw.getrandbits(64) for _ in range(60)]
    for value in values[:40]:
        near = value
        for bits in (1, 2, 3, 3, 4):
            for bit in draw.sample(range(64), bits):
                near ^= 1 << bit
            values.append(near)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "bits long").distinct()
    partners = {r.bits for r in simhash.with_partner(frame).collect()}
    roots = plain_components(values)
    size = Counter(roots.values())
    linked = {v - (1 << 64) if v >> 63 else v for v in roots if size[roots[v]] > 1}
    assert linked <= partners
    edges = simhash.links(frame)
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3 for r in edges.collect())
    groups = {}
    for row in simhash.components(edges).collect():
        groups.setdefault(row.root, set()).add(row.node)
    wanted = {}
    for v in roots:
        if size[roots[v]] > 1:
            wanted.setdefault(roots[v], set()).add(v - (1 << 64) if v >> 63 else v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_keep_one_keeps_every_component_once(spark):
    docs = documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    found = simhash.near_duplicates(docs)
    assert kept.count() == found.select("root").distinct().count()
    again = simhash.near_duplicates(kept)
    assert again.count() == again.select("root").distinct().count()


def test_empty_table(spark):
    empty = documents(spark, []).limit(0)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0
