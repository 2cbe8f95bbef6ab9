from __future__ import annotations

import math
import random
import re
import tracemalloc
from collections import Counter
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from runsieve.llm import signatures
from runsieve.llm.common import arrow_batches

from .samples import TEXTS, documents

_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return _TERM.findall((text or "").translate(_LOWER))


def plain(rows, items, k=50):
    docs = [(i, Counter(plain_terms(t))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    texts = {}
    for key, text in items:
        texts[key] = min(filter(lambda t: t is not None, (text, texts.get(key))), default=None)
    for item, text in texts.items():
        found = []
        for key, counts in docs:
            m = 50 + (50 * sum(counts.values()) * n) // total
            score = 0
            for term in set(plain_terms(text)):
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1)))
                score += w * ((10**9 * counts[term]) // (1000 * counts[term] + 20 * m))
            if score > 0:
                found.append((-score, key is None, key))
        found.sort(key=lambda f: f[:2] if f[1] else f)
        out += [(item, rank, key, -score) for rank, (score, _, key) in enumerate(found[:k], start=1)]
    return sorted(out, key=repr)


def generated(n, seed, words=300):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choices("abcdeéßл日", k=draw.randint(1, 5))) for _ in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    rows = []
    for i in range(n):
        size = draw.choice([1, 3, 20, 60, 400]) if i % 50 else 3000
        rows.append((i, draw.choice([" ", "-", ", "]).join(draw.choices(vocabulary, weights, k=size)).title()))
    items = [(i, " ".join(draw.choices(vocabulary, k=12)) + ".") for i in range(15)]
    return rows, items


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in items], "item_id long, text string, k string, n int, bits int")


def found(spark, rows, items, **options):
    frame = signatures.search(documents(spark, rows), benchmark(spark, items), **options)
    assert frame.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.mark.parametrize("k, documents_of_block", [(50, 2048), (3, 8)])
def test_against_all_pairs(spark, monkeypatch, k, documents_of_block):
    monkeypatch.setattr(signatures, "BLOCK_DOCUMENTS", documents_of_block)
    monkeypatch.setattr(signatures, "PILOT_BLOCKS", 2)
    monkeypatch.setattr(signatures, "BLOCK_QUERIES", 4)
    rows, items = generated(400, seed=k)
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # copies, of equal scores
    rows += [(1001, rows[7][1])] * 2
    assert found(spark, rows, items, k=k) == plain(rows, items, k)


def test_odd_rows_and_queries(spark):
    items = [
        (1, "the quick brown fox"), (2, None), (3, ""), (4, " .,- "), (5, "x" * 3000), (6, "QUICK quick Quick word"),
        (7, "日本語 é"), (8, "nowhere at all zz9"), (None, "word w5 w6"), (9, "word"), (9, "another word"), (10, "w1 w2 w96"),
    ]
    rows = TEXTS + [(None, "word again"), (40, "the the the the fox"), (41, "quick\x00brown\x7ffox_jumps")]
    assert found(spark, rows, items) == plain(rows, items)


def test_empty_tables(spark):
    rows, items = generated(20, seed=1)
    assert found(spark, rows, items[:1]) and not found(spark, rows, [(1, None)])
    assert signatures.search(documents(spark, rows), benchmark(spark, items).limit(0)).count() == 0
    assert signatures.search(documents(spark, rows).limit(0), benchmark(spark, items)).count() == 0


def built(rows):
    blocks = {}
    for key, text in rows:
        terms = signatures.terms_of(text.encode())
        counts = Counter(terms)
        own = signatures.elements(signatures.Hashes()(list(counts)), np.array(list(counts.values())))
        bits = signatures.width_of(len(own))
        blocks.setdefault(bits, signatures.Building(bits)).add(key, len(terms), b" ".join(terms), own)
    return list(blocks.values())


def test_bounds_are_never_below_and_exclude_documents():
    rows, items = generated(600, seed=11)
    queries = signatures.Queries.of([(i, signatures.terms_of(t.encode())) for i, t in items])
    total = sum(len(plain_terms(t)) for _, t in rows)
    df = Counter(t for _, text in rows for t in set(plain_terms(text)))
    weights = signatures.term_weights(len(rows), np.array([df[t.decode()] for t in queries.terms]))
    scores = {(i, d): s for i, _, d, s in plain(rows, items, k=len(rows))}
    kth = np.array([sorted((s for (i, _), s in scores.items() if i == item), reverse=True)[9] for item, _ in items])
    search = signatures.Search(queries, weights, len(rows), total, 10, kth)
    ratio, left, pairs = [], 0, 0
    for block in built(rows):
        n = np.array(block.sizes)
        upper = search.bounds(block.bits, n, block.slices())
        exact = np.array([[scores.get((item, d), 0) for d in block.keys] for item, _ in items])
        assert (upper >= exact).all()
        ratio += (upper[exact > 0] / exact[exact > 0]).tolist()
        left += int((upper >= kth[:, None]).sum())
        pairs += upper.size
    assert np.median(ratio) < 1.3
    assert left < 0.15 * pairs


def test_slices_are_the_documents_signatures():
    rows, _ = generated(30, seed=5)
    for block in built(rows):
        bits = np.unpackbits(block.slices(), axis=1, count=len(block.keys))
        for at, own in enumerate(block.elements):
            wanted = np.zeros(1 << block.bits, bool)
            for slot in signatures.slots(own, block.bits):
                wanted[slot] = True
            assert (bits[:, at].astype(bool) == wanted).all()


BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_tiles_and_early_settling_change_no_result(spark, monkeypatch):
    monkeypatch.setattr(signatures, "TILE_CELLS", 500)
    monkeypatch.setattr(signatures, "FRESH_SCORES", 7)
    rows, items = generated(300, seed=21)
    rows += [(None, rows[7][1]), (7, rows[7][1])]
    assert found(spark, rows, items, k=5) == plain(rows, items, 5)


def test_a_tile_of_bounds_is_what_all_at_once_would_be(monkeypatch):
    rows, items = generated(500, seed=4)
    queries = signatures.Queries.of([(i, signatures.terms_of(t.encode())) for i, t in items])
    weights = np.arange(1, len(queries.terms) + 1, dtype=np.int64)
    search = signatures.Search(queries, weights, 500, 30_000, 10, np.zeros(len(items), np.int64))
    for block in built(rows):
        n, slices = np.array(block.sizes), block.slices()
        monkeypatch.setattr(signatures, "TILE_CELLS", 1 << 40)
        whole = search.bounds(block.bits, n, slices)
        monkeypatch.setattr(signatures, "TILE_CELLS", 20 * len(queries.terms))
        assert np.array_equal(search.bounds(block.bits, n, slices), whole)


def peak_mb(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def searching(terms_of_queries, words, k=50):
    """A search of the queries and a full block of short documents."""
    rows = [(i, f"{words[i % len(words)]} common") for i in range(2047)]
    queries = signatures.Queries.of(list(enumerate(terms_of_queries)))
    weights = np.full(len(queries.terms), 1000, np.int64)
    search = signatures.Search(queries, weights, 2047, 4094, k, np.zeros(len(terms_of_queries), np.int64))
    (block,) = built(rows)
    texts = pa.array(block.texts, pa.binary())
    return search, lambda: search.block(block.bits, block.keys, np.array(block.sizes), block.slices(), texts)


def test_memory_of_bounds_does_not_follow_terms_and_documents():
    words = [b"word%d" % i for i in range(20_000)]
    search, work = searching([words[i::20] for i in range(20)], [w.decode() for w in words])
    # All at once, 20,000 terms and 2,047 documents take 160 MB for one of several arrays.
    assert peak_mb(work) < 80
    assert sum(map(len, search.best)) == 20 * 50


def test_memory_of_scores_does_not_follow_queries_and_documents():
    search, work = searching([[b"common"]] * 400, ["word"], k=3)
    assert peak_mb(work) < 60
    assert all([key for _, _, key in best] == [0, 1, 2] for best in search.best)


def recorded(monkeypatch):
    staged, stage = {}, signatures.stage

    def keep(frame, name, **options):
        staged[name] = stage(frame, name, **options), frame.sparkSession.conf.get(BATCH_SETTING)
        return staged[name][0]

    monkeypatch.setattr(signatures, "stage", keep)
    return staged


def test_blocks_lie_in_small_row_groups_and_pages(spark, monkeypatch):
    staged, draw = recorded(monkeypatch), random.Random(9)
    rows = [(i, " ".join(f"{draw.getrandbits(256):064x}" for _ in range(15_000))) for i in range(24)]
    frame = signatures.search(documents(spark, rows).coalesce(1), benchmark(spark, [(1, rows[3][1][:400])]))
    assert [(row.doc_id, row.rank) for row in frame.collect()] == [(3, 1)]
    (file,) = staged["signatures"][0].inputFiles()
    meta = pq.ParquetFile(unquote(urlparse(file).path)).metadata
    groups = [meta.row_group(i) for i in range(meta.num_row_groups)]
    assert sum(group.total_byte_size for group in groups) > 24e6
    # A group ends with the block that reaches 8 MB.
    assert max(group.total_byte_size for group in groups) < 16e6


def test_arrow_batches_are_small_within_the_search_alone(spark, monkeypatch):
    staged, before = recorded(monkeypatch), spark.conf.get(BATCH_SETTING)
    rows, items = generated(40, seed=2)
    frame = signatures.search(documents(spark, rows), benchmark(spark, items))
    assert {setting for _, setting in staged.values()} == {f"{signatures.BATCH_BYTES}b"}
    assert spark.conf.get(BATCH_SETTING) == before
    # What runs after that, under any setting, reads the best rows and no blocks.
    assert "MapInArrow" not in frame._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ZeroDivisionError), arrow_batches(spark, 1 << 20):
        1 / 0
    assert spark.conf.get(BATCH_SETTING) == before


def test_batches_hold_the_bytes_asked_for(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    texts = spark.range(0, 2000, 1, 1).selectExpr("repeat(string(id % 10), 1000) AS text")
    with arrow_batches(spark, 1 << 16):
        found = [row.size for row in texts.mapInArrow(sizes, "size long").collect()]
    assert sum(found) > 2e6 and max(found) < 2 << 16
