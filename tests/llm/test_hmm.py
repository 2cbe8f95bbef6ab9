from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from runsieve.llm import hmm

from .samples import TEXTS, documents


def held(key):
    return key is not None and zlib.crc32(str(key).encode()) % 5 == 1


def test_counts_and_base_against_plain_python(spark):
    found = hmm.score(documents(spark), states=2, rounds=2, hot_words=8, own_words=3).collect()
    counts = Counter()
    for key, text in TEXTS:
        if not held(key):
            counts.update(hmm.words_of((text or "").encode()))
    total, kinds = sum(counts.values()), len(counts)
    assert len(found) == len(TEXTS)
    texts = dict(TEXTS)
    for row in found:
        words = hmm.words_of((texts[row.doc_id] or "").encode())
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in words)
        assert row.held_out == held(row.doc_id)
        assert (row.n_tokens, row.n_known) == (len(words), sum(w in counts for w in words))
        assert row.train_tokens == total
        assert row.base_score == pytest.approx(base)
        assert row.score < 0


def random_model(states, classes, seed=1):
    draw = np.random.default_rng(seed)
    start, move, emit = draw.random(states), draw.random((states, states)), draw.random((classes, states))
    return hmm.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def path_sum(model, sequence):
    states = range(len(model.start))
    total = 0.0
    for path in itertools.product(states, repeat=len(sequence)):
        p = model.start[path[0]]
        for a, b in itertools.pairwise(path):
            p *= model.move[a, b]
        for s, c in zip(path, sequence):
            p *= model.emit[c, s]
        total += p
    return total


def test_forward_sums_all_paths():
    model = random_model(3, 4)
    sequences = [np.array(s) for s in ([0], [1, 2, 3, 0, 2], [3, 3], [2, 1, 0, 1])]
    found = model.likelihoods(sequences)
    assert np.exp(found) == pytest.approx([path_sum(model, s) for s in sequences])
    assert model.likelihoods([]).size == 0


def test_expected_counts_sum_all_paths():
    model = random_model(2, 3, 4)
    sequences = [np.array([0, 1, 2, 1]), np.array([2]), np.array([1, 0])]
    start, move, emit = model.expected(sequences)
    want = [np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2))]
    for sequence in sequences:
        whole = path_sum(model, sequence)
        for path in itertools.product(range(2), repeat=len(sequence)):
            p = model.start[path[0]] * np.prod([model.emit[c, s] for s, c in zip(path, sequence)])
            p *= np.prod([model.move[a, b] for a, b in itertools.pairwise(path)]) / whole
            want[0][path[0]] += p
            for a, b in itertools.pairwise(path):
                want[1][a, b] += p
            for s, c in zip(path, sequence):
                want[2][c, s] += p
    for found, wanted in zip((start, move, emit), want):
        assert found == pytest.approx(wanted)


def test_emissions_of_known_and_unseen_words_sum_to_one(spark):
    docs = documents(spark).selectExpr("coalesce(text, '') AS t")
    counts = hmm.word_counts(docs)
    vocabulary = hmm.Vocabulary(counts, hot_words=8, own_words=3)
    assert vocabulary.shares.sum() == pytest.approx(1)
    inside = Counter()
    for row in counts.collect():
        if vocabulary.index.get(bytes(row.word), 9) >= vocabulary.own:
            inside[row["class"]] += (row.n + 0.5) / vocabulary.below[row["class"]]
    for kind, share in inside.items():
        assert share + 0.5 / vocabulary.below[kind] == pytest.approx(1)


def test_order_of_words_matters_after_training(spark):
    rows = [(i, "red blue " * 40 if i % 2 else "one two " * 40) for i in range(60)]
    found = hmm.score(documents(spark, rows), states=4, rounds=8).collect()
    assert sum(r.score for r in found) > sum(r.base_score for r in found) + 100


def test_no_training_rows_and_empty_table(spark):
    key = next(i for i in range(100) if held(i))
    row = hmm.score(documents(spark, [(key, "a b")])).first()
    assert (row.train_tokens, row.n_known, row.base_score) == (0, 0, 0.0)
    assert hmm.score(documents(spark, []).limit(0)).count() == 0
