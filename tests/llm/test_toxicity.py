from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from runsieve.llm import toxicity

from .samples import TEXTS, documents

BAD = ["grumblik", "snarfox", "vilewort"]


def generated(n=300, seed=4):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdeghilnorstu", k=draw.randint(2, 8))) for _ in range(400)]
    rows, marks = [], []
    for i in range(n):
        chosen = draw.choices(words, k=draw.randint(30, 120))
        if i % 5 == 0:
            for _ in range(2):
                chosen.insert(draw.randrange(len(chosen)), draw.choice(BAD))
        rows.append((i, " ".join(w + "." if j % 9 == 8 else w for j, w in enumerate(chosen))))
        marks.append((i, int(i % 5 == 0)))
    return rows, marks


@pytest.fixture(scope="module")
def machine():
    rows, marks = generated()
    return toxicity.train([t for _, t in rows], [m for _, m in marks])


def labels(spark, marks):
    return spark.createDataFrame([(i, 1, t) for i, t in marks], "doc_id long, quality int, toxic int")


def test_held_out_documents_and_clean_ones(spark):
    rows, marks = generated()
    found = toxicity.classify(documents(spark, rows + TEXTS), labels(spark, marks)).collect()
    assert len(found) == len(rows) + len(TEXTS)
    truth, first = dict(marks), dict(rows)
    out = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id > 20 and r.doc_id in first]
    assert len(out) > 40
    assert all(r.predicted == truth[r.doc_id] == (r.score >= 0.5) for r in out)


@pytest.mark.parametrize("disguise", ["g.r.u.m.b.l.i.k", "g r u m b l i k", "grum-blik", "grummblik", "snarrfox", "vile*wort!!"])
def test_gapped_and_inserted_characters(machine, disguise):
    assert machine.scores([f"some plain words {disguise} and more of them"])[0] >= 0.5


def test_clean_texts_stay(machine):
    assert machine.scores(["grum rumble fox ort vile w", "", "nothing of the kind here"]).max() < 0.5


def test_kernel_against_enumerated_subsequences():
    words, marks = ["abcab", "xaybzc", "q", "zzzzzz"], ["abc", "zzz"]

    def description(word):
        codes = [0, *toxicity._codes([word], len(word))[0, 1:-1].tolist(), 63]
        out, square = {}, 0.0
        for places in itertools.combinations(range(len(codes)), 3):
            if places[2] - places[0] <= 4:
                weight = toxicity.DECAY ** (places[2] - places[0] - 2)
                key = tuple(codes[p] for p in places)
                out[key] = out.get(key, 0.0) + weight
                square += weight**2
        return {k: v / square**0.5 for k, v in out.items()}

    wanted = [
        [sum(v * description(m).get(k, 0.0) for k, v in description(w).items()) ** toxicity.DEGREE for m in marks]
        for w in words
    ]
    assert toxicity.Landmarks(marks).kernel(words) == pytest.approx(np.array(wanted), abs=1e-5)


def test_no_labels_and_empty_table(spark):
    docs = documents(spark)
    assert {r.score for r in toxicity.classify(docs, labels(spark, [])).collect()} == {0.5}
    assert toxicity.classify(docs.limit(0), labels(spark, [])).count() == 0


def test_filter_keeps_clean_rows_and_columns(spark):
    rows, marks = generated()
    docs = documents(spark, rows)
    kept = toxicity.keep_clean(docs, labels(spark, marks))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, t in marks if not t}


@pytest.mark.parametrize("disguise", ["grum blik", "snar fox", "vile wort", "v ilewort"])
def test_insults_split_by_one_space(machine, disguise):
    assert machine.scores([f"some plain words {disguise} and more of them"])[0] >= 0.5


def test_bound_is_not_below_the_margin(machine):
    draw = random.Random(6)
    letters = "abgiklmrufnosxvwet"
    first, second = (["".join(draw.choices(letters, k=draw.randint(1, 8))) for _ in range(3000)] for _ in "ab")
    first += [word[:at] for word in BAD for at in range(1, len(word))]
    second += [word[at:] for word in BAD for at in range(1, len(word))]
    found = machine.landmarks.kernel([a + b for a, b in zip(first, second)]) @ machine.weights
    bound = toxicity.PairBound(machine.landmarks, machine.weights)
    alone, own, before, _, _ = bound.parts(first)
    _, _, _, other, after = bound.parts(second)
    assert (alone >= machine.landmarks.kernel(first) @ machine.weights - 1e-4).all()
    lengths = np.array([len(a) + len(b) for a, b in zip(first, second)])
    upper = bound.of(own + other, np.concatenate([before, after], axis=1), lengths)
    assert (upper >= found - 1e-4).all()
    assert (upper < 0.5).mean() > 0.5


def test_cached_words_and_pairs_change_no_score(machine):
    rows, _ = generated(60, seed=9)
    texts = [t for _, t in rows] + ["", "a grumb lik b", "g r u m b l i k", "x", "snarfox " * 500]
    whole = machine.scores(texts)
    again = machine.scores(texts)
    alone = []
    for text in texts:
        machine._words = None
        alone.append(machine.scores([text])[0])
    assert whole == pytest.approx(again, abs=1e-9)
    assert whole == pytest.approx(np.array(alone), abs=1e-5)
