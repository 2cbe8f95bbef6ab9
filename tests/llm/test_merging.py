from __future__ import annotations

import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from runsieve.llm import merging

from .samples import TEXTS, documents

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "<|endoftext|>", "a<|endoftext|>b <|startoftext|><|startoftext|> c", "<|endoftext", "<|ENDOFTEXT|>",
    "ΑΣ ΣΑΣ. İstanbul ǅ ẞ", "é ́x à̖", "  a\xa0b　c\x85d​z", "a\x1cb \x1f c\x1d",
    "don't WE'LL 'S it's''t 've", "1234567 １２ ²³ ¼ x1y2", "日本語のテキスト 한국어 ภาษาไทย", "😀👩‍👩‍👧 ❤️", "\x00\x07 \x7f",
    "un" * 3000, "日本" * 2000, "!" * 2000 + "?" * 777, "q" * 5001 + " tail", "ﬁ ﷺ Å K",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return merging.TokenCounter(merging.rules_of(PATH))


def wanted(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_odd_texts_against_the_library(library, counter):
    texts = ODD + [t or "" for _, t in TEXTS]
    assert counter.counts(texts) == [wanted(library, t) for t in texts]
    assert counter.counts(texts) == [wanted(library, t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abeinorst' \n.<|>", max_size=80))
def test_any_text_against_the_library(library, counter, text):
    assert counter.counts([text]) == [wanted(library, text)]


def test_merges_are_those_of_repeated_scans(counter):
    """Against merging by scanning for the lowest rank, without a heap."""
    draw, merges = random.Random(2), counter._merges
    for _ in range(300):
        word = "".join(draw.choices("aeinorstlu", k=draw.randint(1, 14)))
        symbols = [counter._symbols[c] for c in word[:-1]] + [counter._symbols[word[-1] + "</w>"]]
        plain = list(symbols)
        while True:
            pairs = [(merges.rank.get(a * merges.base + b), i) for i, (a, b) in enumerate(zip(plain, plain[1:]))]
            pairs = [(rank, i) for rank, i in pairs if rank is not None]
            if not pairs:
                break
            rank, at = min(pairs)
            plain[at : at + 2] = [merges.symbol[rank]]
        assert len(symbols) - merges.made(list(symbols)) == len(plain)


def test_documents_with_odd_rows(spark, library):
    rows = TEXTS + [(20 + i, t) for i, t in enumerate(ODD)]
    found = merging.count_tokens(documents(spark, rows), limit=100)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    expected = sorted(
        ((i, len((t or "").encode()), wanted(library, t), wanted(library, t) > 100) for i, t in rows), key=repr
    )
    assert sorted(map(tuple, found.collect()), key=repr) == expected
    assert any(row[3] for row in expected)


def test_caches_are_forgotten_without_a_trace(library, monkeypatch):
    monkeypatch.setattr(merging, "CACHE_RUNS", 3)
    counter = merging.TokenCounter(merging.rules_of(PATH))
    texts = [f"word{i % 7} and more{i} things" for i in range(40)]
    found = [counter.counts([t])[0] for t in texts]
    assert found == [wanted(library, t) for t in texts]


def test_empty_table_and_other_files(spark):
    assert merging.count_tokens(documents(spark, []).limit(0)).count() == 0
    with pytest.raises(ValueError):
        merging.TokenCounter(merging.rules_of(public_tokenizers.path("byte_bpe_50k.json")))
