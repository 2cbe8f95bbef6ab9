from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from runsieve.llm import unigram

from .samples import TEXTS, documents


@pytest.fixture(scope="module")
def content():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def vocabulary(content):
    return unigram.Vocabulary(content)


@pytest.fixture(scope="module")
def library(content, vocabulary):
    """The library's own unigram search over the same pieces and scores."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(content)
    proto.trainer_spec.model_type = 1
    for at, piece in enumerate(proto.pieces):
        if piece.type == 1:
            piece.score = float(vocabulary.scores[at])
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def total(vocabulary, ids):
    score, at = 0.0, 0
    while at < len(ids):
        if vocabulary.is_byte[ids[at]]:
            lead = vocabulary.bytes_of[ids[at]][0]
            at += 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            score += vocabulary.unknown
        else:
            score += vocabulary.scores[ids[at]]
            at += 1
    return score


def test_paths_score_as_the_library_s(vocabulary, library):
    texts = [t or "" for _, t in TEXTS] + ["a  b", "\n\nq", " lead", "▁ marker ▁▁x"]
    for text, ids in zip(texts, unigram.Encoder(vocabulary).encode(texts)):
        wanted = library.encode(text)
        assert total(vocabulary, ids.tolist()) == pytest.approx(total(vocabulary, wanted), rel=1e-6)
        assert library.decode(ids.tolist()) == library.decode(wanted)


def test_trie_finds_all_pieces_and_nothing_else(vocabulary):
    pieces = [(b"a", 0), (b"ab", 1), (b"abc", 2), (b"\xe2\x96\x81b", 3), (b"zz", 4)]
    base, check, value = unigram.double_array(pieces)

    def find(text):
        node = 0
        for byte in text:
            after = base[node] + byte + 1
            if check[after] != node:
                return None
            node = after
        return value[node] if value[node] >= 0 else None

    assert [find(text) for text, _ in pieces] == [number for _, number in pieces]
    assert find(b"z") is None and find(b"abcd") is None and find(b"b") is None


def test_round_trip_in_spark(spark):
    rows = unigram.encode(documents(spark))
    found = {(r.doc_id, r.n_pieces): r for r in rows.collect()}
    assert rows.count() == len(TEXTS)
    texts = {r.text for r in unigram.decode(rows).collect()}
    assert texts == {t or "" for _, t in TEXTS}
    assert all(r.round_trip for r in found.values())
    assert unigram.encode(documents(spark, []).limit(0)).count() == 0


def test_bytes_are_counted(spark):
    row = unigram.encode(documents(spark, [(1, "a\nb")])).first()
    assert row.n_bytes == 1 and row.n_pieces == len(row.ids) == 3
    assert np.array(row.ids).min() >= 0
