"""The pipeline against plain decisions on planted documents; no code is shared with the stages."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

from .samples import SCHEMA
from .test_simhash import plain_components, plain_fingerprint

BAD = ["grumblik", "snarfox", "vilewort"]


def planted(seed=8):
    """Texts with what was planted into each: clean, toxic, junk, a copy or a near copy."""
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdeghilnorstu", k=draw.randint(2, 8))) for _ in range(500)]
    rows = []
    for i in range(360):
        chosen = draw.choices(words, k=draw.randint(60, 400))
        kind = ("toxic", "junk", "clean", "clean")[i % 4]
        if kind == "toxic":
            for _ in range(3):
                chosen.insert(draw.randrange(len(chosen)), draw.choice(BAD))
        text = " ".join(chosen).capitalize() + "."
        if kind == "junk":
            text = "!! ".join(chosen[:10] * 8).upper()
        rows.append((len(rows), text, kind))
    for i in range(2, 40, 4):
        text = rows[i][1]
        rows += [(len(rows), text, "clean"), (len(rows) + 1, text[:-1] + "!", "clean")]
        rows.append((len(rows), f"{text} {draw.choice(words)}", "clean"))
    return rows


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("planted")
    rows = planted()
    docs = [(i, t, "clash", "clash", 1, 2, 3, 4, 5) for i, t, _ in rows]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(kind != "junk"), int(kind == "toxic")) for i, _, kind in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, corpus_pipeline.run(spark, str(folder)).collect()


def test_planted_documents_go_and_one_of_each_group_stays(result):
    rows, pieces = result
    clean = {i: plain_fingerprint(text) for i, text, kind in rows if kind == "clean"}
    root = plain_components(clean.values())
    wanted = {}
    for i, value in clean.items():
        wanted[root[value]] = min(i, wanted.get(root[value], i))
    assert len(wanted) < len(clean) - 20
    assert {row.doc_id for row in pieces} == set(wanted.values())


def test_pieces_are_the_tokens_of_what_stays(result):
    rows, pieces = result
    texts = {i: text for i, text, _ in rows}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    spans, sequences = {}, {}
    for row in pieces:
        spans.setdefault(row.doc_id, []).append((row.start, row.length, row.doc_tokens))
        sequences.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for doc, parts in spans.items():
        count = len(tokenizer.encode(texts[doc], add_special_tokens=False).ids) + 1
        at = 0
        for start, length, total in sorted(parts):
            assert start == at and total == count
            at += length
        assert at == count
    for parts in sequences.values():
        ends = np.cumsum([length for _, length in sorted(parts)]).tolist()
        assert [offset for offset, _ in sorted(parts)] == [0, *ends[:-1]]
        assert ends[-1] == 2048 or ends[-1] < 2048 and ends[-1] & (ends[-1] - 1) == 0


def test_odd_rows_pass_through_every_stage(spark, tmp_path):
    """Nulls, empty texts, repeated rows and clashing columns; then empty tables."""
    from .samples import TEXTS, documents

    documents(spark).write.parquet(f"{tmp_path}/some/documents.parquet")
    documents(spark).limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("some", "none"):
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    # Without labels every score is 0.5, which toxicity rejects and quality keeps.
    assert corpus_pipeline.run(spark, f"{tmp_path}/some").count() == 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(spark), "")
    packed = corpus_pipeline.pack(spark, kept, "").collect()
    prints = {plain_fingerprint(text) for _, text in TEXTS}
    assert len({row.doc_id for row in packed}) == len(set(plain_components(prints).values()))
