from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from runsieve.llm import winnow

from .samples import TEXTS, documents

KEYED = list({(i, t or "") for i, t in TEXTS})


def plain_order():
    keys = {i: -(1 << 63) if i is None else i for i, _ in KEYED}
    return sorted(KEYED, key=lambda row: -keys[row[0]])


def test_edits_and_likeness(spark):
    rows = plain_order()
    wanted = {}
    for at, (key, text) in enumerate(rows):
        after = rows[(at + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        wanted[key] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), edited == text, after == text)
    found = winnow.compare_edited(documents(spark)).collect()
    assert len(found) == len(TEXTS)
    for row in found:
        n, digest, same, same_next = wanted[row.doc_id]
        assert (row.n_chars, row.edited_sha256) == (n, digest)
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
        if same:
            assert row.near_edited == 1 and row.fingerprint == row.edited_fingerprint
        if same_next:
            assert row.near_next == 1
    by_text = {}
    for row in found:
        by_text.setdefault(dict(KEYED)[row.doc_id], set()).add(row.fingerprint)
    assert all(len(prints) == 1 for prints in by_text.values())
    assert len({next(iter(p)) for p in by_text.values()}) >= len(by_text) - 1  # blank and empty agree


def plain_choices(hashes, w):
    chosen = []
    for at in range(max(1, len(hashes) - w + 1) if hashes else 0):
        window = hashes[at : at + w]
        least = min(window)
        place = at + max(i for i, h in enumerate(window) if h == least)
        if (least, place) not in chosen:
            chosen.append((least, place))
    return chosen


def test_choices_against_plain_windows(spark):
    docs = documents(spark)
    for k, w in ((3, 8), (1, 1), (2, 5), (4, 4)):
        tokens = docs.select("doc_id", F.expr(r"regexp_extract_all(coalesce(text, ''), '[^\\s]{1,8}', 0)").alias("x"))
        hashed = tokens.select("doc_id", "x", F.transform("x", lambda x: F.hash(x)).alias("h"))
        found = {r.doc_id: r for r in winnow.fingerprints(docs, k=k, w=w).collect()}
        if k == 1:
            for row in hashed.collect():
                wanted = plain_choices(row.h, w)
                assert list(zip(found[row.doc_id].hashes, found[row.doc_id].positions)) == wanted
        else:
            grams = winnow.fingerprints(docs, k=k, w=1)
            for row in grams.collect():
                assert row.positions == list(range(len(row.hashes)))
                wanted = plain_choices(row.hashes, w)
                assert list(zip(found[row.doc_id].hashes, found[row.doc_id].positions)) == wanted


def test_a_shared_passage_gives_a_shared_choice(spark):
    passage = " ".join(f"common{i}" for i in range(winnow.K + winnow.WINDOW - 1))
    docs = documents(spark, [(1, f"alpha beta {passage} gamma"), (2, f"other words here {passage} end of it")])
    one, two = (set(r.hashes) for r in winnow.fingerprints(docs).collect())
    assert one & two


def test_six_shared_tokens_give_a_shared_choice(spark):
    rows = []
    for i in range(30):
        passage = " ".join(f"p{i}x{j}" for j in range(6))
        rows += [(2 * i, f"alpha{i} beta{i} {passage} gamma{i}"), (2 * i + 1, f"other{i} words{i} here{i} {passage} end{i}")]
    found = {r.doc_id: set(r.hashes) for r in winnow.fingerprints(documents(spark, rows)).collect()}
    assert all(found[2 * i] & found[2 * i + 1] for i in range(30))


def test_a_passage_without_spaces_is_found_at_any_offset(spark):
    draw = random.Random(9)
    alphabets = ["".join(map(chr, range(0x4E00, 0x5200))), "acgt", "ABCDEFGHabcdefgh0123456789+/"]
    passages = ["".join(draw.choices(letters, k=600)) for letters in alphabets] + ["ab" * 300, "\u3000word\u00a0" * 100]
    rows = []
    for i, passage in enumerate(passages):
        rows += [(10 * i + n, "#" * n + passage) for n in range(1, 9)]
    found = {r.doc_id: set(r.hashes) for r in winnow.fingerprints(documents(spark, rows)).collect()}
    for i in range(len(passages)):
        for n in range(2, 9):
            one, two = found[10 * i + 1], found[10 * i + n]
            assert len(one & two) >= 0.8 * len(one | two) - 4
            assert one & two


def test_empty_and_single(spark):
    assert winnow.compare_edited(documents(spark, []).limit(0)).count() == 0
    row = winnow.compare_edited(documents(spark, [(4, "alone in the table")])).first()
    assert row.edited_sha256 == hashlib.sha256(b"alone in " + b"alone in ").hexdigest()
