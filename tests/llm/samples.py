"""Small documents with every odd case, and extra columns whose names clash."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, key string, t string, k long, bits long, row long, n int, label int"

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today"),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today"),
    (3, "The quick brown fox jumps over the lazy cat near the old river bank today"),
    (4, ""),
    (5, None),
    (6, "   \t\n "),
    (7, "word"),
    (8, "two words"),
    (9, "é è ü ß 日本語 😀 mixed\r\nline\x0bbreaks  and   spaces "),
    (10, "x" * 3000),
    (11, " ".join(f"w{i % 97}" for i in range(6000))),
    (None, "a row without a key"),
    (12, "THE QUICK brown fox jumps over the lazy dog near the old river bank today"),
    (7, "word"),
    (-3, "negative keys are keys too, and this is a sentence. So is this!"),
]


def documents(spark, rows=TEXTS):
    return spark.createDataFrame(
        [(i, t, "clash", "clash", 1, 2, 3, 4, 5) for i, t in rows], SCHEMA
    )
