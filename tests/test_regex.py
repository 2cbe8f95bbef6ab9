from __future__ import annotations

import re

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runsieve.functions import regex
from runsieve.functions import vocabulary as v

PATTERNS = {
    "case": v.CASE_TERMS,
    "control": v.CONTROL_TERMS,
    "strain": v.STRAIN_TERMS,
    "small_rna": v.SMALL_RNA_TERMS,
    "single_cell": v.SINGLE_CELL_TERMS,
    "depletion": v.DEPLETION_TERMS,
    "polya": v.POLYA_TERMS,
    "long_read": v.LONG_READ_TERMS,
    **dict(v.TISSUE_CLASSES),
    "negation": rf"non[-_ ]?({v.NEGATED_TERMS})\b",
    "tissue_key": rf"^[^=]*({v.TISSUE_KEYS})[^=]*=",
    "spaces": r"a\sb|c[\s]d",
    "end": r"ab$",
    "any": r"x.y",
    "repeated": r"\bo+h\b|\ba?b",
}

# Pieces that make the patterns match, miss narrowly, or meet odd neighbours.
PIECES = sorted(
    {
        piece
        for pattern in PATTERNS.values()
        for piece in re.findall(r"[a-z0-9]{2,}", pattern)
    }
) + [" ", "-", "_", "/", "=", "|", "\n", "\r", "\x0b", "\t", "é", "ß", "1", "s", "non", "y"]


def agree(spark, texts: list[str]) -> None:
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    found = frame.select(
        "i",
        *(regex.matches("t", p).alias(f"m_{n}") for n, p in PATTERNS.items()),
        *(regex.first_term("t", p).alias(f"f_{n}") for n, p in PATTERNS.items()),
        *(regex.replace_all(F.col("t"), p, " $1 ").alias(f"r_{n}") for n, p in PATTERNS.items()),
    ).orderBy("i")
    connection = duckdb.connect()
    connection.execute("CREATE TABLE texts (i BIGINT, t VARCHAR)")
    connection.executemany("INSERT INTO texts VALUES (?, ?)", list(enumerate(texts)))

    def sql(form: str) -> str:
        quoted = (p.replace("'", "''") for p in PATTERNS.values())
        return ", ".join(form.format(p=p) for p in quoted)

    expected = connection.execute(
        f"""SELECT i, {sql("regexp_matches(t, '{p}')")},
        {sql("nullif(regexp_extract(t, '{p}'), '')")},
        {sql("regexp_replace(t, '{p}', ' $1 ', 'g')")} FROM texts ORDER BY i"""
    ).fetchall()
    assert [tuple(r) for r in found.collect()] == expected


@settings(
    max_examples=8,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(
    st.lists(
        st.lists(st.sampled_from(PIECES), max_size=6).map("".join),
        min_size=150,
        max_size=300,
    )
)
def test_java_patterns_agree_with_re2(spark, texts):
    agree(spark, texts)


def test_known_texts(spark):
    agree(
        spark,
        [
            "éwt", "wt", "wt3.r1", "s11_control", "a control b", "nebnext\rpoly",
            "nebnext\npoly", "ba\x0b9", "ba 9", "ab\n", "ab", "x\ry", "x\ny", "",
            "non-alzheimer's", "nonad", "nonads", "a\x0bb", "ooh", "oh", "ooho", "bb",
            "evs", "ev", "eve", "xev", "brainid=frontal-12", "tissue=a=b", "=tissue=",
        ],
    )


@pytest.mark.parametrize("pattern", PATTERNS.values(), ids=PATTERNS)
def test_required_literals_cover_matches(pattern):
    literals = regex.required_literals(pattern)
    for piece in PIECES:
        for text in (piece, f"{piece} {piece}", f"a{piece}1"):
            if re.search(pattern, text) and literals:
                assert any(literal in text for literal in literals)


def test_no_literals_where_none_is_certain():
    assert regex.required_literals(r"abc|[xy]z?") == ()
    assert regex.required_literals(r"(?i)abc") == ()
    assert regex.required_literals(r"abc?") == ("ab",)
    assert regex.required_literals(r"ab{0,2}cd") == ("cd",)
    assert regex.required_literals(r"foo(?:bar|baz)?|it's here") == ("foo", "s here")


def test_null_text(spark):
    row = spark.sql("SELECT CAST(NULL AS STRING) AS t").select(
        regex.matches("t", v.CASE_TERMS), regex.first_term("t", v.CASE_TERMS)
    )
    assert tuple(row.first()) == (None, None)


@pytest.mark.parametrize("pattern", [r"[[:alpha:]]x", r"[^\S]", r"[a&&b]"])
def test_classes_that_java_reads_otherwise_are_refused(pattern):
    with pytest.raises(ValueError, match="no equal in Java"):
        regex.java_regex(pattern)


def test_negated_boundary_and_space(spark):
    frame = spark.createDataFrame([("éa b",), ("a\x0bb",), ("ab",)], "t string")
    rows = frame.select(regex.matches("t", r"\Bb").alias("inner"), regex.matches("t", r"^\S+$").alias("solid")).collect()
    assert [tuple(r) for r in rows] == [(False, False), (False, True), (True, True)]
