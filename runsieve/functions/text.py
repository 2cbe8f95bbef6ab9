"""Text built from the nested attributes of a run.

The attributes stay an array of ``{k, v}``: keys may repeat, and the first
match counts. All text is made row by row with higher-order functions, so
nothing is exploded or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runsieve.functions.regex import java_regex, replace_all
from runsieve.functions.vocabulary import DEFAULT, Vocabulary

SEPARATOR = " | "
_SEPARATOR_REGEX = r" [|] "


def _pair(attribute: Column) -> Column:
    # NULL in either part makes the pair NULL, and array_join leaves it out.
    return F.concat(attribute["k"], F.lit("="), attribute["v"])


def _joined(attributes: Column) -> Column:
    text = F.array_join(F.transform(attributes, _pair), SEPARATOR)
    return F.coalesce(F.lower(text), F.lit(""))


def lower_or_empty(value: Column) -> Column:
    return F.lower(F.coalesce(value, F.lit("")))


def attribute_text(attributes: Column) -> Column:
    """All ``k=v`` pairs ordered by key, lower-cased; ``''`` when none.

    Pairs of equal key are ordered by value, to make the text reproducible.
    """
    return _joined(F.sort_array(attributes))


def scoped_text(attributes: Column, key_pattern: str) -> Column:
    """The pairs whose lower-cased key matches ``key_pattern``, in array order."""
    key = java_regex(key_pattern)
    kept = F.filter(attributes, lambda a: F.lower(a["k"]).rlike(key))
    return _joined(kept)


def blank_phrase(text: Column, vocabulary: Vocabulary = DEFAULT) -> Column:
    """Blank out the phrase that would look like a disease abbreviation."""
    return replace_all(text, vocabulary.blanked_phrase, " ")


def rewrite_negation(text: Column, vocabulary: Vocabulary = DEFAULT) -> Column:
    """Turn negated disease words into one token that counts as a control."""
    pattern = rf"non[-_ ]?({vocabulary.negated_terms})\b"
    return replace_all(text, pattern, vocabulary.negation_token)


def label_text(attributes: Column, vocabulary: Vocabulary = DEFAULT) -> Column:
    """Normalised text of the label-like keys, used for case/control matching."""
    scoped = scoped_text(attributes, vocabulary.label_keys)
    return rewrite_negation(blank_phrase(scoped, vocabulary), vocabulary)


def fragments(blob: Column) -> Column:
    """The ``k=v`` fragments of a text blob."""
    return F.split(blob, _SEPARATOR_REGEX)


def tissue_text(attr_blob: Column, vocabulary: Vocabulary = DEFAULT) -> Column:
    """Sorted fragments of ``attr_blob`` whose key part names a tissue.

    Restricting the keys keeps a serum in a culture medium from passing for a
    serum sample.
    """
    key = java_regex(vocabulary.tissue_keys)
    kept = F.filter(
        fragments(attr_blob),
        lambda kv: kv.contains("=") & F.substring_index(kv, "=", 1).rlike(key),
    )
    return F.array_join(F.sort_array(kept), SEPARATOR)
