"""Pattern matching with RE2 meaning on Spark's Java regex functions.

Vocabularies are written in RE2 syntax. Java differs in a few points: ``\\b``
counts letters of every script as word characters, ``\\s`` includes the
vertical tab, ``.`` stops at more line ends and ``$`` also matches before a
final line end. :func:`java_regex` rewrites those, so that a pattern picks the
same text in both dialects, and raises for the few that it cannot render.

Trying dozens of alternatives at every position of a text is what the screens
spend their time on. So a pattern of several alternatives is tried only where the
next characters are among those that some alternative begins with
(:func:`first_characters`), a look-ahead of a few table look-ups. Where that tells
nothing, a match is attempted only on texts that contain one of the
:func:`required_literals` of the pattern, a plain byte search.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\{[^}]*\}|.", re.DOTALL)
_WORD = re.compile(r"[A-Za-z0-9_]")
_PLAIN = re.compile(r"[A-Za-z0-9_ /:;,=@#&<>-]")
_NOT_WORD_BEHIND = "(?<![A-Za-z0-9_]{})"
_WORD_END = "(?![A-Za-z0-9_])"
_ANY_BOUNDARY = (
    "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
)
_RE2_SPACES = r"\t\n\f\r "
_MIN_LITERAL = 2
#: What a character class may not hold, as Java reads it in another way.
_NOT_IN_CLASS = ("[:", r"\S", "&&")


#: Characters looked at ahead of an alternation, and from how many alternatives on.
_AHEAD, _SEVERAL = 3, 3


def _optional(token: str) -> bool:
    return token[:1] in ("?", "*", "{")


@lru_cache(maxsize=None)
def java_regex(pattern: str) -> str:
    """The Java pattern that matches what ``pattern`` matches under RE2."""
    tokens = ["", *_TOKEN.findall(pattern), "", ""]
    out = ["(?d)"]
    i = 1
    while i < len(tokens) - 2:
        token, after = tokens[i], tokens[i + 1]
        if token == r"\b":
            # One look-around is enough where a plain word character stands on
            # one side. At a word start it comes after that character, so that
            # it is tried at few positions only.
            if _WORD.fullmatch(after) and not _optional(tokens[i + 2]):
                out.append(after + _NOT_WORD_BEHIND.format(after))
                i += 1
                if tokens[i + 1] == "+":
                    out.append(f"{after}*")
                    i += 1
            elif _WORD.fullmatch(tokens[i - 1]):
                out.append(_WORD_END)
            else:
                out.append(_ANY_BOUNDARY)
        elif token == r"\s":
            out.append(f"[{_RE2_SPACES}]")
        elif token == r"\S":
            out.append(f"[^{_RE2_SPACES}]")
        elif token == r"\B":
            out.append(f"(?!{_ANY_BOUNDARY})")
        elif token == "$":
            out.append(r"\z")
        elif token.startswith("[") and len(token) > 1:
            unknown = next((part for part in _NOT_IN_CLASS if part in token[1:]), None)
            if unknown:
                raise ValueError(f"{unknown} inside {token} has no equal in Java patterns")
            out.append(token.replace(r"\s", _RE2_SPACES))
        else:
            out.append(token)
        i += 1
    ahead = first_characters(pattern)
    if not ahead:
        return "".join(out)
    classes = "".join(f"[{''.join(map(_in_class, sorted(chars)))}]" for chars in ahead)
    return f"{out[0]}(?={classes})(?:{''.join(out[1:])})"


def _in_class(char: str) -> str:
    return "\\" + char if char in "\\[]^-&" else char


def _members(token: str) -> set[str] | None:
    """The characters a token can be; None if that is not a small set."""
    if _PLAIN.fullmatch(token):
        return {token}
    if len(token) == 2 and token[0] == "\\":
        if token[1] == "s":
            return set("\t\n\f\r ")
        return None if token[1].isalnum() else {token[1]}
    if token.startswith("[") and len(token) > 2 and token[1] != "^":
        inner = token[1:-1]
        if re.search(r"\\[^s\W]|\[|&&", inner):
            return None
        out = set("\t\n\f\r ") if r"\s" in inner else set()
        inner = inner.replace(r"\s", "").replace("\\", "")
        for first, last in re.findall(r"(.)-(.)", inner):
            out |= {chr(code) for code in range(ord(first), ord(last) + 1)}
        return out | set(inner)
    return None


def _beginnings(tokens: list[str]) -> list[set[str]]:
    """Per place the characters that matches of an alternative can have there.

    As many places as every match has for certain, up to ``_AHEAD``.
    """
    places: list[set[str]] = [set() for _ in range(_AHEAD)]
    ends, known, i = {0}, _AHEAD, 0
    while i < len(tokens) and min(ends) < known:
        token, after = tokens[i], tokens[i + 1] if i + 1 < len(tokens) else ""
        i += 1
        if token == r"\b":
            continue
        chars = _members(token)
        if chars is None or after[:1] in ("*", "+", "{"):
            known = min(known, *ends)
            break
        for end in ends:
            if end < _AHEAD:
                places[end] |= chars
        ends = {end + 1 for end in ends} | (ends if after[:1] == "?" else set())
        i += after[:1] == "?"
    return places[: min(known, *ends)]


@lru_cache(maxsize=None)
def first_characters(pattern: str) -> tuple[frozenset[str], ...]:
    """The characters that every match begins with, place by place.

    Empty if the pattern has few alternatives, sets flags, or if some match
    begins with fewer than two known characters.
    """
    alternatives = _alternatives(pattern)
    if len(alternatives) < _SEVERAL or re.search(r"\(\?[^:]", pattern):
        return ()
    known = [_beginnings(tokens) for tokens in alternatives]
    width = min(map(len, known))
    if width < 2:
        return ()
    return tuple(frozenset().union(*(places[at] for places in known)) for at in range(width))


def _alternatives(pattern: str) -> list[list[str]]:
    """Tokens of each top-level alternative; a group becomes an empty token."""
    found: list[list[str]] = [[]]
    depth = 0
    for token in _TOKEN.findall(pattern):
        if token == ")":
            depth -= 1
            token = ""
        elif token == "(":
            depth += 1
        if depth == 0 and token == "|":
            found.append([])
        elif depth == 0:
            found[-1].append(token)
    return found


def _longest_literal(tokens: list[str]) -> str:
    runs, run = [], ""
    for token, after in zip(tokens, [*tokens[1:], ""]):
        if _PLAIN.fullmatch(token) and not _optional(after):
            run += token
        else:
            runs.append(run)
            run = ""
    return max([*runs, run], key=len)


@lru_cache(maxsize=None)
def required_literals(pattern: str) -> tuple[str, ...]:
    """Texts one of which occurs wherever ``pattern`` matches.

    Empty if some alternative has no plain part of two characters or more, or
    if the pattern sets flags: then every text has to be matched.
    """
    if re.search(r"\(\?[^:]", pattern):
        return ()
    literals = [_longest_literal(tokens) for tokens in _alternatives(pattern)]
    if min(map(len, literals)) < _MIN_LITERAL:
        return ()
    return tuple(
        sorted(a for a in set(literals) if not any(b in a and b != a for b in literals))
    )


def _may_match(column: str, pattern: str) -> Column | None:
    # Looping over the literals keeps the generated code small. A chain of OR
    # grows past the size that the JVM compiles, and then runs interpreted.
    literals = () if first_characters(pattern) else required_literals(pattern)
    if not literals:
        return None
    texts = ", ".join(f"'{text}'" for text in literals)
    return F.expr(f"exists(array({texts}), text -> contains(`{column}`, text))")


def matches(column: str, pattern: str) -> Column:
    """Whether ``pattern`` occurs anywhere in a text column (NULL for NULL)."""
    matched = F.col(column).rlike(java_regex(pattern))
    candidate = _may_match(column, pattern)
    return matched if candidate is None else candidate & matched


def found_term(column: str, pattern: str) -> Column:
    """Leftmost occurrence of ``pattern`` in a text column; NULL or ``''`` if none.

    For patterns that cannot match the empty string it is a text of some length
    exactly where ``matches`` holds, so one pass over the text yields both the
    term and the flag.
    """
    term = F.regexp_extract(column, java_regex(pattern), 0)
    candidate = _may_match(column, pattern)
    return term if candidate is None else F.when(candidate, term)


def first_term(column: str, pattern: str) -> Column:
    """Like :func:`found_term`, with NULL wherever there is none.

    The optimizer projects the found term first, to use it twice.
    """
    return F.nullif(found_term(column, pattern), F.lit(""))


def replace_all(text: Column, pattern: str, replacement: str) -> Column:
    """``text`` with every occurrence of ``pattern`` replaced literally."""
    literal = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, java_regex(pattern), literal)
