"""Tokens of mixed Chinese and ASCII text, and pinyin syllables of typed queries."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode White_Space, spelled out as Java's \s is ASCII only (fixed values).
WHITE_SPACE = "\\x{9}-\\x{D}\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _UPPER.lower())


def split_tokens(c: Column) -> Column:
    """ASCII alphanumeric runs and single other characters, in order; null for null."""
    return F.regexp_extract_all(c, F.lit("(?s)([0-9A-Za-z]+|.)"), 1)


def word_tokens(c: Column) -> Column:
    """As split_tokens, without white space."""
    return F.regexp_extract_all(c, F.lit(f"([0-9A-Za-z]+|[^0-9A-Za-z{WHITE_SPACE}])"), 1)


def is_ascii_word(c: Column) -> Column:
    return c.rlike("^[0-9A-Za-z]+$")


def is_han_token(c: Column) -> Column:
    """One character that is neither white space nor ASCII alphanumeric."""
    return c.rlike(f"^[^0-9A-Za-z{WHITE_SPACE}]$")


def is_han_phrase(c: Column) -> Column:
    return c.rlike(f"^[^0-9A-Za-z{WHITE_SPACE}]+$")


def trim_white_space(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+$", "")


def syllable_pattern(syllables, include_zhchsh: bool) -> str:
    """One group of alternatives, longest first as Java takes the first that fits, then single letters."""
    tokens = {*syllables, *(("zh", "ch", "sh") if include_zhchsh else ())}
    return "(" + "|".join([*map(re.escape, sorted(tokens, key=lambda t: (-len(t), t))), "[a-z]"]) + ")"


def _tree(tails: set[str]) -> str:
    """A pattern of the longest of ``tails``, which share no more than they must: each letter is looked at once."""
    heads: dict[str, set[str]] = {}
    for t in tails:
        if t:
            heads.setdefault(t[0], set()).add(t[1:])
    parts = [re.escape(c) + (_tree(rest) if rest != {""} else "") for c, rest in sorted(heads.items())]
    return ("(?:" + "|".join(parts) + ")" if len(parts) > 1 or "" in tails else parts[0]) + ("?" if "" in tails else "")


def syllable_tree(syllables, include_zhchsh: bool) -> str:
    """What syllable_pattern() matches, as a tree of letters."""
    tokens = {*syllables, *(("zh", "ch", "sh") if include_zhchsh else ())} - {""}
    return f"({_tree(tokens)}|[a-z])"


def once(c: Column, use) -> Column:
    """``use(c)`` with ``c`` evaluated once a row, however often it is used."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def pinyin_tokenize(c: Column, syllables, include_zhchsh: bool = False) -> Column:
    """Greedy longest syllables of the lower-cased text, else single letters; empty without syllables."""
    if not syllables:
        return F.when(c.isNotNull(), F.array().cast("array<string>"))
    return F.regexp_extract_all(F.lower(c), F.lit(syllable_tree(syllables, include_zhchsh)), 1)
