"""SQL names for the functions, for the session.

Romanizers are registered as the operators' Arrow functions, so their plans hold no dictionary; the others are
temporary SQL functions whose bodies stay open to the optimiser. SQL has no overloading by type, so token arrays
have a name of their own, and each registration binds one dictionary (base or overlay). Register again
after a dictionary edit.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..dictionary import Registry
from . import text as tx

#: SQL names of romanizers, and the operators' names.
ROMANIZERS = {
    "romanize2text": "romanize2text", "romanize2array": "romanize2array", "characters2romanize": "characters2romanize",
    "icu_romanize_tokens": "romanize_tokens_all", "pinyin_char_romanize": "char_romanize", "pinyin_word_romanize": "word_romanize",
    "pinyin_word_romanize_tokens": "word_romanize_tokens",
}


def quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession, registry: Registry, suffix: str | None = None, prefix: str = "") -> list[str]:
    """Registers the functions under their names, after ``prefix``, and returns the names."""
    from ..operators.romanize import FUNCTIONS

    d = registry.dictionary(suffix)
    for name, operator in ROMANIZERS.items():
        spark.udf.register(f"{prefix}{name}", FUNCTIONS[operator](d))
    split = quoted("(?s)([0-9A-Za-z]+|.)")
    syllables = lambda z: quoted(tx.syllable_tree(d.syllables, z))
    initials = ", ".join(quoted(t) for t, k in sorted(d.tokens.items()) if k == 2)
    found = lambda c, z: f"CASE WHEN {z} THEN regexp_extract_all(lower({c}), {syllables(True)}, 1) ELSE regexp_extract_all(lower({c}), {syllables(False)}, 1) END"
    run, closed, opened = quoted(r"([\p{IsAlphabetic}\p{Nd}_]+)"), quoted(r"\\S*\\\|$1\\\|\\S*"), quoted(r"\\S*\\\|$1[^\\\|]*\\\|\\S*")
    parts = found("input", "include_zhchsh")
    each = f"transform({parts}, t -> concat({quoted(chr(92) + 'S*' + chr(92) + '|')}, t, CASE WHEN array_contains(CAST(array({initials}) AS ARRAY<STRING>), t) THEN {quoted('[^' + chr(92) + '|]*')} ELSE '' END, {quoted(chr(92) + '|' + chr(92) + 'S*')}))"
    letters = quoted(r"\A[A-Za-z \t\n\x0B\f\r]+\z")
    made = {
        "pinyin_split_tokens": ("input STRING", "ARRAY<STRING>", f"regexp_extract_all(input, {split}, 1)"),
        "pinyin_tokenize": ("input STRING, include_zhchsh BOOLEAN DEFAULT false", "ARRAY<STRING>", parts),
        "pinyin_search": ("input STRING, is_full BOOLEAN DEFAULT false, anchored BOOLEAN DEFAULT false", "STRING", f"concat(CASE WHEN anchored THEN '^' ELSE '' END, CASE WHEN is_full THEN regexp_replace(input, {run}, {closed}) ELSE regexp_replace(input, {run}, {opened}) END)"),
        "pinyin_isearch": ("input STRING, anchored BOOLEAN DEFAULT false, include_zhchsh BOOLEAN DEFAULT false", "STRING", f"CASE WHEN size({parts}) > 0 THEN concat(CASE WHEN anchored THEN '^' ELSE '' END, array_join({each}, ' ')) END"),
        "pinyin_regex_phrase_patterns": ("input STRING, generated_pinyin BOOLEAN DEFAULT false", "ARRAY<STRING>", f"CASE WHEN input IS NULL THEN NULL WHEN input RLIKE {letters} THEN transform({found('input', 'true')}, t -> concat(CASE WHEN generated_pinyin THEN {quoted('.*' + chr(92) + '|')} ELSE '' END, t, '.*')) ELSE CAST(array() AS ARRAY<STRING>) END"),
    }
    for name, (args, kind, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({args}) RETURNS {kind} RETURN {body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}pinyin_tokens_of(input STRING) RETURNS TABLE (token STRING, ord BIGINT) RETURN SELECT col, pos + 1 FROM posexplode(regexp_extract_all(input, {split}, 1)) AS t(pos, col)")
    return [*(f"{prefix}{n}" for n in (*ROMANIZERS, *made)), f"{prefix}pinyin_tokens_of"]
