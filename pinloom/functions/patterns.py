"""Search patterns and phrase queries from typed pinyin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once, pinyin_tokenize

QUERY_TYPE = "struct<kind:string,patterns:array<string>,slope:int,max_expansions:int>"


def pinyin_search(c: Column, is_full: bool = False, prefix: bool = False) -> Column:
    """Each run of letters, digits and _ becomes a pattern over piped readings; other characters stay."""
    tail = "" if is_full else r"[^\\\|]*"
    out = F.regexp_replace(c, r"([\p{IsAlphabetic}\p{Nd}_]+)", rf"\\S*\\\|$1{tail}\\\|\\S*")
    return F.concat(F.lit("^"), out) if prefix else out


def pinyin_isearch(c: Column, tokens: dict[str, int], prefix: bool = False, include_zhchsh: bool = False) -> Column:
    """Patterns of the query's syllables: initials are open, all else is closed; null without syllables.

    ``tokens`` has the category of each token: 1 syllable, 2 initial, 3 vowel.
    """
    found = pinyin_tokenize(c, [t for t, k in tokens.items() if k == 1], include_zhchsh)
    initials = F.array(*(F.lit(t) for t, k in sorted(tokens.items()) if k == 2)).cast("array<string>")
    one = lambda t: F.concat(F.lit(r"\S*\|"), t, F.when(F.array_contains(initials, t), r"[^\|]*").otherwise(""), F.lit(r"\|\S*"))
    head = F.lit("^" if prefix else "")
    return once(found, lambda ts: F.when(F.size(ts) > 0, F.concat(head, F.array_join(F.transform(ts, one), " "))))


def regex_phrase_patterns(c: Column, syllables, generated_pinyin: bool | None = False, strict: bool = False) -> Column:
    """One pattern for each syllable of a query of ASCII letters and blanks; empty for other text, null for null.

    With ``strict`` a null flag gives null and vertical tabs are no blanks; else null counts as false.
    """
    if strict and generated_pinyin is None:
        return F.lit(None).cast("array<string>")
    blank = r" \t\n\f\r" if strict else r" \t\n\x0B\f\r"
    head = r".*\|" if generated_pinyin else ""
    found = F.transform(pinyin_tokenize(c, syllables, True), lambda t: F.concat(F.lit(head), t, F.lit(".*")))
    return F.when(c.isNull(), F.lit(None)).when(c.rlike(rf"\A[A-Za-z{blank}]+\z"), found).otherwise(F.array().cast("array<string>"))


def phrase_token_count(c: Column, syllables) -> Column:
    """Number of syllables, null where there are none."""
    return once(F.size(regex_phrase_patterns(c, syllables, strict=True)), lambda n: F.nullif(n, F.lit(0)))


def token_count(syllables) -> int:
    """Number of tokens that typed queries are cut into."""
    return len({*syllables, "zh", "ch", "sh"})


def query_from_patterns(patterns: Column, slope: Column | None = None, max_expansions: Column | None = None) -> Column:
    """The query value: empty without patterns, regex for one, regex_phrase for more; null for null."""
    none = F.lit(None).cast("int")
    slope = none if slope is None else slope.cast("int")
    most = none if max_expansions is None else max_expansions.cast("int")

    def value(ps: Column) -> Column:
        many = F.size(ps) >= 2
        return F.when(
            ps.isNotNull(),
            F.struct(
                F.when(F.size(ps) == 0, "empty").when(F.size(ps) == 1, "regex").otherwise("regex_phrase").alias("kind"),
                ps.alias("patterns"),
                F.when(many & most.isNotNull(), F.coalesce(slope, F.lit(0))).when(many, slope).alias("slope"),
                F.when(many, most).alias("max_expansions"),
            ),
        )

    return once(patterns, value)


def regex_phrase(c: Column, syllables, slope: int | None = None, max_expansions: int | None = None, generated_pinyin: bool | None = False) -> Column:
    return query_from_patterns(regex_phrase_patterns(c, syllables, generated_pinyin), F.lit(slope), F.lit(max_expansions))


def render_query(query: Column) -> Column:
    """The query as text, for logs and comparisons."""
    quoted = F.array_join(F.transform(query["patterns"], lambda p: F.concat(F.lit("'"), p, F.lit("'"))), ", ")
    more = F.concat(
        F.coalesce(F.concat(F.lit(", "), query["slope"].cast("string")), F.lit("")),
        F.coalesce(F.concat(F.lit(", "), query["max_expansions"].cast("string")), F.lit("")),
    )
    return (
        F.when(query["kind"] == "empty", "empty()")
        .when(query["kind"] == "regex", F.concat(F.lit("regex("), quoted, F.lit(")")))
        .when(query["kind"] == "regex_phrase", F.concat(F.lit("regex_phrase(ARRAY["), quoted, F.lit("]"), more, F.lit(")")))
    )
