"""Dictionary-based word breaks for single texts, by the ICU library that Spark carries.

It runs in the driver's JVM, so it serves typed queries and constants; columns bring token arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..dictionary import Dictionary
from ..operators.romanize import romanize_tokens_all, word_romanize_tokens


def icu_tokens(spark: SparkSession, text: str | None, language: str = "zh") -> list[str] | None:
    """Words of a text without white space; null for null."""
    if text is None:
        return None
    icu = spark.sparkContext._jvm.com.ibm.icu
    breaks = icu.text.BreakIterator.getWordInstance(icu.util.ULocale(language))
    breaks.setText(text)
    units = text.encode("utf-16-le")
    out, start = [], breaks.first()
    while (end := breaks.next()) != -1:
        out.append(units[2 * start : 2 * end].decode("utf-16-le"))
        start = end
    return [t for t in out if t.strip()]


def _literal(tokens: list[str] | None) -> Column:
    return F.lit(None).cast("array<string>") if tokens is None else F.array(*map(F.lit, tokens)).cast("array<string>")


def icu_romanize(spark: SparkSession, text: str | None, d: Dictionary) -> Column:
    """All readings of a constant text's words."""
    return romanize_tokens_all(_literal(icu_tokens(spark, text)), d)


def icu_word_romanize(spark: SparkSession, text: str | None, d: Dictionary) -> Column:
    """First readings of a constant text's words."""
    return word_romanize_tokens(_literal(icu_tokens(spark, text)), d)
