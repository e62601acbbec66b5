"""Preparation of dictionary tables from raw pronunciation data.

Sources: text lines 'U+HEX: reading,reading # note', and word rows (word, joined pinyin). Each step is
a DataFrame plan; ``ord`` is a line's place in its source, where order matters.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dictionary import INITIALS, VOWELS
from ..functions.text import WHITE_SPACE


def _tone_letters() -> tuple[str, str]:
    """Precomposed Latin letters and their base letters, by canonical decomposition."""
    marked, plain = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFKD", chr(code))
        base = [c for c in parts if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != chr(code) and base[0].isascii():
            marked.append(chr(code))
            plain.append(base[0])
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _tone_letters()


def normalize_tone(c: Column, letters: dict[str, str] | None = None) -> Column:
    """Lower-case syllables without tone marks; letters other than a-z, v and ' go.

    ``letters`` maps single characters instead of dropping marks; then u: and the umlaut become v.
    """
    text = F.lower(F.trim(c))
    if letters:
        for k, v in letters.items():
            text = F.replace(text, F.lit(k), F.lit(v))
    else:
        text = F.regexp_replace(F.translate(text, _MARKED, _PLAIN), r"\p{M}", "")
    text = F.replace(F.replace(F.replace(text, F.lit("u:"), F.lit("v")), F.lit("ü"), F.lit("v")), F.lit("’"), F.lit("'"))
    return F.regexp_replace(text, "[^a-zv']", "")


def char_map(lines: DataFrame, letters: dict[str, str] | None = None) -> DataFrame:
    """(character, readings) of lines (ord, value); readings are distinct in order, a later line replaces an earlier."""
    line = F.trim("value")
    form = r"^U\+([0-9A-Fa-f]+):\s*([^#]*)"
    parsed = lines.where(line.rlike(form)).select(
        "ord", F.decode(F.unhex(F.lpad(F.regexp_extract(line, form, 1), 8, "0")), "utf-32").alias("character"),
        F.split(F.regexp_extract(line, form, 2), ",").alias("parts"),
    )
    readings = F.array_distinct(F.filter(F.transform("parts", lambda p: normalize_tone(p, letters)), lambda r: r != ""))
    some = parsed.withColumn("readings", readings).where(F.size("readings") > 0)
    return some.groupBy("character").agg(F.max_by("readings", "ord").alias("readings"))


def mapping_table(chars: DataFrame) -> DataFrame:
    """(character, |reading|reading|) by code point."""
    return chars.select("character", F.concat(F.lit("|"), F.array_join("readings", "|"), F.lit("|")).alias("pinyin")).orderBy(F.ascii("character"))


def token_rows(chars: DataFrame) -> DataFrame:
    """(character, category): distinct syllables as 1, single vowels that occur as 3, the initials as 2."""
    found = chars.select(F.explode("readings").alias("character")).distinct()
    vowels = (*VOWELS, "i", "u")
    rows = found.where(~F.col("character").isin(*INITIALS)).withColumn("category", F.when(F.col("character").isin(*vowels), 3).otherwise(1))
    initials = chars.sparkSession.createDataFrame([(t, 2) for t in INITIALS], "character string, category int")
    rows = rows.unionByName(initials)
    return rows.orderBy(F.when(F.col("category") == 1, 0).when(F.col("category") == 3, 1).otherwise(2), -F.length("character"), "character")


def word_rows(words: DataFrame, syllables) -> DataFrame:
    """(word, pinyin, fallback) of rows (ord, word, joined): the first row of a word wins, its pinyin split greedily.

    Where no syllable fits, the rest of the letters up to an apostrophe is one part and fallback is true.
    """
    text = F.lower(F.trim("joined"))
    for a, b in (("u:", "v"), ("ü", "v"), ("’", "'")):
        text = F.replace(text, F.lit(a), F.lit(b))
    by_length = "|".join(map(re.escape, sorted(set(syllables), key=lambda s: (-len(s), s))))
    rest = rf"[^'{WHITE_SPACE}][\p{{L}}&&[^']]*"
    parts = F.regexp_extract_all(text, F.lit(f"({by_length}|{rest})"), 1)
    known = F.array(*map(F.lit, sorted(set(syllables))))
    first = (
        words.withColumn("word", F.trim("word")).where("word <> '' and trim(joined) <> ''").withColumn("parts", parts).where(F.size("parts") > 0)
        .groupBy("word").agg(F.min_by("parts", "ord").alias("parts"))
    )
    return first.select("word", F.array_join("parts", " ").alias("pinyin"), (F.size(F.array_except("parts", known)) > 0).alias("fallback"))


def word_counts(words: DataFrame) -> tuple[int, int]:
    """Number of words, and of those that needed the fallback."""
    return tuple(words.agg(F.count(F.lit(1)), F.count_if("fallback")).first())


def prepare(lines: DataFrame, words: DataFrame | None, letters: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """All three tables from their sources; an empty character source is an error."""
    chars = char_map(lines, letters)
    if chars.limit(1).count() == 0:
        raise ValueError("the character source has no readings")
    tokens = token_rows(chars)
    syllables = [r[0] for r in tokens.where("category <> 2").select("character").collect()]
    spark = lines.sparkSession
    found = spark.createDataFrame([], "word string, pinyin string, fallback boolean") if words is None else word_rows(words, syllables)
    return {"mapping": mapping_table(chars), "token": tokens, "words": found}
