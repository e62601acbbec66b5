"""python -m pinloom.sources CHARS OUT [--words WORDS] [--letters JSON]: prepares the three dictionary files.

CHARS has lines 'U+HEX: reading,reading # note', WORDS rows 'word,joined pinyin', JSON single-letter
replacements for readings. PINLOOM_WORDS names the word source where --words is absent.
"""

from __future__ import annotations

import argparse
import json
import os
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .files import lines_of, write_table
from .prep import prepare, word_counts


def main(args: list[str] | None = None) -> dict[str, int]:
    parser = argparse.ArgumentParser(prog="pinloom.sources", description=__doc__)
    parser.add_argument("chars")
    parser.add_argument("out")
    parser.add_argument("--words", default=os.environ.get("PINLOOM_WORDS"))
    parser.add_argument("--letters")
    a = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    words = None
    if a.words:
        rows = spark.read.schema("word string, joined string").option("escape", '"').csv(a.words)
        words = rows.withColumn("ord", F.monotonically_increasing_id())
    tables = prepare(lines_of(spark, a.chars), words, json.loads(Path(a.letters).read_text()) if a.letters else None)
    counts = {k: v.count() for k, v in tables.items()} | {"fallback": word_counts(tables["words"])[1]}
    for name, df in tables.items():
        write_table(df.drop("fallback").coalesce(1), f"{a.out}/{name}")
    print(", ".join(f"{k}: {v}" for k, v in counts.items()))
    return counts


if __name__ == "__main__":
    main()
