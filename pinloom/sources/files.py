"""Dictionary files: headerless two-column CSV, as read and written by the dictionary tools."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dictionary import SCHEMAS, Registry, standard_token_table


def read_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A mapping, token or words file; of a repeated key the last row in the file's order stays."""
    return _last(spark.read.schema(SCHEMAS[kind]).option("escape", '"').option("mode", "FAILFAST").csv(path))


def _place() -> Column:
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at")


def _last(df: DataFrame) -> DataFrame:
    key, value = df.columns
    return df.select("*", _place()).where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, "at").alias(value))


def read_plain_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """As read_table() for lines that are cut at their first comma, whatever quotes they hold. Empty lines go, others without a comma are errors."""
    key, value = (c.split()[0] for c in SCHEMAS[kind].split(", "))
    line = F.regexp_replace("value", r"\r+$", "")
    sure = F.when(F.instr("line", ",") > 0, F.col("line")).otherwise(F.raise_error(F.concat(F.lit("no second column in "), F.lit(kind), F.lit(": "), F.col("line"))))
    lines = spark.read.text(path).select(line.alias("line"), _place()).where("line <> ''").select("at", sure.alias("line"))
    parts = lines.select("at", F.substring_index("line", ",", 1).alias(key), F.expr("substring(line, instr(line, ',') + 1)").alias(value))
    last = parts.groupBy(key).agg(F.max_by(value, "at").alias(value))
    return last.withColumn(value, F.col(value).cast("smallint")) if kind == "token" else last


def load_registry(spark: SparkSession, mapping: str, token: str, words: str | None = None) -> Registry:
    """A registry from files; the words file is optional."""
    return Registry(spark, read_table(spark, mapping, "mapping"), read_table(spark, token, "token"), read_table(spark, words, "words") if words else None)


def seed(registry: Registry, mapping: str, words: str, token: str | None = None) -> bool:
    """Replaces the registry's tables by files, without ``token`` by the standard tokens.

    Files that don't read as CSV are read as plain lines, all of them, with a warning.
    """
    spark, paths = registry.spark, {"mapping": mapping, "words": words, "token": token}

    def load(read) -> dict[str, DataFrame]:
        found = {k: read(spark, p, k) if p else standard_token_table(spark) for k, p in paths.items()}
        # Read once and held: a dictionary is bounded by the language.
        return {k: spark.createDataFrame(df.toArrow(), schema=df.schema) for k, df in found.items()}

    try:
        tables = load(read_table)
    except Exception as e:  # what Spark raises for a malformed file depends on the reader
        warnings.warn(f"files read as plain lines, as they are no CSV: {str(e)[:200]}", stacklevel=2)
        tables = load(read_plain_table)
    return registry.seed(tables["mapping"], tables["token"], tables["words"])


def write_table(df: DataFrame, path: str) -> None:
    """Headerless CSV, in the order of ``df``."""
    df.write.mode("overwrite").option("escape", '"').option("emptyValue", "").csv(path)


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value) of a text source, in file order."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), "value")
