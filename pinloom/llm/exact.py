"""Exact deduplication with a heavy-hitter split.

Texts are equal when identical after lower-casing A-Z. Their SHA-256 digests are written once as
a narrow table. A Misra-Gries family sketch (Spark's approx_top_k) proposes frequent digests, an
exact count over all rows verifies them, and the verified winners, at most ``max_heavy`` rows, are
broadcast: their copies are settled map-side without a shuffle. What remains takes an ordinary shuffle
of digests: groups are aggregated map-side first, and those of several rows joined back, so that no task
holds a group. Only DataFrame operations run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, broadcast_if_small, table, whole_row

#: Proposed digests; also the bound of the broadcast table (about 150 bytes a row).
MAX_HEAVY = 2000
#: Counters of each sketch: a digest in more than about 4 of as many rows is always proposed.
COUNTERS = 20000


def _digest(text: str = "text") -> Column:
    return F.sha2(F.encode(ascii_lower(F.coalesce(F.col(text), F.lit(""))), "UTF-8"), 256)


def _split(docs: DataFrame, scratch: Scratch, max_heavy: int, counters: int) -> tuple[DataFrame, DataFrame]:
    """(rows, winners): doc_id, text_sha256, row, best, group_size of each row; and of the heavy digests alone."""
    digests = scratch.save(docs.select("doc_id", _digest().alias("text_sha256")).withColumn("row", F.monotonically_increasing_id()), "digests")
    best = F.max(F.struct("doc_id", "row"))
    proposed = digests.agg(F.expr(f"approx_top_k(text_sha256, {max_heavy}, {counters})").alias("top")).select(
        F.explode("top.item").alias("text_sha256")
    )
    winners = scratch.save(
        digests.join(F.broadcast(proposed), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1"),
        "winners",
    )
    marked = digests.join(F.broadcast(winners), "text_sha256", "left")
    heavy = marked.where("group_size is not null").withColumn("heavy", F.lit(True))
    rest = marked.where("group_size is null").drop("best", "group_size")
    groups = rest.groupBy("text_sha256").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    alone = F.struct("doc_id", "row")
    rest = rest.join(groups, "text_sha256", "left").select(
        "text_sha256", "doc_id", "row", F.coalesce("best", alone).alias("best"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.lit(False).alias("heavy")
    )
    return heavy.select(*rest.columns).unionByName(rest), winners


def exact_duplicates(docs: DataFrame, scratch: Scratch, max_heavy: int = MAX_HEAVY, counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, text_sha256, keep_id, group_size, kept.

    Of equal texts the row with the largest doc_id stays. Null text counts as empty. A null doc_id
    ranks below all others. Of repeated rows with the same doc_id and equal texts one is kept.
    An empty table gives an empty result.
    """
    rows, _ = _split(docs, scratch, max_heavy, counters)
    return rows.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, scratch: Scratch, max_heavy: int = MAX_HEAVY, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with the same columns; ties and nulls as in exact_duplicates().

    Copies of heavy digests go map-side, as the winners are broadcast; the others go by an anti join
    with the keys that lost, broadcast if they are few. Repeated rows (same doc_id, equal text) are
    reduced to the smallest by their other columns.
    """
    rows, winners = _split(docs, scratch, max_heavy, counters)
    is_best = F.col("doc_id").eqNullSafe(F.col("best.doc_id"))
    keys = rows.where("group_size > 1").where(is_best | ~F.col("heavy")).groupBy("doc_id", "text_sha256").agg(
        F.max(is_best.cast("int")).alias("stays"), F.count(F.lit(1)).alias("n")
    )
    keys = scratch.save(keys.where("stays = 0 or n > 1").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("key"), "stays"), "keys")
    n, ties = keys.agg(F.count(F.lit(1)), F.sum("stays")).first()
    side = broadcast_if_small(keys, n)
    won = winners.select(F.col("text_sha256").alias("won"), F.col("best.doc_id").alias("best"))
    d = docs.select(whole_row(docs), _digest().alias("sha"))
    d = d.join(F.broadcast(won), F.col("sha") == F.col("won"), "left").where(F.col("won").isNull() | F.col("row.doc_id").eqNullSafe(F.col("best")))
    d = d.select("row", "sha")
    same = F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("key"))
    once = d.join(side, same, "left_anti").select("row.*")
    if not ties:
        return once
    tied = d.join(side.where("stays = 1"), same, "left_semi").groupBy("sha").agg(F.min("row").alias("row"))
    return once.unionByName(tied.select("row.*"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each of ``documents``; ties, nulls and empty tables as in exact_duplicates()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_duplicates(docs, Scratch(spark, "exact"))


OP2_SQL = """
WITH d AS (
  SELECT doc_id,
         sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM d
"""
