"""The training-data pipeline: each stage works on the documents that the one before it kept.

quality classifier -> exact deduplication -> near duplicates (n-gram Jaccard join) -> benchmark
decontamination -> best-fit packing. All stages but the last return the columns of documents.

Extra columns come along, whatever their names. Null texts count as empty, and an empty table stays
empty. Each stage says which of tied and repeated rows stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pinloom.llm.common import Scratch, table
from pinloom.llm.decontaminate import drop_contaminated
from pinloom.llm.exact import drop_exact_duplicates
from pinloom.llm.jaccard import drop_near_duplicates
from pinloom.llm.packing import pack_documents
from pinloom.llm.quality import drop_rejected
from pinloom.llm.tokens import vocabulary_path


#: Scratch tables of the stages since run() last removed them.
_open: list[Scratch] = []


def _scratch(spark: SparkSession, name: str) -> Scratch:
    _open.append(Scratch(spark, f"stage-{name}"))
    return _open[-1]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws; models and draw are fitted on ``docs`` and labels.

    Null and empty texts stay, and without good labels all do. Rows of equal doc_id and text share their
    fate, as do rows tied with the last that is drawn, which stay. A null doc_id has no label.
    """
    return drop_rejected(docs, table(spark, sf_dir, "labels"), _scratch(spark, "quality"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id.

    Null and empty texts equal each other. A null doc_id ranks last. Of rows with equal doc_id and text
    the smallest by their other columns stays.
    """
    return drop_exact_duplicates(docs, _scratch(spark, "exact"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id.

    Texts without words all stay. A null doc_id ranks last. Rows with equal doc_id and text share their fate.
    """
    return drop_near_duplicates(docs, _scratch(spark, "near"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which fewer than 1 in 20 words lie in test n-grams, each row by itself; all without test items."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096: one row per piece of a document. Empty texts are their end id; each row has its pieces."""
    return pack_documents(docs, _scratch(spark, "pack"), vocabulary_path())


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("pack", pack)]

#: The draw of the first stage and the tokenizer of the last aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's rows are written as Parquet and read again, and its scratch tables go."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        while _open:
            _open.pop().close()
        if before:
            scratch.drop(before)
        before = name
    return docs
