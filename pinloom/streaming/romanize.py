"""Romanization of streams: stateless, so a stream gains columns like a table.

Each micro-batch asks the registry anew, so dictionary edits show from the next batch on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..dictionary import Registry
from ..operators.romanize import char_romanize, word_romanize

MODES = {"char": char_romanize, "word": word_romanize}


def with_pinyin(df: DataFrame, registry: Registry, column: str, out: str = "pinyin", mode: str = "word", suffix: str | None = None) -> DataFrame:
    """``df`` with a romanized copy of a column, for batches and streams; the dictionary is that of now."""
    return df.withColumn(out, MODES[mode](F.col(column), registry.dictionary(suffix)))


def romanize_stream(stream: DataFrame, registry: Registry, column: str, sink: Callable[[DataFrame, int], None], checkpoint: str, **options) -> StreamingQuery:
    """Starts a query that passes each romanized micro-batch to ``sink``; options as in with_pinyin()."""
    each = lambda batch, n: sink(with_pinyin(batch, registry, column, **options), n)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
