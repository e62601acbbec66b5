"""Benchmark decontamination: a broadcast hash set of the test n-grams, scanned over all texts.

Words are maximal runs of ASCII letters, digits and non-ASCII characters after lower-casing A-Z.
A window is 13 consecutive words of an item; an item of fewer words, but not none, is one window.
Each text's words become numbers of the items' vocabulary (0: no word of theirs), windows of known
words are hashed with numpy, looked up in the sorted hash set, and each hit is verified word by
word before it counts.

The hash set grows with the benchmark alone, not with the corpus. Its words are counted first; a
benchmark of more than ``limit`` words is cut into several sets of that size, each broadcast to a
scan of its own. Rows with their hits are written out between scans, so that one set at a time is in
memory, and hits are united before a document is judged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import Scratch, lean, small_batches, table, whole_row

WINDOW = 13
#: A document is contaminated if at least 1 in RATIO of its words is hit.
RATIO = 20
#: Words of benchmark items in one broadcast set (about 100 bytes each in a worker).
LIMIT = 1_000_000

#: Bytes of words keep their place, A-Z are lowered, all else becomes a blank.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_RUNS = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
HITS = "struct<n_words:long,spans:array<struct<first:long,end:long>>,items:array<string>>"
_MUL = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


def _hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n ids."""
    h = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        h = (h ^ ids[k : k + len(h)].astype(np.uint64)) * _MUL
        h ^= h >> np.uint64(29)
    return h


class Grams:
    """The windows of some items: a vocabulary, and by window length sorted hashes with windows and items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        windows: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1) if n else ():
                windows.setdefault(n, {}).setdefault(tuple(ids[i : i + n]), set()).add(item)
        self.by_length = []
        for n, found in sorted(windows.items()):
            grams = np.array(list(found), np.int64)
            h = np.array([_hashes(g, n)[0] for g in grams], np.uint64)
            order = np.argsort(h, kind="stable")
            names = list(found.values())
            self.by_length.append((n, h[order], grams[order], [names[i] for i in order]))

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, which of them are hit, and the items with occurring windows."""
        words = words_of(text)
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        hit, items = np.zeros(len(ids), bool), set()
        zeros = np.concatenate([[0], np.cumsum(ids == 0)])
        for n, hashes, grams, names in self.by_length:
            if len(ids) < n:
                continue
            at = np.flatnonzero(zeros[n:] == zeros[:-n])  # windows of known words only
            if not len(at):
                continue
            h = _hashes(ids, n)[at]
            left, right = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for i, a, b in zip(at[right > left], left[right > left], right[right > left]):
                for k in range(a, b):
                    if np.array_equal(ids[i : i + n], grams[k]):
                        hit[i : i + n] = True
                        items |= names[k]
        return len(ids), hit, items


def _batches(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark's items in sets of at most ``limit`` words (or one item), read piece by piece."""
    part, n = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), "text").orderBy("i").toLocalIterator():
        size = len(words_of(row["text"]))
        if part and n + size > limit:
            yield part
            part, n = [], 0
        part.append((row["i"] if row["i"] is not None else "null", row["text"]))
        n += size
    yield part


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int, limit: int) -> DataFrame:
    """row (a struct of all columns of ``docs``) and hits: struct of n_words, spans [(first, end)] and items, after a scan with each set in turn."""
    spark = docs.sparkSession
    small_batches(spark)
    out, shared, scratch = docs.select(whole_row(docs), F.lit(None).cast(HITS).alias("hits")), None, None
    for i, items in enumerate(_batches(benchmark, limit)):
        if shared is not None:
            scratch = scratch or Scratch(spark, "decontaminate")
            out = scratch.save(out, f"scan-{i}")
            shared.destroy()
            if i > 1:
                scratch.drop(f"scan-{i - 1}")
        shared = spark.sparkContext.broadcast(Grams(items, window))
        out = _scan(out, shared)
    return out


def _scan(rows: DataFrame, shared) -> DataFrame:
    """Adds what a set finds to ``hits``, which earlier sets may have begun."""
    kind = to_arrow_schema(StructType.fromDDL(f"h {HITS}")).field("h").type

    def run(batches):
        for batch in batches:
            found = []
            for text, before in zip(pc.struct_field(batch.column("row"), "text").to_pylist(), batch.column("hits").to_pylist()):
                n, hit, items = shared.value.scan(text)
                for s in before["spans"] if before else ():
                    hit[s["first"] : s["end"]] = True
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                spans = [{"first": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]
                found.append({"n_words": n, "spans": spans, "items": sorted(items.union(before["items"] if before else ()))})
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, kind)], ["row", "hits"])

    return rows.mapInArrow(lean(run), rows.schema)


def _judged(rows: DataFrame, ratio: int) -> DataFrame:
    n_hit = F.aggregate("hits.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    d = rows.withColumn("n_hit", n_hit)
    return d.withColumn("bad", (F.col("n_hit") > 0) & (F.col("n_hit") * ratio >= F.col("hits.n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, ratio: int = RATIO, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_words, spans [(first, end) words that are hit], items, n_hit, contaminated.

    Null and empty texts have no words and are clean, as are documents of an empty benchmark. Null
    items have no windows; a null item_id counts as the name 'null'. Repeated rows are judged each
    by itself. Windows of repeated items count for each of them.
    """
    found = _judged(_scanned(docs.select("doc_id", "text"), benchmark, window, limit), ratio)
    return found.select("row.doc_id", "hits.n_words", "hits.spans", "hits.items", "n_hit", F.col("bad").alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, ratio: int = RATIO, limit: int = LIMIT) -> DataFrame:
    """The documents that aren't contaminated, with all their columns, whatever their names; scans without a join."""
    return _judged(_scanned(docs, benchmark, window, limit), ratio).where(~F.col("bad")).select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = LIMIT) -> DataFrame:
    """``docs`` with the words that are hit, and what stands between them, cut out of the text."""
    found, names = _scanned(docs, benchmark, window, limit), docs.columns

    def run(batches):
        for batch in batches:
            columns = [pc.struct_field(batch.column("row"), c) for c in names]
            i = names.index("text")
            texts = []
            for text, hits in zip(columns[i].to_pylist(), batch.column("hits").to_pylist()):
                if text is not None and hits["spans"]:
                    data = text.encode("utf-8", "surrogatepass")
                    places = [m.span() for m in _RUNS.finditer(data)]
                    at, parts = 0, []
                    for s in hits["spans"]:
                        parts.append(data[at : places[s["first"]][0]])
                        at = places[s["end"] - 1][1]
                    text = b"".join([*parts, data[at:]]).decode("utf-8", "surrogatepass")
                texts.append(text)
            columns[i] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return found.mapInArrow(lean(run), docs.schema)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each of ``documents``; nulls, empty texts and tables, repeated rows as in contamination()."""
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT item, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0))),
lengths AS (SELECT DISTINCT n FROM g),
p AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
h AS (SELECT doc_id, i, p.n AS n, item FROM p JOIN g USING (n, gram)),
c AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
