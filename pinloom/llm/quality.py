"""Quality classifier by importance resampling.

Two pairs of hashed n-gram models, of target text (labelled good: quality 1, toxic 0) and of raw text
(all documents), give log ratios by bucket. One pair counts every occurrence of words and word pairs,
over longer runs, which shows repetition and markup; the other counts a word once a document, over
short runs, which shows rare spoiling words. A document's log weight is the ratio of its least
target-like run, under either pair, on a scale on which CLEAN_LOSS of held-out good documents lie
below -1: over a whole text, ordinary words would outweigh any spoiled passage. The least of many runs is
lower than that of few, so the scale widens with length: documents are classed by the bit length of
their number of words, and where LONG_LOSS of a class's held-out good documents, LEAST_HELD of them or more,
lie lower, the scale from that class on follows them.

Documents are drawn without replacement by Gumbel top-k: k is the number of documents whose weight
is -1 or more, and the k largest of SHARPNESS times weight plus Gumbel noise stay. The noise
comes from a hash of the row, so a rerun draws the same documents.

Texts are read twice, to count and to weigh. Counts cover all documents and are combined by bucket;
sums, ratios, scales, weights and the draw are DataFrame operations, and only the finished models come to
the driver. Labelled rows are used up to ``max_labels``, those with the smallest hashes; three
quarters of them fit the target models, the rest set the scale.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import Scratch, lean, small_batches, table, word_hashes

#: Buckets for words, and as many for word pairs.
BUCKETS = 1 << 20
#: Bound of the labelled rows that are used, by smallest hash of doc_id.
MAX_LABELS = 100_000
#: Added to both models' counts on the target's scale.
SMOOTHING = {"tokens": 2.0, "types": 1.0}
#: Words in a run.
RUN = {"tokens": 16, "types": 2}
#: Share of held-out good documents below -1 under each pair.
CLEAN_LOSS = 0.01
#: Share of the held-out good documents of a class of lengths that may lie below -1 under each pair.
LONG_LOSS = 0.02
#: Held-out good documents that a class of lengths needs for a scale of its own.
LEAST_HELD = 100
#: Factor of weights before noise is added: the smallest tried that loses no more held-out good documents than a plain cut.
SHARPNESS = 20.0
SEED = 42

_WORD = re.compile(rb"[a-z\x80-\xff]+|[0-9]|[^\sa-z0-9\x80-\xff]+")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_KINDS = ("tokens", "types")
_COUNTS = ("raw_tokens", "raw_types", "target_tokens", "target_types")


def features(text: str | None, buckets: int, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words, and of the pairs each word closes (offset by ``buckets``)."""
    h = word_hashes(_WORD.findall((text or "").encode("utf-8", "surrogatepass").lower()), known)
    pairs = (h[:-1] * _A) ^ (h[1:] * _B)
    pairs ^= pairs >> np.uint64(31)
    mask = np.uint64(buckets - 1)
    return (h & mask).astype(np.int64), ((pairs * _A) >> np.uint64(20) & mask).astype(np.int64) + buckets


class Models:
    """Log ratios by bucket of both pairs of models."""

    def __init__(self, ratios: dict[str, np.ndarray], buckets: int):
        self.ratios, self.buckets = ratios, buckets

    def parts(self, text: str | None, known: dict[bytes, int]) -> tuple[float, float, int]:
        """Smallest ratio of a run of words by tokens, and by types, where a word counts where it comes first; class of length."""
        words, pairs = features(text, self.buckets, known)
        if not len(words):
            return 0.0, 0.0, 0
        tokens = self.ratios["tokens"][words]
        tokens[1:] += self.ratios["tokens"][pairs]
        again = np.ones(len(words), bool)
        again[np.unique(words, return_index=True)[1]] = False
        types = np.where(again, np.float32(0), self.ratios["types"][words])
        out = []
        for kind, x in (("tokens", tokens), ("types", types)):
            c = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
            n = min(RUN[kind], len(x))
            out.append(float((c[n:] - c[:-n]).min()))
        return out[0], out[1], len(words).bit_length()


def noise(doc_id, text: str | None, seed: int = SEED) -> float:
    """Standard Gumbel noise from a hash of the row."""
    u = (xxhash.xxh64_intdigest(f"{doc_id}:{xxhash.xxh64_intdigest((text or '').encode('utf-8', 'surrogatepass'))}", seed) >> 11) + 0.5
    return float(-np.log(-np.log(u / 2.0**53)))


def _labelled(labels: DataFrame, scratch: Scratch, max_labels: int) -> DataFrame:
    """(id, held): distinct ids of good documents, to fit on or held out; at most ``max_labels``."""
    i = F.col("doc_id").cast("long")
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    rows = labels.select(i.alias("id"), F.xxhash64(i).alias("h"), good.alias("good")).where("id is not null").orderBy("h", "id").limit(max_labels)
    return scratch.save(rows.where("good").select("id", (F.pmod(F.shiftright("h", 8), F.lit(4)) == 0).alias("held")).distinct(), "labels")


def _member(ids: np.ndarray, column) -> np.ndarray:
    values = column.cast(pa.int64())
    found = np.isin(values.fill_null(0).to_numpy(zero_copy_only=False), ids) if len(ids) else np.zeros(len(values), bool)
    return found & np.asarray(values.is_valid())


def _counts(docs: DataFrame, fitted: np.ndarray, scratch: Scratch, buckets: int) -> DataFrame:
    """By bucket that occurs: occurrences and documents, in all documents and in the target's."""
    chosen = docs.sparkSession.sparkContext.broadcast(fitted)

    def count(batches):
        total, known = np.zeros((4, 2 * buckets), np.uint32), {}
        for batch in batches:
            good = _member(chosen.value, batch.column("doc_id"))
            for text, t in zip(batch.column("text"), good):
                f = np.concatenate(features(text.as_py(), buckets, known))
                once, n = np.unique(f, return_counts=True)
                n = n.astype(np.uint32)
                total[0, once] += n
                total[1, once] += 1
                if t:
                    total[2, once] += n
                    total[3, once] += 1
        at = np.flatnonzero(total[0])
        for a in range(0, len(at), 65536):
            part = at[a : a + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype("i4")), *(pa.array(x[part].astype("i4")) for x in total)], ["bucket", *_COUNTS])

    counts = docs.select("doc_id", "text").mapInArrow(lean(count), "bucket int, " + ", ".join(f"{c} int" for c in _COUNTS))
    sums = scratch.save(counts.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in _COUNTS)), "counts")
    chosen.destroy()
    return sums


def _ratio(kind: str, scale: dict[bool, float | None], buckets: int) -> Column:
    """The log ratio of a bucket; 0 for a half (words, pairs) that the target lacks. scale: target's over raw's total, by half."""
    s = SMOOTHING[kind]
    one = lambda x: F.log((F.col(f"target_{kind}") + s) / (F.col(f"raw_{kind}") * x + s)) if x else F.lit(0.0)
    return F.when(F.col("bucket") < buckets, one(scale.get(True))).otherwise(one(scale.get(False))).cast("float")


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, buckets: int = BUCKETS, max_labels: int = MAX_LABELS) -> Models:
    """Counts over all ``docs``, the target's over those labelled good and not held out. Without any, every ratio is 0."""
    small_batches(docs.sparkSession)
    good = _labelled(labels, scratch, max_labels)
    fitted = np.sort(good.where("not held").toArrow().column("id").to_numpy())
    sums = _counts(docs, fitted, scratch, buckets)
    totals = sums.groupBy((F.col("bucket") < buckets).alias("words")).agg(*(F.sum(c).alias(c) for c in _COUNTS)).collect()
    scale = {k: {r["words"]: r[f"target_{k}"] / r[f"raw_{k}"] for r in totals} for k in _KINDS}
    found = sums.select("bucket", *(_ratio(k, scale[k], buckets).alias(k) for k in _KINDS)).toArrow()
    ratios = {k: np.zeros(2 * buckets, np.float32) for k in _KINDS}
    for k in _KINDS:
        ratios[k][found.column("bucket").to_numpy()] = found.column(k).to_numpy()
    scratch.drop("counts")
    return Models(ratios, buckets)


def _scored(docs: DataFrame, models: Models, scratch: Scratch, seed: int, whole: bool) -> DataFrame:
    """doc_id, tokens, types, length, noise of each row; with ``whole`` also row, a struct of all its columns. Written out."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(models)
    columns = docs.columns if whole else ["doc_id"]
    schema = StructType([docs.schema[c] for c in columns])
    row = to_arrow_schema(StructType().add("row", schema)).field("row").type

    def run(batches):
        known = {}
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            parts = np.array([shared.value.parts(t, known) for t in texts], np.float64).reshape(-1, 3)
            g = np.array([noise(i, t, seed) for i, t in zip(ids, texts)], np.float64)
            rows = pa.StructArray.from_arrays([batch.column(c) for c in columns], fields=list(row))
            yield pa.RecordBatch.from_arrays([rows, pa.array(parts[:, 0]), pa.array(parts[:, 1]), pa.array(parts[:, 2].astype("i4")), pa.array(g)], ["row", *_KINDS, "length", "noise"])

    out = StructType().add("row", schema).add("tokens", "double").add("types", "double").add("length", "integer").add("noise", "double")
    source = docs if whole else docs.select("doc_id", "text")
    scored = scratch.save(source.mapInArrow(lean(run), out), "scored")
    shared.destroy()
    return scored


def kth_largest(values: DataFrame, k: int, bins: int = 4096, few: int = 10_000) -> float:
    """The k-th largest of a column of doubles: histograms of ever narrower ranges, a fixed number of bins each."""
    name = values.columns[0]
    if k <= 0:
        return float("inf")
    low, high, n = values.agg(F.min(name), F.max(name), F.count(name)).first()
    if k >= n:
        return float("-inf")
    above = 0  # values over high
    while n > few and high > low:
        step = (high - low) / bins
        inside = values.where(F.col(name).between(low, high))
        bin_of = F.least(F.floor((F.col(name) - low) / step), F.lit(bins - 1))
        rows = sorted(inside.groupBy(bin_of.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("lo"), F.max(name).alias("hi")).collect(), reverse=True)
        for r in rows:
            if above + r["n"] >= k:
                break
            above += r["n"]
        low, high, n = r["lo"], r["hi"], r["n"]
    if high <= low:
        return low
    rest = np.sort([r[0] for r in values.where(F.col(name).between(low, high)).collect()])[::-1]
    return float(rest[k - above - 1])


def _units(held: DataFrame, clean_loss: float, long_loss: float, least: int) -> dict[str, list[float]]:
    """By kind and class of length, what counts as -1: never less than for shorter documents. ``held``: scores of held-out good ones."""
    found = held.rollup("length").agg(
        F.count(F.lit(1)).alias("n"),
        # exact for so few rows, in any order
        *(F.percentile_approx(k, [clean_loss, long_loss], 10 * MAX_LABELS).alias(k) for k in _KINDS),
    ).collect()
    every = {k: max([1.0, *(-r[k][0] for r in found if r["length"] is None and r["n"])]) for k in _KINDS}
    own = {r["length"]: r for r in found if r["length"] is not None and r["n"] >= least}
    return {k: [max([every[k], *(-own[c][k][1] for c in own if c <= length)]) for length in range(33)] for k in _KINDS}


def _drawn(
    docs: DataFrame, labels: DataFrame, scratch: Scratch, seed: int, whole: bool,
    clean_loss: float = CLEAN_LOSS, long_loss: float = LONG_LOSS, least: int = LEAST_HELD, sharpness: float = SHARPNESS, **fit_options,
) -> DataFrame:
    """_scored() with log_weight, gumbel_key and kept."""
    scored = _scored(docs, fit(docs, labels, scratch, **fit_options), scratch, seed, whole)
    held = scratch.spark.read.parquet(scratch.path("labels")).where("held")  # at most max_labels rows
    units = _units(scored.join(F.broadcast(held), F.col("row.doc_id").cast("long") == F.col("id"), "left_semi"), clean_loss, long_loss, least)
    unit = lambda k: F.get(F.array(*map(F.lit, units[k])), F.col("length"))
    weighed = scored.withColumn("log_weight", F.least(*(F.col(k) / unit(k) for k in _KINDS)))
    weighed = weighed.withColumn("gumbel_key", F.col("log_weight") * F.lit(sharpness) + F.col("noise"))
    limit = kth_largest(weighed.select("gumbel_key"), weighed.where("log_weight >= -1").count())
    return weighed.withColumn("kept", F.col("gumbel_key") >= F.lit(limit))


def resample(docs: DataFrame, labels: DataFrame, scratch: Scratch, seed: int = SEED, **options) -> DataFrame:
    """One row per document: doc_id, log_weight, gumbel_key, kept. ``options`` are those of _drawn() and fit().

    Null and empty texts have no n-grams and weight 0, so they stay. A null doc_id is never
    labelled. Repeated rows share their noise and so their fate; rows tied with the k-th stay.
    Without documents the result is empty, without good labels everything stays.
    """
    drawn = _drawn(docs, labels, scratch, seed, False, **options)
    return drawn.select(F.col("row.doc_id").alias("doc_id"), "log_weight", "gumbel_key", "kept")


def drop_rejected(docs: DataFrame, labels: DataFrame, scratch: Scratch, seed: int = SEED, **options) -> DataFrame:
    """The documents that are drawn, with all their columns, whatever their names; rows as in resample().

    Rows are written out with their scores, as a second weighing would cost more than reading them again.
    """
    drawn = _drawn(docs, labels, scratch, seed, True, **options)
    return drawn.where("kept").select("row.*")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, log_weight, gumbel_key and kept of each of ``documents``, with the models fitted on them and on ``labels``.

    Nulls, empty texts, ties, repeated rows and empty tables as in resample().
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "labels"), Scratch(spark, "quality"))
