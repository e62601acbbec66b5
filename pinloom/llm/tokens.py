"""Token ids and a binary file format for them: ORC, sorted by document id.

Encoding keeps a bounded table from word to ids. Texts are split at ASCII blanks, at which the
tokenizer itself always splits, so a text's ids are its words' ids in order; each new word is
encoded once by the tokenizers library.

Files: one row per document with its ids as a list of 32-bit integers, range-partitioned and
sorted by document id. ORC stores the ids run-length encoded, with row indexes and Bloom filters
on the document id, so that stripes are read in parallel and lookups skip what can't match.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, lean, small_batches, table

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Words a worker remembers; the table starts anew when full (about 150 bytes a word).
REMEMBERED = 600_000
#: Characters encoded in one go: the more, the fewer lookups of frequent words.
TOGETHER = 6 << 20
ROWS_PER_FILE = 200_000
STRIPE_BYTES = 16 << 20
ROW_INDEX_STRIDE = 2000

_SIMPLE = re.compile("[a-zß-öø-ÿ]+").fullmatch


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, int]:
    """Code points that stand for the bytes that print badly, as byte-level vocabularies have them."""
    odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
    return {b: 256 + i for i, b in enumerate(odd)}


_LETTERS = _byte_letters()


class Encoder:
    """ids of whole texts, equal to encode(text, add_special_tokens=False).ids of the library."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = re.compile("|".join(map(re.escape, (t.content for t in self.tokenizer.get_added_tokens_decoder().values()))), re.I)
        self.known: dict[str, bytes] = {}
        self.remembered = remembered

    def _learn(self, word: str) -> bytes:
        if _SIMPLE(word):  # letters in composed form: one pre-token, straight to the model
            s = word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)
            ids = [t.id for t in self.tokenizer.model.tokenize(s)]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One array of unsigned 32-bit ids per text."""
        odd = {i: self.tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts) if "<|" in t and self.special.search(t)}
        plain = pc.ascii_lower(pa.array(["" if i in odd else t for i, t in enumerate(texts)], pa.large_string()))
        # A stop or comma after a letter is a token of its own, so words are the same with and without it.
        plain = pc.replace_substring_regex(plain, r"([a-z\x{df}-\x{f6}\x{f8}-\x{ff}])([.,])([ \n])", r"\1 \2\3")
        split = pc.ascii_split_whitespace(plain)
        coded = split.flatten().dictionary_encode()
        if len(self.known) > self.remembered:
            self.known.clear()
        get, known = self.known.get, self.known
        words = coded.dictionary.to_pylist()
        found = [get(w) for w in words]
        for i, x in enumerate(found):
            if x is None:
                found[i] = known[words[i]] = self._learn(words[i])
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        first = np.cumsum(size) - size
        at = coded.indices.to_numpy(zero_copy_only=False)
        n = size[at]
        ends = np.cumsum(n)
        short = np.int32 if len(ends) and max(ends[-1], len(flat)) < 2**31 else np.int64  # what follows is the largest
        place = np.repeat((first[at] - (ends - n)).astype(short), n)
        place += np.arange(len(place), dtype=short)
        ids = flat[place]
        cuts = np.concatenate([[0], ends])[np.asarray(split.offsets)]
        return [np.array(odd[i], "<u4") if i in odd else ids[cuts[i] : cuts[i + 1]] for i in range(len(texts))]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_batches(batches, path: str, end_id: int | None, size: int = TOGETHER, remembered: int = REMEMBERED, keep: bool = True):
    """(slice of a batch, ids of its texts); null counts as empty. About ``size`` characters are encoded together.

    The words that are remembered stay for the worker's next task only with ``keep``.
    """
    enc = encoder(path)
    enc.remembered = remembered
    end = np.array([] if end_id is None else [end_id], "<u4")
    held, texts, n = [], [], 0

    def done():
        ids = enc.encode(texts)
        at = 0
        for part in held:
            yield part, [np.concatenate([x, end]) for x in ids[at : at + part.num_rows]]
            at += part.num_rows

    for batch in batches:
        for a in range(0, batch.num_rows, 64):
            part = batch.slice(a, 64)
            more = [t or "" for t in part.column("text").to_pylist()]
            held.append(part)
            texts += more
            n += sum(map(len, more))
            if n >= size:
                yield from done()
                held, texts, n = [], [], 0
    if held:
        yield from done()
    if not keep:
        enc.known.clear()


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = END_ID, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Writes doc_id and ids of each text as ORC in ascending doc_id order, null ids first.

    Texts, not ids, are dealt out by range, as they are smaller. Rows of equal doc_id are ordered by
    their text. Null text counts as empty; each row is a document, repeated ones too.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = pa.list_(pa.int32())

    def run(batches):
        for part, encoded in encode_batches(batches, vocabulary, end_id):
            cuts = np.cumsum([0, *map(len, encoded)])
            flat = np.concatenate(encoded) if encoded else np.zeros(0, "<u4")
            cells = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat.astype("<i4")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), cells.cast(ids)], ["doc_id", "tokens"])

    n = max(1, -(-docs.count() // rows_per_file), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(lean(run), f"doc_id {kind}, tokens array<int>").write.mode("overwrite")
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true").option("orc.row.index.stride", str(ROW_INDEX_STRIDE)).option("orc.stripe.size", str(STRIPE_BYTES))
        .option("compression", "zstd").orc(path)
    )


def read_token_files(spark: SparkSession, path: str, doc_id_type: str = "bigint") -> DataFrame:
    """doc_id and tokens; filters on doc_id reach the row indexes and Bloom filters."""
    return spark.read.schema(f"doc_id {doc_id_type}, tokens array<int>").orc(path)


def token_index(files: DataFrame, scratch: Scratch) -> DataFrame:
    """From token files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Each file holds a range of document ids, so the files' sums, one row a file, give each file's
    offset, and running sums within a file the rest. Within a file, rows count in their order there.
    """
    small_batches(files.sparkSession)
    kind = files.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            cells = batch.column("tokens")
            cuts, flat = np.asarray(cells.offsets), np.asarray(cells.values).astype("<u4")
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("file"), batch.column("block"), pa.array(np.diff(cuts).astype("i8")), pa.array(crc, pa.int64())],
                ["doc_id", "file", "block", "n_tokens", "ids_crc32"],
            )

    rows = files.select("doc_id", "tokens", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).mapInArrow(
        lean(run), f"doc_id {kind}, file string, block long, n_tokens long, ids_crc32 long"
    )
    rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()), "token-index")
    # One row a file from here; empty files have none.
    sums = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.min("doc_id").alias("least"), F.count("doc_id").alias("ids"))
    by_range = Window.orderBy(F.col("least").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("file", F.coalesce(F.sum("n").over(by_range), F.lit(0)).alias("base"))
    in_file = Window.partitionBy("file").orderBy("block", "row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(in_file), F.lit(0)))
        .join(offsets, "file")
        .select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each of ``documents``, from its token files; nulls, repeated rows and empty tables as in write_token_files()."""
    scratch = Scratch(spark, "tokens")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    write_token_files(docs, scratch.path("ids"), vocabulary_path())
    return token_index(read_token_files(spark, scratch.path("ids")), scratch)
