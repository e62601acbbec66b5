"""Best-fit packing of documents into token sequences by the sum-of-squares rule.

Each piece goes to the open sequence, or a new one, after which the sum over residual gaps of the
squared number of open sequences with that gap is smallest; equal choices take the tightest gap.
The rule wants no sorted stream, so pieces come shuffled, but for the shortest fifth, which come last,
longest first, to fill what is left. Only lengths are packed: ids stay in the pieces table.

Pieces are dealt evenly by a hash of their key to as many packers as their number asks for. A
packer handles a bounded number of pieces and keeps one counter for each gap, so each leaves at
most the few sequences open that a single packer would.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lean, small_batches, table
from .tokens import END_ID, encode_batches, vocabulary_path

MAX_TOKENS = 4096
#: Characters encoded together, and words remembered for a task: fewer than for files, as other stages' tables may share the executor.
TOGETHER, REMEMBERED = 4 << 20, 300_000
#: Pieces of one packer; the number of packers follows the input.
PIECES_PER_PACKER = 250_000


def placing_order(lengths: np.ndarray, last: float = 0.2) -> np.ndarray:
    """Shuffled with a fixed seed, the shortest ``last`` of all after that, longest first."""
    down = np.argsort(-lengths, kind="stable")
    cut = len(down) - int(len(down) * last)
    return np.concatenate([np.random.default_rng(0).permutation(down[:cut]), down[cut:]])


def sum_of_squares(lengths: np.ndarray, size: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, placed in this order; lengths are from 0 to size."""
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    count = np.zeros(size + 1, np.int64)
    used: list[int] = []
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in order.tolist():
        n = int(lengths[i])
        # Moving a bin from gap g to g - n changes the sum by 2 (count[g - n] - count[g]) + 2, without
        # the new gap's part where it is closed (0); a new bin adds 2 count[size - n] + 1.
        now = count[n:size]
        then = count[: size - n].copy()
        cost = 2 * (then - now) + 2
        if n and len(cost):
            cost[0] = 1 - 2 * now[0]
        fits = np.flatnonzero(now)
        best = int(fits[np.argmin(cost[fits])]) if len(fits) else -1
        fresh = 2 * int(count[size - n]) + 1 if n < size else 0
        if best >= 0 and (cost[best] <= fresh or n == 0):
            b = open_bins[n + best].pop()
            count[n + best] -= 1
        else:
            b = len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        gap = size - used[b]
        if gap:
            open_bins[gap].append(b)
            count[gap] += 1
    return bins, offsets


def pieces_of(docs: DataFrame, vocabulary: str, end_id: int | None = END_ID, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Only documents of more than max_tokens are cut.

    Null text counts as empty, which leaves the end id alone. Repeated rows give pieces each.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for part, encoded in encode_batches(batches, vocabulary, end_id, TOGETHER, REMEMBERED, keep=False):
            at, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encoded):
                for k, a in enumerate(range(0, max(1, len(ids)), max_tokens)):
                    cut = ids[a : a + max_tokens]
                    at.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(len(cut))
                    crc.append(zlib.crc32(cut.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, scratch: Scratch, max_tokens: int = MAX_TOKENS, per_packer: int = PIECES_PER_PACKER) -> DataFrame:
    """``pieces`` with sequence_id and offset. Offsets are gapless from 0 in each sequence.

    Full pieces need no packer: each is a sequence. An empty table stays empty.
    """
    pieces = scratch.save(pieces.withColumn("piece_row", F.monotonically_increasing_id()), "pieces")
    full = pieces.where(F.col("length") >= max_tokens)
    rest = pieces.where(F.col("length") < max_tokens)
    packers = max(1, -(-rest.count() // per_packer))
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def run(key, group):
        lengths = group.column("length").to_numpy()
        bins, offsets = sum_of_squares(lengths, max_tokens, placing_order(lengths))
        ids = bins * packers + key[0].as_py()
        return group.drop_columns(["packer"]).append_column("sequence_id", pa.array(ids * 2)).append_column("offset", pa.array(offsets))

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, piece_row long, sequence_id long, offset long"
    dealt = rest.withColumn("packer", F.pmod(F.xxhash64("piece_row"), F.lit(packers)))
    packed = dealt.groupBy("packer").applyInArrow(run, schema)
    alone = full.withColumn("sequence_id", F.col("piece_row") * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(alone).drop("piece_row")


def pack_documents(docs: DataFrame, scratch: Scratch, vocabulary: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    return pack(pieces_of(docs, vocabulary, max_tokens=max_tokens), scratch, max_tokens)


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of each of ``documents``, with its place; nulls, empty texts, repeated rows and empty tables as in pieces_of() and pack()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, Scratch(spark, "pack"), vocabulary_path())
