"""Suffix-array deduplication of repeated byte strings over a whole corpus.

Every string of a given length has an anchor: the position of the smallest hash among its grams of
GRAM bytes, which depends on its bytes alone, so all occurrences of a repeated string share an anchored
gram. Only grams that occur twice are followed up. Suffixes at their anchors, with the bytes before
them, are sorted by (gram, suffix): a sparse suffix array, dealt out by gram.

A stack scan of the common-prefix lengths of neighbours walks the array's common-prefix interval
tree bottom-up. At each interval, occurrences of different children agree to the right by exactly
the interval's length; their extension to the left is tested among neighbours in left order, smaller
child into larger. An occurrence that agrees with another far enough in all is a member of a maximal
repeat, and the extent of agreement is recorded for every member, whichever it agrees with.
maximal_repeats() gives the groups themselves: for each interval and each set of its members that agree to
the left, tested for diverse extensions on both sides, the string and all its occurrences.

Bytes go where LENGTH of them agree. Shorter agreements, from PASSAGE_BYTES, are reported where they
hold PASSAGE_WORDS words: passages of that many words often have fewer than LENGTH bytes.

Equal texts, and equal contexts of an anchor, are aggregated before they travel. A gram with more than
MAX_CONTEXTS different contexts isn't scanned in one task: its windows are counted by hash, which is
exact too and combines map-side. Cores that many windows share are counted first, so that only windows
around repeated cores are.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import Scratch, broadcast_if_small, lean, small_batches, table

LENGTH = 400
GRAM = 48
#: A passage: a string of so many bytes, and words between ASCII blanks, that also starts elsewhere.
PASSAGE_BYTES, PASSAGE_WORDS = 256, 50
MAX_CONTEXTS = 100_000
#: Bytes of spans or grams that may be broadcast.
BROADCAST_BYTES = 64 << 20

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BYTES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
_CHUNK = 8 << 20  # positions in a chunk fit in 24 bits
_LOW = np.uint64((1 << 24) - 1)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * _A) ^ (b * _B)
    h ^= h >> np.uint64(29)
    return h * _A


def gram_hashes(data: bytes, gram: int) -> np.ndarray:
    """A 64-bit hash of each run of ``gram`` bytes, by doubling."""
    h = _BYTES[np.frombuffer(data, np.uint8)]
    out, have, size = None, 0, 1
    while True:
        if gram & size:
            out = h if out is None else _join(h[: len(h) - have], out[size:])
            have += size
        size *= 2
        if size > gram:
            return out[: len(data) - gram + 1]
        h = _join(h[: -(size // 2)], h[size // 2 :])


def _sliding_least(x: np.ndarray, want: int) -> np.ndarray:
    size = 1
    while size * 2 <= want:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (want - size)], x[want - size :]) if want > size else x


def _chosen(h: np.ndarray, want: int) -> np.ndarray:
    """The place of the least hash in each run of ``want`` of them.

    Of equal ones it is the first, or the last where they lie nearer to the run's start: as the runs move
    over the ends of periodic text, their choice stays where it is.
    """
    at = np.arange(len(h), dtype=np.uint64)
    top = h & ~_LOW
    first = (_sliding_least(top | at, want) & _LOW).astype(np.int64)
    places = np.unique(first)
    padded = np.concatenate([top, np.zeros(want, np.uint64)])  # zeros may look like ties, which costs time alone
    ahead = np.lib.stride_tricks.sliding_window_view(padded[1:], want - 1)[places] if want > 1 else np.zeros((len(places), 0), np.uint64)
    if not (ahead == top[places][:, None]).any():
        return first
    last = _CHUNK_LAST - (_sliding_least(top | (_LOW - at), want) & _LOW).astype(np.int64)
    start = np.arange(len(first))
    return np.where(first - start < start + want - 1 - last, last, first)


_CHUNK_LAST = (1 << 24) - 1


def _periodic(data: bytes, at: np.ndarray, h: np.ndarray, want: int, least: int) -> list[tuple[int, int, int]]:
    """(first, end, period) of maximal periodic stretches of ``least`` bytes and two periods at least, around anchors of equal grams that lie close."""
    near = np.flatnonzero((h[1:] == h[:-1]) & (np.diff(at) < want))
    if not len(near):
        return []
    x = np.frombuffer(data, np.uint8)
    breaks: dict[int, np.ndarray] = {}
    out: list[tuple[int, int, int]] = []
    for i in near.tolist():
        p, period = int(at[i]), int(at[i + 1] - at[i])
        if out and out[-1][2] == period and out[-1][0] <= p < out[-1][1]:
            continue
        if period not in breaks:
            breaks[period] = np.flatnonzero(x[:-period] != x[period:])
        k = int(np.searchsorted(breaks[period], p))
        first = int(breaks[period][k - 1]) + 1 if k else 0
        end = (int(breaks[period][k]) if k < len(breaks[period]) else len(x) - period) + period
        if end - first >= least + 2 * period:
            out.append((first, end, period))
    return out


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM, back: int = LENGTH - GRAM, ahead: int = LENGTH) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(position, gram hash) of the anchor of every string of ``length`` bytes, each once; and long periodic stretches.

    A stretch of period p that is longer than any context by p covers itself, as each string in it starts
    p bytes on too. Of the anchors that only strings inside it have, one stays, whose whole context lies
    inside it: it agrees with any other such string as far as the stretch goes.
    """
    at, found, runs = [], [], []
    want = length - gram + 1
    for a in range(0, max(0, len(data) - length + 1), _CHUNK):
        part = data[a : a + _CHUNK + length - 1]
        h = gram_hashes(part, gram)
        chosen = _chosen(h, want)
        p = np.unique(chosen)
        for first, end, _ in _periodic(part, p, h[p], want, back + ahead):
            runs.append((a + first, a + end))
            inside = chosen[first : end - length + 1]
            whole = inside[(inside >= first + back) & (inside <= end - ahead)]
            if len(whole):
                chosen[first : end - length + 1] = whole[0]
        p = np.unique(chosen)
        at.append(p + a)
        found.append(h[p].view(np.int64))
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    at, found = np.concatenate(at), np.concatenate(found)
    at, first = np.unique(at, return_index=True)
    return at, found[first], runs


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] agrees, a[:hi] doesn't
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def scan_intervals(lefts: list[bytes], rights: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each anchored suffix the extents (before, after) over which it agrees with another, of ``length`` or more in all.

    ``rights`` are in order; ``lefts`` are the bytes before the anchors, reversed.
    """
    m = len(rights)
    found: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    order = sorted(range(m), key=lefts.__getitem__)
    rank = [0] * m
    for r, i in enumerate(order):
        rank[i] = r

    def test(x: int, y: int, deep: int) -> None:
        i, j = order[x], order[y]
        need = max(0, length - deep)
        if lefts[i][:need] == lefts[j][:need] and len(lefts[i]) >= need and len(lefts[j]) >= need:
            n = need + common_prefix(lefts[i][need:], lefts[j][need:])
            for k in (i, j):
                if (n, deep) not in found[k][-2:]:
                    found[k].append((n, deep))

    def close(stack: list) -> None:
        """Joins the last interval to the one before it: their members agree over ``deep`` bytes."""
        deep, top = stack.pop()
        small, large = sorted((top, stack[-1][1]), key=len)
        for x in small:
            p = bisect_left(large, x)
            if p:
                test(large[p - 1], x, deep)
            if p < len(large):
                test(x, large[p], deep)
        if len(small) * 16 < len(large):
            for x in small:
                insort(large, x)
        else:
            large += small
            large.sort()
        stack[-1][1] = large

    stack: list = []
    for i in range(m):
        deep = common_prefix(rights[i - 1], rights[i]) if i else 0
        while len(stack) > 1 and stack[-1][0] > deep:
            close(stack)
        stack.append([deep, [rank[i]]])
    while len(stack) > 1:
        close(stack)
    return found


def maximal_groups(lefts: list[bytes], rights: list[bytes], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """(before, after, members) of each maximal repeat of ``length`` or more around the anchors.

    ``rights`` are in order, ``lefts`` reversed, pairs of them distinct. All members agree over before + after
    bytes, and neither longer string does: some differ just before it, and some just after it.
    """
    m = len(rights)
    lcp = [0, *(common_prefix(rights[i - 1], rights[i]) for i in range(1, m))]
    todo = [(0, m)] if m > 1 else []
    while todo:
        lo, hi = todo.pop()
        deep = min(lcp[lo + 1 : hi])
        cuts = [lo, *(i for i in range(lo + 1, hi) if lcp[i] == deep), hi]
        todo += [(a, b) for a, b in zip(cuts, cuts[1:]) if b - a > 1]
        child = {i: k for k, (a, b) in enumerate(zip(cuts, cuts[1:])) for i in range(a, b)}
        order = sorted(range(lo, hi), key=lefts.__getitem__)
        # The interval tree of what agrees to the left; each node with the first of its members in ``order``.
        stack: list[list[int]] = []
        for at in range(1, len(order) + 1):
            n = common_prefix(lefts[order[at - 1]], lefts[order[at]]) if at < len(order) else -1
            first = at - 1
            while stack and stack[-1][0] > n:
                size, first = stack.pop()
                members = order[first:at]
                if size + deep >= length and len({child[i] for i in members}) > 1:
                    yield size, deep, members
            if n >= 0 and (not stack or stack[-1][0] < n):
                stack.append([n, first])


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


SPANS = "array<struct<first:long,end:long>>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def _texts(docs: DataFrame) -> DataFrame:
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", data.alias("data")).withColumn("cls", F.sha2("data", 256))


def _anchor_table(texts: DataFrame, length: int, gram: int, back: int, ahead: int) -> DataFrame:
    """doc_id, cls, n_bytes, words (of texts of up to 4 times ``length`` bytes), grams (distinct anchored ones), own (those at several places in the text), runs (long periodic stretches)."""

    def run(batches):
        for batch in batches:
            n, words, grams, own, runs = [], [], [], [], []
            for x in batch.column("data"):
                data = x.as_py()
                _, g, periodic = anchors(data, length, gram, back, ahead)
                g, k = np.unique(g, return_counts=True)
                runs.append([{"first": a, "end": b} for a, b in periodic])
                n.append(len(data))
                words.append(len(data.split()) if len(data) <= 4 * length else len(data))
                grams.append(g)
                own.append(g[k > 1])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("cls"), pa.array(n, pa.int64()), pa.array(words, pa.int64()), pa.array(grams, kind), pa.array(own, kind), pa.array(runs, _SPANS)],
                ["doc_id", "cls", "n_bytes", "words", "grams", "own", "runs"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(lean(run), f"doc_id {kind}, cls string, n_bytes long, words long, grams array<long>, own array<long>, runs {SPANS}")


def _contexts(wanted: DataFrame, length: int, gram: int, back: int, ahead: int) -> DataFrame:
    """cls, gram, ctx (hash), positions (of anchors with this context), words (of contexts of fewer than ``ahead`` bytes), before (reversed), after.

    Anchors are those of strings of ``length``; contexts reach ``back`` bytes before and ``ahead`` bytes on.
    """

    def run(batches):
        names = ["cls", "gram", "ctx", "positions", "words", "before", "after"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
        for batch in batches:
            rows = []
            for cls, x, grams in zip(batch.column("cls").to_pylist(), batch.column("data"), batch.column("wanted")):
                data = x.as_py()
                at, h, _ = anchors(data, length, gram, back, ahead)
                keep = np.isin(h, np.array(grams.as_py(), np.int64))
                places: dict[tuple[int, bytes, int], list[int]] = {}
                for p, g in zip(at[keep].tolist(), h[keep].tolist()):
                    start = max(0, p - back)
                    places.setdefault((g, data[start : p + ahead], p - start), []).append(p)
                for (g, around, cut), positions in places.items():
                    ctx = xxhash.xxh64_intdigest(around, cut) - (1 << 63)
                    words = len(around.split()) if len(around) < ahead else 0
                    rows.append((cls, g, ctx, positions, words, around[:cut][::-1], around[cut:]))
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return wanted.select("cls", "data", "wanted").mapInArrow(lean(run), "cls string, gram long, ctx long, positions array<long>, words long, before binary, after binary")


EXTENTS = "array<struct<before:long,after:long,whole:boolean>>"


def _by_gram(distinct: DataFrame, scan, schema: str) -> DataFrame:
    """Rows that ``scan(gram, rows of gram, ctx, before, after)`` makes of each gram's part of the sorted suffixes, group after group."""

    def groups(batches):
        gram, part = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "ctx", "before", "after"))):
                if row[0] != gram:
                    if len(part) > 1:
                        yield gram, part
                    gram, part = row[0], []
                part.append(row)
        if len(part) > 1:
            yield gram, part

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        rows = []
        for gram, part in groups(batches):
            for row in scan(gram, part):
                rows.append(row)
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)

    ordered = distinct.select("gram", "ctx", "before", "after").repartition("gram").sortWithinPartitions("gram", "after")
    return ordered.mapInArrow(lean(run), schema)


def _scanned(distinct: DataFrame, length: int, passage: tuple[int, int]) -> DataFrame:
    """gram, ctx, extents of agreement over ``length`` bytes (whole), or over a passage."""
    least, words = passage

    def scan(gram, part):
        found = scan_intervals([r[2] for r in part], [r[3] for r in part], least)
        for (_, ctx, before, after), extents in zip(part, found):
            kept = []
            for a, b in extents:
                if a + b >= length or len((before[:a][::-1] + after[:b]).split()) >= words:
                    kept.append({"before": a, "after": b, "whole": a + b >= length})
            if kept:
                yield {"gram": gram, "ctx": ctx, "extents": kept}

    return _by_gram(distinct, scan, f"gram long, ctx long, extents {EXTENTS}")


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _twice(rows: DataFrame, keys: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Those of ``rows`` whose keys occur twice; keys are counted map-side first."""
    rows = scratch.save(rows, f"{name}-rows")
    twice = scratch.save(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(*keys), f"{name}-twice")
    return rows.join(broadcast_if_small(twice, twice.count()), keys, "left_semi")


def _repeated_windows(distinct: DataFrame, scratch: Scratch, size: int, gram: int, name: str) -> DataFrame:
    """(gram, ctx, starts): by how many bytes before the anchor windows of ``size`` start that other contexts have too, lying alike.

    Windows are counted by the core that neighbouring ones share, then those around repeated cores by longer ones.
    """
    blocks, gram_bytes = None, gram
    coarse, stride = 0, 1 << max(0, (size // 5).bit_length() - 1)
    while stride != coarse:
        source = distinct.withColumn("starts", F.lit(None).cast("array<int>")) if blocks is None else distinct.join(blocks, ["gram", "ctx"])

        def run(batches, stride=stride, coarse=coarse):
            for batch in batches:
                out: tuple[list, list, list, list] = ([], [], [], [])
                for gram, ctx, before, after, starts in zip(*(batch.column(c).to_pylist() for c in ("gram", "ctx", "before", "after", "starts"))):
                    data, cut = before[::-1] + after, len(before)
                    lo, hi = max(0, cut + size - len(data)), min(cut, size - gram_bytes)
                    wide = [(0, size)] if starts is None else [(b, b + coarse) for b in starts]
                    for a, z in wide:
                        for b in range(a, min(z, hi + 1), stride):
                            # what the windows that start b to b + stride - 1 bytes before the anchor share
                            if b + stride > lo:
                                core = data[max(0, cut - b) : cut - b - stride + 1 + size]
                                for x, v in zip(out, (gram, ctx, b, hashlib.blake2b(core, digest_size=16).digest())):
                                    x.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], ["gram", "ctx", "start", "core"])

        rows = source.select("gram", "ctx", "before", "after", "starts").mapInArrow(lean(run), "gram long, ctx long, start int, core binary")
        again = _twice(rows, ["gram", "start", "core"], scratch, f"{name}-{stride}")
        blocks = scratch.save(again.groupBy("gram", "ctx").agg(F.collect_list("start").alias("starts")), f"{name}-{stride}")
        scratch.drop(f"{name}-{stride}-rows")
        scratch.drop(f"{name}-{stride}-twice")
        coarse, stride = stride, max(1, stride // 8)  # powers of two, so that blocks nest
    return blocks


def _cut_out(distinct: DataFrame, starts: DataFrame, size) -> DataFrame:
    """gram, ctx, before, after, repeat (digest) of the strings at ``starts``, whose length ``size(bytes from the start on)`` gives, or None."""

    def run(batches):
        for batch in batches:
            out: tuple[list, list, list, list, list] = ([], [], [], [], [])
            for gram, ctx, before, after, starts in zip(*(batch.column(c).to_pylist() for c in ("gram", "ctx", "before", "after", "starts"))):
                data, cut = before[::-1] + after, len(before)
                for b in starts:
                    if (n := size(data[cut - b :])) is not None:
                        for x, v in zip(out, (gram, ctx, b, n - b, _digest(data[cut - b : cut - b + n]))):
                            x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["gram", "ctx", "before", "after", "repeat"])

    rows = distinct.join(starts, ["gram", "ctx"]).select("gram", "ctx", "before", "after", "starts")
    return rows.mapInArrow(lean(run), "gram long, ctx long, before long, after long, repeat string")


def _counted(distinct: DataFrame, scratch: Scratch, length: int, gram: int, passage: tuple[int, int]) -> DataFrame:
    """gram, ctx, extents for grams of very many contexts: windows are counted by hashes of their bytes.

    Passages count as the shortest string from each start that is one. Windows that meet make one extent.
    """
    least, words = passage
    distinct = scratch.save(distinct, "hot-contexts")
    kinds = to_arrow_schema(StructType.fromDDL(f"gram long, ctx long, extents {EXTENTS}"))

    def united(whole):
        def run(batches):
            for batch in batches:
                rows = []
                for gram, ctx, parts in zip(*(batch.column(c).to_pylist() for c in ("gram", "ctx", "parts"))):
                    spans = merged((-x["before"], x["after"]) for x in parts)
                    rows.append({"gram": gram, "ctx": ctx, "extents": [{"before": -a, "after": b, "whole": whole} for a, b in spans]})
                yield pa.RecordBatch.from_pylist(rows, kinds)

        return lambda df: df.mapInArrow(lean(run), f"gram long, ctx long, extents {EXTENTS}")

    starts = _repeated_windows(distinct, scratch, length, gram, "hot-whole")
    part = lambda b: F.struct(b.cast("long").alias("before"), (F.lit(length) - b).cast("long").alias("after"))
    whole = united(True)(starts.select("gram", "ctx", F.transform("starts", part).alias("parts")))
    if least >= length:
        return whole
    starts = _repeated_windows(distinct, scratch, least, gram, "hot-least")
    some = _twice(_cut_out(distinct, starts, lambda data: passage_size(data[:length], least, words)), ["gram", "before", "repeat"], scratch, "hot-passages")
    return whole.unionByName(united(False)(some.groupBy("gram", "ctx").agg(F.collect_list(F.struct("before", "after")).alias("parts"))))


def passage_size(data: bytes, least: int, words: int) -> int | None:
    """Bytes of the shortest start of ``data`` that has ``least`` bytes and ``words`` words, None if it has none."""
    if len(data) < least:
        return None
    have = len(data[:least].split())
    if have >= words:
        return least
    if len(data.split()) < words:
        return None
    lo, hi = least, len(data)  # too few words, enough
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if len(data[:mid].split()) < words else (lo, mid)
    return hi


def _sparse_array(docs: DataFrame, scratch: Scratch, length: int, gram: int, back: int, ahead: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, contexts, distinct): classes of equal texts, contexts of anchors whose grams occur twice, and those contexts once."""
    small_batches(docs.sparkSession, 256)
    texts = _texts(docs)
    table_ = scratch.save(_anchor_table(texts, length, gram, back, ahead), "anchors")
    classes = scratch.save(
        table_.where(F.col("n_bytes") >= length).groupBy("cls")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n_bytes", "words", "grams", "own", "runs"))),
        "classes",
    )
    scratch.drop("anchors")
    grams = classes.select("cls", F.explode("grams").alias("gram"))
    twice = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("gram")
    twice = scratch.save(twice.unionByName(classes.select(F.explode("own").alias("gram"))).distinct(), "grams")
    wanted = grams.join(broadcast_if_small(twice, twice.count()), "gram", "left_semi").groupBy("cls").agg(F.collect_list("gram").alias("wanted"))
    wanted = scratch.save(wanted.join(classes.select("cls", "rep"), "cls"), "wanted")
    size = wanted.agg(F.sum(F.size("wanted") * 8 + 100)).first()[0] or 0
    side = F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted
    side = side.withColumnRenamed("cls", "__cls")
    chosen = texts.join(side, (texts["cls"] == side["__cls"]) & texts["doc_id"].eqNullSafe(side["rep"]))
    contexts = scratch.save(_contexts(chosen, length, gram, back, ahead), "contexts", "zstd")  # contexts of neighbouring anchors overlap
    distinct = contexts.groupBy("gram", "ctx").agg(F.sum(F.size("positions")).alias("k"), *(F.first(c).alias(c) for c in ("words", "before", "after")))
    return classes.drop("grams", "own"), contexts, scratch.save(distinct, "distinct", "zstd")


def _hot(distinct: DataFrame, scratch: Scratch, max_contexts: int) -> tuple[DataFrame, DataFrame | None]:
    """``distinct`` in two: of grams that one task can scan, and of those with more contexts, None if there are none."""
    counts = distinct.groupBy("gram").agg(F.count(F.lit(1)).alias("m"))
    many = scratch.save(counts.where(F.col("m") > max_contexts).select("gram"), "many")
    n = many.count()
    if not n:
        return distinct, None
    side = broadcast_if_small(many, n)
    return distinct.join(side, "gram", "left_anti"), distinct.join(side, "gram", "left_semi")


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, max_contexts: int = MAX_CONTEXTS, passage: tuple[int, int] | None = (PASSAGE_BYTES, PASSAGE_WORDS)) -> DataFrame:
    """cls (SHA-256 of a text), spans, n_passages.

    spans, [(first, end) bytes], is what strings of ``length`` bytes that start elsewhere too cover.
    n_passages is the number of maximal runs of what these and passages cover.
    """
    passage = min(passage or (length, 0), (length, 0))
    least, words = passage
    classes, contexts, distinct = _sparse_array(docs, scratch, least, gram, length - gram, length)
    few, hot = _hot(distinct, scratch, max_contexts)
    extents = _scanned(few, length, passage)
    if hot is not None:
        extents = extents.unionByName(_counted(hot, scratch, length, gram, passage))
    size = (F.length("before") + F.length("after")).cast("long")
    same = distinct.where((F.col("k") > 1) & ((size >= length) | (size >= least) & (F.col("words") >= words))).select(
        "gram", "ctx", F.array(F.struct(F.length("before").cast("long").alias("before"), F.length("after").cast("long").alias("after"), (size >= length).alias("whole"))).alias("extents")
    )
    extents = scratch.save(extents.unionByName(same), "extents")
    e = lambda p, x: F.struct((p - x["before"]).alias("first"), (p + x["after"]).alias("end"), x["whole"].alias("whole"))
    spans = (
        contexts.select("cls", "gram", "ctx", F.explode("positions").alias("p")).join(extents, ["gram", "ctx"])
        .select("cls", F.explode(F.transform("extents", lambda x: e(F.col("p"), x))).alias("s"))
    )
    long = F.col("n_bytes") >= length
    full = classes.where((F.col("copies") > 1) & (long | (F.col("words") >= words))).select("cls", F.struct(F.lit(0).cast("long").alias("first"), F.col("n_bytes").alias("end"), long.alias("whole")).alias("s"))
    periodic = classes.select("cls", F.explode("runs").alias("s")).select("cls", F.struct("s.first", "s.end", F.lit(True).alias("whole")).alias("s"))
    collected = spans.unionByName(full).unionByName(periodic).groupBy("cls").agg(F.collect_set("s").alias("spans"))

    def merge(batches):
        for batch in batches:
            found = batch.column("spans").to_pylist()
            spans = [[{"first": a, "end": b} for a, b in merged((s["first"], s["end"]) for s in x if s["whole"])] for x in found]
            n = [len(merged((s["first"], s["end"]) for s in x)) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(spans, _SPANS), pa.array(n, pa.int64())], ["cls", "spans", "n_passages"])

    return scratch.save(collected.mapInArrow(lean(merge), f"cls string, spans {SPANS}, n_passages long"), "spans")


def maximal_repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, max_contexts: int = MAX_CONTEXTS, reach: int | None = None) -> DataFrame:
    """Maximal repeats of ``length`` bytes or more with all their occurrences, one row each: repeat (a digest of the string), length, doc_id, first.

    A repeat that goes on for more than ``reach`` bytes (4 times ``length``) before or after an anchor is given cut there. Of
    grams with more than ``max_contexts`` contexts the repeated strings of exactly ``length`` bytes are given.
    Periodic stretches longer than twice the reach hold one occurrence. Equal texts are occurrences of each other; null,
    empty and short texts have none.
    """
    reach = 4 * length if reach is None else reach
    classes, contexts, distinct = _sparse_array(docs, scratch, length, gram, reach, reach)
    few, hot = _hot(distinct, scratch, max_contexts)

    def scan(gram, part):
        lefts, rights = [r[2] for r in part], [r[3] for r in part]
        for before, after, members in maximal_groups(lefts, rights, length):
            one = members[0]
            name = _digest(lefts[one][:before][::-1] + rights[one][:after])
            for i in members:
                yield {"gram": gram, "ctx": part[i][1], "repeat": name, "before": before, "length": before + after}

    columns = ["gram", "ctx", "repeat", "before", "length"]
    found = _by_gram(few, scan, "gram long, ctx long, repeat string, before long, length long").select(*columns)
    total = (F.col("before") + F.col("after")).alias("length")
    if hot is not None:
        hot = scratch.save(hot, "hot-contexts")
        found = found.unionByName(_cut_out(hot, _repeated_windows(hot, scratch, length, gram, "hot-whole"), lambda data: length).select("gram", "ctx", "repeat", "before", total))
    same = distinct.where((F.col("k") > 1) & (F.length("before") + F.length("after") >= length))
    same = _cut_out(same, same.select("gram", "ctx", F.array(F.length("before")).alias("starts")), len)
    found = found.unionByName(same.select("gram", "ctx", "repeat", "before", total))
    places = contexts.select("cls", "gram", "ctx", F.explode("positions").alias("p")).join(found, ["gram", "ctx"])
    full = classes.where("copies > 1").select("cls", F.col("cls").alias("repeat"), F.col("n_bytes").alias("length"), F.lit(0).cast("long").alias("first"))
    places = places.select("cls", "repeat", "length", (F.col("p") - F.col("before")).alias("first")).unionByName(full).distinct()
    return places.join(_texts(docs).select("doc_id", "cls"), "cls").select("repeat", "length", "doc_id", "first")


def remove_repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, max_contexts: int = MAX_CONTEXTS, passage: tuple[int, int] | None = (PASSAGE_BYTES, PASSAGE_WORDS)) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans, n_removed, n_spans, kept (the remaining bytes), n_passages.

    Null counts as empty; texts of fewer than ``length`` bytes lose nothing. Repeated rows and equal
    texts are occurrences of each other. An empty table gives an empty result.
    """
    spans = repeated_spans(docs, scratch, length, gram, max_contexts, passage)
    size = spans.agg(F.sum(F.size("spans") * 16 + 100)).first()[0] or 0
    joined = _texts(docs).join(F.broadcast(spans) if size <= BROADCAST_BYTES else spans, "cls", "left")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n, removed, kept = [], [], []
            for x, s in zip(batch.column("data"), batch.column("spans").to_pylist()):
                data, at, parts = x.as_py(), 0, []
                for y in s or ():
                    parts.append(data[at : y["first"]])
                    at = y["end"]
                parts.append(data[at:])
                n.append(len(data))
                removed.append(sum(y["end"] - y["first"] for y in s or ()))
                kept.append(b"".join(parts))
            cells = pa.array([s or [] for s in batch.column("spans").to_pylist()], _SPANS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), cells, pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), batch.column("n_passages").fill_null(0)],
                ["doc_id", "n_bytes", "spans", "n_removed", "kept", "n_passages"],
            )

    schema = f"doc_id {kind}, n_bytes long, spans {SPANS}, n_removed long, kept binary, n_passages long"
    out = joined.select("doc_id", "data", "spans", "n_passages").mapInArrow(lean(run), schema)
    return out.withColumn("n_spans", F.size("spans").cast("long"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages and repeated (whether there are any) of each of ``documents``.

    n_passages counts maximal runs of what is removed and of shorter repeated passages of PASSAGE_WORDS words, which
    stay. Nulls, empty texts, repeated rows and empty tables as in remove_repeats().
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = remove_repeats(docs, Scratch(spark, "repeats"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", (F.col("n_passages") > 0).alias("repeated"))
