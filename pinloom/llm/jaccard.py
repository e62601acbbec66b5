"""N-gram Jaccard join with a token-group matrix, exact.

A document's set is its distinct word n-grams, as 64-bit hashes. Two documents link if
100 * |A n B| >= percent * |A u B|. The steps, all on classes of equal sets:

1. Singleton bound. Under one order of all tokens (their hashes), linked sets share at least
   ``need`` tokens within prefixes of fixed length. So a set of which fewer prefix tokens occur in any
   other class links with nothing. Only prefixes are shuffled. Tokens that a Misra-Gries family
   sketch finds frequent are settled map-side: they count as shared.
2. Groups. Sets that share a min-hash are compared with the most typical set among them alone (no
   pairs within groups). Verified links give components. Each set's group is that of the most
   typical set with which it shares at least half of the min-hashes, linked or not, else of that with
   which it shares most, so near copies fill few groups.
3. Token-group matrix. Each group's token union is stored as (token, group). For a set, the overlap
   with a group's union bounds that with each member, so another group is opened only if it holds
   percent of the set's tokens; candidates come from the set's tokens that fewest groups hold. Opened
   groups are read in blocks of bounded size against blocks of queries.

Only pairs across components are of use, and each is searched from the smaller component, so the
bulk of a large group of near copies, being connected already, asks nothing. Every pair across
components that could link is compared, so none is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, connected_components, lean, small_batches, table, whole_row, word_hashes

N_WORDS = 5
PERCENT = 75
#: Longer prefixes ask for more shared tokens: this share of the set's size is added.
EXTRA_PERCENT = 15
PERMUTATIONS = 8
#: Prefix tokens settled map-side: so many at most, in so many rows at least. The sketch's counters bound the share of
#: rows that any other token can have, and so the largest window.
MAX_HOT, COUNTERS, LEAST_HOT = 5000, 50_000, 1000
#: Sets of a component, and queries, that are read together.
BLOCK = 2000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
_SEEDS = np.random.default_rng(7).integers(1, 2**63, PERMUTATIONS, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * _B
    h ^= h >> np.uint64(33)
    h *= _A
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, n: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of words between ASCII blanks, A-Z lower-cased.

    With fewer words the whole sequence is one n-gram; without words the set is empty.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.int64)
    h = word_hashes(words, known)
    n = min(n, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mix(out ^ h[k : k + len(out)])
    return np.unique(out.view(np.int64))


def _least(n: int, percent: int) -> int:
    """Smallest overlap that a set of n needs to link: percent of n, rounded up."""
    return -(-percent * n // 100)


def _need(n: int, percent: int) -> int:
    return 1 + EXTRA_PERCENT * _least(n, percent) // 100


def _prefix(n: int, percent: int) -> int:
    return min(n, n - _least(n, percent) + 1 + EXTRA_PERCENT * n // 100)


def least_column(n: Column, percent: int) -> Column:
    return F.floor((n * percent + 99) / 100).cast("long")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    cuts = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat.astype(np.int64)))


def _sets(docs: DataFrame, n_words: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n (set size), need, cls (128-bit digest of the set), prefix (its smallest tokens)."""

    def run(batches):
        known = {}
        for batch in batches:
            sets = [shingle_set(t.as_py(), n_words, known) for t in batch.column("text")]
            n = [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()),
                    pa.array([_need(k, percent) for k in n], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() for s in sets], pa.string()),
                    _lists([s[: _prefix(len(s), percent)] for s in sets]),
                ],
                ["doc_id", "text_hash", "n", "need", "cls", "prefix"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return source.mapInArrow(lean(run), f"doc_id {kind}, text_hash long, n long, need long, cls string, prefix array<long>")


def _full_sets(docs: DataFrame, n_words: int) -> DataFrame:
    """cls, tokens (sorted), keys (a min-hash for each permutation)."""

    def run(batches):
        known = {}
        for batch in batches:
            sets = [s for t in batch.column("text") if len(s := shingle_set(t.as_py(), n_words, known))]
            keys = [np.array([_mix(s.view(np.uint64) ^ seed).min() for seed in _SEEDS], np.uint64).view(np.int64) for s in sets]
            cls = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() for s in sets], pa.string())
            yield pa.RecordBatch.from_arrays([cls, _lists(sets), _lists(keys)], ["cls", "tokens", "keys"])

    return docs.select("text").mapInArrow(lean(run), "cls string, tokens array<long>, keys array<long>")


def _settled(rows: DataFrame, hot: np.ndarray, counts: np.ndarray) -> DataFrame:
    """row, c, prefix without hot tokens, and their number k and summed counts: those need no shuffle."""

    def run(batches):
        for batch in batches:
            cells = batch.column("prefix")
            cuts, flat = np.asarray(cells.offsets), np.asarray(cells.values)
            at = np.searchsorted(hot, flat)
            is_hot = (at < len(hot)) & (hot[np.minimum(at, len(hot) - 1)] == flat) if len(hot) else np.zeros(len(flat), bool)
            weight = np.where(is_hot, counts[np.minimum(at, len(hot) - 1)], 0) if len(hot) else np.zeros(len(flat), np.int64)
            before = np.concatenate([[0], np.cumsum(is_hot)])
            sums = np.concatenate([[0], np.cumsum(weight)])
            left = cuts - before[cuts]
            cold = pa.ListArray.from_arrays(pa.array((left - left[0]).astype("i4")), pa.array(flat[cuts[0] : cuts[-1]][~is_hot[cuts[0] : cuts[-1]]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("c"), cold, pa.array((before[cuts[1:]] - before[cuts[:-1]]).astype("i8")), pa.array((sums[cuts[1:]] - sums[cuts[:-1]]).astype("i8"))],
                ["row", "c", "prefix", "k", "weight"],
            )

    return rows.mapInArrow(lean(run), "row long, c long, prefix array<long>, k long, weight long")


def _candidates(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Classes that the singleton bound leaves: cls, node (a number for the class), rep (a doc_id of it), n, typical."""
    sketch = f"approx_top_k(token, {MAX_HOT}, {COUNTERS})"
    rows = sets.where("n > 0")
    top = rows.select(F.explode("prefix").alias("token")).agg(F.expr(sketch).alias("top")).select(F.explode("top").alias("t"))
    frequent = top.select("t.item", F.col("t.count").cast("long").alias("n")).where(F.col("n") >= LEAST_HOT).orderBy("item").collect()
    settled = _settled(rows.select("row", F.xxhash64("cls").alias("c"), "prefix"), np.array([r[0] for r in frequent], np.int64), np.array([r[1] for r in frequent], np.int64))
    w = Window.partitionBy("token")
    cold = settled.select("row", "c", F.explode("prefix").alias("token")).select("row", F.min("c").over(w).alias("a"), F.max("c").over(w).alias("b"), F.count("c").over(w).alias("weight"))
    shared = cold.where("a <> b").select("row", F.lit(1).cast("long").alias("k"), "weight")
    found = shared.unionByName(settled.where("k > 0").select("row", "k", "weight")).groupBy("row").agg(F.sum("k").alias("k"), F.sum("weight").alias("weight"))
    return scratch.save(
        rows.select("row", "doc_id", "cls", "n", "need").join(found, "row").where("k >= need")
        .groupBy("cls").agg(F.min("row").alias("node"), F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.max(F.col("weight") / F.col("n")).alias("typical")),
        "candidate-classes",
    )


def _linked(a: str, b: str, percent: int) -> Column:
    inter = F.size(F.array_intersect(a, b))
    return inter * 100 >= (F.size(a) + F.size(b) - inter) * percent


def _led(full: DataFrame, percent: int) -> DataFrame:
    """(node, leader, n, m, typical, shared): the most typical sets of those with a set's min-hashes, and in how many."""
    keyed = full.select("node", "n", "typical", F.posexplode("keys").alias("r", "key"))
    leader = keyed.groupBy("r", "key").agg(F.max(F.struct("typical", "node", "n")).alias("top"), F.count("node").alias("size")).where("size > 1")
    led = keyed.join(leader, ["r", "key"]).select("node", "n", F.col("top.node").alias("leader"), F.col("top.n").alias("m"), F.col("top.typical").alias("typical"))
    return led.groupBy("node", "leader", "n", "m", "typical").agg(F.count(F.lit(1)).alias("shared"))


def _star_links(full: DataFrame, led: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) of sets with leaders."""
    pairs = led.where((F.col("node") != F.col("leader")) & (F.least("n", "m") * 100 >= F.greatest("n", "m") * percent)).select(F.col("node").alias("a"), F.col("leader").alias("b"))
    one = full.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    two = full.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(one, "a").join(two, "b").where(_linked("x", "y", percent)).select("a", "b")


def _across_groups(full: DataFrame, scratch: Scratch, percent: int) -> DataFrame | None:
    """(node, group) of other groups that the bound leaves for a set.

    Only sets of which percent of the tokens occur in other groups can link across groups, on either
    side, so groups stand here for those of their members alone.
    """
    tokens = full.select("node", "group", "rank.comp", F.explode("tokens").alias("token"))
    ends = [f(c).alias(f"{n}_{c}") for c in ("group", "comp") for f, n in ((F.min, "a"), (F.max, "b"))]
    wide = tokens.groupBy("token").agg(*ends).where("a_group <> b_group and a_comp <> b_comp").select("token")
    wide = scratch.save(wide, "wide-tokens")
    shared = scratch.save(tokens.drop("comp").join(broadcast_if_small(wide, wide.count()), "token", "left_semi"), "shared-tokens")
    able = (
        shared.groupBy("node").agg(F.count("token").alias("k")).join(full.select("node", "n", "rank", F.col("group").alias("own")), "node")
        .withColumn("least", least_column(F.col("n"), percent)).where("k >= least")
    )
    able = scratch.save(able, "able")
    n_able = able.count()
    if not n_able:
        return None
    shared = scratch.save(shared.join(broadcast_if_small(able.drop("own"), n_able), "node"), "able-tokens")
    tops = able.groupBy(F.col("own").alias("group")).agg(F.max("rank").alias("top"), F.min("least").alias("lo"), F.max("n").alias("hi"))
    matrix = scratch.save(shared.select("token", "group").distinct().join(tops, "group"), "matrix")
    spread = matrix.groupBy("token").agg(F.count("group").alias("groups"), F.max("top").alias("highest"))
    # A set asks only groups with members of components larger than its own.
    place = F.row_number().over(Window.partitionBy("node").orderBy("groups", "token"))
    first = shared.join(spread, "token").withColumn("place", place).where("place <= k - least + 1 and groups > 1 and highest > rank")
    # Members of linkable sizes: each set's size is at least what the other needs.
    other = matrix.select("token", F.col("group").alias("asked"), "top", "lo", "hi")
    pairs = first.join(other, "token").where("asked <> group and top > rank and lo <= n and hi >= least").select("node", "asked", "least").distinct()
    overlap = (
        pairs.join(shared.select("node", "token"), "node").join(other.select("token", "asked"), ["token", "asked"])
        .groupBy("node", "asked", "least").agg(F.count("token").alias("bound")).where("bound >= least")
    )
    return overlap.select("node", F.col("asked").alias("group"))


def _cross_links(full: DataFrame, scratch: Scratch, percent: int) -> DataFrame | None:
    """Links (a, b) between sets of different components, from opened groups.

    ``full`` has node, n, rank (of its component: size, then number), group, tokens. At least one link
    is returned for each set, block of a group and component in it, as more would join nothing new.
    """
    tops = full.groupBy("group").agg(F.max("rank").alias("top"), F.count("node").alias("members"))
    tops = scratch.save(tops, "group-tops")
    own = full.join(tops, "group").where("rank < top").select("node", "group")
    across = _across_groups(full, scratch, percent)
    opened = scratch.save(own if across is None else own.unionByName(across), "opened")
    if opened.limit(1).count() == 0:
        return None
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    queries = opened.groupBy("group").agg(F.count("node").alias("queries")).join(tops, "group")
    queries = scratch.save(queries.select("group", blocks("queries").alias("q"), blocks("members").alias("m")), "asked")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    block_of = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    rank = [F.col("rank.size").alias("size"), F.col("rank.comp").alias("comp")]
    sets = full.select("node", "tokens", *rank)
    left = opened.join(queries, "group").select("node", "group", block_of("q").alias("qb"), every("m").alias("mb")).join(sets, "node")
    left = left.select(*(F.col(c).alias(f"{c}_q") for c in left.columns))
    right = full.select("node", "tokens", "group", *rank).join(queries, "group").withColumn("mb", block_of("m")).select("node", "tokens", "size", "comp", "group", "mb", every("q").alias("qb"))

    def run(key, queries, members):
        at, size, comp = (members.column(c).to_numpy() for c in ("node", "size", "comp"))
        sets = members.column("tokens").combine_chunks()
        sizes = np.diff(np.asarray(sets.offsets)).astype(np.int64)
        flat = np.asarray(sets.flatten())
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        a, b = [], []
        asked = (queries.column(f"{c}_q") for c in ("node", "size", "comp", "tokens"))
        for node, my_size, my_comp, x in zip(*(c if i == 3 else c.to_pylist() for i, c in enumerate(asked))):
            x = np.asarray(x.values)
            lo, hi = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
            n = hi - lo
            hits = owner[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            inter = np.bincount(hits, minlength=len(sizes))
            larger = (size > my_size) | ((size == my_size) & (comp > my_comp))
            found = np.flatnonzero((100 * inter >= percent * (len(x) + sizes - inter)) & larger)
            for i in found[np.unique(comp[found], return_index=True)[1]]:
                a.append(node)
                b.append(int(at[i]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    keys = ["group", "mb", "qb"]
    return left.groupBy(*(f"{k}_q" for k in keys)).cogroup(right.groupBy(*keys)).applyInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, scratch: Scratch, n_words: int = N_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id (the smallest doc_id reachable by links).

    Texts without words, and null, have empty sets, link with nothing and are their own component.
    Equal sets link. A null doc_id takes part like any other but is never the smallest. Repeated rows
    are documents each; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    sets = scratch.save(_sets(docs, n_words, percent).withColumn("row", F.monotonically_increasing_id()), "sets")
    classes = _candidates(sets, scratch)
    reps = classes.select(F.col("rep").alias("__rep"))
    chosen = docs.select("doc_id", "text").join(broadcast_if_small(reps, reps.count()), F.col("doc_id").eqNullSafe(F.col("__rep")), "left_semi")
    full = scratch.save(
        _full_sets(chosen, n_words).join(classes.select("cls", "node", "n", "typical"), "cls").dropDuplicates(["cls"]).drop("cls"), "full-sets"
    )
    led = scratch.save(_led(full, percent), "led")
    links = scratch.save(_star_links(full, led, percent), "star-links")
    roots = connected_components(scratch, links, "groups")
    near = F.least("shared", F.lit(PERMUTATIONS // 2))
    group = led.groupBy("node").agg(F.max(F.struct(near, "typical", "leader")).alias("most")).select("node", F.col("most.leader").alias("leader"))
    # Leaders are grouped as well: their sets follow them.
    up = group.select(F.col("node").alias("leader"), F.col("leader").alias("up"))
    group = group.join(up, "leader", "left").select("node", F.coalesce("up", "leader").alias("group"))
    placed = full.select("node", "n", "tokens").join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    placed = placed.join(group, "node", "left").withColumn("group", F.coalesce("group", "node"))
    sizes = full.select("node").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("comp")).agg(F.count("node").alias("size"))
    placed = placed.join(sizes, "comp").select("node", "n", "tokens", "group", F.struct("size", "comp").alias("rank"))
    more = _cross_links(scratch.save(placed, "grouped"), scratch, percent)
    if more is not None:
        more = scratch.save(more, "cross-links")
        if more.limit(1).count():
            roots = connected_components(scratch, links.unionByName(more), "components")
    own = sets.groupBy("cls").agg(F.min("doc_id").alias("own"))
    rooted = classes.select("cls", "node").join(roots, "node").select("cls", "root")
    least = own.join(rooted, "cls").groupBy("root").agg(F.min("own").alias("least"))
    label = scratch.save(own.join(rooted.join(least, "root"), "cls", "left").select("cls", F.coalesce("least", "own").alias("label")), "labels")
    return sets.join(label, "cls").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("label")).alias("component_id"),
    )


def drop_near_duplicates(docs: DataFrame, scratch: Scratch, n_words: int = N_WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of each component that with the smallest doc_id.

    Documents with empty sets all stay. Rows with equal doc_id and text share their fate.
    """
    found = scratch.save(jaccard_components(docs, scratch, n_words, percent).where("n_shingles > 0"), "decisions")
    best = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("best"))
    gone = (
        found.join(best, found["component_id"].eqNullSafe(best["component_id"]))
        .where(~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))))
        .select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    )
    gone = scratch.save(gone, "gone")
    side = broadcast_if_small(gone, gone.count())
    d = docs.select(whole_row(docs))
    return d.join(side, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("row.text") == F.col("hash")), "left_anti").select("row.*")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of each of ``documents``; nulls, empty texts and tables, repeated rows as in jaccard_components()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs, Scratch(spark, "jaccard")).drop("text_hash")


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + n - 1], ' ')) AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT doc_id, w, least(5, len(w)) AS n FROM w WHERE len(w) > 0))),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least AS component_id
FROM (SELECT doc_id, min(other) AS least FROM r GROUP BY doc_id) LEFT JOIN c USING (doc_id)
"""
