import random
from collections import defaultdict

import pytest

from pinloom.llm import jaccard
from pinloom.llm.common import Scratch
from tests.llm.conftest import docs_frame


def brute(rows, percent=75):
    def grams(t):
        w = (t or "").encode().lower().split()
        n = min(5, len(w))
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset()

    sets = [grams(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for x in least[root(i)] if x is not None]
        out.append((d, len(sets[i]), min(ids) if sets[i] and ids else d))
    return sorted(out, key=str)


def check(spark, texts, **more):
    df = docs_frame(spark, texts, **more)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = jaccard.jaccard_components(df, Scratch(spark, "test")).drop("text_hash").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def edited(rng, words, share):
    out = list(words)
    for i in rng.sample(range(len(out)), max(1, int(len(out) * share))):
        out[i] = f"edit{rng.randrange(10**6)}"
    return out


def corpus(seed, chain):
    """Near copies at many distances, chains whose ends don't link, shared passages, short texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(20, 120))]
        for _ in range(6):
            texts.append(" ".join(edited(rng, base, rng.choice([0.01, 0.02, 0.03, 0.04, 0.06, 0.1]))))
        if chain:
            for _ in range(8):
                base = edited(rng, base, 0.02)
                texts.append(" ".join(base))
    for _ in range(25):
        texts.append(" ".join([word() for _ in range(rng.randrange(0, 30))] + passage + [word() for _ in range(rng.randrange(0, 12))]))
    texts += ["a b c", "A b  c", "a b", "", None, "a b c d e", "a b c d e", "a b c d e f"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    check(spark, corpus(seed, chain=seed % 2 == 1))


def test_small_blocks_and_one_permutation(spark, monkeypatch):
    """With little help from groups, the token-group matrix finds what they miss."""
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "_star_links", lambda full, led, percent: full.select(jaccard.F.col("node").alias("a"), jaccard.F.col("node").alias("b")).limit(0))
    check(spark, corpus(4, chain=True))


def test_singleton_groups(spark, monkeypatch):
    """Without groups and star links, every link comes from the bound across groups."""
    empty = lambda full, percent: full.select("node", jaccard.F.col("node").alias("leader"), "n", jaccard.F.col("n").alias("m"), "typical", jaccard.F.lit(1).cast("long").alias("shared"))
    monkeypatch.setattr(jaccard, "_led", empty)
    check(spark, corpus(5, chain=True))


def test_hot_tokens(spark, monkeypatch):
    """Tokens of three documents count as hot; the result stays the same."""
    monkeypatch.setattr(jaccard, "LEAST_HOT", 3)
    check(spark, corpus(6, chain=True))


def test_odd_texts(spark):
    df = docs_frame(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = jaccard.jaccard_components(df, Scratch(spark, "test")).drop("text_hash").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    kept = jaccard.drop_near_duplicates(df, Scratch(spark, "test"))
    assert kept.columns == df.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    first = {}
    for d, n, c in brute(rows):
        first.setdefault((d, n, c), None)
    assert set(ids) == {d for d, n, c in first if n == 0 or d == c}


def test_empty(spark):
    df = docs_frame(spark).limit(0)
    assert jaccard.jaccard_components(df, Scratch(spark, "test")).count() == 0
    assert jaccard.drop_near_duplicates(df, Scratch(spark, "test")).count() == 0
