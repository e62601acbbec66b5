import hashlib
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pinloom.llm import repeats
from pinloom.llm.common import Scratch
from tests.llm.conftest import docs_frame


def brute(rows, length, passage):
    count = Counter()
    data = [(d, (t or "").encode()) for d, t in rows]
    for _, x in data:
        count.update(x[i : i + length] for i in range(len(x) - length + 1))
    # passages: from each start the shortest string of enough bytes and words, if it is no longer than length
    least, words = passage
    short = lambda x, i: next((x[i : i + n] for n in range(least, min(length, len(x) - i) + 1) if len(x[i : i + n].split()) >= words), None)
    passages = Counter(s for _, x in data for i in range(len(x)) if (s := short(x, i)))
    out = []
    for d, x in data:
        gone, found = bytearray(len(x)), bytearray(len(x))
        for i in range(len(x)):
            if i + length <= len(x) and count[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
            if (s := short(x, i)) and passages[s] > 1:
                found[i : i + len(s)] = b"\1" * len(s)
        kept = bytes(b for b, g in zip(x, gone) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(x), sum(gone), runs, hashlib.sha256(kept).hexdigest(), any(gone) or any(found)))
    return sorted(out, key=str)


def check(spark, df, length, gram, passage, **more):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = repeats.remove_repeats(df, Scratch(spark, "test"), length, gram, passage=passage, **more).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest(), r.n_passages > 0) for r in got), key=str) == brute(rows, length, passage)
    assert all(r.n_passages >= (r.n_spans > 0) for r in got)


def corpus(seed):
    rng = random.Random(seed)
    some = lambda n, letters="abé ": "".join(rng.choice(letters) for _ in range(n))
    parts = [some(rng.randrange(20, 90)) for _ in range(8)]
    texts = ["".join(rng.choice(parts) if rng.random() < 0.5 else some(rng.randrange(0, 60), "abcdefgh") for _ in range(rng.randrange(1, 8))) for _ in range(40)]
    return [*texts, "ab" * 200, "a" * 300, "a" * 39, "a" * 40, texts[0], texts[1][3:], None, "", texts[2] + texts[2]]


@pytest.mark.parametrize(("seed", "more"), [(1, {}), (2, {}), (3, {"max_contexts": 2}), (4, {"max_contexts": 2})])
def test_against_brute_force(spark, seed, more):
    check(spark, docs_frame(spark, corpus(seed)), 40, 8, (26, 3), **more)


@pytest.mark.parametrize(("seed", "more"), [(5, {}), (6, {"max_contexts": 2})])
def test_periodic_texts(spark, seed, more):
    """Stretches of every length, alone, in common and at the edges of other text."""
    rng = random.Random(seed)
    units = ["the ", "of of ", "a", "xyz", "é "]
    some = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 50)))
    shared = [some() for _ in range(4)]
    texts = [rng.choice(["", some(), rng.choice(shared)]) + rng.choice(units) * rng.randrange(0, 60) + rng.choice(["", some(), rng.choice(shared)]) for _ in range(70)]
    check(spark, docs_frame(spark, texts), 40, 8, (26, 3), **more)


def test_odd_texts(spark):
    check(spark, docs_frame(spark), 400, 48, (256, 50))
    check(spark, docs_frame(spark).limit(0), 400, 48, (256, 50))


def test_passages(spark):
    """Of 50 words and fewer than 400 bytes: found, but not removed."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8)))
    words = lambda n: " ".join(word() for _ in range(n))
    passages = [words(n) for n in (50, 52, 55, 40)]
    texts = [f"{words(60)} {passages[i % 4]} {words(70)}" for i in range(12)] + [words(200) for _ in range(5)] + [passages[0]]
    assert all(256 <= len(p) < 400 for p in passages[:3])
    got = {r.doc_id: r for r in repeats.remove_repeats(docs_frame(spark, texts), Scratch(spark, "test")).collect()}
    assert [got[i].n_passages for i in range(18)] == [int(i % 4 < 3) for i in range(12)] + [0] * 5 + [1]
    assert not any(r.n_removed for r in got.values())


def test_passage_size():
    text = b"a bc  def " * 6
    for least in range(1, 60):
        for words in range(20):
            want = next((n for n in range(least, len(text) + 1) if len(text[:n].split()) >= words), None)
            assert repeats.passage_size(text, least, words) == want


def every_repeat(texts, length):
    """string -> occurrences, of all maximal repeats; a text's ends are unlike any other's."""
    places = defaultdict(set)
    for d, x in enumerate(texts):
        for i in range(len(x)):
            for j in range(i + length, len(x) + 1):
                places[x[i:j]].add((d, i))
    out = {}
    for w, found in places.items():
        before = {texts[d][i - 1 : i] or (d, "start") for d, i in found}
        after = {texts[d][i + len(w) : i + len(w) + 1] or (d, "end") for d, i in found}
        if len(found) > 1 and len(before) > 1 and len(after) > 1:
            out[hashlib.sha256(w).hexdigest(), len(w)] = found
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_maximal_repeats(spark, seed):
    """Every maximal repeat with every occurrence, against all substrings."""
    rng = random.Random(seed)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randrange(8, 20))) for _ in range(5)]
    texts = ["".join(rng.choice(parts) if rng.random() < 0.6 else rng.choice("abcd") * rng.randrange(1, 5) for _ in range(5)) for _ in range(14)]
    texts += [texts[0], texts[1][2:], "a" * 30, "ab" * 12, "", "é" * 9]
    df = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "doc_id long, text string").repartition(2)
    got = defaultdict(list)
    for r in repeats.maximal_repeats(df, Scratch(spark, "test"), 12, 4, reach=200).collect():
        got[r.repeat, r.length].append((r.doc_id, r["first"]))
    assert all(len(v) == len({*v}) for v in got.values())
    assert {k: {*v} for k, v in got.items()} == every_repeat([t.encode() for t in texts], 12)


def test_maximal_repeats_of_hot_grams(spark):
    """Strings of exactly the length, where a gram has more contexts than one task takes."""
    texts = [f"{i:03}" * 5 + "the very same passage here" + f"{i:03}" * 5 for i in range(9)]
    df = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    rows = repeats.maximal_repeats(df, Scratch(spark, "test"), 20, 4, max_contexts=3).collect()
    places = {(r.doc_id, r["first"]) for r in rows if r.length == 20}
    assert places == {(d, i) for d in range(9) for i in range(15, 24)}  # the numbers begin alike
    assert repeats.maximal_repeats(df.limit(0), Scratch(spark, "test")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=8), st.text("ab", max_size=8)), min_size=2, max_size=12), st.integers(4, 12))
def test_scan_finds_every_extent(pairs, length):
    """Against all pairs: the bytes that agree over ``length`` with some other suffix."""
    pairs = sorted({(a.encode(), b"g" + b.encode()) for a, b in pairs}, key=lambda x: x[1])
    lefts, rights = [a for a, _ in pairs], [b for _, b in pairs]
    found = repeats.scan_intervals(lefts, rights, length) if len(pairs) > 1 else [[]]
    for i in range(len(pairs)):
        want, got = set(), set()
        for j in range(len(pairs)):
            if i != j:
                a, b = repeats.common_prefix(lefts[i], lefts[j]), repeats.common_prefix(rights[i], rights[j])
                if a + b >= length:
                    want |= set(range(-a, b))
        for a, b in found[i]:
            got |= set(range(-a, b))
        assert got == want
