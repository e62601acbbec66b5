"""The quality classifier against models in plain dictionaries."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pinloom.llm import quality
from pinloom.llm.common import Scratch
from tests.llm.conftest import docs_frame

VOCABULARY = "alpha beta gamma delta of the été x9 !! *".split()


def grams(text):
    words = re.findall(rb"[a-z\x80-\xff]+|[0-9]|[^\sa-z0-9\x80-\xff]+", (text or "").encode().lower())
    return words, [*zip(words, words[1:])]


def brute(rows, good, held, sharpness, clean_loss, long_loss, least):
    """(id, text) -> (weight, key, kept) from counts by words and pairs themselves."""
    count = {(side, kind): [Counter(), Counter()] for side in ("raw", "target") for kind in ("tokens", "types")}
    for i, t in rows:
        for half, found in enumerate(grams(t)):
            for side in ("raw", "target") if i in good else ("raw",):
                count[side, "tokens"][half].update(found)
                count[side, "types"][half].update(set(found))

    def ratio(kind, half, g):
        raw, target = count["raw", kind][half], count["target", kind][half]
        if not target:
            return 0.0
        s = quality.SMOOTHING[kind]
        return math.log((target[g] + s) / (raw[g] * sum(target.values()) / sum(raw.values()) + s))

    def parts(text):
        words, pairs = grams(text)
        if not words:
            return 0.0, 0.0
        tokens = [ratio("tokens", 0, w) + (ratio("tokens", 1, pairs[k - 1]) if k else 0) for k, w in enumerate(words)]
        types = [ratio("types", 0, w) if w not in words[:k] else 0.0 for k, w in enumerate(words)]
        runs = lambda x, n: min(sum(x[k : k + n]) for k in range(max(1, len(x) - n + 1)))
        return runs(tokens, quality.RUN["tokens"]), runs(types, quality.RUN["types"])

    found = [(i, t, *parts(t)) for i, t in rows]
    lowest = lambda values, share: -sorted(values)[max(0, math.ceil(share * len(values)) - 1)]

    def unit(k, text):
        length = len(grams(text)[0]).bit_length()
        best = max(1.0, lowest([r[k] for r in found if r[0] in held], clean_loss))
        for c in range(length + 1):
            values = [r[k] for r in found if r[0] in held and len(grams(r[1])[0]).bit_length() == c]
            if len(values) >= least:
                best = max(best, lowest(values, long_loss))
        return best

    weights = [min(a / unit(2, t), b / unit(3, t)) for _, t, a, b in found]
    keys = [sharpness * w + quality.noise(i, t) for (i, t), w in zip(rows, weights)]
    k = sum(w >= -1 for w in weights)
    limit = -math.inf if k >= len(keys) else sorted(keys, reverse=True)[k - 1] if k else math.inf
    return weights, keys, [x >= limit for x in keys]


@pytest.mark.parametrize(("sharpness", "clean_loss", "long_loss", "least"), [(1.0, 0.2, 0.02, 100), (20.0, 0.3, 0.05, 3)])
def test_against_plain_counts(spark, sharpness, clean_loss, long_loss, least):
    rng = random.Random(5)
    texts = []
    for i in range(150):
        t = [rng.choice(VOCABULARY) for _ in range(rng.randrange(0, 60))]
        texts.append(" ".join([*t, *rng.choices(["Spoiled", "junk***"], k=4)] if i % 5 == 0 else t))
    texts += ["", None, " \n", texts[3], texts[5]]
    df = docs_frame(spark, texts)
    some = df.limit(6).collect()
    extra = [(None, "alpha no id", *some[0][2:]), *some, *some[:2]]  # a null id, repeated rows
    df = spark.createDataFrame([*df.collect(), *extra], df.schema).repartition(3)
    labels = spark.createDataFrame([(i, int(i % 5 != 0), int(i % 10 == 0)) for i in range(0, 150, 2)] + [(None, 1, 0), (2, 1, 0), (7, None, None), (9, 1, None)], "doc_id long, quality long, toxic long")
    named = quality._labelled(labels, Scratch(spark, "test"), 1000).collect()
    assert {r.id for r in named} == {i for i in range(0, 150, 2) if i % 5} | {9}
    good, held = {r.id for r in named if not r.held}, {r.id for r in named if r.held}
    assert good and held
    rows = [(r.doc_id, r.text) for r in df.collect()]
    weights, keys, kept = brute(rows, good, held, sharpness, clean_loss, long_loss, least)
    want = sorted(((str(r[0]), w, k) for r, w, k in zip(rows, weights, kept)), key=lambda x: x[:2])
    options = {"sharpness": sharpness, "clean_loss": clean_loss, "long_loss": long_loss, "least": least}
    got = sorted(((str(r.doc_id), r.log_weight, r.kept) for r in quality.resample(df, labels, Scratch(spark, "test"), **options).collect()), key=lambda x: x[:2])
    assert [(a, k) for a, _, k in got] == [(a, k) for a, _, k in want] and 0 < sum(kept) < len(kept)
    assert [w for _, w, _ in got] == pytest.approx([w for _, w, _ in want], abs=1e-4)
    left = quality.drop_rejected(df, labels, Scratch(spark, "test"), **options)
    assert sorted(map(str, left.collect())) == sorted(str(r) for r, k in zip(df.collect(), _by_row(df, rows, kept)) if k)


def _by_row(df, rows, kept):
    fate = {(i, t): k for (i, t), k in zip(rows, kept)}
    return [fate[r.doc_id, r.text] for r in df.collect()]


def test_clashing_names(spark):
    """Columns named like those that the operator makes stay as they are."""
    df = docs_frame(spark).select("doc_id", "text", F.lit(1).alias("tokens"), F.lit("x").alias("noise"), F.lit(2.5).alias("log_weight"), F.lit(3).alias("gumbel_key"), F.lit(None).cast("int").alias("types"), F.lit("h").alias("id"), F.lit(0).alias("bucket"))
    labels = spark.createDataFrame([(0, 1, 0, "t"), (1, 1, 0, "t")], "doc_id long, quality long, toxic long, text string")
    left = quality.drop_rejected(df, labels, Scratch(spark, "test"), buckets=1 << 12)
    assert left.columns == df.columns
    found = left.collect()
    assert found and not {*map(str, found)} - {*map(str, df.collect())}


def test_ties_at_the_limit_stay(spark):
    df = docs_frame(spark, ["alpha beta gamma"] * 5 + ["spoiled spoiled spoiled"] * 5, [1] * 5 + [2] * 5)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality long, toxic long")
    rows = quality.resample(df, labels, Scratch(spark, "test"), buckets=1 << 12).collect()
    assert len({(r.doc_id, r.gumbel_key) for r in rows}) == 2 and len({(r.doc_id, r.kept) for r in rows}) == 2


def test_scale_widens_with_length(spark):
    """Classes with too few documents take the scale of shorter ones, and no scale is narrower than a shorter class's."""
    rows = [(5, -2.0, 0.0)] * 90 + [(6, -3.0, 0.0)] * 4 + [(8, -5.0, -6.0)] * 10 + [(9, -4.0, 0.0)] * 10
    held = spark.createDataFrame(rows, "length int, tokens double, types double")
    units = quality._units(held, 0.3, 0.1, 10)
    assert units["tokens"] == [2.0] * 8 + [5.0] * 25 and units["types"] == [1.0] * 8 + [6.0] * 25
    assert quality._units(held.limit(0), 0.3, 0.1, 10) == {k: [1.0] * 33 for k in ("tokens", "types")}
