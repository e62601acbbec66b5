"""The pipeline on a small fixture: each stage against brute force on its own input."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from pinloom.llm.tokens import vocabulary_path
from tests.llm.test_filters import brute_hits, lowered
from tests.llm.test_jaccard import brute as components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(9)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(30))
    item = " ".join(f"bench{i}" for i in range(20))
    texts = []
    for i in range(160):
        base = [word() for _ in range(rng.randrange(30, 80))]
        texts.append(" ".join(base))
        if i % 8 == 0:
            texts += [" ".join(base).upper(), " ".join([*base[:-1], "changed"])]
        if i % 10 == 0:
            texts.append(" ".join(base[:40]) + " " + item)
        if i % 9 == 0:
            texts.append(" ".join(rng.choice(["junk***", "IDIOT", "!!"]) for _ in range(60)))
    texts += ["", None, "tiny", "tiny", " ".join(word() for _ in range(5000))]
    rng.shuffle(texts)
    path = str(tmp_path_factory.mktemp("sf"))
    docs = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int("junk" not in (t or "").lower()), int("IDIOT" in (t or ""))) for i, t in enumerate(texts) if i % 3 == 0]
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, sf_dir, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact", "near", "decontaminate", "pack"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        if name == "pack":
            break
        assert docs.columns == COLUMNS
        kept = sorted(r.doc_id for r in after)
        assert {(r.doc_id, r.text) for r in after} <= set(before)
        if name == "quality":
            clean = [i for i, t in before if "***" not in (t or "") and "IDIOT" not in (t or "")]
            assert len(set(clean) & set(kept)) >= 0.9 * len(clean)
            assert len(set(kept) - set(clean)) <= 0.1 * (len(before) - len(clean))
        if name == "exact":
            best = {}
            for i, t in before:
                best[lowered(t)] = max(i, best.get(lowered(t), -1))
            assert kept == sorted(best.values())
        if name == "near":
            assert kept == sorted(d for d, n, c in components(before) if n == 0 or d == c)
        if name == "decontaminate":
            items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            hits = {i: brute_hits(t, items, 13) for i, t in before}
            assert kept == sorted(i for i, (n, k, _) in hits.items() if not (k and 20 * k >= n))
            assert len(kept) < len(before)
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary_path())
    want = {i: len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in before}
    got = Counter()
    for r in after:
        got[r.doc_id] += r.length
    assert got == want
    used = Counter()
    for r in after:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns[:2] == ["doc_id", "piece"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_odd_tables(spark, tmp_path):
    """Empty tables, null ids, null and repeated rows, and names used inside pass through every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, sha string, hits string"
    rows = [(None, "no id at all here", "en", None, None, "r", "s", "h"), (1, None, None, None, None, None, None, None), (1, None, None, None, None, None, None, None), (2, "", "en", "a", 0, "r", "s", "h"), (3, "plain words of a text", "en", "a", 1, "r", "s", "h"), (3, "plain words of a text", "en", "a", 1, "r", "s", "h"), (4, "Plain words of a text", "en", "b", 1, "r", "s", "h")]
    for name, data in (("some", rows), ("none", [])):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(data, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(3, 0, 1), (None, 1, 0)][: len(data)], "doc_id long, quality long, toxic long").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        docs = spark.read.parquet(f"{at}/documents.parquet")
        for step, stage in corpus_pipeline.STAGES[:-1]:
            stage(spark, docs, at).write.parquet(f"{at}/{step}")
            docs = spark.read.parquet(f"{at}/{step}")
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        assert sorted(map(str, {(r.doc_id, r.text) for r in docs.collect()})) == sorted(map(str, [(None, "no id at all here"), (2, ""), (4, "Plain words of a text")] if data else []))
        assert corpus_pipeline.run(spark, at).count() == (3 if data else 0)
