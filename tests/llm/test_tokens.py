import zlib

import numpy as np
import pytest

from pinloom.llm import tokens
from pinloom.llm.common import Scratch
from tests.llm.conftest import ODD_TEXTS, docs_frame


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


def test_encoder_equals_library(plain):
    enc = tokens.Encoder(tokens.vocabulary_path(), remembered=5)
    texts = [t or "" for t in ODD_TEXTS] + ["a,b c, d. don't it's L'été ÀÉ Ź <|endoftext|> <|ENDOFTEXT|> x.\n y,\t", "\x1c\x85\xa0 　x", "ß ﬁ İ Σς"]
    for _ in range(2):
        for t, ids in zip(texts, enc.encode(texts)):
            assert ids.tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_round_trip(spark, plain):
    docs = docs_frame(spark)
    scratch = Scratch(spark, "test")
    tokens.write_token_files(docs, scratch.path("ids"), tokens.vocabulary_path())
    files = tokens.read_token_files(spark, scratch.path("ids"))
    rows = docs.collect()
    want = sorted((r.doc_id is not None, r.doc_id or 0, [*plain.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.tokens) for r in files.collect()) == want
    got = sorted(tokens.token_index(files, scratch).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in rows), key=lambda x: (x is not None, x))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (k if has else -1, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for has, k, ids in want
    )
    one = files.where("doc_id = 3")
    assert one.count() == sum(r.doc_id == 3 for r in rows)
    assert "PushedFilters" in one._jdf.queryExecution().toString()


def test_empty(spark):
    docs = docs_frame(spark).limit(0)
    scratch = Scratch(spark, "test")
    tokens.write_token_files(docs, scratch.path("ids"), tokens.vocabulary_path())
    assert tokens.token_index(tokens.read_token_files(spark, scratch.path("ids")), scratch).count() == 0


def test_files_have_indexes_and_bloom_filters(spark):
    """In each file: stripes, row indexes and a Bloom filter on doc_id, ids as run lengths."""
    docs = spark.range(5000).selectExpr("id AS doc_id", "concat('word ', id, ' and more of them') AS text")
    scratch = Scratch(spark, "test")
    tokens.write_token_files(docs, scratch.path("ids"), tokens.vocabulary_path(), rows_per_file=2500)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(scratch.path("ids"))
    files = [s.getPath() for s in folder.getFileSystem(conf).listStatus(folder) if s.getPath().getName().endswith(".orc")]
    assert len(files) >= 2
    seen = 0
    for path in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(path, jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == tokens.ROW_INDEX_STRIDE and reader.getCompressionKind().toString() == "ZSTD"
        names = [*reader.getSchema().getFieldNames()]
        column = reader.getSchema().getChildren().get(names.index("doc_id")).getId()
        rows = reader.rows()
        for stripe in reader.getStripes():
            footer = rows.readStripeFooter(stripe)
            kinds = {(s.getColumn(), s.getKind().toString()) for s in footer.getStreamsList()}
            assert (column, "BLOOM_FILTER_UTF8") in kinds and (column, "ROW_INDEX") in kinds
            assert {c for c, k in kinds if k == "BLOOM_FILTER_UTF8"} == {column}
            assert {e.getKind().toString() for e in footer.getColumnsList()} <= {"DIRECT", "DIRECT_V2"}
            seen += 1
        rows.close()
    assert seen >= len(files)
