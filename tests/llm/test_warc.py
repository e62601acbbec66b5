import hashlib

import pytest

from pinloom.llm import warc
from pinloom.llm.common import Scratch

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
BIG = "<p>ünï</p>" * 300


def pages():
    return [
        (1, "http://a/", "plain"),
        (2, "http://b/\r\nx", FAKE + "tail" + FAKE),
        (3, None, None),
        (4, "http://c/", BIG),
        (5, "http://d/", BIG),
        (6, "http://e/", BIG),
        (7, "u", "WARC/1.1\r\n"),
        (8, "u", "WARC/1.1\r\nWARC/1.1\r\n" * 3),
        (9, "u", FAKE * 400),
        (10, "u", FAKE * 400),
        (11, "u", "\r\n\r\n" + FAKE[:-4]),
        (12, "u", "x" * 999),
        (13, "u", "x" * 999),
        (1, "http://a/", "plain"),
        (None, "u", BIG),
    ] + [(100 + i, "u", "y" * (i * 37 % 211)) for i in range(60)]


def expected(rows, least=1000):
    keep = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= least and i is not None:
            keep[h] = max(keep.get(h, i), i)
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        k = keep.get(h)
        again = k is not None and k != i
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", k if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", ["128m", "1000b", "97b"])
def test_round_trip(spark, split):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").withColumn("sha1", __import__("pyspark").sql.functions.lit(1))
    scratch = Scratch(spark, "test")
    warc.write_warc(df.coalesce(2), scratch.path("warc"), scratch)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = warc.page_records(warc.read_warc(spark, scratch.path("warc"), scratch)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(tuple, got), key=str) == expected(pages())


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    scratch = Scratch(spark, "test")
    warc.write_warc(df, scratch.path("warc"), scratch)
    assert warc.read_warc(spark, scratch.path("warc"), scratch).count() == 0
