"""WARC archives: written as splittable text, read back by boundary-chain verification.

Writing: each page is one record; of equal payloads of at least MIN_REVISIT bytes that with the
largest page_id is a response and the others are revisits that refer to it. Files go out through
Spark's own writer, so they can lie in any store that Spark reaches.

Reading: files are cut at the magic line, splits in parallel, so every fragment starts at a
candidate record. Each candidate whose header parses gives an edge from its offset to its
successor's. Runs of candidates that follow one another are contracted to segments, and pointer
jumping over segments, from the start of each file, doubles the distance it sees in each round.
Only records on that chain are real; a magic line inside a payload is not reached, and the payload
it cuts is put together again. Payloads are digested where they are read and don't travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, table

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
MIN_REVISIT = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def records_of(pages: DataFrame, scratch: Scratch, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, sha1, bytes, keep: keep is the page_id that a revisit refers to, else null.

    Groups of equal payloads, one narrow row each, are counted and then broadcast if they are few.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", "url", html.alias("html")).withColumn("sha1", F.sha1(F.encode("html", "UTF-8"))).withColumn("bytes", F.octet_length("html"))
    groups = (
        pages.where(F.octet_length("html") >= min_revisit)
        .groupBy(F.sha1(F.encode("html", "UTF-8")).alias("sha1"))
        .agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1 and keep is not null")
        .drop("copies")
    )
    groups = scratch.save(groups, "groups")
    return p.join(broadcast_if_small(groups, groups.count()), "sha1", "left").withColumn("keep", F.when(~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep")))


def write_warc(pages: DataFrame, path: str, scratch: Scratch, min_revisit: int = MIN_REVISIT) -> None:
    """One record per page. Null html is an empty payload; repeated rows (equal page_id and payload) are all responses."""
    r = records_of(pages, scratch, min_revisit)
    revisit = F.col("keep").isNotNull()
    http = F.concat(F.lit(HTTP + "\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    uri = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _record_id(F.col("page_id")),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _record_id(F.col("keep")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    r.select(F.concat(head, block).alias("value")).write.mode("overwrite").option("lineSep", END).text(path)


def _header(name: str) -> Column:
    return F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)


def _parsed(df: DataFrame) -> DataFrame:
    """``value`` (what follows a magic line) taken apart as a record; body_* only where it is a whole one."""
    df = df.withColumn("head", F.substring_index("value", END, 1)).withColumn("size", F.octet_length("value").cast("long"))
    df = df.withColumn("head_size", F.octet_length("head").cast("long") + len(END))
    df = df.withColumn("content", F.when(F.col("head_size") <= F.col("size"), F.expr("try_cast(regexp_extract(head, '(?i)(?:^|\\r\\n)Content-Length:[ \\t]*([0-9]+)[ \\t]*(?:\\r\\n|$)', 1) as bigint)")))
    df = df.withColumn("warc_type", _header("WARC-Type")).withColumn("record_id", _header("WARC-Record-ID"))
    df = df.withColumn("content", F.when((F.col("warc_type") != "") & (F.col("record_id") != ""), F.col("content")))
    df = df.withColumn("whole", F.coalesce(F.col("size") == F.col("head_size") + F.col("content") + len(END), F.lit(False)))
    bytes_ = F.expr("substring(cast(value as binary), cast(head_size + 1 as int), cast(content as int))")
    df = df.withColumn("block_bytes", F.when(F.col("whole"), bytes_))
    http = F.octet_length(F.substring_index(F.col("block_bytes").cast("string"), END, 1))
    payload = F.expr(f"substring(block_bytes, http_size + {len(END) + 1}, octet_length(block_bytes))")
    df = df.withColumn("http_size", http).withColumn("payload", payload)
    return df.select(
        *[c for c in df.columns if c in ("file", "block", "row", "value", "hash")],
        "size", "head_size", "content", "whole", "warc_type", "record_id",
        _header("WARC-Target-URI").alias("target_uri"), _header("WARC-Refers-To").alias("refers_id"),
        F.regexp_replace(_header("WARC-Payload-Digest"), "(?i)^sha1:", "").alias("digest"),
        "payload",
    )


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """file, block, row, value: what lies between magic lines, in file order by (block, row)."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")


def _offsets(df: DataFrame) -> DataFrame:
    """``at``: the offset of each fragment's magic line; -1 where a file begins without one. Windows spill, they hold no payloads."""
    n = len(MAGIC)
    w = Window.partitionBy("file").orderBy("block", "row").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("at", F.coalesce(F.sum(F.col("size") + n).over(w) - n, F.lit(-1)))


def read_warc(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """One row per real record: file, at, warc_type, record_id, target_uri, refers_id, digest, payload_bytes, payload_sha1.

    A file without a record at its start has none. A record cut off by the file's end is left out.
    """
    n = len(MAGIC)
    parsed = _parsed(_fragments(spark, path))
    narrow = parsed.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_sha1", F.sha1("payload"))
    # What the tasks emit: candidates with their sizes and digests.
    candidates = scratch.save(narrow.withColumn("hash", F.xxhash64("value")).drop("payload", "value"), "fragments")
    placed = _offsets(candidates).where("at >= 0 and content is not null").withColumn("next", F.col("at") + n + F.col("head_size") + F.col("content") + len(END))
    by_file = Window.partitionBy("file").orderBy("at")
    cut = F.coalesce((F.lag("next").over(by_file) != F.col("at")).cast("long"), F.lit(1))
    records = scratch.save(placed.withColumn("cut", cut).withColumn("segment", F.sum("cut").over(by_file)), "candidates")
    exits = records.groupBy("file", "segment").agg(F.max_by("next", "at").alias("exit"))
    landing = records.select("file", F.col("at").alias("exit"), F.col("segment").alias("to"))
    edges = scratch.save(exits.join(landing, ["file", "exit"]).select("file", "segment", "to", "exit"), "segment-edges")
    reached = _jump(records.where("at = 0").select("file", "segment"), edges, scratch)
    entry = (
        reached.join(edges, ["file", "segment"]).select("file", F.col("to").alias("segment"), F.col("exit").alias("entry"))
        .unionByName(records.where("at = 0").select("file", "segment", F.lit(0).cast("long").alias("entry")))
    )
    real = records.join(entry, ["file", "segment"]).where("at >= entry")
    columns = ["file", "at", "warc_type", "record_id", "target_uri", "refers_id", "digest", "payload_bytes", "payload_sha1"]
    whole = real.where("whole").select(*columns)
    torn = scratch.save(real.where("not whole").select("file", "at", "next"), "torn")
    if torn.limit(1).count() == 0:
        return whole
    return whole.unionByName(_mended(spark, path, candidates, torn, scratch).select(*columns))


def _jump(start: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Segments reached from the files' first ones: (file, segment)."""
    reached = scratch.save(start, "reached-0")
    jump = edges.select("file", "segment", "to")
    seen, step = reached.count(), 0
    while True:
        step += 1
        onward = reached.join(jump, ["file", "segment"]).select("file", F.col("to").alias("segment"))
        new = scratch.save(reached.unionByName(onward).distinct(), f"reached-{step}")
        count = new.count()
        if count == seen:
            return new
        twice = jump.select("file", F.col("segment").alias("a"), F.col("to").alias("segment")).join(jump, ["file", "segment"])
        jump = scratch.save(twice.select("file", F.col("a").alias("segment"), "to"), f"jump-{step}")
        reached, seen = new, count


def _mended(spark: SparkSession, path: str, candidates: DataFrame, torn: DataFrame, scratch: Scratch) -> DataFrame:
    """Records whose payload holds magic lines, put together from their fragments.

    Their places come from ``candidates``, without payloads; the files are then read for the fragments in those
    records alone, found by size and hash, so no others travel.
    """
    files = torn.select("file").distinct()
    placed = _offsets(candidates.join(broadcast_if_small(files, files.count()), "file", "left_semi")).select("file", "at", "size", "hash")
    marked = placed.join(torn, ["file", "at"], "left").withColumn("first", F.when(F.col("next").isNotNull(), F.struct("at", "next")))
    owner = F.last("first", ignorenulls=True).over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    parts = scratch.save(marked.withColumn("owner", owner).where("owner is not null and at < owner.next").drop("next", "first"), "torn-parts")
    keys = parts.select("file", "size", "hash").distinct()
    raw = _fragments(spark, path).withColumn("size", F.octet_length("value").cast("long")).withColumn("hash", F.xxhash64("value"))
    wanted = raw.join(broadcast_if_small(keys, keys.count()), ["file", "size", "hash"], "left_semi").groupBy("file", "size", "hash").agg(F.first("value").alias("value"))
    joined = parts.join(wanted, ["file", "size", "hash"]).groupBy("file", F.col("owner.at").alias("at")).agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("parts"))
    value = F.array_join(F.transform("parts", lambda p: p["value"]), MAGIC)
    mended = _parsed(joined.select(F.struct("file", "at").alias("file"), value.alias("value"))).where("whole")
    return mended.select(
        "file.file", "file.at", "warc_type", "record_id", "target_uri", "refers_id", "digest",
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_sha1"),
    )


def _page(record_id: str) -> Column:
    return F.expr(f"try_cast(regexp_extract({record_id}, '^<urn:x-page:(.*)>$', 1) as bigint)")


def page_records(records: DataFrame) -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest, record_type, refers_to. Revisits take their size from the record they refer to."""
    responses = records.where("warc_type = 'response'").select(_page("record_id").alias("page_id"), "payload_bytes", F.col("payload_sha1").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    revisits = records.where("warc_type = 'revisit'").select(_page("record_id").alias("page_id"), "digest", "refers_id")
    sizes = records.where("warc_type = 'response'").groupBy(F.col("record_id").alias("refers_id")).agg(F.max("payload_bytes").alias("payload_bytes"))
    found = revisits.join(sizes, "refers_id", "left").select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), _page("refers_id").alias("refers_to"))
    return responses.unionByName(found)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each of ``pages``, read back from the archives.

    Null html is an empty payload; repeated rows, null urls and empty tables as in write_warc() and read_warc().
    """
    scratch = Scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), scratch.path("warc"), scratch)
    return page_records(read_warc(spark, scratch.path("warc"), scratch))


OP3_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, CASE WHEN payload_bytes >= {MIN_REVISIT} THEN max(page_id) OVER (PARTITION BY payload_digest) END AS keep FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keep <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keep <> page_id THEN keep END AS refers_to
FROM k
"""
