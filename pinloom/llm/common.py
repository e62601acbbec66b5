"""Shared helpers: scratch tables in the cluster's shared folder, sources, components."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_package

#: Used only where the session names no shared folder (tests, a laptop).
FALLBACK_DIR = "/tmp/checkpoints"
#: Rows a side may have to be broadcast: each row counted here is at most about 120 bytes, so 60 MB.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named in spark.checkpoint.dir; set only where unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = FALLBACK_DIR
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Before Python code runs on executors: they get it, and Arrow batches of few rows, as single texts may be very long."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for mapInArrow, after which memory goes back to the system: workers outlive their tasks and would keep it.

    Arrays of a megabyte or more are mapped one by one, so that they can go back at once.
    """

    def wrapped(batches):
        libc = _libc()
        if libc is not None:
            libc.mallopt(_MMAP_THRESHOLD, 1 << 20)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if libc is not None:
                libc.malloc_trim(0)

    return wrapped


_MMAP_THRESHOLD = -3


def _libc() -> ctypes.CDLL | None:
    """The C library, where it has glibc's controls."""
    libc = ctypes.CDLL(None)
    return libc if hasattr(libc, "malloc_trim") and hasattr(libc, "mallopt") else None


class Scratch:
    """Tables of one operator run, written to the shared folder: they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/pinloom-{name}-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        df.write.mode("overwrite").option("compression", compression).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        _remove(self.spark, self.path(name))

    def close(self) -> None:
        _remove(self.spark, self.root)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone: nothing to remove it with
        return


def word_hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of words. ``known`` is a task's own memory of them, gone with the task."""
    if len(known) > 300_000:
        known.clear()
    h = np.empty(len(words), np.uint64)
    get = known.get
    for i, w in enumerate(words):
        x = get(w)
        if x is None:
            x = known[w] = xxhash.xxh64_intdigest(w)
        h[i] = x
    return h


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; pure ASCII takes the byte-wise path of lower()."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one struct ``row``, beside which an operator's own columns clash with no name."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns)).alias("row")


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only for a side whose counted rows fit; else Spark's own choice of join."""
    return F.broadcast(df) if rows <= limit else df


def connected_components(scratch: Scratch, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b): root is the smallest node reachable.

    Labels move along edges as minima (combined map-side, so a star's centre is no hot key) and
    then jump to their label's label, so chains shorten by powers. Each round is written to the
    shared folder; it ends when no label changes.
    """
    both = edges.select("a", "b").where("a <> b")
    both = scratch.save(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = (
            both.join(labels, F.col("b") == F.col("node"))
            .groupBy(F.col("a").alias("n"))
            .agg(F.min("root").alias("r"))
        )
        moved = labels.join(near, F.col("node") == F.col("n")).select("node", F.col("root").alias("was"), F.least("root", "r").alias("root"))
        up = moved.select(F.col("node").alias("up"), F.col("root").alias("up_root"))
        jumped = moved.join(up, F.col("root") == F.col("up")).select("node", F.least("root", "up_root").alias("root"), "was")
        new = scratch.save(jumped, f"{name}-{step}")
        changed = new.where("root <> was").limit(1).count()
        scratch.drop(f"{name}-{step - 1}")
        labels = new.select("node", "root")
        if not changed:
            scratch.drop(f"{name}-edges")
            return labels
