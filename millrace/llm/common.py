"""What the operators share: tables in the shared folder, files in it, and connected components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps
from inspect import isgeneratorfunction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import hadoop_path, scratch_path, shared_dir

#: White space of the word contracts: blank and the five ASCII controls from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query of this subpackage; without SQL it is tested against a brute-force version."""

    def register(run: Query) -> Query:
        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            shared_dir(spark)
            return run(spark, sf_dir)

        QUERIES[name] = prepared
        if sql is not None:
            ORACLE[name] = sql
        return prepared

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Parquet tables in the folder that the cluster shares. A written table cuts the lineage, fixes what a
    lost executor could otherwise compute differently, and may be dropped once its readers are done."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = scratch_path(spark, label)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(f"{name}-{uuid.uuid4().hex[:8]}")
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.written_to = path
        return out

    def drop(self, *written: DataFrame) -> None:
        for df in written:
            files, path = hadoop_path(self.spark, df.written_to)
            files.delete(path, True)

    def clear(self) -> None:
        """Drop all that was written, once nothing reads it any more."""
        files, path = hadoop_path(self.spark, self.root)
        files.delete(path, True)


def open_folder(path: str):
    """(file system, path in it) for binary files of tasks; any store that Arrow knows by its URI."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        path = "file://" + path
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)  # glibc has it


def give_back() -> None:
    """What this worker has freed goes back to the system, which Arrow and malloc put off. Workers outlive their stage, and
    an executor's memory is that of all its workers."""
    pa.default_memory_pool().release_unused()
    _TRIM(0)


def thrifty(run: Callable) -> Callable:
    """The same function of a task's batches, or of one large group; what it has freed is given back at its end."""

    @wraps(run)
    def over_batches(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    @wraps(run)
    def over_group(group):
        try:
            return run(group)
        finally:
            give_back()

    return over_batches if isgeneratorfunction(run) else over_group


def rows_of(batches: Iterator[pa.RecordBatch], most_rows: int = 512, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most_bytes`, so that long texts don't pile up in a task.

    A single row over that size comes alone."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(most_rows, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).get_total_buffer_size() > most_bytes and _sliced_bytes(batch, at, n) > most_bytes:
                n = (n + 1) // 2
            yield batch.slice(at, n)
            at += n


def at_blanks(data: bytes, most: int = 4 << 20) -> Iterator[bytes]:
    """A text in parts of about that size, cut at blanks, so that a very long one is not a list of all its words."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + most)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end


_FAST, _BACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(x: np.ndarray) -> bytes:
    """An array of integers, its bytes in planes so that equal high bytes lie together."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T) if len(x) else x
    return _FAST.compress(planes.tobytes())


def unpacked(data: bytes, dtype) -> np.ndarray:
    flat = np.frombuffer(_BACK.decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel() if len(flat) else np.empty(0, dtype)


def _sliced_bytes(batch: pa.RecordBatch, at: int, n: int) -> int:
    return batch.slice(at, n).nbytes


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node that can be reached.

    Alternates the two star steps: each node's larger neighbours are linked to its smallest neighbour, then
    each node's smaller ones are. Every step is a join and a group-by over the edges; nothing comes to the
    driver but two sums. Rounds are written tables, and the one before is dropped."""
    spark = edges.sparkSession
    now = scratch.write(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges"
    )
    before = None
    for _ in range(most_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.write(large.filter("u <> v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = scratch.write(small.select("e.u", "e.v").filter("u <> v").distinct(), "edges")
        scratch.drop(large, now)
        now = after
        sums = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if before == sums:
            roots = now.select(F.col("v").alias("u"), "v").distinct()
            return now.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = sums
    raise RuntimeError("components did not settle")
