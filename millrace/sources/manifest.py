"""Which files a consumer has read: files that arrive late, in partitions already read, are seen.

A cursor over partition values skips what lands behind it. A manifest instead keeps the files read, and a read takes those
of the listing that it does not hold, oldest first and a bounded number at a time. A file that is written again under its
name (another time or size) is a new file. Rows of the manifest are written only after the outputs are: a crash in between
repeats a batch and never skips one.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import freeze, hadoop_path, scratch_path, session_conf
from millrace.sources.formats import read_files, read_path
from millrace.sources.sampling import file_listing

MANIFEST_SCHEMA = "consumer string, input string, path string, modified_at timestamp, bytes bigint, read_at timestamp"
#: Files of one batch; their paths pass through the driver, as Spark plans a scan by path.
MAX_FILES = 1000
_FILE = ["path", "modified_at", "bytes"]


class FileManifest:
    """Append-only record of the files read, by consumer and input."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def rows(self) -> DataFrame:
        fs, jpath = hadoop_path(self.spark, self.path)
        if not fs.exists(jpath):
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        return self.spark.read.schema(MANIFEST_SCHEMA).parquet(self.path)

    def of(self, consumer: str, source: str) -> DataFrame:
        return self.rows().where((F.col("consumer") == consumer) & (F.col("input") == source))

    def add(self, consumer: str, source: str, files: DataFrame) -> None:
        """Call only after the outputs are committed."""
        named = files.select(F.lit(consumer).alias("consumer"), F.lit(source).alias("input"), *_FILE, F.current_timestamp().alias("read_at"))
        named.coalesce(1).write.mode("append").parquet(self.path)

    def unread(self, consumer: str, source: str, suffix: str = "") -> DataFrame:
        """Files below a path that the consumer has not read: path, modified_at, bytes."""
        listed = file_listing(self.spark, source)
        if suffix:
            listed = listed.where(F.col("path").endswith(suffix))
        return listed.join(self.of(consumer, source).select(*_FILE), _FILE, "left_anti")


class FilesRead:
    """One batch of files: its rows, how many files, whether more are waiting, and `done` to call when it is written."""

    def __init__(self, manifest: FileManifest, consumer: str, source: str, df: DataFrame | None = None, files: DataFrame | None = None, n: int = 0, more: bool = False):
        self.df, self.n, self.more = df, n, more
        self._manifest, self._consumer, self._source, self._files = manifest, consumer, source, files

    @property
    def skipped(self) -> bool:
        return self.df is None

    def done(self) -> None:
        if self._files is not None:
            self._manifest.add(self._consumer, self._source, self._files)


def read_unread(
    manifest: FileManifest,
    consumer: str,
    source: str,
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
    max_files: int = MAX_FILES,
    suffix: str = "",
    forced: bool = False,
) -> FilesRead:
    """The rows of the oldest files below a path that the consumer has not read, partition columns as text. Nothing new is
    a skip, unless forced: then everything is read again. Force changes nothing while there is something new."""
    spark = manifest.spark
    waiting = manifest.unread(consumer, source, suffix)
    # pinned: the rows read and those of the manifest are of the same files, whatever arrives meanwhile
    batch = freeze(waiting.orderBy("modified_at", "path").limit(max_files + 1), scratch_path(spark, "files"))
    found = batch.orderBy("modified_at", "path").collect()
    with session_conf(spark, spark__sql__sources__partitionColumnTypeInference__enabled="false"):
        if not found:
            return FilesRead(manifest, consumer, source, read_path(spark, source, fmt, options) if forced else None)
        taken = found[:max_files]
        rows = read_files(spark, [r["path"] for r in taken], fmt, source, options)
    last = F.struct(*[F.lit(taken[-1][c]).alias(c) for c in ("modified_at", "path")])
    return FilesRead(manifest, consumer, source, rows, batch.where(F.struct("modified_at", "path") <= last), len(taken), len(found) > len(taken))
