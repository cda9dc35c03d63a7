"""Samples, pages, newest files and shared scans."""

from __future__ import annotations

from contextlib import contextmanager
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import hadoop_path
from millrace.sources.formats import read_files


def sample_rows(df: DataFrame, n: int) -> tuple[DataFrame, bool]:
    """The first `n` rows and whether there are more, learned from one row beyond."""
    truncated = df.limit(n + 1).count() > n
    return df.limit(n), truncated


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of a total order. Spark keeps the best offset+limit rows per task; there is no full sort."""
    return df.orderBy(*order).offset(offset).limit(limit)


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """`path, modified_at, bytes` of every file below a path; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("bytes"))
    )


def newest_files(spark: SparkSession, path: str, k: int) -> DataFrame:
    """The `k` files modified last, newest first."""
    return file_listing(spark, path).orderBy(F.desc("modified_at"), F.desc("path")).limit(k)


def probe_prefixes(base: str, template: str, as_of: datetime) -> list[str]:
    """Places to look for recent files: today, one and three days back, this month, the base."""
    days = [as_of - timedelta(days=d) for d in (0, 1, 3)]
    month = template.split("%d")[0].rstrip("/").rsplit("/", 1)[0] if "%d" in template else template
    places = [f"{base.rstrip('/')}/{d.strftime(template)}" for d in days]
    return [*places, f"{base.rstrip('/')}/{as_of.strftime(month)}", base]


def sample_newest(
    spark: SparkSession,
    base: str,
    fmt: str,
    k: int = 3,
    n: int = 100,
    template: str | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """Rows from the newest files, looking first where a date layout would put them."""
    places = probe_prefixes(base, template, as_of or datetime.utcnow()) if template else [base]
    for place in places:
        fs, jpath = hadoop_path(spark, place)
        if not fs.exists(jpath):
            continue
        files = [row["path"] for row in newest_files(spark, place, k).collect()]
        if files:
            return read_files(spark, files, fmt, base).limit(n)
    raise FileNotFoundError(f"no files below {base}")


@contextmanager
def shared_scan(df: DataFrame, readers: int):
    """Keep an input in memory and on disk while two or more stages read it."""
    if readers < 2:
        yield df
        return
    kept = df.persist()
    try:
        yield kept
    finally:
        kept.unpersist()
