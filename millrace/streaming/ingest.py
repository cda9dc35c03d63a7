"""New files as a bounded stream: each run takes what has arrived, a checkpoint remembers it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

MAX_FILES_PER_BATCH = 1000


def file_stream(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    fmt: str = "parquet",
    max_files: int = MAX_FILES_PER_BATCH,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Files below a path in order of arrival, at most `max_files` per batch. Late files in directories
    that were already read are seen, unlike with a partition cursor."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files)
    return reader.options(**(options or {})).load(path)


def run_available(
    df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None, path: str | None = None
) -> StreamingQuery:
    """Process everything available and stop. Either appends to a Parquet path, exactly once per file, or
    hands each batch with its id to `sink`, which must cope with a repeated id."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if sink is not None:
        query = writer.foreachBatch(sink).start()
    else:
        query = writer.format("parquet").outputMode("append").start(path)
    query.awaitTermination()
    return query


def once(stream: DataFrame, keys: Sequence[str], ts: str, within: str) -> DataFrame:
    """A stream's rows without those of a key that was seen before, for deliveries that repeat under other names. State is
    kept for as long as a copy may come after its first (`within`, in event time); rows older than that are late and left
    out, copies or not."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(list(keys))
