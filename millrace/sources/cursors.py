"""Incremental reads over partition columns, and the table that remembers how far a consumer got.

A cursor is a tuple of partition values, compared as text from left to right. Values must therefore be
zero-padded, as `month=04`. The comparisons use partition columns only, so Spark prunes directories.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import hadoop_path, local_frame, session_conf

CURSOR_SCHEMA = "consumer string, input string, cursor array<string>, updated_at timestamp"


def read_partitioned(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read a partitioned layout with its partition columns kept as text (`04` stays `04`)."""
    with session_conf(spark, spark__sql__sources__partitionColumnTypeInference__enabled="false"):
        return spark.read.format(fmt).load(path)


def _tuple(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("string") for c in columns])


def _literal(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(str(v)) for v in values])


def after_cursor(df: DataFrame, columns: Sequence[str], cursor: Sequence[str] | None) -> DataFrame:
    """Rows of the partitions beyond the cursor; every row without one."""
    if not cursor:
        return df
    return df.where(_tuple(columns) > _literal(cursor))


def in_window(df: DataFrame, columns: Sequence[str], start: Sequence[str], end: Sequence[str]) -> DataFrame:
    """Rows of the partitions in the closed window. A bound shorter than the columns covers whole
    prefixes: the end `("2026", "05")` takes in every day of that month."""
    if not start or not end:
        raise ValueError("a window read needs both bounds")
    low = _tuple(columns[: len(start)]) >= _literal(start)
    high = _tuple(columns[: len(end)]) <= _literal(end)
    return df.where(low & high)


def newest_cursor(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the greatest partition tuple among the rows, NULL when there are none."""
    return df.agg(F.max(_tuple(columns)).alias("cursor"))


def newest_partition(spark: SparkSession, path: str, columns: Sequence[str]) -> tuple[str, ...] | None:
    """The greatest partition tuple of a layout, found by listing only the greatest branch."""
    fs, jpath = hadoop_path(spark, path)
    if not columns:
        return ()
    prefix = f"{columns[0]}="
    names = [s.getPath().getName() for s in fs.listStatus(jpath) if s.isDirectory()]
    for name in sorted((n for n in names if n.startswith(prefix)), reverse=True):
        rest = newest_partition(spark, f"{path.rstrip('/')}/{name}", columns[1:])
        if rest is not None:
            return (name[len(prefix) :], *rest)
    return None


def initial_cursor(
    spark: SparkSession, path: str, columns: Sequence[str], start_from: str | None
) -> tuple[str, ...] | None:
    """Where a first run starts: `all` from the beginning, `now` after the newest partition, or a
    literal such as `2026/04/26`."""
    if start_from in (None, "", "all"):
        return None
    if start_from == "now":
        return newest_partition(spark, path, columns)
    return tuple(start_from.strip("/").split("/"))


class CursorTable:
    """Cursors by consumer and input. Each pair has a directory of its own, in which an advance writes the new cursor and
    then removes the one before: a read costs one small file, however often the cursor has moved."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _home(self, consumer: str, input_name: str) -> str:
        digest = hashlib.sha256(json.dumps([consumer, input_name]).encode()).hexdigest()
        return f"{self.path}/key={digest[:32]}"

    def _moves(self, home: str) -> list[int]:
        """The numbers of the cursors that are kept, newest last: one, or two after a crash."""
        fs, jpath = hadoop_path(self.spark, home)
        if not fs.exists(jpath):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(jpath) if s.isDirectory()]
        moves = sorted(int(n.split("=")[1]) for n in names if n.startswith("move="))
        whole = [m for m in moves if fs.exists(hadoop_path(self.spark, f"{home}/move={m}/_SUCCESS")[1])]
        return whole

    def rows(self) -> DataFrame:
        """The cursors of all consumers and inputs."""
        fs, jpath = hadoop_path(self.spark, self.path)
        if not fs.exists(jpath):
            return self.spark.createDataFrame([], CURSOR_SCHEMA)
        kept = self.spark.read.schema(f"{CURSOR_SCHEMA}, key string, move bigint").parquet(self.path)
        last = kept.groupBy("key").agg(F.max_by(F.struct("consumer", "input", "cursor", "updated_at"), "move").alias("c"))
        return last.select("c.*")

    def get(self, consumer: str, input_name: str) -> tuple[str, ...] | None:
        home = self._home(consumer, input_name)
        moves = self._moves(home)
        if not moves:
            return None
        row = self.spark.read.schema(CURSOR_SCHEMA).parquet(f"{home}/move={moves[-1]}").first()
        return tuple(row["cursor"]) if row is not None and row["cursor"] is not None else None

    def advance(self, consumer: str, input_name: str, cursor: Sequence[str]) -> None:
        """Call only after the outputs are committed: a crash in between repeats work, never skips it."""
        home = self._home(consumer, input_name)
        moves = self._moves(home)
        row = {"consumer": consumer, "input": input_name, "cursor": [str(v) for v in cursor], "updated_at": datetime.now(timezone.utc)}
        local_frame(self.spark, [row], CURSOR_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{home}/move={(moves[-1] if moves else 0) + 1}")
        for m in moves:
            fs, jpath = hadoop_path(self.spark, f"{home}/move={m}")
            fs.delete(jpath, True)


class PartitionRead:
    """One incremental read: the new rows, and the cursor to store once they are written."""

    def __init__(self, df: DataFrame | None, cursor: tuple[str, ...] | None):
        self.df = df
        self.cursor = cursor

    @property
    def skipped(self) -> bool:
        return self.df is None


def read_incremental(
    spark: SparkSession,
    cursors: CursorTable,
    consumer: str,
    path: str,
    columns: Sequence[str],
    fmt: str = "parquet",
    start_from: str = "all",
    forced: bool = False,
) -> PartitionRead:
    """Read what is beyond the stored cursor. Nothing new is a skip, unless forced: then the whole input is read again.
    Force changes nothing while there is something new."""
    stored = cursors.get(consumer, path)
    newest = newest_partition(spark, path, columns)
    if newest is None:
        return PartitionRead(None, None)
    if stored is None:
        stored = initial_cursor(spark, path, columns, start_from)
        if start_from == "now":
            # Remember the baseline, or a quiet first run would move "now" forward each time.
            cursors.advance(consumer, path, newest)
    rows = read_partitioned(spark, path, fmt)
    upto = in_window(rows, columns, [""] * len(columns), newest)
    if stored is not None and tuple(newest) <= tuple(stored):
        return PartitionRead(upto, newest) if forced else PartitionRead(None, None)
    return PartitionRead(after_cursor(upto, columns, stored), newest)
