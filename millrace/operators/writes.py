"""Output descriptions, append and replace, clustered layout, and plain path and JSON sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.merge import MAX_LAYOUT_COLUMNS
from millrace.operators.schema import evolve

MODES = ("replace", "append", "merge")


@dataclass(frozen=True)
class OutputSpec:
    """Where an output goes and how. Keys without a mode mean merge; an explicit `append` with keys
    stays an append and does not remove duplicates."""

    target: str = ""
    kind: str = "table"
    mode: str = ""
    merge_keys: Sequence[str] = ()
    merge_update: Mapping[str, str] = field(default_factory=dict)
    cluster_by: Sequence[str] = ()
    bound_by: Sequence[str] = ()
    stats: bool = False

    def __post_init__(self):
        if self.kind not in ("table", "path", "json_object"):
            raise ValueError(f"unsupported output kind {self.kind!r}")
        if not self.mode:
            object.__setattr__(self, "mode", "merge" if self.merge_keys else "replace")
        if self.mode not in MODES:
            raise ValueError(f"unsupported mode {self.mode!r}")
        if self.mode == "merge" and not self.merge_keys:
            raise ValueError("mode 'merge' needs merge_keys")
        if len(self.cluster_by) > MAX_LAYOUT_COLUMNS:
            raise ValueError(f"at most {MAX_LAYOUT_COLUMNS} columns to cluster by")

    @classmethod
    def parse(cls, value: str | Mapping | OutputSpec) -> OutputSpec:
        """Accept a spec, a mapping of its fields, a path (has a slash) or a table name."""
        if isinstance(value, OutputSpec):
            return value
        if isinstance(value, str):
            return cls(target=value, kind="path" if "/" in value else "table")
        if isinstance(value, Mapping):
            return cls(**value)
        raise TypeError(f"unsupported output description {type(value).__name__}")

    def layout_columns(self) -> list[str]:
        """Those named; else the first merge keys."""
        return list(self.cluster_by) or list(self.merge_keys)[:MAX_LAYOUT_COLUMNS]


def append_rows(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Target and batch together; a column new in the batch reads NULL in older rows."""
    return evolve(target, batch.schema).unionByName(batch, allowMissingColumns=True)


def range_arranged(df: DataFrame, columns: Sequence[str], files: int | None = None) -> DataFrame:
    """Range-partition and sort by columns. The number of the task a row comes from is the last range
    column, so that a value with a large share of the rows, or of equal rows, fills several files instead
    of one; a repeated task gives its rows the same number."""
    chosen = [F.col(f"`{c}`") for c in columns]
    numbered = df.withColumn("_task", F.spark_partition_id())
    order = [*chosen, F.col("_task")]
    parts = numbered.repartitionByRange(files, *order) if files else numbered.repartitionByRange(*order)
    return parts.sortWithinPartitions(*chosen).drop("_task")


def clustered(df: DataFrame, columns: Sequence[str], files: int | None = None) -> DataFrame:
    """Arrange by at most four columns, so that files cover narrow value ranges and scans can skip them."""
    if len(columns) > MAX_LAYOUT_COLUMNS:
        raise ValueError(f"at most {MAX_LAYOUT_COLUMNS} columns to cluster by")
    return range_arranged(df, columns, files) if columns else df


def write_path(df: DataFrame, path: str, mode: str = "replace") -> None:
    df.write.mode("append" if mode == "append" else "overwrite").parquet(path)


def write_json(df: DataFrame, path: str, max_rows: int = 100_000) -> None:
    """One JSON array document in one file, written by a task. Meant for small rollups: a frame above the
    limit is refused before anything is gathered.

    The document is the only line of a text file below `path`; the content type is application/json.
    """
    if df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows are too many for one JSON document")
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))
    body = F.concat_ws(",", F.collect_list("row"))
    rows.agg(F.concat(F.lit("["), body, F.lit("]")).alias("value")).write.mode("overwrite").text(path)
