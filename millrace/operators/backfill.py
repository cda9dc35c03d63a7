"""Backfill: run a window into a side table, compare it with the target, then promote or discard it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.merge import merge_upsert, present_keys
from millrace.operators.ordering import latest_per_key
from millrace.operators.schema import evolve, schema_diff, schema_drifted
from millrace.operators.writes import append_rows
from millrace.session import hadoop_path
from millrace.tables.store import Provenance, VersionedTable
from millrace.sources.cursors import in_window

REGISTRY_SCHEMA = (
    "target string, run string, node string, window_from string, window_to string, state string, at timestamp"
)


class PromoteError(ValueError):
    """A promote that would silently lose or duplicate rows."""


def staging_name(target: str, run: str) -> str:
    return f"{target}__backfill__{run}"


def window_output(
    source: DataFrame,
    columns: Sequence[str],
    start: Sequence[str],
    end: Sequence[str],
    transform: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """The transform over a closed partition window. Cursors are neither read nor moved."""
    return transform(in_window(source, columns, start, end))


def diff(staging: DataFrame, target: DataFrame | None) -> DataFrame:
    """One row: row counts (target -1 when absent), whether the schemas agree, how they differ, and the
    staging columns."""
    staged = staging.agg(F.count(F.lit(1)).alias("staging_rows"))
    if target is None:
        present = F.lit(-1).cast("bigint")
        lines, equal = [], False
    else:
        present = target.agg(F.count(F.lit(1)).alias("n")).scalar()
        lines = schema_diff(target.schema, staging.schema)
        equal = not schema_drifted(target.schema, staging.schema)
    return staged.select(
        "staging_rows",
        present.alias("target_rows"),
        F.lit(equal).alias("schema_equal"),
        F.lit("\n".join(lines)).alias("schema_diff"),
        F.lit(",".join(staging.columns)).alias("staging_columns"),
    )


def key_overlap(staging: DataFrame, target: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """How many staging rows would update a target row and how many would be new. Staging rows are
    counted, so duplicates in the target do not inflate the answer."""
    unknown = [k for k in keys if k not in staging.columns]
    if unknown:
        raise ValueError(f"no such staging column: {', '.join(unknown)}")
    if target is None:
        return staging.agg(F.lit(0).cast("bigint").alias("matching"), F.count(F.lit(1)).alias("new"))
    # Count per key first: a key that fills the staging table becomes one row before the join.
    per_key = staging.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    seen = present_keys(target, per_key, keys).withColumn("_seen", F.lit(1))
    total = F.coalesce(F.sum("_rows"), F.lit(0))
    hit = F.coalesce(F.sum(F.when(F.col("_seen").isNotNull(), F.col("_rows"))), F.lit(0))
    return per_key.join(seen, list(keys), "left").agg(hit.alias("matching"), (total - hit).alias("new"))


def promote(
    staging: DataFrame,
    target: DataFrame | None,
    mode: str,
    keys: Sequence[str] = (),
    update: Mapping[str, str] | None = None,
    force_dedup: str | None = None,
    allow_duplicates: bool = False,
    replace_counters: bool = False,
) -> DataFrame:
    """The target's contents after the promote.

    A merge target merges on its keys. Additive columns are refused unless `replace_counters` says that the
    staged rows take the place of the old ones, whatever the rules: adding a re-run would count twice, and a corrected
    window may lower a `max`.
    An append target needs `force_dedup` (a column to merge on) or `allow_duplicates`. A replace target
    refuses. Without a target the staging table becomes it.
    """
    if target is None:
        return staging
    if mode == "merge":
        return merge_upsert(target, staging, keys, _rules(update, replace_counters))
    if mode == "append":
        if force_dedup:
            return merge_upsert(target, staging, [force_dedup])
        if allow_duplicates:
            return append_rows(target, staging)
        raise PromoteError("an append target needs force_dedup or allow_duplicates")
    raise PromoteError(f"a {mode} target cannot take a promote; run the stage instead")


def _rules(update: Mapping[str, str] | None, replace_counters: bool) -> dict[str, str]:
    """The merge rules of a promote: none if the staged rows take the place of the old ones."""
    if replace_counters:
        return {}
    if "additive" in (update or {}).values():
        raise PromoteError("promoting into additive columns would count the window twice")
    return dict(update or {})


def promote_into(
    table: VersionedTable,
    staging: DataFrame,
    mode: str,
    run: str,
    keys: Sequence[str] = (),
    update: Mapping[str, str] | None = None,
    force_dedup: str | None = None,
    allow_duplicates: bool = False,
    replace_counters: bool = False,
) -> int:
    """Commit a promote to a versioned table under the rules of `promote`, with change rows for what it changes and
    `backfill` as its trigger; the version."""
    by = Provenance(run, "backfill")
    if table.commit() is None:
        return table.replace(staging, by, merge_keys=keys)
    if mode == "merge":
        return table.merge(staging, keys, _rules(update, replace_counters), by=by)
    if mode == "append" and force_dedup:
        return table.merge(staging, [force_dedup], by=by)
    if mode == "append" and allow_duplicates:
        return table.append(staging, by)
    if mode == "append":
        raise PromoteError("an append target needs force_dedup or allow_duplicates")
    raise PromoteError(f"a {mode} target cannot take a promote; run the stage instead")


class StagingRegistry:
    """Append-only record of staging tables: one row when opened, one when promoted or discarded."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def record(self, target: str, run: str, node: str, start: Sequence[str], end: Sequence[str], state: str) -> None:
        values = (target, run, node, "/".join(start), "/".join(end), state)
        names = [part.split()[0] for part in REGISTRY_SCHEMA.split(", ")]
        row = [F.lit(v).alias(n) for v, n in zip(values, names)]
        frame = self.spark.range(1).select(*row, F.current_timestamp().alias("at"))
        frame.write.mode("append").parquet(self.path)

    def open(self, target: str | None = None) -> DataFrame:
        """Stagings that were neither promoted nor discarded, newest first."""
        fs, jpath = hadoop_path(self.spark, self.path)
        if not fs.exists(jpath):
            return self.spark.createDataFrame([], REGISTRY_SCHEMA)
        rows = self.spark.read.schema(REGISTRY_SCHEMA).parquet(self.path)
        if target is not None:
            rows = rows.where(F.col("target") == target)
        latest = latest_per_key(rows, ["target", "run"], ["at", "state"])
        return latest.where(F.col("state") == "open").orderBy(F.desc("at"))

    def discard(self, staging_path: str, target: str, run: str) -> None:
        """Delete the staging directory and close its record."""
        fs, jpath = hadoop_path(self.spark, staging_path)
        if fs.exists(jpath):
            fs.delete(jpath, True)
        self.record(target, run, "", (), (), "discarded")
