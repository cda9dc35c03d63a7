"""State of tables: latest commit, timeline, live files, freshness, inventory and lineage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import average_file_bytes, file_health, freshness
from millrace.operators.ordering import latest_per_key, top_per_group
from millrace.plans.telemetry import touched_rows
from millrace.tables.store import VersionedTable


def commit_state(table: VersionedTable, *, pipeline: str, node: str, output_key: str, name: str) -> DataFrame:
    """The row for `tables` after a write: version, rows touched, files, bytes, writer."""
    head = table.commit()
    latest = touched_rows(table.log_of([head["version"]] if head else []))
    return latest.select(
        F.lit(pipeline).alias("pipeline"),
        F.lit(node).alias("node"),
        F.lit(output_key).alias("output_key"),
        F.lit(name).alias("table_name"),
        F.lit(table.path).alias("table_id"),
        F.col("version").alias("snapshot_id"),
        F.col("committed_at").alias("snapshot_ts"),
        "row_count",
        F.col("file_count").cast("int").alias("file_count"),
        "total_bytes",
        F.col("run_id").alias("last_writer_run_id"),
    )


def latest_state(tables: DataFrame) -> DataFrame:
    return latest_per_key(tables, ["table_id"], ["snapshot_ts", "snapshot_id"])


def timeline(commits: DataFrame, n: int, table: str = "table_id") -> DataFrame:
    """The newest `n` commits of each table with parent, commit total and a truncation flag."""
    newest = top_per_group(commits, [table], [F.desc("version")], n)
    span = commits.groupBy(table).agg(
        (F.max("version") + 1).alias("total_commits"), (F.count(F.lit(1)) > n).alias("truncated")
    )
    parent = F.when(F.col("version") > 0, F.col("version") - 1)
    return newest.withColumn("parent_version", parent).join(span, table)


def _net(added: str = "added") -> Column:
    parts = [F.coalesce(c, F.lit(0)) for c in (added, "updated", "deleted")]
    return parts[0] - parts[1] - parts[2]


def row_counts(commits: DataFrame, table: str = "table_id", exact: DataFrame | None = None) -> DataFrame:
    """Current rows per table: an exact count if given, else the newest commit's own total, else the sum
    of net changes since the last replace. The sum is approximate unless it starts at version 0 or at a
    replace. `added` of a merge includes its updates, which do not add rows.

    Expects `version, added, updated, deleted, total, replaces`.
    """
    anchors = commits.groupBy(table).agg(
        F.max(F.when(F.col("replaces"), F.col("version"))).alias("_reset"),
        F.min("version").alias("_oldest"),
        F.max_by(F.struct("total"), "version").alias("_newest"),
    )
    since = commits.join(anchors.select(table, "_reset"), table)
    since = since.where(F.col("_reset").isNull() | (F.col("version") >= F.col("_reset")))
    sums = since.groupBy(table).agg(F.greatest(F.sum(_net()), F.lit(0)).alias("_fold"))
    facts = anchors.join(sums, table)
    if exact is None:
        facts = facts.withColumn("_exact", F.lit(None).cast("bigint"))
    else:
        facts = facts.join(exact.select(table, F.col("row_count").alias("_exact")), table, "left")
    stamped = F.col("_newest.total")
    anchored = F.col("_reset").isNotNull() | (F.col("_oldest") == 0)
    guess = F.col("_exact").isNull() & stamped.isNull()
    return facts.select(
        table,
        F.coalesce("_exact", stamped, "_fold").alias("row_count"),
        (guess & ~anchored).alias("approximate"),
    )


def live_files(actions: DataFrame, table: str = "table_id") -> DataFrame:
    """Files, bytes and rows of each table from `add` and `remove` facts per file: a file counts when its
    newest fact is an add. Expects `path, action, version, bytes, rows`."""
    latest = actions.groupBy(table, "path").agg(
        F.max_by(F.struct("action", "bytes", "rows"), F.struct("version", "action")).alias("f")
    )
    return (
        latest.where("f.action = 'add'")
        .groupBy(table)
        .agg(
            F.count(F.lit(1)).alias("file_count"),
            F.sum("f.bytes").alias("total_bytes"),
            F.sum("f.rows").alias("row_count"),
        )
    )


def file_facts(df: DataFrame) -> DataFrame:
    """One row per file a frame reads: path, bytes and rows, from file metadata."""
    meta = df.select("_metadata.file_path", "_metadata.file_size")
    return meta.groupBy("file_path", "file_size").agg(F.count(F.lit(1)).alias("rows"))


def health(states: DataFrame) -> DataFrame:
    files, size = F.col("file_count"), F.col("total_bytes")
    return states.withColumns(
        {"avg_file_bytes": average_file_bytes(files, size), "file_health": file_health(files, size)}
    )


def with_freshness(states: DataFrame, now: Column, committed: str = "snapshot_ts", sla: str = "sla") -> DataFrame:
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col(committed).cast("timestamp"))
    return states.withColumn("freshness", freshness(age, F.col(sla)))


def inventory(states: DataFrame, columns: DataFrame, owners: DataFrame, now: Column) -> DataFrame:
    """Every column of every table beside the table's owner, newest commit, freshness and file health.
    Tables without a commit are listed too. `owners` has one row per table: `table_id, owner, sla`."""
    state = latest_state(states)
    tables = owners.join(state, "table_id", "left")
    return columns.join(health(with_freshness(tables, now)), "table_id", "left")


def lineage(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Edges from producers to consumers.

    `inputs`: `pipeline, node, schema, table` for a table reference, or `source` for a registered source.
    `outputs`: `pipeline, node, schema, output`; a table is known as `node__output`, and as the bare node
    when its output is `default`. An unknown table is an `(external)` edge; a source is a root.
    """
    suffixed = F.concat_ws("__", "node", "output")
    names = F.when(F.col("output") == "default", F.array(F.col("node"), suffixed)).otherwise(F.array(suffixed))
    produced = outputs.select(
        F.col("pipeline").alias("from_pipeline"),
        F.col("node").alias("from_node"),
        F.col("schema"),
        F.explode(names).alias("table"),
    )
    references = inputs.where(F.col("source").isNull()).join(produced, ["schema", "table"], "left")
    via = F.concat_ws(".", "schema", "table")
    edges = references.select(
        F.coalesce("from_pipeline", F.lit("(external)")).alias("from_pipeline"),
        F.coalesce("from_node", "table").alias("from_node"),
        F.col("pipeline").alias("to_pipeline"),
        F.col("node").alias("to_node"),
        via.alias("via_table"),
        (F.col("from_pipeline") != F.col("pipeline")).alias("_other"),
    )
    kind = F.when(F.col("_other").isNull(), "external").when(F.col("_other"), "cross").otherwise("local")
    roots = inputs.where(F.col("source").isNotNull()).select(
        "pipeline", F.concat(F.lit("sources."), "source").alias("from_node"), F.col("node").alias("to_node")
    )
    roots = roots.select(
        F.lit("").alias("from_pipeline"), "from_node", F.col("pipeline").alias("to_pipeline"), "to_node",
        F.lit("").alias("via_table"), F.lit("source").alias("kind"),
    )
    return edges.withColumn("kind", kind).drop("_other").unionByName(roots).orderBy("from_node", "to_node", "via_table")
