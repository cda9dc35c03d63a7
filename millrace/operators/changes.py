"""Change rows: derived from two snapshots, read back by version range, reduced to the latest per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordering import latest_per_key

COPIES_PER_ROW = 10_000
CHANGE_COLUMNS = ("_change_type", "_commit_version", "_commit_timestamp")


def repeated(df: DataFrame, copies: str) -> DataFrame:
    """Each row as often as its count says, without the count. Large counts are cut into pieces that are
    spread over the tasks first, so that no single task or array has to hold all copies of a row."""
    count = F.col(copies)
    few = df.where(count <= COPIES_PER_ROW).withColumn("_copy", F.explode(F.sequence(F.lit(1), count.cast("int"))))
    pieces = F.sequence(F.lit(0).cast("bigint"), F.floor((count - 1) / COPIES_PER_ROW))
    many = df.where(count > COPIES_PER_ROW).withColumn("_piece", F.explode(pieces))
    size = F.least(F.lit(COPIES_PER_ROW), count - F.col("_piece") * COPIES_PER_ROW).cast("int")
    many = many.repartition("_piece").withColumn("_copy", F.explode(F.sequence(F.lit(1), size)))
    return few.drop("_copy", copies).unionByName(many.drop("_copy", "_piece", copies))


def change_rows(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What turned `before` into `after`: `insert`, `update_preimage`, `update_postimage`, `delete`.

    Both sides are counted together per whole row, so equal rows cancel in the map-side aggregation and
    duplicates stay exact. Only changed rows go on to the key lookup; nothing is paired row by row.
    """
    names = before.columns
    signed = before.withColumn("_copies", F.lit(-1)).unionByName(
        after.select(*names).withColumn("_copies", F.lit(1))
    )
    moved = (
        signed.groupBy(*[F.col(f"`{n}`") for n in names])
        .agg(F.sum("_copies").alias("_copies"))
        .where("_copies <> 0")
    )
    sides = moved.groupBy(*[F.col(f"`{k}`").alias(f"_key_{i}") for i, k in enumerate(keys)]).agg(
        F.bool_or(F.col("_copies") > 0).alias("_has_new"),
        F.bool_or(F.col("_copies") < 0).alias("_has_old"),
    )
    on = [F.col(f"`{k}`") == F.col(f"_key_{i}") for i, k in enumerate(keys)]
    updated = F.coalesce(F.col("_has_new") & F.col("_has_old"), F.lit(False))
    kind = F.when(F.col("_copies") > 0, F.when(updated, "update_postimage").otherwise("insert")).otherwise(
        F.when(updated, "update_preimage").otherwise("delete")
    )
    typed = moved.join(sides, on, "left").select(
        kind.alias("_change_type"), *[F.col(f"`{n}`") for n in names], F.abs("_copies").alias("_copies")
    )
    return repeated(typed, "_copies")


def version_range(changes: DataFrame, after: int, upto: int, deletes: bool = False) -> DataFrame:
    """Rows a consumer needs from the commits in `(after, upto]`, still with their commit columns."""
    kinds = ["insert", "update_postimage"] + (["delete"] if deletes else [])
    version = F.col("_commit_version")
    return changes.where((version > after) & (version <= upto) & F.col("_change_type").isin(kinds))


def without_commit_columns(changes: DataFrame) -> DataFrame:
    return changes.drop(*CHANGE_COLUMNS)


def latest_changes(changes: DataFrame, keys: Sequence[str], tiebreak: Sequence[str] = ()) -> DataFrame:
    """The newest row per key of the producer's table. Rows of one commit are told apart by `tiebreak`
    (by default the remaining columns), so the choice does not depend on task order."""
    rest = tiebreak or [c for c, t in changes.dtypes if c not in keys and not t.startswith("map")]
    return latest_per_key(changes, keys, ["_commit_version", *[c for c in rest if c != "_commit_version"]])


def changed_keys(changes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The distinct keys a range touched: what a keyed consumer has to recompute."""
    return changes.select(*columns).distinct()
