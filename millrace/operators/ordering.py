"""Numbering rows of groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import freeze


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank", path: str | None = None) -> DataFrame:
    """`row_number` per group when one group may be far larger than a task.

    Rows are range-partitioned by group and order, so a large group spreads over many tasks, and are written sorted with
    their place in the task. A rank is that place, less the group's first one in the task, plus the sizes of the group's
    earlier parts: one row per group and task, never per input row. The rows are shuffled once. They are written so that
    places and sizes agree; give a `path` (see `session.scratch_dir`) to remove them when the result has been used.
    `order` has to be total (end it with a unique column).
    """
    groups = [F.col(f"`{g}`") for g in group]
    placed = df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)
    ranged = freeze(placed.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), path)
    sizes = ranged.groupBy("_part", *groups).agg(F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_first"))
    parts = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_size").over(parts), F.lit(0))
    offsets = sizes.select("_part", *groups, (before - F.col("_first") + 1).alias("_offset"))
    same = [F.col("l._part") == F.col("o._part")]
    same += [F.col(f"l.`{g}`").eqNullSafe(F.col(f"o.`{g}`")) for g in group]
    joined = ranged.alias("l").join(offsets.alias("o"), same, "left")
    return joined.select(*[F.col(f"l.`{c}`") for c in df.columns], (F.col("_at") + F.col("_offset")).alias(name))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first `k` rows of each group with their number. Spark drops all but `k` per task before the
    shuffle, so a large group costs no more than a small one."""
    window = Window.partitionBy(*[F.col(f"`{g}`") for g in group]).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest order values of each key. `order` should end in a unique column, or
    equal rows make the choice arbitrary."""
    names = df.columns
    best = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        F.max_by(
            F.struct(*[F.col(f"`{n}`") for n in names]), F.struct(*[F.col(f"`{o}`") for o in order])
        ).alias("_row")
    )
    return best.select(*[F.col(f"_row.`{n}`").alias(n) for n in names])


def exact_percentiles(df: DataFrame, columns: Sequence[str], shares: Mapping[str, float], groups: Sequence[str] = (), path: str | None = None) -> DataFrame:
    """Discrete percentiles by distributed selection: for each group, column and share, the least value that the share of
    the non-NULL values does not exceed. `groups, column, share, value` (a double), a row only where there is a value.

    Values are counted, which takes the weight out of frequent ones, and range-partitioned by group, column and value.
    Counts of the ranges tell which range holds a wanted rank; only those ranges are ranked value by value. No task holds
    more than a range, whatever the number of distinct values. The ranges are written so that both steps see the same;
    give a `path` to remove them when the result has been used."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])).alias("_cell")
    key = [*groups, "column"]
    long = df.select(*[F.col(f"`{g}`") for g in groups], cells).select(*groups, "_cell.column", "_cell.value").where("value IS NOT NULL")
    names = [F.col(f"`{k}`") for k in key]
    counts = long.groupBy(*names, "value").agg(F.count(F.lit(1)).alias("_n"))
    placed = counts.repartitionByRange(*names, "value").withColumn("_part", F.spark_partition_id())
    ranged = freeze(placed.sortWithinPartitions(*names, "value"), path)
    sizes = ranged.groupBy(*names, "_part").agg(F.sum("_n").alias("_size"))  # a row for each group and range it lies in
    whole, earlier = Window.partitionBy(*names), Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_total": F.sum("_size").over(whole), "_before": F.coalesce(F.sum("_size").over(earlier), F.lit(0))})
    # a rank is a whole number: the share is taken as the decimal that it was written as
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("share"), F.ceil(F.lit(Decimal(str(q))) * F.col("_total").cast("decimal(20,0)")).cast("bigint").alias("rank")) for n, q in shares.items()])).alias("_w")
    ranks = sizes.select(*names, "_part", "_size", "_before", wanted).select(*names, "_part", "_size", "_before", "_w.share", F.greatest("_w.rank", F.lit(1)).alias("_rank"))
    hit = ranks.where("_rank > _before AND _rank <= _before + _size").drop("_size")
    same = [F.col("r._part") == F.col("h._part")] + [F.col(f"r.`{k}`").eqNullSafe(F.col(f"h.`{k}`")) for k in key]
    near = ranged.alias("r").join(hit.alias("h"), same).select(*[F.col(f"r.`{k}`") for k in key], "r.value", "r._n", "r._part", "h.share", "h._rank", "h._before")
    running = Window.partitionBy(*names, "_part", "share").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    reached = near.withColumn("_upto", F.col("_before") + F.sum("_n").over(running)).where("_upto >= _rank")
    return reached.groupBy(*names, "share").agg(F.min("value").alias("value"))
