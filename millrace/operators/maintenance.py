"""Layout upkeep over versioned tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.merge import MAX_LAYOUT_COLUMNS
from millrace.operators.writes import clustered, range_arranged
from millrace.tables.store import Provenance, VersionedTable

DEFAULT_RETENTION_HOURS = 168
ZORDER_BITS = 6  # 63 range bounds per column


def _range(value: Column, bounds: Sequence, low: int = 0) -> Column:
    """Which range a value falls in, by halving: six comparisons for 63 bounds."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    return F.when(value < F.lit(bounds[mid]), _range(value, bounds[:mid], low)).otherwise(_range(value, bounds[mid + 1 :], low + mid + 1))


def zorder_key(df: DataFrame, columns: Sequence[str], bits: int = ZORDER_BITS, sample_rows: int = 8192, seed: int = 3) -> Column:
    """Interleaved bits of each column's range. The bounds are quantiles of about `sample_rows` rows drawn from the
    whole frame; values are compared whole, texts included."""
    names = list(columns)
    total = max(df.count(), 1)
    sample = df.select(*[F.col(f"`{n}`") for n in names]).sample(min(1.0, sample_rows / total), seed).collect()
    key = F.lit(0).cast("bigint")
    for i, name in enumerate(names):
        values = sorted(row[i] for row in sample if row[i] is not None and row[i] == row[i])
        bounds = [values[len(values) * k // 2**bits] for k in range(1, 2**bits)] if values else []
        bucket = F.coalesce(_range(F.col(f"`{name}`"), list(dict.fromkeys(bounds))), F.lit(0)).cast("bigint")
        for bit in range(bits):
            one = F.shiftright(bucket, bit).bitwiseAND(F.lit(1))
            key = key + F.shiftleft(one, bit * len(names) + i)
    return key


def zordered(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows close in several columns end up in the same files."""
    return range_arranged(df.withColumn("_z", zorder_key(df, columns)), ["_z"]).drop("_z")


def recluster(
    table: VersionedTable, columns: Sequence[str] = (), merge_keys: Sequence[str] = (), zorder: bool = False
) -> int:
    """Rewrite by at most four named columns, else by the first four merge keys. Later writes keep the columns."""
    head = table.commit()
    if len(columns) > MAX_LAYOUT_COLUMNS:
        raise ValueError(f"at most {MAX_LAYOUT_COLUMNS} columns to cluster by")
    chosen = list(columns) or list(merge_keys or (head["merge_keys"] if head else ()))[:MAX_LAYOUT_COLUMNS]
    if not chosen:
        raise ValueError("name the columns to cluster by")
    rows = table.read()
    arranged = zordered(rows, chosen) if zorder else clustered(rows, chosen)
    return table.rewrite(arranged, "ZORDER" if zorder else "CLUSTER", Provenance(trigger="maintenance"), chosen)


def expire(table: VersionedTable, retention_hours: float = DEFAULT_RETENTION_HOURS) -> int:
    """Delete the directories that no version within the retention needs; how many."""
    return table.expire(retention_hours)


def sweep(tables: Mapping[str, VersionedTable], actions: Mapping[str, Callable[[VersionedTable], object]]) -> DataFrame:
    """Run each action on each table: `table, action, status, detail`, sorted by table. A failure is recorded and does not
    stop the others. The loop is over tables and actions; what an action does, it does as Spark jobs."""
    report = []
    for name in sorted(tables):
        for action, run in actions.items():
            try:
                report.append((name, action, "ok", str(run(tables[name]))))
            except Exception as error:  # one table's trouble must not stop the sweep
                report.append((name, action, "failed", str(error).splitlines()[0][:1000] if str(error) else type(error).__name__))
    spark = SparkSession.active() if not tables else next(iter(tables.values())).spark
    return spark.createDataFrame(report, "table string, action string, status string, detail string").orderBy("table")


#: The upkeep of a table: fewer files, the layout it remembers, what nobody needs any more.
UPKEEP: dict[str, Callable[[VersionedTable], object]] = {
    "compact": lambda table: table.compact(),
    "cluster": lambda table: recluster(table, list(table.commit()["cluster_by"])),
    "expire": expire,
}
