"""Streaming merges: each micro-batch becomes one commit of a versioned table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from millrace.streaming.ingest import run_available
from millrace.tables.store import Provenance, VersionedTable


def merge_batches(
    table: VersionedTable,
    name: str,
    keys: Sequence[str],
    update: Mapping[str, str] | None = None,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> Callable[[DataFrame, int], None]:
    """A batch writer that merges `prepare(batch)`. The batch id goes into the commit, and a batch whose id
    is already there is left out: a replay after a crash does not add its counts twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if table.has_batch(name, batch_id):
            return
        local = VersionedTable(batch.sparkSession, table.path, table._partition_by)
        local.merge(prepare(batch), keys, update, by=Provenance(f"{name}:{batch_id}", "event", (name, batch_id)))

    return write


def stream_merge(
    df: DataFrame,
    checkpoint: str,
    table: VersionedTable,
    name: str,
    keys: Sequence[str],
    update: Mapping[str, str] | None = None,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> StreamingQuery:
    return run_available(df, checkpoint, merge_batches(table, name, keys, update, prepare))
