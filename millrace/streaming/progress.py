"""Run progress as a streaming job: the newest marker per run and node.

`stream_progress` keeps it in a versioned table, of which a reader tells what is stale. `live_progress` keeps it as state of
the stream: a node that claims to run sets a timer, and when event time passes it with no newer marker, the stream itself
says that the node is stale and forgets it. Terminal states stay.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from millrace.operators.ordering import latest_per_key
from millrace.plans.telemetry import PROGRESS_FRESH_MS
from millrace.session import session_conf
from millrace.streaming.upsert import stream_merge
from millrace.tables.store import VersionedTable

KEYS = ("run", "node")
ORDER = ("updated_ms", "tasks_completed")


def keep_newer(columns: Sequence[str], keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> dict[str, str]:
    """Merge rules under which an older row never replaces a newer one, whatever order batches come in."""
    sides = [", ".join(f"{side}.`{c}`" for c in order) for side in ("source", "target")]
    newer = f"struct({sides[0]}) >= struct({sides[1]})"
    return {c: f"if({newer}, source.`{c}`, target.`{c}`)" for c in columns if c not in keys}


def stream_progress(markers: DataFrame, checkpoint: str, table: VersionedTable, name: str = "progress") -> StreamingQuery:
    """Fold the available markers into the table; `telemetry.progress_states` reads states from it."""
    return stream_merge(
        markers, checkpoint, table, name, KEYS, keep_newer(markers.columns), lambda batch: latest_per_key(batch, KEYS, ORDER)
    )


#: What the stateful stream says of a node: its newest state, and when (event time) that was so. STALE ends a RUNNING.
LIVE_SCHEMA = "run bigint, node string, updated_ms bigint, tasks_completed bigint, status string, at_ms bigint"
STALE = "STALE"
_STATE = "updated_ms bigint, tasks_completed bigint, status string"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Progress(StatefulProcessor):
    """The newest marker of a run's node, with a timer while it claims to run."""

    def __init__(self, fresh_ms: int, columns: Sequence[str]):
        self.fresh_ms, self.row = fresh_ms, Row(*columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept = self.newest.get()  # each question to the state is a message: one tells whether there is any, and what
        before = None if kept is None else tuple(kept)
        best = before
        for row in rows:
            marker = (row["updated_ms"], row["tasks_completed"], row["status"])
            if best is None or marker[:2] > best[:2]:
                best = marker
        if best is None or best == before:
            return
        if before is not None and before[2] == "RUNNING":
            self.handle.deleteTimer(before[0] + self.fresh_ms)
        self.newest.update(best)
        if best[2] == "RUNNING":
            self.handle.registerTimer(best[0] + self.fresh_ms)
        yield self.row(*key, best[0], best[1], best[2], best[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kept = self.newest.get()
        if kept is None:
            return
        marker = tuple(kept)
        if marker[2] == "RUNNING" and expiredTimerInfo.getExpiryTimeInMs() >= marker[0] + self.fresh_ms:
            self.newest.clear()
            yield self.row(*key, marker[0], marker[1], STALE, marker[0] + self.fresh_ms)

    def close(self) -> None:
        pass


def live_progress(markers: DataFrame, late: str, fresh_ms: int = PROGRESS_FRESH_MS) -> DataFrame:
    """Changes of state per run and node (see LIVE_SCHEMA) of a stream of markers (run, node, status, updated_ms,
    tasks_completed), in event time. Markers may come `late` that much; those later still are left out. No status means
    running, the overall `_run` is no node. State is a marker per node, for nodes that run or have ended."""
    status = F.coalesce(F.nullif("status", F.lit("")), F.lit("running"))
    known = F.when(status.isin("succeeded", "failed", "skipped"), F.upper(status)).otherwise("RUNNING")
    plain = markers.where("node <> '_run'").select("run", "node", "updated_ms", "tasks_completed", known.alias("status"), F.timestamp_millis("updated_ms").alias("_event"))
    columns = [c.split()[0] for c in LIVE_SCHEMA.split(", ")]
    keyed = plain.withWatermark("_event", late).groupBy("run", "node")
    return keyed.transformWithState(statefulProcessor=_Progress(fresh_ms, columns), outputStructType=LIVE_SCHEMA, outputMode="Update", timeMode="EventTime")


def stream_live_progress(markers: DataFrame, checkpoint: str, table: VersionedTable, late: str, name: str = "live") -> StreamingQuery:
    """Keep the last that the stream has said of each node in a table."""
    order = ("at_ms", "tasks_completed")
    columns = [c.split()[0] for c in LIVE_SCHEMA.split(", ")]
    with session_conf(markers.sparkSession, spark__sql__streaming__stateStore__providerClass=_ROCKSDB):
        return stream_merge(live_progress(markers, late), checkpoint, table, name, KEYS, keep_newer(columns, order=order), lambda batch: latest_per_key(batch, KEYS, order))
