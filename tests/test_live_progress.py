"""Progress kept as state, deliveries once, and the cascade."""

import random

from helpers import rows
from pyspark.sql import functions as F

from millrace.plans.telemetry import CASCADE_NOTE, cascade_skipped, with_cascade
from millrace.streaming.ingest import file_stream, once, run_available
from millrace.streaming.progress import STALE, stream_live_progress
from millrace.tables.store import VersionedTable

MARKERS = "run long, node string, status string, updated_ms long, tasks_completed long"


def test_running_expires_and_terminal_states_stay(spark, tmp_path):
    landing, table = f"{tmp_path}/in", VersionedTable(spark, f"{tmp_path}/live")

    def tell(*markers):
        spark.createDataFrame(markers, MARKERS).coalesce(1).write.mode("append").parquet(landing)
        stream_live_progress(file_stream(spark, landing, MARKERS), f"{tmp_path}/state", table, "1 second")

    tell((1, "a", "running", 1_000, 1), (1, "a", "", 2_000, 2), (1, "b", "succeeded", 1_500, 9), (1, "_run", "running", 1_000, 0), (2, "a", "running", 1_900, 0))
    assert rows(table.read(), "run", "node", "status", "updated_ms") == [(1, "a", "RUNNING", 2_000), (1, "b", "SUCCEEDED", 1_500), (2, "a", "RUNNING", 1_900)]
    tell((2, "a", "running", 14_500, 5), (3, "c", "failed", 15_000, 1))  # the clock is at 14,000 now
    assert rows(table.read(), "run", "node", "status") == [(1, "a", STALE), (1, "b", "SUCCEEDED"), (2, "a", "RUNNING"), (3, "c", "FAILED")]
    tell((1, "a", "running", 16_000, 3), (2, "a", "succeeded", 16_000, 6), (3, "c", "running", 14_900, 0))
    assert rows(table.read(), "run", "node", "status") == [(1, "a", "RUNNING"), (1, "b", "SUCCEEDED"), (2, "a", "SUCCEEDED"), (3, "c", "FAILED")]
    tell((9, "z", "skipped", 40_000, 0))
    assert rows(table.read().where("run < 9"), "run", "node", "status") == [(1, "a", STALE), (1, "b", "SUCCEEDED"), (2, "a", "SUCCEEDED"), (3, "c", "FAILED")]


def test_a_delivery_counts_once(spark, tmp_path):
    landing, out = f"{tmp_path}/in", f"{tmp_path}/out"
    at = F.timestamp_seconds(F.col("id") + 1_700_000_000)
    for k in range(4):
        for _ in range(2):
            spark.range(100 * k, 100 * k + 100).select("id", at.alias("ts")).coalesce(1).write.mode("append").parquet(landing)
    stream = once(file_stream(spark, landing, "id long, ts timestamp", max_files=1), ["id"], "ts", "5 minutes")
    run_available(stream, f"{tmp_path}/state", path=out)
    assert rows(spark.read.parquet(out), "id") == [(i,) for i in range(400)]


def reached_by_hand(edges, told):
    out, parents = set(), {}
    for p, c in edges:
        parents.setdefault(c, set()).add(p)
    skipped = {n for n, s in told.items() if s == "skipped"}
    while True:
        new = {c for c, ps in parents.items() if c not in told and c not in out and ps <= skipped | out}
        if not new:
            return out
        out |= new


def test_cascade_equals_a_search(spark):
    rng = random.Random(4)
    edges = [(a, b) for a in range(30) for b in range(a + 1, 30) if rng.random() < 0.08] + [(1, 2), (1, 2)]
    runs = {r: {n: rng.choice(["skipped", "skipped", "ok"]) for n in range(30) if rng.random() < 0.5} for r in range(40)}
    e = spark.createDataFrame(edges, "parent long, child long")
    df = spark.createDataFrame([(r, n, s) for r, told in runs.items() for n, s in told.items()], "run_id long, node long, status string")
    got = {r: set() for r in runs}
    for row in cascade_skipped(e, df).collect():
        got[row.run_id].add(row.node)
    assert got == {r: reached_by_hand(edges, told) for r, told in runs.items()}
    whole = with_cascade(df.withColumn("error_msg", F.lit(None).cast("string")), e)
    assert whole.where(F.col("error_msg") == CASCADE_NOTE).count() == sum(map(len, got.values()))
    assert cascade_skipped(e, df.limit(0)).count() == 0
