import json

import pytest
from pyspark.sql import functions as F

from helpers import rows
from millrace.functions.scalars import duration_seconds, file_health, freshness, parse_magnitude, parse_magnitude_udf
from millrace.operators import profile as pr
from millrace.plans import catalog as cat
from millrace.plans import systables as sy
from millrace.plans import telemetry as t


def task(reason="Success", **metrics):
    info = {"Launch Time": metrics.pop("launch", 0), "Finish Time": metrics.pop("finish", 0)}
    return json.dumps({"Event": "SparkListenerTaskEnd", "Task End Reason": {"Reason": reason}, "Task Info": info, "Task Metrics": metrics})


def log(spark, lines):
    return t.parse_event_log(spark.createDataFrame([(x,) for x in lines], "value string"))


def test_event_log_metrics(spark):
    mb = 1048576
    lines = [
        task(**{"Peak Execution Memory": 30 * mb, "Memory Bytes Spilled": 400, "Executor CPU Time": 5_500_000, "launch": 0, "finish": 250}),
        task(**{"Peak Execution Memory": 10 * mb, "Shuffle Read Metrics": {"Remote Bytes Read": 1000, "Local Bytes Read": 2500}, "Executor CPU Time": 1_000_000}),
        task("ExceptionFailure", **{"Input Metrics": {"Bytes Read": 30000, "Records Read": 125}}),
        json.dumps({"Event": "SparkListenerStageCompleted"}),
        "not json", "", "[1]",
    ]
    m = t.event_log_metrics(log(spark, lines)).first()
    assert (m.peak_execution_memory_mb, m.memory_spilled_bytes, m.shuffle_read_bytes, m.input_records) == (30, 400, 3500, 125)
    assert (m.num_stages, m.num_tasks, m.num_failed_tasks, m.executor_cpu_time_ms, m.max_task_duration_ms) == (1, 3, 1, 6, 250)
    empty = t.event_log_metrics(log(spark, ["junk"])).first()
    assert set(empty.asDict()) == set(sy.TASK_METRICS) and not any(v is not None for v in empty)
    bare = t.event_log_metrics(log(spark, ['{"Event": "SparkListenerTaskEnd"}'])).first()
    assert (bare.num_tasks, bare.num_failed_tasks, bare.memory_spilled_bytes, bare.max_task_duration_ms) == (1, 1, 0, 0)


DETAIL = "executionArn string, status string, startDate bigint, stopDate bigint, input string, error string, cause string"


@pytest.mark.parametrize(
    "detail, want",
    [
        (("a:b:abc-123", "SUCCEEDED", 1000, 6000, '{"_trigger": "scheduled"}', None, None), ("abc-123", 5000, "scheduled", None, "", None)),
        (("a:r", "FAILED", 6000, 1000, '{"_trigger": 7}', "E", '{"errorMessage": "boom"}'), ("r", 0, "manual", None, "E", "boom")),
        (("a:r", "TIMED_OUT", None, 5, "[]", "", "plain"), ("r", None, "manual", None, "", "plain")),
        (("r", "ABORTED", 1, 2, '{"_backfill": {"target_outputs": {"b": "t2", "a": "t1"}}}', "E", ""), ("r", 1, "manual", "t1", "E", None)),
    ],
)
def test_run_rows(spark, detail, want):
    out = t.run_rows(spark.createDataFrame([detail, ("x", "RUNNING", 1, 2, None, None, None)], DETAIL), F.lit("p"))
    assert rows(out, "run_id", "duration_ms", "trigger", "target_table", "error_class", "error_msg") == [want]
    assert ", ".join(f"{n} {k}" for n, k in out.dtypes) == sy.RUNS


def test_long_messages_are_cut(spark):
    detail = ("a", "FAILED", 1, 2, None, None, "x" * 5000)
    message = t.run_rows(spark.createDataFrame([detail], DETAIL), F.lit("p")).first()["error_msg"]
    assert len(message) == 4096 and message.endswith("...")


def nodes(spark, data):
    schema = "node string, run_id string, started_at timestamp, memory_mb int, peak_rss_mb bigint, memory_spilled_bytes bigint, disk_spilled_bytes bigint"
    df = spark.createDataFrame([(n, str(i), i, *rest) for i, (n, *rest) in enumerate(data)], schema.replace("started_at timestamp", "at int"))
    return df.withColumn("started_at", F.timestamp_seconds("at"))


def test_rightsizing(spark):
    data = [("a", 1024, 800, 0, 0)] * 12 + [("b", 2048, 1900, 5, 0)] * 5 + [("c", None, 100, 0, 0), ("d", 512, None, 0, 0)]
    got = {r["node"]: r for r in t.rightsizing(nodes(spark, data)).collect()}
    assert (got["a"]["recommended_mb"], got["a"]["confidence"]) == (960, "high")
    assert (got["b"]["recommended_mb"], got["b"]["confidence"]) == (2880, "medium")
    assert got["c"]["confidence"] == got["d"]["confidence"] == "n/a" and got["c"]["recommended_mb"] is None
    assert (got["a"]["p95_peak_rss_mb"], got["a"]["current_mb"], got["a"]["samples"]) == (800, 1024, 12)


@pytest.mark.parametrize("p95, spill, want", [(1000, 0.25, 1536), (100, 0.0, 512), (20000, 0.0, 10240)])
def test_recommended_memory(spark, p95, spill, want):
    assert spark.range(1).select(t.recommended_memory(F.lit(p95), F.lit(spill))).first()[0] == want


def test_costs(spark):
    data = [("lambda", 1000, 1024), ("local", 1000, 1024), ("fargate", 3600000, 2048), ("emr-serverless", 3600000, 2048), ("lambda", 0, 1024), ("lambda", 5, None), ("other", 5, 5)]
    df = spark.createDataFrame(data, "target string, ms bigint, mb int")
    costs = [r[0] for r in df.select(t.run_cost(F.col("target"), F.col("ms"), F.col("mb"))).collect()]
    assert costs == pytest.approx([0.0000166667, 0, 0.04048 + 2 * 0.004445, 0.052624 + 2 * 0.0057785, 0, 0, 0])


def test_costs_round_as_the_sql_does(spark):
    """A cost on the edge of a whole nano-dollar: the order of the steps decides its last bit."""
    df = spark.createDataFrame([("fargate", 26880, 576)], "target string, ms bigint, mb int")
    cost = t.run_cost(F.col("target"), F.col("ms"), F.col("mb"))
    assert df.select(F.floor(cost * 1e9)).first()[0] == 103677  # as DuckDB gives it


def test_progress_states(spark):
    schema = "run string, node string, status string, updated_ms bigint, tasks_completed bigint"
    data = [("r", "old", "running", 0, 1), ("r", "new", "", 9000, 1), ("r", "done", "succeeded", 0, 1), ("r", "_run", "running", 9000, 1), ("r", "new", "running", 8000, 9)]
    out = t.progress_states(spark.createDataFrame(data, schema), 12_000)
    assert rows(out, "node", "status", "tasks_completed") == [("done", "SUCCEEDED", 1), ("new", "RUNNING", 1)]


def test_failed_step(spark):
    schema = "execution string, event_id bigint, type string, name string, error string, cause string"
    data = [
        ("x", 1, "TaskStateEntered", "a", None, None), ("x", 2, "TaskStateEntered", "b", None, None), ("x", 3, "TaskFailed", None, "E", "c"),
        ("x", 4, "ExecutionFailed", None, "F", "d"), ("y", 1, "TaskStateEntered", "a", None, None), ("y", 2, "ExecutionFailed", None, "G", "e"),
        ("z", 1, "TaskFailed", None, "H", "f"), ("ok", 1, "TaskStateEntered", "a", None, None),
    ]
    out = t.failed_steps(spark.createDataFrame(data, schema))
    assert rows(out) == [("x", "b", "E", "c"), ("y", "", "G", "e"), ("z", "", "H", "f")]


def commits(spark, data):
    return spark.createDataFrame([("t", *d) for d in data], "table_id string, version bigint, added bigint, updated bigint, deleted bigint, total bigint, replaces boolean")


@pytest.mark.parametrize(
    "data, want",
    [
        ([(0, 10, None, None, None, True), (1, 5, 2, None, None, False), (2, None, None, 3, None, False)], (10, False)),
        ([(4, 10, None, None, None, False), (5, 5, None, None, None, False)], (15, True)),
        ([(4, 10, None, None, None, False), (5, 7, None, None, None, True)], (7, False)),
        ([(0, 1, None, 9, None, False)], (0, False)),
        ([(3, 1, None, None, 42, False)], (42, False)),
    ],
)
def test_row_counts_fold(spark, data, want):
    row = cat.row_counts(commits(spark, data)).first()
    assert (row["row_count"], row["approximate"]) == want


def test_lineage(spark):
    inputs = spark.createDataFrame(
        [("p", "b", "s", "a", None), ("q", "c", "s", "a__default", None), ("q", "d", "zz", "gone", None), ("p", "a", None, None, "raw")],
        "pipeline string, node string, schema string, table string, source string",
    )
    outputs = spark.createDataFrame([("p", "a", "s", "default"), ("p", "b", "s", "x")], "pipeline string, node string, schema string, output string")
    out = rows(cat.lineage(inputs, outputs), "from_node", "to_node", "from_pipeline", "kind")
    assert out == [("a", "b", "p", "local"), ("a", "c", "p", "cross"), ("gone", "d", "(external)", "external"), ("sources.raw", "a", "", "source")]


def test_scalars(spark):
    text = spark.createDataFrame([("1.5K",), (" 200m ",), ("3.2B",), ("1T",), ("-2",), ("",), ("K",), ("1.5X",), (None,)], "x string")
    want = [1500.0, 2e8, 3.2e9, 1e12, -2.0, None, None, None, None]
    assert [r[0] for r in text.select(parse_magnitude(F.col("x"))).collect()] == want
    assert [r[0] for r in text.select(parse_magnitude_udf()("x")).collect()][:5] == want[:5]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(duration_seconds(F.lit(x))) for x in ("30m", "4h", "7d", "120s", "m", "1.5h", "x")] == [1800, 14400, 604800, 120, None, None, None]
    ages = [(-5, "4h"), (7200, "4h"), (14400, "4h"), (1, "bad"), (None, "4h"), (1, None)]
    got = [one(freshness(F.lit(a).cast("bigint"), F.lit(s).cast("string"))) for a, s in ages]
    assert got == ["fresh", "aging", "stale", "none", "none", "none"]
    files = [(16, 16 * 1000), (15, 1), (16, 16 * 16 * 1024 * 1024), (0, 5), (None, 5)]
    assert [one(file_health(F.lit(n).cast("bigint"), F.lit(b).cast("bigint"))) for n, b in files] == ["small", "ok", "ok", "unknown", "unknown"]


def test_profile_handles_odd_names_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([("x", 1, None), ("x", 10, None), (None, 9, None)], "`a.b` string, n int, gone date")
    got = {r["column_name"]: r for r in pr.column_profile(df).collect()}
    assert got["a.b"]["null_count"] == 1 and got["n"]["max_value"] == "10" and got["gone"]["null_pct"] == 1.0
    assert got["n"]["approx_p50"] == 9.0 and got["a.b"]["approx_p50"] is None
    tops = rows(pr.top_values(df), "column_name", "value", "count", "rank")
    assert tops == [("a.b", None, 1, 2), ("a.b", "x", 2, 1), ("n", "1", 1, 1), ("n", "10", 1, 2), ("n", "9", 1, 3)]
    empty = pr.column_profile(df.limit(0)).where("column_name = 'n'").first()
    assert (empty["row_count"], empty["null_pct"], empty["min_value"]) == (0, 0.0, None)
    stats = pr.profile_rows(df, run_id="r", table="t", version=3, scope="table")
    assert stats.where("column_name = 'a.b'").first()["top_10"][0].asDict() == {"value": "x", "count": 2}
    many = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("m"))
    assert pr.listable_columns(many) == ["m"]
