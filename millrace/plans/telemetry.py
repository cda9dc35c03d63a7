"""Analytics over run telemetry: event logs, run rows, costs, memory advice, progress and health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.ranges import range_join
from millrace.functions.scalars import truncated
from millrace.operators.ordering import latest_per_key, top_per_group
from millrace.session import freeze, scratch_dir

# Statuses, triggers, memory limits and list prices (USD, us-east-1 on demand).
TERMINAL = ("SUCCEEDED", "FAILED", "TIMED_OUT", "ABORTED")
FAILED = ("FAILED", "TIMED_OUT", "ABORTED")
TRIGGERS = ("manual", "scheduled", "event", "backfill", "backfill-direct", "upstream")
PROGRESS_FRESH_MS = 12_000
HEALTH_WINDOW = 20
CASCADE_NOTE = "all upstreams skipped"
MEMORY_STEP_MB, MEMORY_MIN_MB, MEMORY_MAX_MB = 64, 512, 10240
SPILL_RATE_LIMIT = 0.25
LAMBDA_GB_SECOND = 0.0000166667
VCPU_HOUR = {"fargate": 0.04048, "emr-serverless": 0.052624}
GB_HOUR = {"fargate": 0.004445, "emr-serverless": 0.0057785}
GB_PER_VCPU = 2.0

EVENT_LOG_SCHEMA = """
`Event` string,
`Task End Reason` struct<`Reason`: string>,
`Task Info` struct<`Launch Time`: bigint, `Finish Time`: bigint>,
`Task Metrics` struct<
  `Peak Execution Memory`: bigint, `Memory Bytes Spilled`: bigint, `Disk Bytes Spilled`: bigint,
  `JVM GC Time`: bigint, `Executor CPU Time`: bigint, `Executor Run Time`: bigint,
  `Shuffle Read Metrics`: struct<`Remote Bytes Read`: bigint, `Local Bytes Read`: bigint>,
  `Shuffle Write Metrics`: struct<`Shuffle Bytes Written`: bigint>,
  `Input Metrics`: struct<`Bytes Read`: bigint, `Records Read`: bigint>>,
`Stage Info` struct<`Submission Time`: bigint, `Completion Time`: bigint>
"""


# -- Spark event logs


def parse_event_log(lines: DataFrame, column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Event log lines under an explicit schema (names that differ only in case defeat inference). Lines that are not
    JSON become empty rows, and so do events that tell nothing of tasks and stages: those, most of a log's bytes, are known
    by their text and not parsed."""
    told = F.col(column).contains("SparkListenerTaskEnd") | F.col(column).contains("SparkListenerStageCompleted")
    return lines.select(*keep, F.from_json(F.when(told, F.col(column)), EVENT_LOG_SCHEMA).alias("e")).select(*keep, "e.*")


def event_log_metrics(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Fourteen task metrics per run. A run whose log shows neither task nor stage has NULLs throughout."""
    task = F.col("Event") == "SparkListenerTaskEnd"
    stage = F.col("Event") == "SparkListenerStageCompleted"

    def metric(path: str) -> Column:
        return F.when(task, F.coalesce(F.col(f"`Task Metrics`.{path}"), F.lit(0)))

    def launched(path: str) -> Column:
        return F.when(task, F.col(f"`Task Info`.`{path}`"))

    tasks, stages = F.count_if(task), F.count_if(stage)
    seen = (tasks > 0) | (stages > 0)
    peak = F.max(metric("`Peak Execution Memory`"))
    cpu = F.sum(metric("`Executor CPU Time`"))
    read = metric("`Shuffle Read Metrics`.`Remote Bytes Read`") + metric("`Shuffle Read Metrics`.`Local Bytes Read`")
    bad = F.coalesce(F.col("`Task End Reason`.Reason") != "Success", F.lit(True))
    longest = F.max(F.greatest(launched("Finish Time") - launched("Launch Time"), F.lit(0)))
    return events.groupBy(*by).agg(
        F.floor(peak / 1048576).alias("peak_execution_memory_mb"),
        F.sum(metric("`Memory Bytes Spilled`")).alias("memory_spilled_bytes"),
        F.sum(metric("`Disk Bytes Spilled`")).alias("disk_spilled_bytes"),
        F.sum(read).alias("shuffle_read_bytes"),
        F.sum(metric("`Shuffle Write Metrics`.`Shuffle Bytes Written`")).alias("shuffle_write_bytes"),
        F.sum(metric("`Input Metrics`.`Bytes Read`")).alias("input_bytes"),
        F.sum(metric("`Input Metrics`.`Records Read`")).alias("input_records"),
        F.when(seen, stages).alias("num_stages"),
        F.when(seen, tasks).alias("num_tasks"),
        F.when(tasks > 0, F.count_if(task & bad)).alias("num_failed_tasks"),
        F.sum(metric("`JVM GC Time`")).alias("jvm_gc_time_ms"),
        F.floor(cpu / 1000000).alias("executor_cpu_time_ms"),
        F.sum(metric("`Executor Run Time`")).alias("executor_run_time_ms"),
        F.when(tasks > 0, F.coalesce(longest, F.lit(0))).alias("max_task_duration_ms"),
    )


def events_between(events: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Only the tasks and stages that ended in a run's time range, for runs that share a session."""
    ended = F.coalesce(F.col("`Task Info`.`Finish Time`"), F.col("`Stage Info`.`Completion Time`"))
    return events.where(ended.between(start_ms, end_ms))


# -- run rows


def _text(json: Column, path: str) -> Column:
    return F.get_json_object(json, path)


def run_trigger(detail_input: Column) -> Column:
    """The known trigger named in the input, else `manual`."""
    value = F.trim(_text(detail_input, "$._trigger"))
    return F.when(value.isin(*TRIGGERS), value).otherwise("manual")


def backfill_target(detail_input: Column) -> Column:
    """The first non-empty staging table, by output name."""
    targets = F.from_json(_text(detail_input, "$._backfill.target_outputs"), "map<string,string>")
    ordered = F.array_sort(F.map_entries(targets))
    filled = F.filter(ordered, lambda e: F.coalesce(e["value"] != "", F.lit(False)))
    return F.try_element_at(filled, F.lit(1))["value"]


def error_message(cause: Column) -> Column:
    """The message inside a JSON cause, or the cause itself; NULL when empty."""
    inner = F.coalesce(
        F.nullif(_text(cause, "$.errorMessage"), F.lit("")), F.nullif(_text(cause, "$.Cause"), F.lit("")), cause
    )
    return truncated(F.nullif(inner, F.lit("")))


def run_rows(details: DataFrame, pipeline: Column) -> DataFrame:
    """Rows for `runs` from execution status events; only terminal ones are kept.

    Expects `executionArn, status, startDate, stopDate, input, error, cause`, dates in milliseconds.
    """
    failed = F.col("status") != "SUCCEEDED"
    start, stop = F.col("startDate"), F.col("stopDate")
    return details.where(F.col("status").isin(*TERMINAL)).select(
        F.element_at(F.split("executionArn", ":"), -1).alias("run_id"),
        pipeline.alias("pipeline"),
        F.col("executionArn").alias("sf_execution_arn"),
        "status",
        run_trigger(F.col("input")).alias("trigger"),
        backfill_target(F.col("input")).alias("target_table"),
        F.when(start > 0, F.timestamp_millis(start)).alias("started_at"),
        F.when(stop > 0, F.timestamp_millis(stop)).alias("ended_at"),
        F.when(start.isNotNull() & stop.isNotNull(), F.greatest(stop - start, F.lit(0))).alias("duration_ms"),
        F.lit("").alias("failed_step"),
        F.when(failed, truncated(F.coalesce("error", F.lit("")))).otherwise("").alias("error_class"),
        F.when(failed, error_message(F.col("cause"))).alias("error_msg"),
    )


def node_run_rows(raw: DataFrame) -> DataFrame:
    """Normalise node runs: times from milliseconds, no negative duration, short messages, whole-number
    memory or NULL, and where it ran. Expects `started_ms, ended_ms, memory_limit, function_name`."""
    return raw.withColumns(
        {
            "started_at": F.timestamp_millis("started_ms"),
            "ended_at": F.timestamp_millis("ended_ms"),
            "duration_ms": F.greatest(F.col("ended_ms") - F.col("started_ms"), F.lit(0)),
            "error_msg": truncated(F.col("error_msg")),
            "memory_mb": F.col("memory_limit").try_cast("int"),
            "compute_target": F.when(F.coalesce("function_name", F.lit("")) != "", "lambda").otherwise("local"),
        }
    ).drop("started_ms", "ended_ms", "memory_limit", "function_name")


def with_skipped(node_runs: DataFrame, expected: DataFrame, keys: Sequence[str] = ("run_id", "node")) -> DataFrame:
    """Add a `skipped` row for each expected node of a run that left no row."""
    present = node_runs.select(*keys).distinct()
    missing = expected.select(*keys).distinct().join(present, list(keys), "left_anti")
    return node_runs.unionByName(missing.withColumn("status", F.lit("skipped")), allowMissingColumns=True)


def cascade_skipped(edges: DataFrame, node_runs: DataFrame, keys: Sequence[str] = ("run_id",), most_rounds: int = 1000) -> DataFrame:
    """The nodes that a run skips because all their parents were skipped, in one step or through others: `keys`, node.

    `edges` are (parent, child) of the graph, `node_runs` have the keys, node and status; a node with a row of its own is
    what its row says. Skips spread by a child a round: a round counts the skipped parents of each run and child, by a
    join and a group-by over what the round before has found, and ends when nothing is new. Rounds are written tables."""
    spark, keys = edges.sparkSession, list(keys)
    edges = edges.select("parent", "child").distinct()
    needs = edges.groupBy("child").agg(F.count(F.lit(1)).alias("parents"))
    have = node_runs.select(*keys, F.col("node").alias("child")).distinct()
    with scratch_dir(spark, "cascade") as path:
        links = freeze(edges.join(needs, "child"), f"{path}/links")
        new = freeze(node_runs.where(F.col("status") == "skipped").select(*keys, "node").distinct(), f"{path}/skipped-0")
        met = found = None
        for round_ in range(1, most_rounds + 1):
            hits = new.join(links, F.col("node") == F.col("parent")).groupBy(*keys, "child", "parents").agg(F.count(F.lit(1)).alias("skipped"))
            if met is not None:  # parents that earlier rounds have found
                hits = hits.unionByName(met).groupBy(*keys, "child", "parents").agg(F.sum("skipped").alias("skipped"))
            hits = freeze(hits, f"{path}/met-{round_}")
            whole = hits.where("skipped = parents").join(have, [*keys, "child"], "left_anti").select(*keys, F.col("child").alias("node"))
            met = hits.where("skipped < parents")
            new = freeze(whole, f"{path}/skipped-{round_}")
            if new.isEmpty():
                break
            found = new if found is None else found.unionByName(new)
        else:
            raise RuntimeError("the graph is deeper than the rounds allowed")
        return freeze(new if found is None else found)


def with_cascade(node_runs: DataFrame, edges: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Node runs with a `skipped` row for every node that the cascade reaches."""
    missing = cascade_skipped(edges, node_runs, keys).withColumns({"status": F.lit("skipped"), "error_msg": F.lit(CASCADE_NOTE)})
    if "error_msg" not in node_runs.columns:
        missing = missing.drop("error_msg")
    return node_runs.unionByName(missing, allowMissingColumns=True)


def net_rows(commits: DataFrame) -> DataFrame:
    """Add `net_rows`: a merge counts inserts less deletes, any other write its output rows; never below
    zero, NULL when the metric is missing."""
    merge = F.upper("operation").contains("MERGE")
    added = F.when(merge, F.col("inserted")).otherwise(F.col("output_rows"))
    gone = F.when(merge, F.coalesce("deleted", F.lit(0))).otherwise(0)
    return commits.withColumn("net_rows", F.when(added.isNotNull(), F.greatest(added - gone, F.lit(0))))


def net_output(commit: Row) -> int | None:
    """`net_rows` of one commit row that is at hand."""
    if "MERGE" in commit["operation"].upper():
        return None if commit["inserted"] is None else max(commit["inserted"] - (commit["deleted"] or 0), 0)
    return None if commit["output_rows"] is None else max(commit["output_rows"], 0)


def touched_output(commit: Row) -> int | None:
    """`row_count` of `touched_rows` for one commit row that is at hand."""
    if "MERGE" in commit["operation"].upper():
        return (commit["inserted"] or 0) + (commit["updated"] or 0) or None
    return commit["output_rows"]


def touched_rows(commits: DataFrame) -> DataFrame:
    """Add `row_count`: rows a commit touched. Merges: inserted and updated, NULL when none."""
    merge = F.upper("operation").contains("MERGE")
    both = F.coalesce("inserted", F.lit(0)) + F.coalesce("updated", F.lit(0))
    rows = F.when(merge, F.nullif(both, F.lit(0))).otherwise(F.col("output_rows"))
    return commits.withColumn("row_count", rows)


# -- listings and status


def latest_runs(runs: DataFrame, n: int, order: Sequence[str] = ("started_at", "run_id")) -> DataFrame:
    """The newest `n` runs of each pipeline; `truncated` says whether there were more."""
    newest = top_per_group(runs, ["pipeline"], [F.desc(c) for c in order], n + 1)
    counts = Window.partitionBy("pipeline")  # at most n + 1 rows per pipeline
    return newest.withColumn("truncated", F.count(F.lit(1)).over(counts) > n).where(F.col("rank") <= n)


def node_run_listing(
    node_runs: DataFrame,
    n: int,
    pipeline: str | None = None,
    node: str | None = None,
    execution: str | None = None,
    order: Sequence[str] = ("started_at", "run_id", "node"),
) -> DataFrame:
    """The newest node runs that match the given filters."""
    for column, value in (("pipeline", pipeline), ("node", node), ("sf_execution_arn", execution)):
        if value is not None:
            node_runs = node_runs.where(F.col(column) == value)
    return node_runs.orderBy(*[F.desc(c) for c in order]).limit(n)


def run_status(status: Column) -> Column:
    """Badge of a run status (upper-case vocabulary)."""
    return (
        F.when(status == "SUCCEEDED", "success")
        .when(status.isin(*FAILED), "failed")
        .when(status == "RUNNING", "running")
        .otherwise("outline")
    )


def node_status(status: Column) -> Column:
    """Badge of a node run status (lower-case vocabulary)."""
    return (
        F.when(status == "ok", "success")
        .when(status.isin("failed", "running"), status)
        .otherwise("outline")
    )


def run_matrix(runs: DataFrame, node_runs: DataFrame, n: int) -> DataFrame:
    """Run by node: the latest node run of each execution and node, next to its run. `position` counts
    the newest `n` runs per pipeline from oldest to newest, `bar` is the duration against the longest."""
    shown = top_per_group(runs, ["pipeline"], [F.desc("started_at"), F.desc("run_id")], n, "_newness")
    whole = Window.partitionBy("pipeline")  # at most n rows per pipeline
    longest = F.max(F.when(F.col("duration_ms") > 0, F.col("duration_ms"))).over(whole)
    shown = shown.select(
        "pipeline",
        "run_id",
        F.coalesce(F.nullif("sf_execution_arn", F.lit("")), "run_id").alias("_key"),
        F.to_date("started_at").alias("day"),
        (F.max("_newness").over(whole) - F.col("_newness") + 1).cast("bigint").alias("position"),
        F.round(F.greatest("duration_ms", F.lit(0)) / longest, 4).alias("bar"),
    )
    key = F.coalesce(F.nullif("sf_execution_arn", F.lit("")), F.col("run_id"))
    latest = latest_per_key(node_runs.withColumn("_key", key), ["_key", "node"], ["started_at", "status"])
    cells = latest.select("_key", "node", F.col("status").alias("node_status"))
    return shown.join(cells, "_key").drop("_key")


def progress_states(markers: DataFrame, now_ms: int | Column) -> DataFrame:
    """The newest marker per run and node. One that claims to run but is old is dropped; terminal ones
    never expire; no status means running."""
    latest = latest_per_key(markers, ["run", "node"], ["updated_ms", "tasks_completed"])
    status = F.coalesce(F.nullif("status", F.lit("")), F.lit("running"))
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    stale = (status == "running") & (now - F.col("updated_ms") >= PROGRESS_FRESH_MS)
    known = F.when(status.isin("succeeded", "failed", "skipped"), F.upper(status)).otherwise("RUNNING")
    return latest.where((F.col("node") != "_run") & ~stale).withColumn("status", known)


def settled_states(progress: DataFrame, node_runs: DataFrame) -> DataFrame:
    """Live states, where a recorded result beats a live `RUNNING` for the same run and node."""
    final = (
        node_runs.where(F.col("status").isin("ok", "failed"))
        .groupBy(F.col("run_id").alias("run"), "node")
        .agg(F.max_by("status", "started_at").alias("_final"))
    )
    recorded = F.when(F.col("_final") == "ok", "SUCCEEDED").when(F.col("_final") == "failed", "FAILED")
    both = progress.join(final, ["run", "node"], "left")
    running = F.col("status") == "RUNNING"
    return both.withColumn("status", F.when(running, F.coalesce(recorded, "status")).otherwise(F.col("status"))).drop("_final")


def pipeline_health(runs: DataFrame, pipelines: DataFrame) -> DataFrame:
    """State of each pipeline from its newest terminal run, and the success rate of the last twenty;
    no rate while something runs."""
    running = runs.groupBy("pipeline").agg(
        F.bool_or(F.col("status") == "RUNNING").alias("_running")
    )
    terminal = runs.where(F.col("status").isin(*TERMINAL))
    recent = top_per_group(terminal, ["pipeline"], [F.desc("started_at"), F.desc("run_id")], HEALTH_WINDOW)
    window = recent.groupBy("pipeline").agg(
        F.max(F.when(F.col("rank") == 1, F.col("status"))).alias("_last"),
        F.avg((F.col("status") == "SUCCEEDED").cast("double")).alias("_rate"),
        F.count(F.lit(1)).alias("_window"),
    )
    busy = F.coalesce("_running", F.lit(False))
    state = (
        F.when(busy, "running")
        .when(F.col("_last").isNull(), "never-run")
        .when(F.col("_last").isin(*FAILED), "failed")
        .otherwise("healthy")
    )
    joined = pipelines.select("pipeline").distinct().join(running, "pipeline", "left").join(window, "pipeline", "left")
    return joined.select(
        "pipeline",
        state.alias("state"),
        F.when(~busy, F.col("_rate")).alias("success_rate"),
        F.when(busy, 0).otherwise(F.coalesce("_window", F.lit(0))).cast("bigint").alias("success_window"),
    )


# -- failures and logs


def failed_steps(history: DataFrame, execution: str = "execution") -> DataFrame:
    """Step, error and cause of each execution's first failure. A task failure names the state entered
    last before it, an execution failure names none.

    Expects `event_id, type, name, error, cause`. Two aggregations instead of a window, so one endless
    execution does not end up in one task.
    """
    failure = F.col("type").isin("TaskFailed", "ExecutionFailed")
    first = history.where(failure).groupBy(execution).agg(
        F.min(F.struct("event_id", "type", "error", "cause")).alias("_f")
    )
    entered = history.where(F.col("type") == "TaskStateEntered").select(execution, "event_id", "name")
    before = (
        entered.join(first.select(execution, F.col("_f.event_id").alias("_at")), execution)
        .where(F.col("event_id") < F.col("_at"))
        .groupBy(execution)
        .agg(F.max_by("name", "event_id").alias("_state"))
    )
    step = F.when(F.col("_f.type") == "TaskFailed", F.coalesce("_state", F.lit(""))).otherwise("")
    return first.join(before, execution, "left").select(
        execution, step.alias("failed_step"), F.col("_f.error").alias("error"), F.col("_f.cause").alias("cause")
    )


def step_windows(history: DataFrame, keys: Sequence[str], now_ms: int) -> DataFrame:
    """`start_ms` and `end_ms` of each step: first entered to last exited or failed, or to now."""
    at = F.col("at_ms")
    return (
        history.groupBy(*keys)
        .agg(
            F.min(F.when(F.col("type") == "TaskStateEntered", at)).alias("start_ms"),
            F.max(F.when(F.col("type").isin("TaskStateExited", "TaskFailed"), at)).alias("end_ms"),
        )
        .where("start_ms IS NOT NULL")
        .withColumn("end_ms", F.coalesce("end_ms", F.lit(now_ms)))
    )


def step_logs(lines: DataFrame, windows: DataFrame, keys: Sequence[str], at: str = "at_ms", bucket_ms: int = 3_600_000, salts: int = 4) -> DataFrame:
    """Log lines inside their step's time window; the lines of one bucket are spread over `salts` tasks."""
    return range_join(lines, at, windows, "start_ms", "end_ms", bucket_ms, "inner", keys, salts)


# -- cost and memory


def run_cost(target: Column, duration_ms: Column, memory_mb: Column) -> Column:
    """Approximate USD of one run. Local, unknown and unmeasured runs cost nothing."""
    seconds, gb = duration_ms / 1000.0, memory_mb / 1024.0
    cost = F.when((duration_ms <= 0) | duration_ms.isNull() | memory_mb.isNull() | (memory_mb <= 0), 0.0)
    cost = cost.when(target == "lambda", seconds * gb * LAMBDA_GB_SECOND)
    for name, vcpu_hour in VCPU_HOUR.items():
        # Hourly prices are added up before they meet the hours: doubles round by the order of the steps.
        per_hour = memory_mb / (1024.0 * GB_PER_VCPU) * vcpu_hour + gb * GB_HOUR[name]
        cost = cost.when(target == name, per_hour * (duration_ms / 3_600_000.0))
    return cost.otherwise(0.0)


def cost_rollup(node_runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Runs, records, seconds, cost and the two rates of completed runs, per node or pipeline."""
    inputs, outputs = F.col("input_records"), F.col("output_rows")
    records = F.when(inputs > 0, inputs).when(outputs > 0, outputs).otherwise(0)
    cost = run_cost(F.col("compute_target"), F.col("duration_ms"), F.col("memory_mb"))
    named = F.nullif("compute_target", F.lit(""))
    totals = (
        node_runs.where(F.col("status") == "ok")
        .groupBy(*by)
        .agg(
            # The rows are seen newest first, so the last target seen is the oldest run's.
            F.min_by(named, F.when(named.isNotNull(), F.struct("started_at", "run_id"))).alias("compute_target"),
            F.count(F.lit(1)).alias("runs"),
            F.sum(records).alias("records"),
            (F.sum(F.coalesce("duration_ms", F.lit(0))) / 1000.0).alias("billed_seconds"),
            F.sum(cost).alias("cost_usd"),
        )
    )
    per_second = F.col("records") / F.nullif("billed_seconds", F.lit(0.0))
    per_billion = F.col("cost_usd") / F.nullif(F.col("records"), F.lit(0)) * 1e9
    return totals.withColumns(
        {"records_per_sec": F.coalesce(per_second, F.lit(0.0)), "cost_per_billion": F.coalesce(per_billion, F.lit(0.0))}
    )


def recommended_memory(p95: Column, spill_rate: Column) -> Column:
    """A fifth above the observed peak, a quarter more when spilling, in whole steps within the limits."""
    base = F.floor(p95 * 6 / 5)
    base = F.when(spill_rate >= SPILL_RATE_LIMIT, F.floor(base * 5 / 4)).otherwise(base)
    stepped = F.ceil(base / MEMORY_STEP_MB) * MEMORY_STEP_MB
    return F.least(F.greatest(stepped, F.lit(MEMORY_MIN_MB)), F.lit(MEMORY_MAX_MB))


def rightsizing(node_runs: DataFrame, by: Sequence[str] = ("node",)) -> DataFrame:
    """Memory advice per node from the 95th percentile peak, the spill rate and the newest allocation.
    The percentile is the exact nearest rank: peaks are whole megabytes, so few distinct values."""
    peak, memory = F.col("peak_rss_mb"), F.col("memory_mb")
    spilled = (F.coalesce("memory_spilled_bytes", F.lit(0)) > 0) | (F.coalesce("disk_spilled_bytes", F.lit(0)) > 0)
    facts = node_runs.groupBy(*by).agg(
        F.count(peak).alias("samples"),
        F.max_by(memory, F.when(memory.isNotNull(), F.struct("started_at", "run_id"))).cast("bigint").alias("current_mb"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY peak_rss_mb)").cast("bigint").alias("p95_peak_rss_mb"),
        F.count_if(peak.isNotNull() & spilled).alias("_spilled"),
    )
    rate = F.coalesce(F.col("_spilled") / F.nullif(F.col("samples"), F.lit(0)), F.lit(0.0))
    known = F.col("current_mb").isNotNull() & (F.col("samples") > 0)
    confidence = F.when(~known, "n/a").when(F.col("samples") >= 10, "high").when(F.col("samples") >= 4, "medium")
    advice = recommended_memory(F.col("p95_peak_rss_mb"), F.col("spill_rate")).cast("bigint")
    return (
        facts.withColumn("spill_rate", rate)
        .withColumn("recommended_mb", F.when(known, advice))
        .withColumn("confidence", confidence.otherwise("low"))
        .drop("_spilled")
    )


# -- a pipeline's own dashboard


def recent_failures(runs: DataFrame, pipeline: str, now: Column, hours: int = 24) -> DataFrame:
    """How many runs of a pipeline failed in the hours before `now`."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    failed = runs.where((F.col("pipeline") == pipeline) & (F.col("status") == "FAILED") & (age < hours * 3_600_000_000))
    return failed.agg(F.count(F.lit(1)).alias("n"))


def run_total(runs: DataFrame, pipeline: str) -> DataFrame:
    return runs.where(F.col("pipeline") == pipeline).agg(F.count(F.lit(1)).alias("n"))


def newest_runs(runs: DataFrame, pipeline: str, n: int) -> DataFrame:
    """The last `n` runs to start; those of one instant by their id, so that the choice is always the same."""
    return runs.where(F.col("pipeline") == pipeline).orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)


def duration_series(runs: DataFrame, pipeline: str, n: int = 50) -> DataFrame:
    return newest_runs(runs, pipeline, n).select(F.col("started_at").alias("x"), F.col("duration_ms").alias("y"), "run_id").orderBy("x", "run_id")


def failing_nodes(node_runs: DataFrame, pipeline: str) -> DataFrame:
    failed = node_runs.where((F.col("pipeline") == pipeline) & (F.col("status") == "failed"))
    return failed.groupBy(F.col("node").alias("x")).agg(F.count(F.lit(1)).alias("y")).orderBy(F.desc("y"), "x")
