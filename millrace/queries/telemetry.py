"""Run telemetry: R1 to R18. Runs, node runs and histories are derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.plans import serving
from millrace.plans import telemetry as t
from millrace.queries._registry import query, table
from millrace.session import scratch_path
from millrace.streaming.ingest import file_stream
from millrace.streaming.progress import stream_live_progress, stream_progress
from millrace.tables.store import VersionedTable

# The derived tables are plain SQL that both engines read alike; only the time functions differ.
NODE_RUNS = """SELECT 'run-' || CAST(event_id AS {s}) AS run_id, 'p' || CAST(user_id AS {s}) AS pipeline, event_type AS node,
  {ms} AS started_ms, ts AS started_at, CAST(floor(value * 100) AS BIGINT) AS duration_ms,
  CASE WHEN value < 10 THEN 'failed' WHEN value < 20 THEN 'skipped' ELSE 'ok' END AS status,
  CASE event_type WHEN 'view' THEN 'lambda' WHEN 'click' THEN 'lambda' WHEN 'purchase' THEN 'fargate'
    WHEN 'signup' THEN 'emr-serverless' ELSE 'local' END AS compute_target,
  CASE WHEN value < 5 THEN NULL ELSE CAST(floor(value) AS INT) + 512 END AS memory_mb,
  CASE WHEN value < 2 THEN NULL ELSE CAST(floor(value * 10) AS BIGINT) END AS peak_rss_mb,
  CASE WHEN value > 60 THEN CAST(1000 AS BIGINT) END AS memory_spilled_bytes,
  CASE WHEN value > 200 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS disk_spilled_bytes,
  CASE WHEN value < 30 THEN NULL ELSE CAST(floor(value * 1000) AS BIGINT) END AS input_records,
  CASE WHEN value < 1 THEN NULL ELSE CAST(floor(value * 10) AS BIGINT) END AS output_rows FROM events"""
RUNS = """SELECT 'run-' || CAST(o_orderkey AS {s}) AS run_id, o_orderpriority AS pipeline,
  CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN 'RUNNING' WHEN o_orderstatus = 'F' THEN 'FAILED'
    WHEN o_orderstatus = 'O' THEN 'SUCCEEDED' ELSE 'ABORTED' END AS status,
  o_orderdate AS started_at, CAST(floor(o_totalprice) AS BIGINT) AS duration_ms, '' AS sf_execution_arn,
  CASE WHEN o_custkey < 500 THEN 'manual' ELSE 'scheduled' END AS trigger FROM orders"""
ORDER_NODE_RUNS = """SELECT 'run-' || CAST(l_orderkey AS {s}) AS run_id, '' AS sf_execution_arn,
  'n' || CAST(l_linenumber AS {s}) AS node, l_shipdate AS started_at,
  CASE l_returnflag WHEN 'A' THEN 'ok' WHEN 'N' THEN 'failed' ELSE 'skipped' END AS status FROM lineitem"""
HISTORY = """SELECT user_id, event_id, {ms} AS at_ms, CASE event_type WHEN 'view' THEN 'TaskStateEntered' WHEN 'click' THEN
  'TaskStateExited' WHEN 'error' THEN CASE WHEN value < 40 THEN 'TaskFailed' ELSE 'Other' END WHEN 'purchase' THEN
  CASE WHEN value < 20 THEN 'ExecutionFailed' ELSE 'Other' END ELSE 'Other' END AS type,
  'step-' || CAST(CAST(floor(value) AS BIGINT) AS {s}) AS name, 'E' || CAST(event_id AS {s}) AS error, props AS cause FROM events"""


def duck(sql: str) -> str:
    return sql.replace("{s}", "VARCHAR").replace("{ms}", "epoch_us(ts) // 1000")


def derived(spark, sf, sql):
    """The derived table in Spark; its source tables become views first."""
    for name in ("events", "orders", "lineitem"):
        table(spark, sf, name).createOrReplaceTempView(f"given_{name}")
        sql = sql.replace(f"FROM {name}", f"FROM given_{name}")
    return spark.sql(sql.replace("{s}", "STRING").replace("{ms}", "unix_millis(CAST(ts AS TIMESTAMP))"))


# -- R1, R2: event logs

LOG_LINE = """CASE WHEN l_linenumber = 7 THEN '{"Event": broken' WHEN l_linenumber = 6 THEN
  to_json(named_struct('Event', 'SparkListenerStageCompleted', 'Stage Info', named_struct('Completion Time', l_suppkey)))
  ELSE to_json(named_struct('Event', 'SparkListenerTaskEnd',
    'Task End Reason', named_struct('Reason', IF(l_returnflag = 'R', 'ExceptionFailure', 'Success')),
    'Task Info', named_struct('Launch Time', l_suppkey, 'Finish Time', l_suppkey + CAST(l_quantity AS BIGINT)),
    'Task Metrics', named_struct('Peak Execution Memory', l_partkey * 1048576, 'Memory Bytes Spilled', l_partkey,
      'Disk Bytes Spilled', l_suppkey, 'JVM GC Time', CAST(l_linenumber AS BIGINT), 'Executor CPU Time', l_partkey * 1000000,
      'Executor Run Time', CAST(l_quantity AS BIGINT), 'Shuffle Read Metrics', named_struct('Remote Bytes Read', l_partkey,
      'Local Bytes Read', l_suppkey), 'Shuffle Write Metrics', named_struct('Shuffle Bytes Written', l_suppkey),
      'Input Metrics', named_struct('Bytes Read', l_partkey * 100, 'Records Read', l_partkey)))) END"""
TASK = "l_linenumber < 6"


def metrics_sql(where: str = "true") -> str:
    def total(expr):
        return f"CAST(sum({expr}) FILTER ({TASK}) AS BIGINT)"

    return f"""SELECT l_orderkey AS run, max(l_partkey) FILTER ({TASK}) AS peak_execution_memory_mb,
      {total('l_partkey')} AS memory_spilled_bytes, {total('l_suppkey')} AS disk_spilled_bytes,
      {total('l_partkey + l_suppkey')} AS shuffle_read_bytes, {total('l_suppkey')} AS shuffle_write_bytes,
      {total('l_partkey * 100')} AS input_bytes, {total('l_partkey')} AS input_records,
      CASE WHEN count(*) FILTER (l_linenumber < 7) > 0 THEN count(*) FILTER (l_linenumber = 6) END AS num_stages,
      CASE WHEN count(*) FILTER (l_linenumber < 7) > 0 THEN count(*) FILTER ({TASK}) END AS num_tasks,
      CASE WHEN count(*) FILTER ({TASK}) > 0 THEN count(*) FILTER ({TASK} AND l_returnflag = 'R') END AS num_failed_tasks,
      {total('l_linenumber')} AS jvm_gc_time_ms, {total('l_partkey')} AS executor_cpu_time_ms,
      {total('CAST(l_quantity AS BIGINT)')} AS executor_run_time_ms,
      CAST(max(l_quantity) FILTER ({TASK}) AS BIGINT) AS max_task_duration_ms
      FROM lineitem WHERE {where} GROUP BY l_orderkey"""


def log_events(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("given_lineitem")
    lines = spark.sql(f"SELECT l_orderkey AS run, {LOG_LINE} AS value FROM given_lineitem")
    return t.parse_event_log(lines, keep=["run"])


@query("r1_event_log_metrics", metrics_sql())
def r1(spark, sf):
    return t.event_log_metrics(log_events(spark, sf), ["run"])


@query(
    "r2_scoped_metrics",
    metrics_sql("CASE WHEN l_linenumber < 6 THEN l_suppkey + CAST(l_quantity AS BIGINT) BETWEEN 50 AND 100 "
                "WHEN l_linenumber = 6 THEN l_suppkey BETWEEN 50 AND 100 ELSE false END"),
)
def r2(spark, sf):
    return t.event_log_metrics(t.events_between(log_events(spark, sf), 50, 100), ["run"])


# -- R3 to R6: rows


@query(
    "r3_run_rows",
    """SELECT 'exec-' || o_orderkey AS run_id, 'shop' AS pipeline, 'arn:x:y:exec-' || o_orderkey AS sf_execution_arn,
         CASE o_orderstatus WHEN 'F' THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'scheduled' WHEN '2-HIGH' THEN 'backfill' ELSE 'manual' END AS trigger,
         CASE WHEN o_orderpriority = '2-HIGH' THEN 'b__' || o_custkey END AS target_table,
         greatest(CAST(floor(o_totalprice) AS BIGINT) - 1000, 0) AS duration_ms, '' AS failed_step,
         CASE o_orderstatus WHEN 'F' THEN 'States.TaskFailed' ELSE '' END AS error_class,
         CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 'boom ' || o_custkey
              WHEN o_orderpriority = '2-HIGH' THEN 'plain text' WHEN o_orderpriority = '3-MEDIUM' THEN 'why'
              WHEN o_orderpriority = '5-LOW' THEN repeat('x', 4093) || '...' END END AS error_msg
       FROM orders WHERE o_orderstatus <> 'P'""",
)
def r3(spark, sf):
    sql = """SELECT 'arn:x:y:exec-' || CAST(o_orderkey AS STRING) AS executionArn,
      CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'SUCCEEDED' ELSE 'RUNNING' END AS status,
      CAST(1000 AS BIGINT) AS startDate, CAST(floor(o_totalprice) AS BIGINT) AS stopDate,
      CASE o_orderpriority WHEN '1-URGENT' THEN '{"_trigger": " scheduled "}' WHEN '2-HIGH' THEN
        '{"_trigger": "backfill", "_backfill": {"target_outputs": {"b": "b__' || CAST(o_custkey AS STRING) || '", "a": "", "c": "later"}}}'
        WHEN '3-MEDIUM' THEN '{"_trigger": "unheard-of"}' WHEN '5-LOW' THEN 'not json' END AS input,
      'States.TaskFailed' AS error, CASE o_orderpriority WHEN '1-URGENT' THEN
        '{"errorMessage": "boom ' || CAST(o_custkey AS STRING) || '"}' WHEN '2-HIGH' THEN 'plain text' WHEN '3-MEDIUM' THEN
        '{"Cause": "why"}' WHEN '5-LOW' THEN repeat('x', 5000) ELSE '' END AS cause FROM orders"""
    return t.run_rows(derived(spark, sf, sql), F.lit("shop")).drop("started_at", "ended_at")


@query(
    "r4_node_run_rows",
    """SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_linenumber > 5 THEN 0 ELSE l_suppkey END AS duration_ms,
              CASE WHEN l_quantity > 40 THEN 4096 ELSE 100 * CAST(l_quantity AS BIGINT) END AS message_length,
              CASE WHEN l_returnflag = 'A' THEN 512 END AS memory_mb,
              CASE WHEN l_linestatus = 'O' THEN 'lambda' ELSE 'local' END AS compute_target FROM lineitem""",
)
def r4(spark, sf):
    sql = """SELECT l_orderkey, l_partkey, l_linenumber, CAST(5000 AS BIGINT) AS started_ms,
      CASE WHEN l_linenumber > 5 THEN 4000 ELSE 5000 + l_suppkey END AS ended_ms, repeat('0123456789', 10 * CAST(l_quantity AS INT)) AS error_msg,
      CASE l_returnflag WHEN 'A' THEN '512' WHEN 'N' THEN 'lots' END AS memory_limit,
      CASE WHEN l_linestatus = 'O' THEN 'fn' ELSE '' END AS function_name FROM lineitem"""
    rows = t.node_run_rows(derived(spark, sf, sql))
    rows = rows.withColumn("message_length", F.length("error_msg").cast("bigint"))
    return rows.drop("error_msg", "started_at", "ended_at")


@query(
    "r5_skipped_nodes",
    """WITH seen AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
            expected AS (SELECT o_orderkey, n FROM orders, range(1, 8) r(n))
       SELECT status, count(*) AS n FROM (
         SELECT CASE WHEN l_orderkey IS NULL THEN 'skipped' ELSE 'present' END AS status
         FROM expected LEFT JOIN seen ON o_orderkey = l_orderkey AND n = l_linenumber
         UNION ALL SELECT 'row' FROM lineitem) x WHERE status <> 'present' GROUP BY status""",
)
def r5(spark, sf):
    runs = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("node"), F.lit("row").alias("status")
    )
    nodes = F.explode(F.sequence(F.lit(1), F.lit(7))).alias("node")
    expected = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), nodes)
    return t.with_skipped(runs, expected).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _reached() -> str:
    """Skipped or not by line number: recorded, else all parents (the number before and half of it) are skipped."""
    steps = ["coalesce(r1, false) AS s1"]
    for k in range(2, 8):
        parents = sorted({k - 1, k // 2})
        steps.append(f"coalesce(r{k}, {' AND '.join(f's{p}' for p in parents)}) AS s{k}")
    return ", ".join(steps)


@query(
    "r5_cascade",
    f"""WITH w AS (SELECT l_orderkey AS run_id, {', '.join(f"max(skipped) FILTER (l_linenumber = {k}) AS r{k}" for k in range(1, 8))}
          FROM (SELECT l_orderkey, l_linenumber, l_quantity < 25 AS skipped FROM lineitem WHERE l_linenumber <= 2 OR l_quantity > 40) x GROUP BY 1),
             s AS (SELECT *, {_reached()} FROM w)
        SELECT n AS node, reached, count(*) AS runs FROM (
          {' UNION ALL '.join(f"SELECT {k} AS n, r{k} IS NULL AS reached FROM s WHERE s{k}" for k in range(1, 8))}) x GROUP BY n, reached""",
)
def r5_cascade(spark, sf):
    """Runs are orders, nodes are line numbers; each has the number before and half of it as its parents."""
    lines = table(spark, sf, "lineitem").where("l_linenumber <= 2 OR l_quantity > 40").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_quantity") < 25).alias("skipped"))
    runs = lines.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("int").alias("node"), F.when(F.col("skipped"), "skipped").otherwise("ok").alias("status"))
    numbers = table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("int").alias("child")).distinct().where("child > 1")
    edges = numbers.select(F.explode(F.array(F.col("child") - 1, (F.col("child") / 2).cast("int"))).alias("parent"), "child")
    whole = t.with_cascade(runs.withColumn("error_msg", F.lit(None).cast("string")), edges).where("status = 'skipped'")
    return whole.groupBy("node", F.col("error_msg").isNotNull().alias("reached")).agg(F.count(F.lit(1)).alias("runs"))



@query(
    "r6_net_rows",
    """SELECT l_suppkey, CAST(sum(CASE WHEN l_returnflag = 'A' THEN greatest(l_partkey - 500, 0)
                                       WHEN l_linenumber = 1 THEN NULL ELSE l_partkey END) AS BIGINT) AS net_rows
       FROM lineitem GROUP BY l_suppkey""",
)
def r6(spark, sf):
    sql = """SELECT l_suppkey, CASE WHEN l_returnflag = 'A' THEN 'MERGE' ELSE 'WRITE' END AS operation, l_partkey AS inserted,
      CAST(500 AS BIGINT) AS deleted, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_partkey END AS output_rows FROM lineitem"""
    return t.net_rows(derived(spark, sf, sql)).groupBy("l_suppkey").agg(F.sum("net_rows").alias("net_rows"))


# -- R7 to R10, R14, R15, R18: listings and status


@query(
    "r7_latest_runs",
    f"""SELECT pipeline, run_id, status, total > 25 AS truncated FROM (
          SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY started_at DESC, run_id DESC) AS rn,
                 count(*) OVER (PARTITION BY pipeline) AS total FROM ({duck(RUNS)}) r) x WHERE rn <= 25""",
)
def r7(spark, sf):
    return t.latest_runs(derived(spark, sf, RUNS), 25).select("pipeline", "run_id", "status", "truncated")


@query(
    "r8_node_run_listing",
    f"""SELECT run_id, status FROM ({duck(NODE_RUNS)}) r WHERE pipeline = 'p41' AND node = 'view'
        ORDER BY started_at DESC, run_id DESC LIMIT 10""",
)
def r8(spark, sf):
    runs = derived(spark, sf, NODE_RUNS)
    return t.node_run_listing(runs, 10, pipeline="p41", node="view").select("run_id", "status")


@query(
    "r9_run_matrix",
    f"""WITH runs AS (SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY started_at DESC, run_id DESC) AS newness
                      FROM ({duck(RUNS)}) r),
             shown AS (SELECT *, max(newness) OVER (PARTITION BY pipeline) - newness + 1 AS position,
                       round(duration_ms / max(duration_ms) OVER (PARTITION BY pipeline), 4) AS bar FROM runs WHERE newness <= 200),
             cells AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, node ORDER BY started_at DESC, status DESC) AS rn
                       FROM ({duck(ORDER_NODE_RUNS)}) n) y WHERE rn = 1)
        SELECT shown.pipeline, shown.run_id, CAST(shown.started_at AS DATE) AS day, position, bar, node, cells.status AS node_status
        FROM shown JOIN cells ON shown.run_id = cells.run_id""",
)
def r9(spark, sf):
    return t.run_matrix(derived(spark, sf, RUNS), derived(spark, sf, ORDER_NODE_RUNS), 200)


PROGRESS = """SELECT user_id AS run, event_type AS node, CASE WHEN value < 30 THEN 'running' WHEN value < 35 THEN ''
  WHEN value < 60 THEN 'succeeded' WHEN value < 100 THEN 'failed' ELSE 'skipped' END AS status, {ms} AS updated_ms,
  event_id AS tasks_completed FROM events"""
NOW_MS = 1706659200000 - 86400000


@query(
    "r10_progress",
    f"""WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, node
                          ORDER BY updated_ms DESC, tasks_completed DESC) AS rn FROM ({duck(PROGRESS)}) p) x WHERE rn = 1),
             live AS (SELECT run, node, tasks_completed, CASE WHEN status IN ('running', '') THEN 'RUNNING' ELSE upper(status) END AS status
                      FROM latest WHERE NOT (status IN ('running', '') AND {NOW_MS} - updated_ms >= 12000)),
             final AS (SELECT user_id, event_type, max_by(value < 10, ts) AS failed FROM events
                       WHERE value < 10 OR value >= 20 GROUP BY 1, 2)
        SELECT run, node, tasks_completed, CASE WHEN live.status = 'RUNNING' AND failed IS NOT NULL
                 THEN CASE WHEN failed THEN 'FAILED' ELSE 'SUCCEEDED' END ELSE live.status END AS status
        FROM live LEFT JOIN final ON run = user_id AND node = event_type""",
)
def r10(spark, sf):
    states = t.progress_states(derived(spark, sf, PROGRESS), NOW_MS).drop("updated_ms")
    recorded = derived(spark, sf, NODE_RUNS).withColumn("run_id", F.expr("CAST(substring(pipeline, 2) AS BIGINT)"))
    return t.settled_states(states, recorded)


@query(
    "r10_streaming_progress",
    f"""SELECT run, node, updated_ms, tasks_completed, status FROM (SELECT *, row_number() OVER (PARTITION BY run, node
          ORDER BY updated_ms DESC, tasks_completed DESC) AS rn FROM ({duck(PROGRESS)}) p) x WHERE rn = 1""",
)
def r10_streaming(spark, sf):
    landing, state = scratch_path(spark, "markers"), scratch_path(spark, "state")
    markers = derived(spark, sf, PROGRESS)
    markers.repartition(4, "tasks_completed").write.parquet(landing)
    folded = VersionedTable(spark, scratch_path(spark, "progress"))
    stream_progress(file_stream(spark, landing, markers.schema, max_files=2), state, folded)
    return folded.read()


@query(
    "r10_stateful_progress",
    f"""SELECT run, node, updated_ms, tasks_completed, CASE WHEN status IN ('running', '') AND {NOW_MS} - updated_ms >= 12000 THEN 'STALE'
               WHEN status IN ('running', '') THEN 'RUNNING' ELSE upper(status) END AS status
        FROM (SELECT *, row_number() OVER (PARTITION BY run, node ORDER BY updated_ms DESC, tasks_completed DESC) AS rn FROM ({duck(PROGRESS)}) p WHERE updated_ms < {NOW_MS}) x WHERE rn = 1""",
)
def r10_stateful(spark, sf):
    """States kept by the stream, with timers that say when a running node is stale; equal to the fold over all markers.
    A last marker moves event time to the moment that is asked about."""
    landing, state = scratch_path(spark, "markers"), scratch_path(spark, "state")
    markers = derived(spark, sf, PROGRESS).where(F.col("updated_ms") < NOW_MS)
    late_ms = 40 * 86_400_000  # files come in any order
    markers.repartition(3, "tasks_completed").write.parquet(landing)
    live = VersionedTable(spark, scratch_path(spark, "live"))

    def run():
        stream_live_progress(file_stream(spark, landing, markers.schema, max_files=2), state, live, "40 days")

    run()
    marks = spark.range(1).select(F.lit(-1).alias("run"), F.lit("clock").alias("node"), F.lit("skipped").alias("status"), F.lit(NOW_MS + late_ms).alias("updated_ms"), F.lit(0).alias("tasks_completed"))
    marks.select(*[F.col(f.name).cast(f.dataType) for f in markers.schema]).write.mode("append").parquet(landing)
    run()
    return live.read().where("run >= 0").drop("at_ms")


PIPELINE = "2-HIGH"
OWN_RUNS = f"(SELECT * FROM ({duck(RUNS)}) a WHERE pipeline = '{PIPELINE}')"


@query(
    "r14_failures_24h",
    f"SELECT count(*) AS n FROM {OWN_RUNS} d WHERE status = 'FAILED' AND started_at > TIMESTAMP '2001-07-31'",
)
def r14_failures(spark, sf):
    return t.recent_failures(derived(spark, sf, RUNS), PIPELINE, F.lit("2001-08-01T00:00:00"))


@query("r14_runs_total", f"SELECT count(*) AS n FROM {OWN_RUNS} d")
def r14_total(spark, sf):
    return t.run_total(derived(spark, sf, RUNS), PIPELINE)


@query(
    "r14_recent_durations",
    f"""SELECT CAST(started_at AS DATE) AS x, duration_ms AS y, run_id
        FROM (SELECT * FROM {OWN_RUNS} d ORDER BY started_at DESC, run_id DESC LIMIT 50) e""",
)
def r14_durations(spark, sf):
    return t.duration_series(derived(spark, sf, RUNS), PIPELINE).withColumn("x", F.to_date("x"))


@query(
    "r14_failures_by_node",
    f"SELECT node AS x, count(*) AS y FROM ({duck(ORDER_NODE_RUNS)}) n WHERE status = 'failed' GROUP BY node",
)
def r14_nodes(spark, sf):
    return t.failing_nodes(derived(spark, sf, ORDER_NODE_RUNS).withColumn("pipeline", F.lit(PIPELINE)), PIPELINE)


@query(
    "r14_recent_runs",
    f"SELECT run_id, status, trigger, duration_ms FROM {OWN_RUNS} d ORDER BY started_at DESC, run_id DESC LIMIT 10",
)
def r14_recent(spark, sf):
    return t.newest_runs(derived(spark, sf, RUNS), PIPELINE, 10).select("run_id", "status", "trigger", "duration_ms")


@query(
    "r15_status_badges",
    f"""SELECT 'run' AS kind, status, CASE status WHEN 'SUCCEEDED' THEN 'success' WHEN 'RUNNING' THEN 'running' ELSE 'failed' END AS badge,
               count(*) AS n FROM ({duck(RUNS)}) r GROUP BY status
        UNION ALL SELECT 'node', status, CASE status WHEN 'ok' THEN 'success' WHEN 'failed' THEN 'failed' ELSE 'outline' END, count(*)
        FROM ({duck(NODE_RUNS)}) n GROUP BY status""",
)
def r15(spark, sf):
    def badges(kind, rows, badge):
        return rows.groupBy("status", badge(F.col("status")).alias("badge")).agg(F.count(F.lit(1)).alias("n")).withColumn(
            "kind", F.lit(kind)
        )

    runs = badges("run", derived(spark, sf, RUNS), t.run_status)
    return runs.unionByName(badges("node", derived(spark, sf, NODE_RUNS), t.node_status))


# -- R11 to R13: memory and cost


@query(
    "r11_rightsizing",
    f"""WITH n AS ({duck(NODE_RUNS)}), f AS (
          SELECT pipeline, node, count(peak_rss_mb) AS samples, max_by(memory_mb, (started_at, run_id)) FILTER (memory_mb IS NOT NULL) AS current_mb,
            quantile_disc(peak_rss_mb, 0.95) AS p95,
            count(*) FILTER (peak_rss_mb IS NOT NULL AND (coalesce(memory_spilled_bytes, 0) > 0 OR disk_spilled_bytes > 0)) AS sp
          FROM n GROUP BY pipeline, node),
        g AS (SELECT *, CASE WHEN samples > 0 THEN sp / samples ELSE 0.0 END AS spill_rate, p95 * 6 // 5 AS base FROM f),
        h AS (SELECT *, CASE WHEN spill_rate >= 0.25 THEN base * 5 // 4 ELSE base END AS b2 FROM g)
        SELECT pipeline, node, samples, CAST(current_mb AS BIGINT) AS current_mb, p95 AS p95_peak_rss_mb, spill_rate,
          CASE WHEN current_mb IS NOT NULL AND samples > 0
               THEN least(greatest(((b2 + 63) // 64) * 64, 512), 10240) END AS recommended_mb,
          CASE WHEN current_mb IS NULL OR samples = 0 THEN 'n/a' WHEN samples >= 10 THEN 'high' WHEN samples >= 4 THEN 'medium'
               ELSE 'low' END AS confidence FROM h""",
)
def r11(spark, sf):
    return t.rightsizing(derived(spark, sf, NODE_RUNS), ["pipeline", "node"])


COST = """CASE WHEN duration_ms <= 0 OR memory_mb IS NULL THEN 0.0::DOUBLE
  WHEN compute_target = 'lambda' THEN duration_ms / 1000.0::DOUBLE * (memory_mb / 1024.0::DOUBLE) * 0.0000166667::DOUBLE
  WHEN compute_target = 'fargate' THEN (memory_mb / 2048.0::DOUBLE * 0.04048::DOUBLE + memory_mb / 1024.0::DOUBLE * 0.004445::DOUBLE) * (duration_ms / 3600000.0::DOUBLE)
  WHEN compute_target = 'emr-serverless' THEN (memory_mb / 2048.0::DOUBLE * 0.052624::DOUBLE + memory_mb / 1024.0::DOUBLE * 0.0057785::DOUBLE) * (duration_ms / 3600000.0::DOUBLE)
  ELSE 0.0::DOUBLE END"""


@query("r12_run_cost", f"SELECT run_id, CAST(floor({COST} * 1e9) AS BIGINT) AS nano_usd FROM ({duck(NODE_RUNS)}) n")
def r12(spark, sf):
    cost = t.run_cost(F.col("compute_target"), F.col("duration_ms"), F.col("memory_mb"))
    return derived(spark, sf, NODE_RUNS).select("run_id", F.floor(cost * 1e9).alias("nano_usd"))


@query(
    "r13_cost_rollup",
    f"""SELECT pipeline, count(*) AS runs, CAST(sum(rec) AS BIGINT) AS records, sum(duration_ms) / 1000.0::DOUBLE AS billed_seconds,
               round(sum(cost), 9) AS cost_usd, round(sum(rec) / (sum(duration_ms) / 1000.0::DOUBLE), 6) AS records_per_sec,
               round(sum(cost) / sum(rec) * 1e9, 6) AS cost_per_billion, min_by(compute_target, (started_at, run_id)) AS compute_target
        FROM (SELECT *, {COST} AS cost, CASE WHEN input_records > 0 THEN input_records WHEN output_rows > 0 THEN output_rows ELSE 0 END AS rec
              FROM ({duck(NODE_RUNS)}) n WHERE status = 'ok') x GROUP BY pipeline""",
)
def r13(spark, sf):
    digits = {"cost_usd": 9, "records_per_sec": 6, "cost_per_billion": 6}
    rollup = t.cost_rollup(derived(spark, sf, NODE_RUNS), ["pipeline"])
    return rollup.withColumns({name: F.round(name, n) for name, n in digits.items()})


# -- R16 to R18


@query(
    "r16_failed_steps",
    f"""WITH h AS ({duck(HISTORY)}),
             f AS (SELECT user_id, min(event_id) AS at FROM h WHERE type IN ('TaskFailed', 'ExecutionFailed') GROUP BY user_id)
        SELECT f.user_id, CASE WHEN h.type = 'TaskFailed' THEN coalesce((SELECT max_by(e.name, e.event_id) FROM h e
                 WHERE e.user_id = f.user_id AND e.type = 'TaskStateEntered' AND e.event_id < f.at), '') ELSE '' END AS failed_step,
               h.error, h.cause FROM f JOIN h ON h.user_id = f.user_id AND h.event_id = f.at""",
)
def r16(spark, sf):
    return t.failed_steps(derived(spark, sf, HISTORY), "user_id")


@query(
    "r17_step_logs",
    f"""WITH h AS ({duck(HISTORY)}), w AS (SELECT user_id, at_ms // 86400000 AS step, min(at_ms) FILTER (type = 'TaskStateEntered') AS lo,
                coalesce(max(at_ms) FILTER (type IN ('TaskStateExited', 'TaskFailed')), 1706745600000) AS hi
              FROM h GROUP BY 1, 2 HAVING min(at_ms) FILTER (type = 'TaskStateEntered') IS NOT NULL)
        SELECT w.user_id, step, count(*) AS lines, CAST(sum(event_id) AS BIGINT) AS ids FROM h JOIN w
          ON h.user_id = w.user_id AND at_ms BETWEEN lo AND hi GROUP BY 1, 2""",
)
def r17(spark, sf):
    history = derived(spark, sf, HISTORY)
    day = F.floor(F.col("at_ms") / 86400000).cast("bigint")
    windows = t.step_windows(history.withColumn("step", day), ["user_id", "step"], 1706745600000)
    lines = t.step_logs(history.select("user_id", "event_id", "at_ms"), windows, ["user_id"], bucket_ms=21_600_000)
    return lines.groupBy("user_id", "step").agg(F.count(F.lit(1)).alias("lines"), F.sum("event_id").alias("ids"))


@query(
    "r18_pipeline_health",
    f"""WITH r AS ({duck(RUNS)}), b AS (SELECT pipeline, bool_or(status = 'RUNNING') AS busy FROM r GROUP BY 1),
             x AS (SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY started_at DESC, run_id DESC) AS rn
                   FROM r WHERE status <> 'RUNNING'),
             w AS (SELECT pipeline, max(CASE WHEN rn = 1 THEN status END) AS last, count(*) AS n,
                          avg(CASE WHEN status = 'SUCCEEDED' THEN 1.0 ELSE 0.0 END) AS rate FROM x WHERE rn <= 20 GROUP BY 1)
        SELECT b.pipeline, CASE WHEN busy THEN 'running' WHEN last IN ('FAILED', 'ABORTED') THEN 'failed' ELSE 'healthy' END AS state,
               CASE WHEN NOT busy THEN rate END AS success_rate, CASE WHEN busy THEN 0 ELSE n END AS success_window
        FROM b JOIN w ON b.pipeline = w.pipeline
        UNION ALL SELECT 'idle', 'never-run', NULL, 0""",
)
def r18(spark, sf):
    runs = derived(spark, sf, RUNS)
    idle = spark.range(1).select(F.lit("idle").alias("pipeline"))
    return t.pipeline_health(runs, runs.select("pipeline").unionByName(idle))
