"""Schemas of the four append-only telemetry tables. Fixed, because a type inferred from a first batch of
NULLs would refuse later values."""

# Column names and types of the telemetry tables.
TASK_METRICS = (
    "peak_execution_memory_mb",
    "memory_spilled_bytes",
    "disk_spilled_bytes",
    "shuffle_read_bytes",
    "shuffle_write_bytes",
    "input_bytes",
    "input_records",
    "num_stages",
    "num_tasks",
    "num_failed_tasks",
    "jvm_gc_time_ms",
    "executor_cpu_time_ms",
    "executor_run_time_ms",
    "max_task_duration_ms",
)

NODE_RUNS = (
    "run_id string, pipeline string, node string, started_at timestamp, ended_at timestamp, "
    "duration_ms bigint, status string, compute_target string, memory_mb int, cold_start boolean, "
    "lambda_request_id string, sf_execution_arn string, error_class string, error_msg string, "
    "runner_image_digest string, module_version string, output_rows bigint, peak_rss_mb bigint, "
    + ", ".join(f"{m} bigint" for m in TASK_METRICS)
)
RUNS = (
    "run_id string, pipeline string, sf_execution_arn string, status string, trigger string, "
    "target_table string, started_at timestamp, ended_at timestamp, duration_ms bigint, "
    "failed_step string, error_class string, error_msg string"
)
TABLES = (
    "pipeline string, node string, output_key string, table_name string, table_id string, "
    "snapshot_id bigint, snapshot_ts timestamp, row_count bigint, file_count int, total_bytes bigint, "
    "last_writer_run_id string"
)
COLUMN_STATS = (
    "run_id string, pipeline string, node string, output_key string, table_identifier string, "
    "snapshot_id bigint, snapshot_ts timestamp, column_name string, column_type string, row_count bigint, "
    "null_count bigint, null_pct double, approx_count_distinct bigint, min_value string, max_value string, "
    "approx_p50 double, approx_p95 double, top_10 array<struct<value:string,count:bigint>>, "
    "computed_at timestamp"
    # our own: what was profiled (table or batch), and the sketches that profiles are folded from
    ", scope string, distinct_sketch binary, quantile_sketch binary"
)

SYSTEM_TABLES = {"node_runs": NODE_RUNS, "runs": RUNS, "tables": TABLES, "column_stats": COLUMN_STATS}
