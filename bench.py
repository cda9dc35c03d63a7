"""Time the headline queries; prints one JSON line. `BENCH_SF_DIR` and `BENCH_CPUS` choose data and cores."""

from __future__ import annotations

import contextlib
import io
import json
import os
import sys
import tempfile
import time

from pyspark.sql import functions as F

from millrace.operators.merge import bounded_merge, merge_upsert
from millrace.operators.writes import clustered
from millrace.queries import QUERIES
from millrace.session import local_session, scratch_path
from millrace.tables.store import VersionedTable, read_feed

HEADLINE = (
    "s5_partition_cursor", "s12_text_types", "t4_staged_chain", "k2_grouped_kpis", "k6_zscore", "k11_ranked_batches",
    "k12_fact_dimension", "k15_latest_per_key", "w3_merge", "w4_aggregate_merge", "w5_bounded_merge",
    "w6_partition_bounded_merge", "c1_change_rows", "c3_latest_per_key", "c6_incremental_totals", "c7_changed_keys_only",
    "b3_key_overlap", "m1_compact", "p1_column_profile", "p2_top_values", "p6_row_counts", "p11_lineage",
    "r1_event_log_metrics", "r9_run_matrix", "r11_rightsizing", "r13_cost_rollup", "r16_failed_steps", "r17_step_logs",
    "d6_pie_slices", "a1_beacons", "a2_daily_rollup", "a4_element_rates", "a5_sessions", "a7_countries",
)


#: Rows of the tables that ratios are measured on, at least: below that fixed costs are all there is to see.
RATIO_ROWS = int(os.environ.get("BENCH_RATIO_ROWS", 10_000_000))


def enlarged(df, key: str, rows: int):
    """A table's rows, repeated under new keys until there are so many."""
    times = max(1, -(-rows // max(df.count(), 1)))
    return df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn(key, F.col(key) * times + F.col("_k")).drop("_k")


def incremental_ratios(spark, sf_dir: str) -> dict[str, float]:
    """Time of an incremental run over the time of a full one, writes included, each on a warm second attempt. Changed
    rows are those of the newest day (c6, c7) and of 150 keys (w5)."""
    events = enlarged(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value"), "event_id", RATIO_ROWS)
    orders = enlarged(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey", RATIO_ROWS)
    target_path = scratch_path(spark, "target")
    clustered(orders, ["o_orderkey"], 64).write.parquet(target_path)
    target = spark.read.parquet(target_path)
    newest = target.agg(F.max("o_orderkey")).first()[0]
    batch = target.where(F.col("o_orderkey") > newest - 150).withColumn("o_totalprice", F.col("o_totalprice") + 1)

    last_day = F.to_date("ts") == events.agg(F.max(F.to_date("ts"))).first()[0]
    raw, totals, days, busy, whole = (VersionedTable(spark, scratch_path(spark, n)) for n in ("raw", "totals", "days", "busy", "whole"))
    raw.append(events.where(~last_day))
    raw.append(events.where(last_day))

    def counted(rows):
        return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))

    def daily(rows):
        return rows.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))

    totals.merge(counted(raw.read(0)), ["user_id"])
    days.merge(daily(raw.read(0)), ["day"])
    busy.merge(days.read(0), ["day"])
    out = lambda: scratch_path(spark, "full")
    pairs = {
        "c6_totals": (
            lambda: totals.merge(counted(read_feed(raw, 0).df), ["user_id"], {"n": "additive", "total": "additive"}),
            lambda: whole.replace(counted(raw.read())),
        ),
        "c7_changed_days": (
            lambda: busy.merge(daily(read_feed(raw, 0).df), ["day"]),
            lambda: whole.replace(daily(raw.read())),
        ),
        "w5_bounded_merge": (
            lambda: bounded_merge(target, batch, ["o_orderkey"]).write.parquet(out()),
            lambda: merge_upsert(target, batch, ["o_orderkey"]).write.parquet(out()),
        ),
    }

    def seconds(run):
        run()
        start = time.perf_counter()
        run()
        return time.perf_counter() - start

    return {name: round(seconds(part) / seconds(full), 3) for name, (part, full) in pairs.items()}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(tempfile.mkdtemp(prefix="millrace-"), os.environ.get("BENCH_CPUS", "8"), app="millrace-bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds, ratios = {}, {}
    with contextlib.redirect_stdout(io.StringIO()):
        for name in names:
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        if not sys.argv[1:]:
            ratios = incremental_ratios(spark, sf_dir)
    total = round(sum(seconds.values()), 3)
    result = {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds}
    print(json.dumps({**result, "incremental_over_full": ratios, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
