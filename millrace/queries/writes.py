"""Writes, change feeds, backfill, upkeep and streaming merges: W1 to W14, C1 to C7, B1 to B8, M1 to M4, ST2."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import backfill as b
from millrace.operators import changes as ch
from millrace.operators import maintenance as m
from millrace.operators import merge as mg
from millrace.operators import writes as w
from millrace.operators.schema import schema_drifted
from millrace.queries._registry import query, table
from millrace.queries.sources import DAY, EVENT_SUMMARY, daily_events, summary
from millrace.session import scratch_path
from millrace.sources.cursors import read_partitioned
from millrace.streaming.ingest import file_stream
from millrace.streaming.upsert import stream_merge
from millrace.tables.store import FeedError, Provenance, VersionedTable, read_feed

# The target holds the orders that are not open, the source those that are not finished at a new price:
# pending orders are in both, open ones are new, and low-priority ones have no key at all.
KEYED = """CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderkey END AS k, o_custkey, o_orderstatus"""
TARGET_SQL = f"SELECT {KEYED}, o_totalprice AS price FROM orders WHERE o_orderstatus <> 'O'"
SOURCE_SQL = f"SELECT {KEYED}, o_totalprice + 100 AS price FROM orders WHERE o_orderstatus <> 'F'"
WITH_BOTH = f"WITH t AS ({TARGET_SQL}), s AS ({SOURCE_SQL}) "
MERGED_SQL = (
    WITH_BOTH
    + """SELECT coalesce(s.k, t.k) AS k, CASE WHEN s.price IS NULL THEN t.o_custkey ELSE s.o_custkey END AS o_custkey,
  CASE WHEN s.price IS NULL THEN t.o_orderstatus ELSE s.o_orderstatus END AS o_orderstatus, coalesce(s.price, t.price) AS price
  FROM t FULL JOIN s ON t.k = s.k"""
)
HALF = "2024-01-16"


def both(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("orders_keyed")
    frames = [spark.sql(q.replace("FROM orders ", "FROM orders_keyed ")) for q in (TARGET_SQL, SOURCE_SQL)]
    return frames[0], frames[1]


def store(spark, label, partition_by=()):
    return VersionedTable(spark, scratch_path(spark, label), partition_by)


def per_user(events):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(28,2)").alias("total"),
        F.min(micros).alias("first_us"),
        F.max(micros).alias("last_us"),
        F.max("value").alias("peak"),
        F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"),
    )


def halves(spark, sf):
    events = table(spark, sf, "events")
    cut = F.lit(HALF).cast("timestamp_ntz")
    return events.where(F.col("ts") < cut), events.where(F.col("ts") >= cut)


USERS_SQL = """SELECT user_id, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total,
  min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us, max(value) AS peak,
  max_by(event_type, (ts, event_id)) AS last_type FROM events"""


# -- writes


@query(
    "w1_replace",
    """SELECT true AS added_drifts, true AS type_drifts, false AS same_drifts, status, n FROM (
         SELECT o_orderstatus AS status, CAST(count(*) AS VARCHAR) AS n FROM orders GROUP BY 1)""",
)
def w1(spark, sf):
    orders = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status"))
    plain = orders.agg(F.count(F.lit(1)).alias("n"))
    wider = plain.withColumn("note", F.lit("x"))
    text = plain.withColumn("n", F.col("n").cast("string"))
    t = store(spark, "replace")
    for frame in (plain, wider, text):
        t.replace(frame)
    drift = {
        "added_drifts": F.lit(schema_drifted(plain.schema, wider.schema)),
        "type_drifts": F.lit(schema_drifted(plain.schema, text.schema)),
        "same_drifts": F.lit(schema_drifted(t.read().schema, text.schema)),
    }
    return t.read().withColumns(drift)


@query(
    "w2_append_evolving",
    f"""SELECT event_id, value, NULL AS half FROM events WHERE ts < TIMESTAMP '{HALF}'
        UNION ALL SELECT event_id, value, 'second' FROM events WHERE ts >= TIMESTAMP '{HALF}'""",
)
def w2(spark, sf):
    first, second = halves(spark, sf)
    t = store(spark, "append")
    t.append(first.select("event_id", "value"))
    t.append(second.select("event_id", "value", F.lit("second").alias("half")))
    return t.read()


@query("w3_merge", MERGED_SQL)
def w3(spark, sf):
    target, source = both(spark, sf)
    return mg.merge_upsert(target, source, ["k"])


@query(
    "w4_aggregate_merge",
    f"""WITH a AS ({USERS_SQL} WHERE ts < TIMESTAMP '{HALF}' GROUP BY user_id),
             b AS ({USERS_SQL} WHERE ts >= TIMESTAMP '{HALF}' GROUP BY user_id)
        SELECT coalesce(b.user_id, a.user_id) AS user_id, coalesce(a.n, 0) + coalesce(b.n, 0) AS n,
          CAST(CAST(coalesce(a.total, 0) AS DECIMAL(28,2)) + CAST(coalesce(b.total, 0) AS DECIMAL(28,2)) AS DOUBLE) AS total,
          least(a.first_us, b.first_us) AS first_us, greatest(a.last_us, b.last_us) AS last_us,
          CASE WHEN a.peak IS NULL OR b.peak IS NULL THEN coalesce(a.peak, b.peak) ELSE a.peak * 0.5 + b.peak * 0.5 END AS peak,
          coalesce(b.last_type, a.last_type) AS last_type
        FROM a FULL JOIN b ON a.user_id = b.user_id""",
)
def w4(spark, sf):
    first, second = halves(spark, sf)
    update = {
        "n": "additive", "total": "additive", "first_us": "min", "last_us": "max",
        "peak": "target.peak * 0.5D + source.peak * 0.5D",
    }
    merged = mg.merge_upsert(per_user(first), per_user(second), ["user_id"], update)
    return merged.withColumn("total", F.col("total").cast("double"))


@query(
    "w4_sketch_merge",
    "SELECT event_type, true AS close FROM events GROUP BY event_type",
)
def w4_sketch(spark, sf):
    def sketches(events):
        return events.groupBy("event_type").agg(F.hll_sketch_agg("event_id", F.lit(14)).alias("sketch"))

    first, second = halves(spark, sf)
    merged = mg.merge_upsert(sketches(first), sketches(second), ["event_type"], {"sketch": "sketch"})
    exact = table(spark, sf, "events").groupBy("event_type").agg(F.count_distinct("event_id").alias("exact"))
    estimate = F.hll_sketch_estimate("sketch")
    return merged.join(exact, "event_type").select(
        "event_type", (F.abs(estimate - F.col("exact")) <= 0.05 * F.col("exact")).alias("close")
    )


@query("w5_bounded_merge", MERGED_SQL)
def w5(spark, sf):
    target, source = both(spark, sf)
    return mg.bounded_merge(target, source, ["k"], cluster_by=["k"])


@query(
    "w6_bound_violations",
    """SELECT l_orderkey, count(*) AS tuples FROM (SELECT DISTINCT l_orderkey, CAST(l_shipdate AS DATE) AS d FROM lineitem) x
       GROUP BY l_orderkey HAVING count(*) > 1""",
)
def w6(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("d", F.to_date("l_shipdate"))
    return mg.bound_violations(lines, ["l_orderkey"], ["d"])


@query(
    "w6_partition_bounded_merge",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE o_totalprice + 100 END AS price,
              o_orderpriority FROM orders""",
)
def w6_merge(spark, sf):
    orders = table(spark, sf, "orders")
    target = orders.where("o_orderstatus <> 'O'").select("o_orderkey", F.col("o_totalprice").alias("price"), "o_orderpriority")
    source = orders.where("o_orderstatus <> 'F'")
    source = source.select("o_orderkey", (F.col("o_totalprice") + 100).alias("price"), "o_orderpriority")
    t = store(spark, "bounded", ["o_orderpriority"])
    t.replace(target)
    t.merge(source, ["o_orderkey"], bound_by=["o_orderpriority"])
    return t.read()


@query(
    "w7_schema_evolution",
    WITH_BOTH
    + """SELECT coalesce(s.k, t.k) AS k, coalesce(s.price, t.price) AS price,
          CASE WHEN s.price IS NOT NULL THEN s.o_orderstatus || '!' END AS mark FROM t FULL JOIN s ON t.k = s.k""",
)
def w7(spark, sf):
    target, source = both(spark, sf)
    source = source.select("k", "price", F.concat("o_orderstatus", F.lit("!")).alias("mark"))
    return mg.merge_upsert(target.select("k", "price"), source, ["k"])


@query(
    "w8_clustered_layout",
    f"SELECT user_id, {EVENT_SUMMARY}, true AS narrow FROM events GROUP BY user_id",
)
def w8(spark, sf):
    path = scratch_path(spark, "clustered")
    events = table(spark, sf, "events").select("event_id", "user_id", "value")
    w.clustered(events, ["user_id"], files=8).write.parquet(path)
    back = spark.read.parquet(path)
    files = back.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.min("user_id").alias("low"), F.max("user_id").alias("high"))
    # A value may go on in the next file, but ranges of files meet at most at their ends.
    after = F.lead("low").over(Window.orderBy("low", "high"))  # eight files
    narrow = files.select(F.coalesce(after >= F.col("high"), F.lit(True)).alias("ok")).agg(F.bool_and("ok")).scalar()
    return summary(back, "user_id").withColumn("narrow", narrow)


@query(
    "w9_json_document",
    f"SELECT event_type, {EVENT_SUMMARY} FROM events GROUP BY event_type",
)
def w9(spark, sf):
    path = scratch_path(spark, "document")
    w.write_json(summary(table(spark, sf, "events"), "event_type"), path)
    document = spark.read.text(path, wholetext=True)
    return document.select(F.inline(F.from_json("value", "array<struct<event_type:string,n:bigint,total:double>>")))


@query("w10_path_sink", "SELECT o_orderkey, o_custkey FROM orders")
def w10(spark, sf):
    path = scratch_path(spark, "sink")
    orders = table(spark, sf, "orders")
    w.write_path(orders, path)
    w.write_path(orders.select("o_orderkey", "o_custkey"), path)
    return spark.read.parquet(path)


@query(
    "w11_output_specs",
    """SELECT spec, mode, CASE mode WHEN 'append' THEN 2 * n WHEN 'refused' THEN 0 ELSE n END AS rows_after_two_writes
       FROM (VALUES ('keys', 'merge'), ('append with keys', 'append'), ('nothing', 'replace'), ('merge without keys', 'refused'),
               ('unknown mode', 'refused')) v(spec, mode), (SELECT count(*) AS n FROM orders) o""",
)
def w11(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    specs = {
        "keys": {"merge_keys": ["o_orderkey"]},
        "append with keys": {"mode": "append", "merge_keys": ["o_orderkey"]},
        "nothing": {},
        "merge without keys": {"mode": "merge"},
        "unknown mode": {"mode": "upsert"},
    }
    parts = []
    for name, fields in specs.items():
        try:
            spec = w.OutputSpec.parse(fields)
            t = store(spark, "spec")
            for _ in range(2):
                t.write(orders, spec)
            mode, rows = spec.mode, t.read()
        except ValueError:
            mode, rows = "refused", orders.limit(0)
        count = rows.agg(F.count(F.lit(1)).alias("rows_after_two_writes"))
        parts.append(count.withColumns({"spec": F.lit(name), "mode": F.lit(mode)}))
    return reduce(DataFrame.unionByName, parts)


@query(
    "w12_provenance",
    """SELECT 0 AS version, 'CREATE' AS operation, 'manual' AS trigger, 'r0' AS run_id, count(*) AS inserted, NULL AS updated
         FROM orders WHERE o_orderstatus <> 'O'
       UNION ALL SELECT 1, 'MERGE', 'event', 'r1', sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT,
         sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::BIGINT FROM orders WHERE o_orderstatus <> 'F'""",
)
def w12(spark, sf):
    orders = table(spark, sf, "orders")
    t = store(spark, "provenance")
    t.merge(orders.where("o_orderstatus <> 'O'"), ["o_orderkey"], by=Provenance("r0"))
    t.merge(orders.where("o_orderstatus <> 'F'"), ["o_orderkey"], by=Provenance("r1", "event"))
    return t.log().select(F.col("version").cast("int").alias("version"), "operation", "trigger", "run_id", "inserted", "updated")


@query(
    "w13_duplicate_source_keys",
    """SELECT l_orderkey AS o_orderkey, count(*) AS source_rows FROM lineitem
       WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey HAVING count(*) > 1""",
)
def w13(spark, sf):
    source = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return mg.duplicate_source_keys(table(spark, sf, "orders"), source, ["o_orderkey"])


@query(
    "w14_versioned_dimension",
    """SELECT o_custkey, as_of, CASE WHEN max(st) = 2 THEN max(CASE WHEN st = 2 THEN p END) ELSE max(p) END AS price FROM (
         SELECT o_custkey, CAST(o_orderdate AS DATE) AS as_of, 1 AS st, o_totalprice AS p FROM orders WHERE o_orderstatus <> 'O'
         UNION ALL SELECT o_custkey, CAST(o_orderdate AS DATE), 2, o_totalprice + 1 FROM orders WHERE o_orderstatus <> 'F') x
       GROUP BY o_custkey, as_of""",
)
def w14(spark, sf):
    orders = table(spark, sf, "orders").withColumn("as_of", F.to_date("o_orderdate"))

    def snapshot(rows, add):
        return rows.groupBy("o_custkey", "as_of").agg(F.max(F.col("o_totalprice") + add).alias("price"))

    target = snapshot(orders.where("o_orderstatus <> 'O'"), 0)
    source = snapshot(orders.where("o_orderstatus <> 'F'"), 1)
    return mg.merge_upsert(target, source, ["o_custkey", "as_of"])


# -- change feed


@query(
    "c1_change_rows",
    WITH_BOTH
    + """SELECT 'update_preimage' AS _change_type, t.k, t.o_custkey, t.o_orderstatus, t.price FROM t JOIN s ON t.k = s.k
         UNION ALL SELECT 'update_postimage', s.k, s.o_custkey, s.o_orderstatus, s.price FROM t JOIN s ON t.k = s.k
         UNION ALL SELECT 'insert', k, o_custkey, o_orderstatus, price FROM s WHERE k IS NULL OR k NOT IN (SELECT k FROM t WHERE k IS NOT NULL)""",
)
def c1(spark, sf):
    target, source = both(spark, sf)
    after = mg.merge_upsert(target, source, ["k"])
    return ch.change_rows(target, after, ["k"])


@query(
    "c1_merge_changes",
    WITH_BOTH
    + """SELECT 'update_preimage' AS _change_type, t.k, t.o_custkey, t.o_orderstatus, t.price FROM t JOIN s ON t.k = s.k
         UNION ALL SELECT 'update_postimage', s.k, s.o_custkey, s.o_orderstatus, s.price FROM t JOIN s ON t.k = s.k
         UNION ALL SELECT 'insert', k, o_custkey, o_orderstatus, price FROM s WHERE k IS NULL OR k NOT IN (SELECT k FROM t WHERE k IS NOT NULL)""",
)
def c1_merge(spark, sf):
    target, source = both(spark, sf)
    return mg.merge_parts(target, source, ["k"]).changes()


THIRDS = ("2024-01-11", "2024-01-21")


def user_history(spark, sf):
    """Event counts per user, merged once for each third of the month."""
    events = table(spark, sf, "events")
    t = store(spark, "users")
    low, high = (F.lit(d).cast("timestamp_ntz") for d in THIRDS)
    ts = F.col("ts")
    for part in (ts < low, (ts >= low) & (ts < high), ts >= high):
        t.merge(events.where(part).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), ["user_id"])
    return t


PER_THIRD = f"""SELECT user_id, count(*) AS n, CASE WHEN ts < TIMESTAMP '{THIRDS[0]}' THEN 0
  WHEN ts < TIMESTAMP '{THIRDS[1]}' THEN 1 ELSE 2 END AS v FROM events GROUP BY 1, 3"""


@query("c2_version_range", f"SELECT user_id, n, CAST(v AS BIGINT) AS v FROM ({PER_THIRD}) x WHERE v > 0")
def c2(spark, sf):
    t = user_history(spark, sf)
    rows = ch.version_range(t.changes(0), 0, 2).withColumn("v", F.col("_commit_version"))
    return ch.without_commit_columns(rows)


@query(
    "c3_latest_per_key",
    f"SELECT user_id, max_by(n, v) AS n FROM ({PER_THIRD}) x WHERE v > 0 GROUP BY user_id",
)
def c3(spark, sf):
    return read_feed(user_history(spark, sf), 0, ["user_id"]).df


@query(
    "c4_read_decision",
    f"""WITH p AS ({PER_THIRD})
        SELECT 'first' AS reader, 'full' AS decision, count(DISTINCT user_id) AS n FROM p
        UNION ALL SELECT 'behind', 'range', count(DISTINCT user_id) FROM p WHERE v = 2
        UNION ALL SELECT 'current', 'skip', 0 UNION ALL SELECT 'forced', 'full', count(DISTINCT user_id) FROM p
        UNION ALL SELECT 'ahead', 'full', count(DISTINCT user_id) FROM p""",
)
def c4(spark, sf):
    t = user_history(spark, sf)
    readers = {"first": (None, False), "behind": (1, False), "current": (2, False), "forced": (2, True), "ahead": (9, False)}
    result = None
    for name, (last, forced) in readers.items():
        feed = read_feed(t, last, ["user_id"], forced)
        rows = t.read().limit(0) if feed.skipped else feed.df
        decision = "skip" if feed.skipped else "full" if feed.full else "range"
        part = rows.agg(F.count(F.lit(1)).alias("n")).withColumns({"reader": F.lit(name), "decision": F.lit(decision)})
        result = part if result is None else result.unionByName(part)
    return result


@query(
    "c5_compaction_is_silent",
    f"SELECT user_id, max_by(n, v) AS n, CAST(0 AS BIGINT) AS changed FROM ({PER_THIRD}) x GROUP BY user_id",
)
def c5(spark, sf):
    t = user_history(spark, sf)
    t.rewrite(t.read().repartition(4), "SPREAD")
    before = t.version()
    t.compact()
    changed = read_feed(t, before, ["user_id"]).df.agg(F.count(F.lit(1))).scalar()
    return t.read().withColumn("changed", changed)


@query(
    "c6_incremental_totals",
    "SELECT user_id, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY user_id",
)
def c6(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    raw, totals = store(spark, "raw"), store(spark, "totals")
    low, high = (F.lit(d).cast("timestamp_ntz") for d in THIRDS)
    last, ts = None, F.col("ts")
    for part in (ts < low, (ts >= low) & (ts < high), ts >= high):
        raw.append(events.where(part))
        feed = read_feed(raw, last)
        batch = per_user(feed.df).select("user_id", "n", "total")
        totals.merge(batch, ["user_id"], {"n": "additive", "total": "additive"})
        last = feed.version
    return totals.read().withColumn("total", F.col("total").cast("double"))


@query(
    "c7_changed_keys_only",
    """SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) >= 300 AS busy,
              (SELECT count(DISTINCT CAST(ts AS DATE)) FROM events WHERE ts >= TIMESTAMP '2024-01-11') AS handled
       FROM events GROUP BY 1""",
)
def c7(spark, sf):
    days = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    producer, consumer = store(spark, "days"), store(spark, "busy")
    cut, later = F.lit("2024-01-16").cast("date"), F.lit("2024-01-11").cast("date")
    handled, last = 0, None
    for batch in (days.where(F.col("day") < cut), days.where(F.col("day") >= later)):
        producer.merge(batch, ["day"])
        feed = read_feed(producer, last, ["day"])
        handled = feed.df.count()
        consumer.merge(feed.df.withColumn("busy", F.col("n") >= 300), ["day"])
        last = feed.version
    return consumer.read().withColumn("handled", F.lit(handled).cast("bigint"))


@query(
    "st2_streaming_merge",
    "SELECT user_id, count(*) AS n, max(value) AS peak FROM events GROUP BY user_id",
)
def st2(spark, sf):
    landing, state = scratch_path(spark, "landing"), scratch_path(spark, "state")
    events = table(spark, sf, "events").select("event_id", "user_id", "value")
    events.repartition(4).write.parquet(landing)
    t = store(spark, "streamed")

    def counts(batch):
        return batch.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak"))

    stream = file_stream(spark, landing, events.schema, max_files=2)
    stream_merge(stream, state, t, "users", ["user_id"], {"n": "additive", "peak": "max"}, counts)
    return t.read()


# -- backfill

WINDOW = (("2024", "01", "10"), ("2024", "01", "19"))
WINDOW_SQL = "ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'"


def day_counts(rows):
    return rows.groupBy(F.col("day").cast("int").alias("d")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "b1_stage_window",
    f"SELECT CAST(day(ts) AS INTEGER) AS d, count(*) AS n FROM events WHERE {WINDOW_SQL} GROUP BY 1",
)
def b1(spark, sf):
    rows = read_partitioned(spark, daily_events(spark, sf))
    staging = VersionedTable(spark, scratch_path(spark, b.staging_name("days", "r1")))
    staging.replace(b.window_output(rows, DAY, *WINDOW, day_counts))
    return staging.read()


def staged_orders(spark, sf):
    """Staging: orders that are not finished, one column more. Target: orders that are not open, twice."""
    orders = table(spark, sf, "orders")
    columns = ["o_orderkey", "o_custkey", "o_totalprice"]
    target = orders.where("o_orderstatus <> 'O'").select(columns)
    staging = orders.where("o_orderstatus <> 'F'").select(*columns, F.lit("late").alias("note"))
    return staging, target.unionByName(target)


@query(
    "b2_diff",
    """SELECT (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS staging_rows, present AS target_rows,
              false AS schema_equal, diff AS schema_diff, 'o_orderkey,o_custkey,o_totalprice,note' AS staging_columns
       FROM (SELECT 2 * count(*) AS present, '+ note string' AS diff FROM orders WHERE o_orderstatus <> 'O'
             UNION ALL SELECT -1, '') x""",
)
def b2(spark, sf):
    staging, target = staged_orders(spark, sf)
    return b.diff(staging, target).unionByName(b.diff(staging, None))


@query(
    "b3_key_overlap",
    """SELECT count(*) FILTER (o_orderstatus = 'P') AS matching, count(*) FILTER (o_orderstatus = 'O') AS new
       FROM orders WHERE o_orderstatus <> 'F'""",
)
def b3(spark, sf):
    return b.key_overlap(*staged_orders(spark, sf), ["o_orderkey"])


@query(
    "b4_column_overlap",
    """SELECT 'target' AS against, count(*) FILTER (o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'O')) AS matching,
              count(*) FILTER (o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'O')) AS new
       FROM orders WHERE o_orderstatus <> 'F'
       UNION ALL SELECT 'nothing', 0, count(*) FROM orders WHERE o_orderstatus <> 'F'""",
)
def b4(spark, sf):
    staging, target = staged_orders(spark, sf)
    found = b.key_overlap(staging, target, ["o_custkey"]).withColumn("against", F.lit("target"))
    return found.unionByName(b.key_overlap(staging, None, ["o_custkey"]).withColumn("against", F.lit("nothing")))


def single_target(target):
    return target.distinct()


@query(
    "b5_promote_merge",
    """SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderstatus <> 'F' THEN 'late' END AS note FROM orders""",
)
def b5(spark, sf):
    staging, target = staged_orders(spark, sf)
    return b.promote(staging, single_target(target), "merge", ["o_orderkey"])


@query(
    "b6_promote_append",
    """SELECT 'dedup' AS how, count(*) AS n, count(*) FILTER (o_orderstatus <> 'F') AS late FROM orders
       UNION ALL SELECT 'duplicates', count(*) FILTER (o_orderstatus <> 'O') + count(*) FILTER (o_orderstatus <> 'F'),
         count(*) FILTER (o_orderstatus <> 'F') FROM orders""",
)
def b6(spark, sf):
    staging, target = staged_orders(spark, sf)
    target = single_target(target)
    frames = {
        "dedup": b.promote(staging, target, "append", force_dedup="o_orderkey"),
        "duplicates": b.promote(staging, target, "append", allow_duplicates=True),
    }
    parts = [
        f.agg(F.count(F.lit(1)).alias("n"), F.count("note").alias("late")).withColumn("how", F.lit(how))
        for how, f in frames.items()
    ]
    return parts[0].unionByName(parts[1])


@query(
    "b5_promote_commit",
    """SELECT 'promoted' AS what, trigger, n, total FROM (SELECT 'backfill' AS trigger, count(*) AS n,
         CAST(sum(CASE WHEN o_orderstatus <> 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) - 1000 ELSE CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS total FROM orders)
       UNION ALL SELECT 'insert', 'backfill', count(*), CAST(sum(CAST(o_totalprice AS DECIMAL(18,2)) - 1000) AS DOUBLE) FROM orders WHERE o_orderstatus = 'O'
       UNION ALL SELECT 'update_postimage', 'backfill', count(*), CAST(sum(CAST(o_totalprice AS DECIMAL(18,2)) - 1000) AS DOUBLE) FROM orders WHERE o_orderstatus = 'P'
       UNION ALL SELECT 'update_preimage', 'backfill', count(*), CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders WHERE o_orderstatus = 'P'""",
)
def b5_commit(spark, sf):
    # A corrected window lowers a `max`: the staged rows take the place of the old ones.
    price = F.col("o_totalprice").cast("decimal(18,2)")
    orders = table(spark, sf, "orders").select("o_orderkey", price.alias("price"), "o_orderstatus")
    target = store(spark, "promoted", ["o_orderstatus"])
    target.replace(orders.where("o_orderstatus <> 'O'"), merge_keys=["o_orderkey"])
    late = orders.where("o_orderstatus <> 'F'").withColumn("price", (F.col("price") - 1000).cast("decimal(18,2)"))
    version = b.promote_into(target, late, "merge", "r1", ["o_orderkey"], {"price": "max"}, replace_counters=True)
    total = [F.count(F.lit(1)).alias("n"), F.sum("price").cast("double").alias("total")]
    moved = target.changes(version - 1).groupBy(F.col("_change_type").alias("what")).agg(*total)
    now = target.read().agg(*total).select(F.lit("promoted").alias("what"), "n", "total")
    return now.unionByName(moved).withColumn("trigger", F.lit(target.commit()["trigger"]))


@query("b7_promote_new", "SELECT o_orderkey, o_custkey, o_totalprice, 'late' AS note FROM orders WHERE o_orderstatus <> 'F'")
def b7(spark, sf):
    staging, _ = staged_orders(spark, sf)
    return b.promote(staging, None, "merge", ["o_orderkey"])


@query(
    "b8_open_stagings",
    f"""SELECT 'days' AS target, 'r2' AS run, 'daily' AS node, '2024/01/10' AS window_from, '2024/01/19' AS window_to,
               count(DISTINCT CAST(ts AS DATE)) AS staged FROM events WHERE {WINDOW_SQL}""",
)
def b8(spark, sf):
    root = scratch_path(spark, "backfill")
    registry = b.StagingRegistry(spark, f"{root}/registry")
    rows = read_partitioned(spark, daily_events(spark, sf))
    for run in ("r1", "r2"):
        staging = VersionedTable(spark, f"{root}/{b.staging_name('days', run)}")
        staging.replace(b.window_output(rows, DAY, *WINDOW, day_counts))
        registry.record("days", run, "daily", *WINDOW, "open")
    registry.discard(f"{root}/{b.staging_name('days', 'r1')}", "days", "r1")
    staged = VersionedTable(spark, f"{root}/{b.staging_name('days', 'r2')}").read().agg(F.count(F.lit(1))).scalar()
    return registry.open("days").drop("state", "at").withColumn("staged", staged)


@query(
    "w6_key_is_no_partition",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
              CAST(o_totalprice + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS price FROM orders""",
)
def w6_key(spark, sf):
    """A merge by a key that says nothing about the partition, after an append of other files of the same names."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("price"))
    t = store(spark, "by-status", ["o_orderstatus"])
    t.replace(orders.where("o_orderkey % 3 <> 0").coalesce(1), merge_keys=["o_orderkey"])
    t.append(orders.where("o_orderkey % 3 = 0 AND o_orderkey % 10 <> 0").coalesce(1))
    batch = orders.where("o_orderkey % 10 = 0")
    t.merge(batch.withColumns({"price": F.col("price") + 1, "o_orderstatus": F.lit("X")}), ["o_orderkey"])
    return t.read().select("o_orderkey", "o_orderstatus", "price")


ODD = "CASE o_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN '__HIVE_DEFAULT_PARTITION__' WHEN 3 THEN '~' WHEN 4 THEN 'a/b=c %41+' ELSE o_orderstatus END"


@query(
    "w6_odd_partitions",
    f"""SELECT part, o_orderkey, CAST(o_totalprice + CASE WHEN part IS NULL OR o_orderkey % 3 <> 0 THEN 0 ELSE 2 END AS DOUBLE) AS price
        FROM (SELECT *, {ODD} AS part FROM orders)
        UNION ALL SELECT NULL, o_orderkey, CAST(o_totalprice + n AS DOUBLE) FROM orders, (VALUES (1), (2)) v(n) WHERE o_orderkey % 3 = 0 AND ({ODD}) IS NULL""",
)
def w6_odd(spark, sf):
    """Two merges into partitions of empty, NULL and odd texts: rows are updated in place, and NULL keys insert again."""
    orders = table(spark, sf, "orders").select(F.expr(ODD).alias("part"), "o_orderkey", F.col("o_totalprice").cast("double").alias("price"))
    t = store(spark, "odd-parts", ["part"])
    t.replace(orders, merge_keys=["part", "o_orderkey"])
    for n in (1, 2):
        t.merge(orders.where("o_orderkey % 3 = 0").withColumn("price", F.col("price") + n), ["part", "o_orderkey"])
    return t.read().select("part", "o_orderkey", "price")


@query(
    "w6_observed_counts",
    f"""SELECT version, operation, inserted, updated, output_rows, total_rows FROM (VALUES
          (0, 'CREATE', (SELECT count(*) FROM t), NULL, (SELECT count(*) FROM t), (SELECT count(*) FROM t)),
          (1, 'MERGE', (SELECT count(*) FROM s WHERE k IS NULL OR k NOT IN (SELECT k FROM t WHERE k IS NOT NULL)), (SELECT count(*) FROM s WHERE k IN (SELECT k FROM t)), NULL,
             (SELECT count(*) FROM t) + (SELECT count(*) FROM s WHERE k IS NULL OR k NOT IN (SELECT k FROM t WHERE k IS NOT NULL))),
          (2, 'APPEND', (SELECT count(*) FROM s), NULL, (SELECT count(*) FROM s),
             (SELECT count(*) FROM t) + (SELECT count(*) FROM s) + (SELECT count(*) FROM s WHERE k IS NULL OR k NOT IN (SELECT k FROM t WHERE k IS NOT NULL))),
          (3, 'WRITE', 0, NULL, 0, 0)) v(version, operation, inserted, updated, output_rows, total_rows)""".replace("FROM (VALUES", "FROM (WITH t AS (" + TARGET_SQL + "), s AS (" + SOURCE_SQL + ") SELECT * FROM (VALUES").replace("v(version, operation, inserted, updated, output_rows, total_rows)", "v(version, operation, inserted, updated, output_rows, total_rows)) q"),
)
def w6_observed(spark, sf):
    """What commits say of themselves, counted while they were written; the last one writes no row."""
    target, source = both(spark, sf)
    t = store(spark, "observed", ["o_orderstatus"])
    t.replace(target, merge_keys=["k"])
    t.merge(source, ["k"])
    t.append(source)
    t.replace(source.limit(0))
    return t.log().select(F.col("version").cast("int").alias("version"), "operation", "inserted", "updated", "output_rows", "total_rows")


@query(
    "c2_type_change",
    """SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, true AS refused, true AS in_full
       FROM events GROUP BY event_type""",
)
def c2_type(spark, sf):
    """A column changes its type: its old values can't be given as changes, so a feed reads in full."""
    events = table(spark, sf, "events").select("event_id", "event_type", F.col("value").cast("decimal(18,2)").alias("value"))
    t = store(spark, "retyped")
    t.append(events.withColumn("value", F.col("value").cast("string")).where("event_id % 2 = 0"))
    t.append(events.withColumn("value", F.col("value").cast("string")).where("event_id % 2 = 1"))
    t.replace(events)
    try:
        t.changes(0)
        refused = False
    except FeedError:
        refused = True
    feed = read_feed(t, 0)
    told = feed.df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("double").alias("total"))
    return told.withColumns({"refused": F.lit(refused), "in_full": F.lit(feed.full)})


@query(
    "c4_forced_behind",
    "SELECT user_id, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY user_id",
)
def c4_forced(spark, sf):
    """An additive consumer that forces each read counts nothing twice while there is something new."""
    events = table(spark, sf, "events")
    raw, totals = store(spark, "raw"), store(spark, "totals")
    last = None
    for k in range(3):
        raw.append(events.where(F.col("event_id") % 3 == k))
        feed = read_feed(raw, last, forced=True)
        batch = per_user(feed.df).select("user_id", "n", "total")
        totals.merge(batch, ["user_id"], {"n": "additive", "total": "additive"})
        last = feed.version
    return totals.read().withColumn("total", F.col("total").cast("double"))


# -- upkeep


@query("m1_compact", "SELECT event_id, user_id, value, true AS fewer_files FROM events")
def m1(spark, sf):
    t = store(spark, "compact")
    events = table(spark, sf, "events").select("event_id", "user_id", "value")
    t.replace(events.repartition(16))
    before = t.commit()["file_count"]
    t.compact()
    return t.read().withColumn("fewer_files", F.lit(t.commit()["file_count"] < before))


@query(
    "m2_recluster",
    """SELECT h AS how, user_id, count(*) AS n, max(value) AS peak FROM events, (VALUES ('cluster'), ('zorder')) v(h)
       GROUP BY h, user_id""",
)
def m2(spark, sf):
    t = store(spark, "recluster")
    t.replace(table(spark, sf, "events").select("event_id", "user_id", "value", "event_type"))
    parts = []
    for how in ("cluster", "zorder"):
        m.recluster(t, ["user_id", "value"], zorder=how == "zorder")
        stats = t.read().groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak"))
        parts.append(stats.withColumn("how", F.lit(how)))
    return parts[0].unionByName(parts[1])


@query(
    "m3_expire",
    "SELECT event_type, count(*) AS n, true AS kept_until_due, 1 AS removed FROM events GROUP BY event_type",
)
def m3(spark, sf):
    t = store(spark, "expire")
    events = table(spark, sf, "events").select("event_id", "event_type")
    t.replace(events)
    t.replace(events)
    young = m.expire(t, retention_hours=1)  # replaced a moment ago, however old the files are
    removed = m.expire(t, retention_hours=-1)
    counts = t.read().groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumns({"kept_until_due": F.lit(young == 0), "removed": F.lit(removed)})


@query(
    "m4_sweep",
    """SELECT "table", action, CASE WHEN "table" = 'a_missing' OR ("table" = 'plain' AND action = 'cluster') THEN 'failed' ELSE 'ok' END AS status, n
       FROM (VALUES ('a_missing'), ('orders'), ('plain')) t("table"), (VALUES ('compact'), ('cluster'), ('expire')) a(action), (SELECT count(*) AS n FROM orders) o""",
)
def m4(spark, sf):
    """Upkeep of three tables: one that is not there, one with a layout, one without (which can't be clustered)."""
    laid, plain = store(spark, "swept"), store(spark, "plain")
    laid.replace(table(spark, sf, "orders"), cluster_by=["o_custkey"])
    plain.replace(table(spark, sf, "orders").repartition(4))
    report = m.sweep({"orders": laid, "plain": plain, "a_missing": store(spark, "missing")}, m.UPKEEP)
    n = laid.read().agg(F.count(F.lit(1))).scalar()
    return report.select("table", "action", "status").withColumn("n", n)
