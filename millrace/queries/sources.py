"""Sources and scans: S1 to S16, and ST1."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.writes import write_path
from millrace.queries._registry import layout, query, table
from millrace.session import freeze, scratch_path
from millrace.sources import cursors as c
from millrace.sources.documents import json_rows, text_column_types, typed_text, variant_rows
from millrace.sources.formats import read_files, read_named, read_path
from millrace.sources.manifest import FileManifest, read_unread
from millrace.sources.sampling import file_listing, newest_files, page, shared_scan
from millrace.streaming.ingest import file_stream, once, run_available
from millrace.tables.store import VersionedTable

DAY = ["year", "month", "day"]


def daily_events(spark, sf) -> str:
    """All events by year, month and day, as text with leading zeros."""

    def write(path):
        parts = {"year": "yyyy", "month": "MM", "day": "dd"}
        dated = table(spark, sf, "events").withColumns({n: F.date_format("ts", p) for n, p in parts.items()})
        dated.hint("rebalance", *DAY).write.partitionBy(*DAY).parquet(path)

    return layout(spark, sf, "daily-events", write)


def summary(df, *by):
    total = F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), total.alias("total"))


EVENT_SUMMARY = "count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total"


@query(
    "s1_read_formats",
    f"""SELECT f AS fmt, event_type, {EVENT_SUMMARY} FROM events,
        (VALUES ('parquet'), ('csv'), ('tsv'), ('json'), ('ndjson')) v(f) GROUP BY f, event_type""",
)
def s1(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    result = None
    for fmt in ("parquet", "csv", "tsv", "json", "ndjson"):
        path = scratch_path(spark, f"events-{fmt}")
        options = {}
        if fmt == "parquet":
            events.write.parquet(path)
        elif fmt == "csv":
            events.write.csv(path, header=False)
            options = {"header": "false", "columns": "event_id,event_type,value"}
        elif fmt == "tsv":
            events.write.csv(path, header=True, sep="\t")
        else:
            events.write.json(path)
        part = summary(read_path(spark, f"{path}/", fmt, options), "event_type").withColumn("fmt", F.lit(fmt))
        result = part if result is None else result.unionByName(part)
    return result


def typed_events(spark, sf) -> str:
    def write(path):
        events = table(spark, sf, "events").select("event_id", "event_type", "value")
        events.hint("rebalance", "event_type").write.partitionBy("event_type").parquet(path)

    return layout(spark, sf, "typed-events", write)


@query("s2_read_file_list", f"SELECT event_type, {EVENT_SUMMARY} FROM events GROUP BY event_type")
def s2(spark, sf):
    base = typed_events(spark, sf)
    files = [row["path"] for row in file_listing(spark, base).where(F.col("path").endswith(".parquet")).collect()]
    return summary(read_files(spark, files, "parquet", base), "event_type")


@query(
    "s3_read_prefix",
    f"""SELECT 'partitioned' AS layout, event_type, {EVENT_SUMMARY} FROM events GROUP BY event_type
        UNION ALL SELECT 'nested', 'all', {EVENT_SUMMARY} FROM events""",
)
def s3(spark, sf):
    base = typed_events(spark, sf)
    partitioned = summary(read_path(spark, f"{base}/"), "event_type").withColumn("layout", F.lit("partitioned"))
    flat = scratch_path(spark, "nested")
    write_path(table(spark, sf, "events"), f"{flat}/2024/01")
    nested = summary(read_path(spark, f"{flat}/"), F.lit("all").alias("event_type"))
    return partitioned.unionByName(nested.withColumn("layout", F.lit("nested")))


@query(
    "s4_named_input",
    """SELECT 'path' AS kind, o_orderstatus, count(*) AS n FROM orders GROUP BY 2
       UNION ALL SELECT 'table', o_orderstatus, count(*) FROM orders GROUP BY 2""",
)
def s4(spark, sf):
    read_named(spark, f"{sf}/orders.parquet").createOrReplaceTempView("orders_input")
    parts = {"path": f"{sf}/orders.parquet", "table": "orders_input"}
    frames = [
        read_named(spark, name).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
        for kind, name in parts.items()
    ]
    return frames[0].unionByName(frames[1])


@query(
    "s5_partition_cursor",
    f"""SELECT strftime(ts, '%d') AS day, {EVENT_SUMMARY} FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1""",
)
def s5(spark, sf):
    rows = c.read_partitioned(spark, daily_events(spark, sf))
    return summary(c.after_cursor(rows, DAY, ("2024", "01", "15")), "day")


@query(
    "s5_late_files",
    """SELECT 1 AS read, strftime(ts, '%d') AS day, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE event_id % 10 <> 3 AND ts < TIMESTAMP '2024-01-21' GROUP BY 2
       UNION ALL SELECT 2, strftime(ts, '%d'), count(*), CAST(sum(event_id) AS BIGINT) FROM events WHERE event_id % 10 = 3 AND ts < TIMESTAMP '2024-01-21' GROUP BY 2
       UNION ALL SELECT 3, strftime(ts, '%d'), count(*), CAST(sum(event_id) AS BIGINT) FROM events WHERE ts >= TIMESTAMP '2024-01-21' GROUP BY 2""",
)
def s5_late(spark, sf):
    """Files that land in partitions already read are read once, and so is what comes after them."""
    landing, manifest = scratch_path(spark, "late-landing"), FileManifest(spark, scratch_path(spark, "manifest"))
    events = table(spark, sf, "events").select("event_id", F.date_format("ts", "dd").alias("day"))
    parts, number = None, 0
    for what in ("event_id % 10 <> 3 AND day <= '20'", "event_id % 10 = 3 AND day <= '20'", "day > '20'", "false"):
        events.where(what).write.mode("append").partitionBy("day").parquet(landing)
        while not (got := read_unread(manifest, "daily", landing, suffix=".parquet")).skipped:
            number += 0 if got.more else 1
            counts = got.df.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")).withColumn("read", F.lit(number))
            parts = counts if parts is None else parts.unionByName(counts)
            got.done()
    return parts


@query(
    "s6_first_cursor",
    f"""SELECT 'all' AS start_from, {EVENT_SUMMARY} FROM events
        UNION ALL SELECT '2024/01/20', {EVENT_SUMMARY} FROM events WHERE ts >= TIMESTAMP '2024-01-21'
        UNION ALL SELECT 'now', count(*), NULL FROM events WHERE ts > (SELECT max(ts) FROM events)""",
)
def s6(spark, sf):
    path = daily_events(spark, sf)
    rows = c.read_partitioned(spark, path)
    parts = []
    for start in ("all", "2024/01/20", "now"):
        cursor = c.initial_cursor(spark, path, DAY, start)
        parts.append(summary(c.after_cursor(rows, DAY, cursor)).withColumn("start_from", F.lit(start)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "s7_stored_cursor",
    f"""SELECT 1 AS run, false AS skipped, '2024/01/30' AS cursor, {EVENT_SUMMARY} FROM events
        WHERE ts >= TIMESTAMP '2024-01-11'
        UNION ALL SELECT 2, true, '2024/01/30', 0, NULL""",
)
def s7(spark, sf):
    path = daily_events(spark, sf)
    store = c.CursorTable(spark, scratch_path(spark, "cursors"))
    result = None
    for run in (1, 2):
        got = c.read_incremental(spark, store, "daily", path, DAY, start_from="2024/01/10")
        rows = c.read_partitioned(spark, path).limit(0) if got.skipped else got.df
        if not got.skipped:
            store.advance("daily", path, got.cursor)
        cursor = "/".join(store.get("daily", path))
        part = summary(rows).withColumns(
            {"run": F.lit(run), "skipped": F.lit(got.skipped), "cursor": F.lit(cursor)}
        )
        result = part if result is None else result.unionByName(part)
    return result


@query(
    "s8_closed_window",
    f"""SELECT w, {EVENT_SUMMARY} FROM events, (VALUES ('days', DATE '2024-01-05', DATE '2024-01-12'),
          ('month', DATE '2024-01-08', DATE '2024-01-31')) v(w, lo, hi)
        WHERE CAST(ts AS DATE) BETWEEN lo AND hi GROUP BY w""",
)
def s8(spark, sf):
    rows = c.read_partitioned(spark, daily_events(spark, sf))
    days = c.in_window(rows, DAY, ("2024", "01", "05"), ("2024", "01", "12"))
    month = c.in_window(rows, DAY, ("2024", "01", "08"), ("2024", "01"))
    return summary(days).withColumn("w", F.lit("days")).unionByName(summary(month).withColumn("w", F.lit("month")))


@query(
    "s9_new_file_ingest",
    f"""SELECT 'first' AS run, {EVENT_SUMMARY} FROM events WHERE event_type <> 'purchase'
        UNION ALL SELECT 'second', {EVENT_SUMMARY} FROM events""",
)
def s9(spark, sf):
    landing, out, state = (scratch_path(spark, n) for n in ("landing", "ingested", "state"))
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    stream = lambda: file_stream(spark, landing, events.schema, max_files=3)
    kept = []
    for run, rows in (("first", "event_type <> 'purchase'"), ("second", "event_type = 'purchase'")):
        events.where(rows).repartition(4).write.mode("append").parquet(landing)
        run_available(stream(), state, path=out)
        run_available(stream(), state, path=out)  # nothing new: nothing is read twice
        seen = scratch_path(spark, "seen")
        write_path(summary(spark.read.parquet(out)).withColumn("run", F.lit(run)), seen)
        kept.append(spark.read.parquet(seen))
    return kept[0].unionByName(kept[1])


@query(
    "s10_forced_read",
    f"""SELECT f AS forced, CASE WHEN f THEN count(*) ELSE 0 END AS n,
               CASE WHEN f THEN CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) END AS total
        FROM events, (VALUES (true), (false)) v(f) GROUP BY f""",
)
def s10(spark, sf):
    path = daily_events(spark, sf)
    store = c.CursorTable(spark, scratch_path(spark, "cursors"))
    store.advance("daily", path, c.newest_partition(spark, path, DAY))
    result = None
    for forced in (False, True):
        got = c.read_incremental(spark, store, "daily", path, DAY, forced=forced)
        rows = c.read_partitioned(spark, path).limit(0) if got.skipped else got.df
        part = summary(rows).withColumn("forced", F.lit(forced))
        result = part if result is None else result.unionByName(part)
    return result


@query(
    "s11_json_path",
    """SELECT event_id, json_extract_string(props, '$.k') AS k, NULL AS note FROM events
       UNION ALL SELECT event_id, NULL, event_type FROM events""",
)
def s11(spark, sf):
    body = F.concat(
        F.lit('{"data":{"items":['), F.col("props"), F.lit(', 7, {"note":"'), F.col("event_type"), F.lit('"}]}}')
    )
    documents = table(spark, sf, "events").select("event_id", body.alias("body"))
    return json_rows(documents, "body", "data.items", keep=["event_id"])


TEXT_CELLS = """CAST(l_orderkey AS {s}) AS a_long, CAST(l_discount AS {s}) AS a_double,
  CASE WHEN l_linenumber > 5 THEN ' ' ELSE CAST(l_linenumber AS {s}) END AS some_blank,
  CASE WHEN l_linenumber = 7 THEN 'n/a' ELSE CAST(l_quantity AS {s}) END AS mixed, ' ' AS blank"""


@query(
    "s12_text_types",
    """SELECT 'a_long' AS column_name, 'long' AS column_type, count(*) AS filled FROM lineitem
        UNION ALL SELECT 'a_double', 'double', count(*) FROM lineitem
        UNION ALL SELECT 'some_blank', 'long', count(*) FROM lineitem WHERE l_linenumber <= 5
        UNION ALL SELECT 'mixed', 'string', count(*) FROM lineitem
        UNION ALL SELECT 'blank', 'string', count(*) FROM lineitem""",
)
def s12(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("lineitem_cells")
    text = spark.sql(f"SELECT {TEXT_CELLS.format(s='STRING')} FROM lineitem_cells")
    types = freeze(text_column_types(text))
    typed = typed_text(text, types=types)
    filled = typed.agg(*[F.count(n).alias(n) for n in typed.columns]).unpivot([], typed.columns, "column_name", "filled")
    return types.join(filled, "column_name")


@query(
    "s13_sample_page",
    """SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) > 150 AS more
       FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100""",
)
def s13(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    order = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    more = page(orders, order, 150, 1).count() > 0
    return page(orders, order, 100, 50).withColumn("more", F.lit(more))


@query("s14_newest_files", f"SELECT event_type, {EVENT_SUMMARY} FROM events WHERE event_type = 'click' GROUP BY event_type")
def s14(spark, sf):
    base = scratch_path(spark, "landing")
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    events.where("event_type <> 'click'").write.mode("append").parquet(base)
    older = file_listing(spark, base).where(F.col("path").endswith(".parquet")).count()
    events.where("event_type = 'click'").write.mode("append").parquet(base)
    files = file_listing(spark, base).where(F.col("path").endswith(".parquet")).count() - older
    newest = [row["path"] for row in newest_files(spark, base, files + 1).collect() if row["path"].endswith(".parquet")]
    return summary(read_files(spark, newest[:files], "parquet", base), "event_type")


@query(
    "s15_shared_scan",
    """SELECT 'flag' AS stage, l_returnflag AS g, count(*) AS n FROM lineitem GROUP BY 2
       UNION ALL SELECT 'status', l_linestatus, count(*) FROM lineitem GROUP BY 2""",
)
def s15(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus")
    out = scratch_path(spark, "stages")
    with shared_scan(lines, readers=2) as scan:
        for stage, column in (("flag", "l_returnflag"), ("status", "l_linestatus")):
            counts = scan.groupBy(F.col(column).alias("g")).agg(F.count(F.lit(1)).alias("n"))
            write_path(counts.withColumn("stage", F.lit(stage)), f"{out}/{stage}")
    return spark.read.parquet(f"{out}/flag").unionByName(spark.read.parquet(f"{out}/status"))


@query(
    "s16_time_travel",
    """SELECT v AS version, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
       FROM orders, (VALUES (0, 'F'), (1, 'P'), (2, 'Z')) t(v, upto) WHERE o_orderstatus <= upto
         AND (v > 0 OR o_orderstatus = 'F') AND (v <> 1 OR o_orderstatus <> 'O') GROUP BY v""",
)
def s16(spark, sf):
    orders = table(spark, sf, "orders")
    history = VersionedTable(spark, scratch_path(spark, "history"))
    for status in ("F", "P", "O"):
        history.append(orders.where(F.col("o_orderstatus") == status))
    parts = []
    for v in range(3):
        total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
        parts.append(history.read(v).agg(F.lit(v).alias("version"), F.count(F.lit(1)).alias("n"), total.alias("total")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "st1_redelivered",
    f"SELECT event_type, {EVENT_SUMMARY} FROM events GROUP BY event_type",
)
def st1_redelivered(spark, sf):
    """Every file is delivered twice, the second time under another name; each event counts once, and the stream remembers
    no more events than the delay covers."""
    landing, out, state = (scratch_path(spark, n) for n in ("landing", "once", "state"))
    events = table(spark, sf, "events").select("event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    for day in range(0, 31, 8):
        some = events.where(F.day("ts").between(day, day + 7))
        for _ in range(2):
            some.coalesce(1).write.mode("append").parquet(landing)
    stream = once(file_stream(spark, landing, events.schema, max_files=2), ["event_id"], "ts", "8 days")
    run_available(stream, state, path=out)
    return summary(spark.read.parquet(out), "event_type")


@query(
    "s11_variant",
    """SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN event_id ELSE NULL END AS BIGINT) AS n,
              CASE event_id % 3 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN event_type ELSE 'true' END AS mixed,
              CASE WHEN event_id % 3 = 1 THEN value END AS amount, CASE WHEN event_id % 3 = 2 THEN user_id END AS "user.id" FROM events""",
)
def s11_variant(spark, sf):
    """Objects whose keys and types differ from row to row: the union of keys and types is found in one pass."""
    event = F.struct(F.col("event_id").alias("id"), F.col("event_id").alias("n"), F.col("event_id").alias("mixed"))
    other = F.struct(F.col("event_id").alias("id"), F.col("value").alias("amount"), F.col("event_type").alias("mixed"))
    third = F.struct(F.col("event_id").alias("id"), F.lit(True).alias("mixed"), F.struct(F.col("user_id").alias("id")).alias("user"))
    kind = F.col("event_id") % 3
    item = F.when(kind == 0, F.to_json(event)).when(kind == 1, F.to_json(other)).otherwise(F.to_json(third))
    documents = table(spark, sf, "events").select(F.concat(F.lit('{"data":{"items":['), item, F.lit(', 7, "x"]}}')).alias("body"))
    rows = variant_rows(documents, "body", "data.items")
    return rows.select(F.col("id").alias("event_id"), "n", "mixed", F.col("amount").cast("double").alias("amount"), F.col("`user`.id").alias("user.id"))


@query(
    "st1_file_stream",
    f"SELECT event_type, {EVENT_SUMMARY} FROM events GROUP BY event_type",
)
def st1(spark, sf):
    landing, out, state = (scratch_path(spark, n) for n in ("landing", "streamed", "state"))
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    events.repartition(8).write.parquet(landing)
    run_available(file_stream(spark, landing, events.schema, max_files=3), state, path=out)
    return summary(spark.read.parquet(out), "event_type")
