"""Dashboard datasets and widget shapes: D1 to D9."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from millrace.plans import serving as s
from millrace.queries._registry import query, table

NOW = datetime(2024, 1, 31)


def views(spark, sf, *names):
    for name in names:
        table(spark, sf, name).createOrReplaceTempView(f"given_{name}")


@query(
    "d1_dataset_template",
    """SELECT event_type, count(*) AS n FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-10T00:00:00'
       GROUP BY event_type""",
)
def d1(spark, sf):
    views(spark, sf, "events")
    template = """SELECT event_type, count(*) AS n FROM given_events
                  WHERE event_type = {{kind}} AND ts >= CAST({{range.start}} AS TIMESTAMP_NTZ) GROUP BY event_type"""
    return s.dataset(spark, template, {"kind": "click", "range.start": "2024-01-10T00:00:00"})


@query(
    "d2_time_ranges",
    """SELECT name, count(ts) AS n FROM (VALUES ('now-24h', 1), ('last_7d', 7), ('now-2w', 14), ('bad', 30), ('', 30), ('now-0d', 30)) v(name, d)
       LEFT JOIN events ON ts >= TIMESTAMP '2024-01-31' - d * INTERVAL 1 DAY AND ts <= TIMESTAMP '2024-01-31' GROUP BY name""",
)
def d2(spark, sf):
    events = table(spark, sf, "events")
    result = None
    for name in ("now-24h", "last_7d", "now-2w", "bad", "", "now-0d"):
        params = s.parameters([s.Control("r", "time_range", name)], {}, NOW)
        low, high = (F.lit(params[f"r.{side}"].rstrip("Z")).cast("timestamp_ntz") for side in ("start", "end"))
        part = events.where(F.col("ts").between(low, high)).agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(name))
        result = part if result is None else result.unionByName(part)
    return result


@query(
    "d3_render_dashboard",
    """SELECT w AS widget, event_type AS x, count(*) AS y FROM events, (VALUES ('bars'), ('table')) v(w) GROUP BY 1, 2
       UNION ALL SELECT 'broken', 'error', 1""",
)
def d3(spark, sf):
    views(spark, sf, "events")
    datasets = {
        "kinds": "SELECT event_type AS x, count(*) AS y FROM given_events GROUP BY event_type",
        "broken": "SELECT no_such_column FROM given_events",
    }
    widgets = [s.Widget("bars", "kinds"), s.Widget("table", "kinds"), s.Widget("broken", "broken")]
    shown = s.render(spark, datasets, widgets, {})
    parts = [rows.select(F.lit(w).alias("widget"), "x", "y") for w, rows in shown.rows.items()]
    parts += [
        spark.range(1).select(F.lit(w).alias("widget"), F.lit("error").alias("x"), F.lit(1).cast("bigint").alias("y"))
        for w in shown.errors
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query(
    "d4_capped_query",
    "SELECT count(*) > 1000 AS truncated, least(count(*), 1000) AS shown, true AS missing_is_empty FROM orders",
)
def d4(spark, sf):
    views(spark, sf, "orders")
    rows, truncated = s.query(spark, "SELECT o_orderkey FROM given_orders")
    missing, _ = s.query(spark, "SELECT * FROM no_such_table", strict=False)
    flags = {"truncated": F.lit(truncated), "missing_is_empty": F.lit(missing is None)}
    return rows.agg(F.count(F.lit(1)).alias("shown")).withColumns(flags)


@query("d5_select_options", "SELECT DISTINCT o_orderpriority AS value FROM orders")
def d5(spark, sf):
    return s.options(table(spark, sf, "orders").select("o_orderpriority", "o_orderkey"))


@query(
    "d6_pie_slices",
    """WITH g AS (SELECT p_brand AS name, CAST(sum(p_size) AS DOUBLE) AS value FROM part GROUP BY 1),
            r AS (SELECT *, row_number() OVER (ORDER BY value DESC, name) AS rn FROM g WHERE value > 0)
       SELECT CASE WHEN rn <= 7 THEN name ELSE 'Other' END AS name, sum(value) AS value FROM r GROUP BY 1""",
)
def d6(spark, sf):
    brands = table(spark, sf, "part").groupBy("p_brand").agg(F.sum("p_size").cast("string").alias("size"))
    return s.pie(brands, "p_brand", "size")


@query(
    "d7_series",
    """WITH d AS (SELECT CAST(ts AS DATE) AS x, count(*) AS n, max(value) AS peak FROM events GROUP BY 1)
       SELECT x, 'n' AS series, CAST(n AS DOUBLE) AS y FROM d UNION ALL SELECT x, 'peak', peak FROM d UNION ALL SELECT x, 'kind', NULL FROM d""",
)
def d7(spark, sf):
    days = table(spark, sf, "events").groupBy(F.to_date("ts").alias("x")).agg(
        F.count(F.lit(1)).alias("n"), F.max("value").cast("string").alias("peak"), F.min("event_type").alias("kind")
    )
    return s.series(days, "x")


@query(
    "d8_world_map",
    """WITH v AS (SELECT c_custkey, n_nationkey AS region_id, c_acctbal AS value FROM customer JOIN nation ON c_nationkey = n_nationkey
                  WHERE n_nationkey <> 3),
            l AS (SELECT region_id, max_by(value, c_custkey) AS value FROM v GROUP BY region_id),
            b AS (SELECT min(value) AS lo, max(value) AS hi FROM v)
       SELECT region_id, value, 0.25 + 0.75 * least(greatest((value - lo) / (hi - lo), 0.0), 1.0) AS opacity FROM l, b""",
)
def d8(spark, sf):
    nations = table(spark, sf, "nation")
    # One nation is missing from the codes, so its rows are dropped; codes come in odd case and spacing.
    codes = nations.where("n_nationkey <> 3").select(F.col("n_name").alias("code"), F.col("n_nationkey").alias("region_id"))
    customers = table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = customers.select(
        F.concat(F.lit(" "), F.lower("n_name")).alias("region"), F.col("c_acctbal").cast("string").alias("v"), "c_custkey"
    )
    return s.world_map(rows, "region", "v", "c_custkey", codes)


ROLES = {"event_id": "numeric", "ts": "temporal", "user_id": "numeric", "event_type": "string", "value": "numeric", "props": "string"}


@query(
    "d9_column_roles",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{r}' AS role, count({c}) AS filled FROM events" for c, r in ROLES.items()),
)
def d9(spark, sf):
    events = table(spark, sf, "events")
    filled = events.agg(*[F.count(c).alias(c) for c in events.columns]).unpivot([], events.columns, "column_name", "filled")
    return s.column_roles(events).join(filled, "column_name").select("column_name", "role", "filled")
