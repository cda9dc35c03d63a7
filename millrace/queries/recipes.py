"""Transforms and recipes: T1 to T4, K1 to K15."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import parse_magnitude
from millrace.operators.ordering import latest_per_key
from millrace.operators.writes import OutputSpec
from millrace.plans import recipes as r
from millrace.plans.staged import Chain, Stage, python_transform, run_transform, sql_transform
from millrace.queries._registry import query, table
from millrace.session import freeze, scratch_path
from millrace.sources.formats import InputSpec
from millrace.tables.store import Provenance

MONEY = "decimal(18,2)"


def money(name):
    return F.col(name).cast(MONEY)


# -- transforms

T1 = """
SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders WHERE o_totalprice > 10 GROUP BY o_orderstatus
"""


@query("t1_sql_transform", T1)
def t1(spark, sf):
    return sql_transform(spark, T1, {"orders": table(spark, sf, "orders")})


T2 = """
from pyspark.sql import functions as F

def transform(spark, inputs):
    agents = inputs["agents"]
    return {"default": agents.withColumn("is_bot", F.lower("ua").rlike("bot|crawler|spider"))}
"""


@query(
    "t2_python_transform",
    """SELECT is_bot, count(*) AS n FROM (
         SELECT regexp_matches(lower(CASE event_type WHEN 'error' THEN 'ExampleBot/1.0' WHEN 'signup' THEN 'a Crawler'
                                     ELSE 'Mozilla/5.0' END), 'bot|crawler|spider') AS is_bot FROM events)
       GROUP BY is_bot""",
)
def t2(spark, sf):
    kind = F.col("event_type")
    agent = F.when(kind == "error", "ExampleBot/1.0").when(kind == "signup", "a Crawler").otherwise("Mozilla/5.0")
    agents = table(spark, sf, "events").select(agent.alias("ua"))
    outputs = run_transform(spark, python_transform(T2), {"agents": agents})
    return outputs["default"].groupBy("is_bot").agg(F.count(F.lit(1)).alias("n"))


@query(
    "t3_multi_output",
    """SELECT 'trips' AS output, l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY l_returnflag
       UNION ALL SELECT 'trips__large', l_returnflag, count(*) FROM lineitem WHERE l_quantity >= 40 GROUP BY l_returnflag""",
)
def t3(spark, sf):
    def split(_, inputs):
        lines = inputs["lines"]
        return {"all": lines, "large": lines.where("l_quantity >= 40")}

    chain = Chain(spark, scratch_path(spark, "chain"))
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity")
    chain.run([Stage("trips", split, {"lines": lines})])

    def counted(name, label):
        groups = chain.table(name).read().groupBy(F.col("l_returnflag").alias("flag"))
        return groups.agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("output"), "flag", "n")

    return counted("trips__all", "trips").unionByName(counted("trips__large", "trips__large"))


@query(
    "t4_staged_chain",
    """SELECT count(*) AS months, CAST(sum(n) AS BIGINT) AS trips, CAST(sum(revenue) AS DOUBLE) AS revenue,
              CAST(sum(revenue) AS DOUBLE) / CAST(sum(n) AS BIGINT) AS per_trip, 'ok,ok,ok' AS first_run,
              'skipped,skipped' AS second_run
       FROM (SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n,
                    sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS revenue
             FROM lineitem WHERE l_quantity > 0 GROUP BY 1) m""",
)
def t4(spark, sf):
    bronze = Stage(
        "bronze",
        "SELECT CAST(l_shipdate AS TIMESTAMP) AS shipped, CAST(l_quantity AS DOUBLE) AS quantity, "
        "CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lines",
        {"lines": table(spark, sf, "lineitem")},
    )
    silver = Stage(
        "silver",
        "SELECT date_format(shipped, 'yyyy-MM') AS month, count(*) AS n, CAST(sum(price) AS DECIMAL(18,2)) AS revenue "
        "FROM trips WHERE quantity > 0 GROUP BY 1",
        {"trips": "bronze"},
        {"default": OutputSpec(merge_keys=["month"])},
        incremental=["trips"],
    )
    gold = Stage(
        "gold",
        "SELECT count(*) AS months, sum(n) AS trips, CAST(sum(revenue) AS DOUBLE) AS revenue, "
        "CAST(sum(revenue) AS DOUBLE) / sum(n) AS per_trip FROM months",
        {"months": "silver"},
        incremental=["months"],
    )
    chain = Chain(spark, scratch_path(spark, "chain"))
    first = ",".join(x.status for x in chain.run([bronze, silver, gold]))
    second = ",".join(x.status for x in chain.run([silver, gold]))
    return chain.table("gold").read().withColumns({"first_run": F.lit(first), "second_run": F.lit(second)})


@query(
    "t4_node_rows",
    """WITH m AS (SELECT l_partkey AS mode, count(*) AS n FROM lineitem GROUP BY 1)
       SELECT run, node, status, output_rows, error_msg FROM (VALUES
         ('r1', 'raw', 'ok', (SELECT count(*) FROM lineitem WHERE l_quantity <= 25), NULL),
         ('r1', 'modes', 'ok', (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_quantity <= 25), NULL), ('r1', 'report', 'ok', 1, NULL),
         ('r2', 'raw', 'ok', (SELECT count(*) FROM lineitem WHERE l_quantity > 25), NULL),
         ('r2', 'modes', 'ok', (SELECT count(*) FROM m) - (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_quantity <= 25), NULL), ('r2', 'report', 'ok', 1, NULL),
         ('r3', 'modes', 'skipped', NULL, NULL), ('r3', 'report', 'skipped', NULL, 'all upstreams skipped')) v(run, node, status, output_rows, error_msg)""",
)
def t4_node_rows(spark, sf):
    """What each run says of its stages: a merge counts the rows that it adds, a stage reads the table that another one
    names as its target, and a stage skipped by cascade leaves a row."""
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_quantity")
    modes = Stage(
        "modes", "SELECT l_partkey AS mode, count(*) AS n FROM lines GROUP BY 1", {"lines": "raw"},
        {"default": OutputSpec(target="by_mode", merge_keys=["mode"], merge_update={"n": "additive"})}, incremental=["lines"],
    )
    report = Stage("report", "SELECT sum(n) AS n FROM modes", {"modes": "by_mode"}, incremental=["modes"])
    chain = Chain(spark, scratch_path(spark, "chain"))
    for run, part in (("r1", "l_quantity <= 25"), ("r2", "l_quantity > 25")):
        raw = Stage("raw", "SELECT * FROM lines", {"lines": lines.where(part)}, {"default": OutputSpec(mode="append")})
        chain.run([raw, modes, report], Provenance(run))
    chain.run([modes, report], Provenance("r3"))
    return chain.system("node_runs").select(F.col("run_id").alias("run"), "node", "status", "output_rows", "error_msg")


# -- recipes


DAYS_SQL = """SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"""


@query(
    "t4_outputs_and_telemetry",
    f"""WITH d AS ({DAYS_SQL}), late AS (SELECT * FROM d WHERE day > DATE '2024-01-20')
        SELECT 'path' AS what, '' AS name, count(*) AS a, CAST(sum(n) AS BIGINT) AS b FROM d
        UNION ALL SELECT 'json', '', count(DISTINCT event_type), CAST(sum(n) AS BIGINT) FROM d
        UNION ALL SELECT 'table', '', count(*), CAST(sum(n) AS BIGINT) FROM d
        UNION ALL SELECT 'tables', 'daily__days', 2, (SELECT count(*) FROM d)
        UNION ALL SELECT 'stats', c, (SELECT count(*) FROM d), CASE c WHEN 'n' THEN (SELECT min(n) FROM d) ELSE 0 END FROM (VALUES ('day'), ('event_type'), ('n')) v(c)
        UNION ALL SELECT 'node', 'daily ' || s, k, 0 FROM (VALUES ('ok', 2), ('skipped', 1)) v(s, k)""",
)
def t4_outputs(spark, sf):
    """A stage that reads a partitioned path by cursor and writes a path, a JSON document and a table with statistics;
    the second run finds only the days that were added, the third nothing."""
    source, chain = scratch_path(spark, "by-day"), Chain(spark, scratch_path(spark, "chain"))
    dated = table(spark, sf, "events").withColumns({"day": F.date_format("ts", "yyyy-MM-dd")}).select("day", "event_type", "event_id")
    path, document = f"{chain.path}/out/days", f"{chain.path}/out/types"

    def daily(spark, inputs):
        days = inputs["rows"].groupBy(F.to_date("day").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
        return {"days": days, "files": days, "types": days.groupBy("event_type").agg(F.sum("n").alias("n"))}

    stage = Stage(
        "daily", daily, {"rows": InputSpec(source, partitions=("day",))},
        {"days": OutputSpec(mode="append", stats=True), "files": OutputSpec(path, "path", "append"), "types": OutputSpec(document, "json_object")},
    )
    typed = "array<struct<event_type: string, n: bigint>>"
    types = []
    for part in ("day <= '2024-01-20'", "day > '2024-01-20'", "false"):
        dated.where(part).write.mode("append").partitionBy("day").parquet(source)
        if chain.run([stage], Provenance("r"))[0].status == "ok":
            read = spark.read.text(document).select(F.inline(F.from_json("value", typed)))
            types.append(freeze(read))  # the next run's document takes the place of this one

    def row(what, df, name=F.lit("")):
        return df.select(F.lit(what).alias("what"), name.alias("name"), F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))

    def counted(df):
        return df.agg(F.count(F.lit(1)).alias("a"), F.sum("n").alias("b"))

    both = types[0].unionByName(types[1]).groupBy("event_type").agg(F.sum("n").alias("n"))
    stats = chain.system("column_stats").groupBy("column_name").agg(F.sum("row_count").alias("a"), F.min(F.when(F.col("column_name") == "n", F.col("min_value").cast("bigint")).otherwise(0)).alias("b"))
    tables = chain.system("tables").groupBy("table_name").agg(F.count(F.lit(1)).alias("a"), F.sum("row_count").alias("b"))
    nodes = chain.system("node_runs").groupBy("node", "status").agg(F.count(F.lit(1)).alias("a"), F.lit(0).alias("b"))
    parts = [
        row("path", counted(spark.read.parquet(path))), row("json", counted(both)), row("table", counted(chain.table("daily__days").read())),
        row("tables", tables, F.col("table_name")), row("stats", stats, F.col("column_name")), row("node", nodes, F.concat_ws(" ", "node", "status")),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "k1_type_pinning",
    """SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
              CAST(l_quantity AS BIGINT) AS l_quantity, CAST(l_shipdate AS DATE) AS l_shipdate,
              CAST(l_discount AS VARCHAR) AS l_discount FROM lineitem""",
)
def k1(spark, sf):
    types = {"l_orderkey": "bigint", "l_linenumber": "bigint", "l_quantity": "bigint", "l_shipdate": "timestamp", "l_discount": "string"}
    pinned = r.pinned(table(spark, sf, "lineitem"), types)
    return pinned.withColumn("l_shipdate", F.to_date("l_shipdate"))


@query(
    "k2_grouped_kpis",
    """SELECT l_returnflag, count(*) AS n, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18,2))), 2) AS DOUBLE) AS total,
              round(avg((l_extendedprice * l_discount) / nullif(l_extendedprice, 0)) * 100, 1) AS avg_pct
       FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag ORDER BY total DESC""",
)
def k2(spark, sf):
    lines = table(spark, sf, "lineitem")
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    kpis = r.grouped_kpis(lines, "l_returnflag", money("l_extendedprice"), price * discount, price)
    return kpis.withColumn("total", F.col("total").cast("double"))


@query(
    "k3_rollup_of_rollup",
    """SELECT CAST(sum(n) AS BIGINT) AS trips, CAST(sum(revenue) AS DOUBLE) AS revenue,
              CAST(sum(revenue) AS DOUBLE) / CAST(sum(n) AS BIGINT) AS per_trip
       FROM (SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS revenue
             FROM lineitem GROUP BY 1, 2) g""",
)
def k3(spark, sf):
    groups = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus")
    per_group = groups.agg(F.count(F.lit(1)).alias("n"), F.sum(money("l_extendedprice")).alias("revenue"))
    revenue = F.sum("revenue").cast("double")
    return per_group.agg(
        F.sum("n").alias("trips"), revenue.alias("revenue"), (revenue / F.sum("n")).alias("per_trip")
    )


@query(
    "k4_daily_aggregate",
    """SELECT CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS revenue
       FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01' GROUP BY 1""",
)
def k4(spark, sf):
    events = table(spark, sf, "events").where("ts >= TIMESTAMP_NTZ '2024-01-01' AND ts < TIMESTAMP_NTZ '2024-02-01'")
    return events.groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(money("value")).cast("double").alias("revenue")
    )


@query(
    "k5_flags_and_conditional_sum",
    """SELECT day, n, n >= 300 AS busy, purchases, large FROM (
         SELECT CAST(ts AS DATE) AS day, count(*) AS n,
                CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS purchases,
                CAST(sum(CASE WHEN value > 100 THEN 1 ELSE 0 END) AS BIGINT) AS large
         FROM events GROUP BY 1) d""",
)
def k5(spark, sf):
    days = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("event_type") == "purchase").cast("bigint")).alias("purchases"),
        F.sum((F.col("value") > 100).cast("bigint")).alias("large"),
    )
    return days.withColumn("busy", F.col("n") >= 300)


@query(
    "k6_zscore",
    """SELECT l_orderkey, l_partkey, l_linenumber, round((l_extendedprice - m) / nullif(s, 0), 4) AS z
       FROM lineitem, (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem) t""",
)
def k6(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    scored = r.zscores(lines, "l_extendedprice")
    return scored.withColumn("z", F.round("z", 4)).drop("l_extendedprice")


@query(
    "k7_rate_buckets",
    """SELECT bucket, count(*) AS n FROM (
         SELECT CASE WHEN rate IS NULL THEN 'unknown' WHEN rate < 0.02 THEN 'low' WHEN rate < 0.06 THEN 'medium'
                     ELSE 'high' END AS bucket
         FROM (SELECT l_tax / nullif(l_discount, 0) * 0.05 AS rate FROM lineitem) x) y GROUP BY bucket""",
)
def k7(spark, sf):
    lines = table(spark, sf, "lineitem")
    steps = [(0.02 / 0.05, "low"), (0.06 / 0.05, "medium")]
    return r.rate_bucket(lines, "l_tax", "l_discount", steps, "high").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query(
    "k8_outliers",
    """SELECT event_id, value FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) t
       WHERE abs((value - m) / nullif(s, 0)) > 3""",
)
def k8(spark, sf):
    return r.outliers(r.zscores(table(spark, sf, "events"), "value")).select("event_id", "value")


K9_TEXT = """CASE l_linenumber WHEN 1 THEN CAST(l_quantity AS {s}) || 'K' WHEN 2 THEN ' ' || CAST(l_quantity AS {s}) || 'm'
  WHEN 3 THEN CAST(l_discount AS {s}) || 'B' WHEN 4 THEN '-' || CAST(l_quantity AS {s}) || 'T'
  WHEN 5 THEN CAST(l_tax AS {s}) WHEN 6 THEN CAST(l_quantity AS {s}) || 'x' ELSE ' ' END"""


@query(
    "k9_parse_magnitude",
    f"""SELECT text, count(*) AS n,
               min(CASE WHEN regexp_matches(t, '^[-0-9.]+[KMBT]?$') THEN
                 CAST(regexp_extract(t, '^[-0-9.]+') AS DOUBLE) *
                 CASE right(t, 1) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 WHEN 'T' THEN 1e12 ELSE 1.0 END END) AS parsed
        FROM (SELECT {K9_TEXT.format(s="VARCHAR")} AS text, upper(trim({K9_TEXT.format(s="VARCHAR")})) AS t FROM lineitem) x
        GROUP BY text""",
)
def k9(spark, sf):
    text = table(spark, sf, "lineitem").select(F.expr(K9_TEXT.format(s="STRING")).alias("text"))
    counts = text.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("parsed", parse_magnitude(F.col("text")))


@query(
    "k10_explode_envelope",
    """SELECT CAST(page_id AS VARCHAR) AS object_id, url, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host,
              CAST(to_timestamp(1700000000 + page_id * 3600) AT TIME ZONE 'UTC' AS DATE) AS created_on FROM pages
       UNION ALL
       SELECT CAST(event_id AS VARCHAR), NULL, NULL,
              CAST(to_timestamp(1700000000 + event_id * 60) AT TIME ZONE 'UTC' AS DATE) FROM events""",
)
def k10(spark, sf):
    item = "struct<objectID: string, url: string, created_at_i: bigint>"

    def envelope(df, key, url, step):
        hit = F.struct(
            F.col(key).cast("string").alias("objectID"), url.alias("url"), (F.lit(1700000000) + F.col(key) * step).alias("created_at_i")
        )
        return df.select(F.to_json(F.struct(F.array(hit).alias("hits"))).alias("body"))

    pages = envelope(table(spark, sf, "pages"), "page_id", F.col("url"), 3600)
    events = envelope(table(spark, sf, "events"), "event_id", F.lit(None).cast("string"), 60)
    bodies = pages.unionByName(events).select(F.from_json("body", f"struct<hits: array<{item}>>").alias("b"))
    hits = bodies.select(F.explode("b.hits").alias("h"))
    return hits.select(
        F.col("h.objectID").alias("object_id"),
        F.col("h.url").alias("url"),
        F.try_parse_url("h.url", F.lit("HOST")).alias("host"),
        F.to_date(F.timestamp_seconds("h.created_at_i")).alias("created_on"),
    )


@query(
    "k11_ranked_batches",
    """SELECT CAST(ts AS DATE) AS batch, event_id,
              row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY value DESC, event_id) AS rank FROM events""",
)
def k11(spark, sf):
    events = table(spark, sf, "events").select(F.to_date("ts").alias("batch"), "event_id", "value")
    return r.ranked_batch(events, "batch", "value", "event_id").select("batch", "event_id", F.col("rank").cast("bigint").alias("rank"))


@query(
    "k12_fact_dimension",
    """SELECT p_brand, count(DISTINCT l_orderkey) AS orders, round(avg(l_extendedprice), 2) AS avg_price,
              max(l_quantity) AS max_quantity
       FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_retailprice > 0 GROUP BY p_brand""",
)
def k12(spark, sf):
    parts = table(spark, sf, "part").where("p_retailprice > 0").select("p_partkey", "p_brand")
    lines = table(spark, sf, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy("p_brand").agg(
        F.count_distinct("l_orderkey").alias("orders"),
        F.round(F.avg("l_extendedprice"), 2).alias("avg_price"),
        F.max("l_quantity").alias("max_quantity"),
    )


@query(
    "k13_share_of_total",
    """SELECT o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount,
              round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) * 100
                    / (SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders), 2) AS share_pct
       FROM orders GROUP BY o_orderpriority""",
)
def k13(spark, sf):
    shares = r.share_of_total(table(spark, sf, "orders"), "o_orderpriority", money("o_totalprice"))
    return shares.withColumns({"amount": F.col("amount").cast("double"), "share_pct": F.col("share_pct").cast("double")})


@query(
    "k14_top_groups",
    "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 10",
)
def k14(spark, sf):
    return r.top_groups(table(spark, sf, "lineitem"), "l_partkey", 10)


@query(
    "k15_latest_per_key",
    """SELECT user_id, event_type, event_id, value FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) x
       WHERE rn = 1""",
)
def k15(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return latest_per_key(events, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")
