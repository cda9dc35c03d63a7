"""Profiles, catalog state and freshness: P1 to P11."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import profile as pr
from millrace.operators.sketches import table_profile
from millrace.operators.writes import OutputSpec
from millrace.plans import catalog as cat
from millrace.plans.staged import Chain, Stage
from millrace.queries._registry import query, table
from millrace.session import scratch_path
from millrace.sources.sampling import file_listing
from millrace.tables.store import Provenance, VersionedTable

NOW = "2001-08-02 00:00:00"


def profile_sql(columns):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, '{kind}' AS column_type, count(*) AS row_count, count(*) - count({c}) AS null_count,
          CASE WHEN count(*) = 0 THEN 0.0 ELSE (count(*) - count({c})) / count(*) END AS null_pct,
          CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value, true AS approx_ok FROM o"""
        for c, kind in columns.items()
    )


PROFILED = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz", "maybe": "string",
}


@query(
    "p1_column_profile",
    f"""WITH o AS (SELECT *, CASE WHEN o_orderpriority > '3' THEN o_orderpriority END AS maybe FROM orders)
        SELECT * FROM ({profile_sql(PROFILED)}) u""",
)
def p1(spark, sf):
    maybe = F.when(F.col("o_orderpriority") > "3", F.col("o_orderpriority"))
    orders = table(spark, sf, "orders").withColumn("maybe", maybe).drop("o_orderpriority")
    profile = pr.column_profile(orders)
    exact = orders.agg(*[F.count_distinct(c).alias(c) for c in orders.columns])
    exact = exact.unpivot([], orders.columns, "column_name", "exact")
    # The sketch's standard error is five percent; three of them are practically never exceeded.
    near = F.abs(F.col("approx_count_distinct") - F.col("exact")) <= F.greatest(0.15 * F.col("exact"), F.lit(0))
    ordered = F.coalesce(F.col("approx_p50") <= F.col("approx_p95"), F.lit(True))
    checked = profile.join(exact, "column_name").withColumn("approx_ok", near & ordered)
    return checked.drop("approx_count_distinct", "approx_p50", "approx_p95", "exact")


FOLDED = "l_quantity l_extendedprice l_discount l_shipdate l_returnflag".split()


@query(
    "p3_folded_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, "
        + (f"CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high" if c in FOLDED[:3] else "NULL AS low, NULL AS high")
        + ", true AS p50_near, true AS p95_near, true AS distinct_near FROM lineitem"
        for c in FOLDED
    ),
)
def p3_folded(spark, sf):
    """The profile of a table from its batches' profiles: three appends by a chain that asks for statistics, folded and held
    against the rows."""
    lines = table(spark, sf, "lineitem").select(*FOLDED)
    chain = Chain(spark, scratch_path(spark, "chain"))
    for k, part in enumerate(("l_quantity <= 10", "l_quantity > 10 AND l_quantity <= 30", "l_quantity > 30")):
        stage = Stage("lines", "SELECT * FROM rows", {"rows": lines.where(part)}, {"default": OutputSpec(mode="append", stats=True)})
        chain.run([stage], Provenance(f"r{k}"))
    folded = table_profile(chain.system("column_stats")).drop("table_identifier")
    long = lines.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in FOLDED[:3]])).alias("x")).select("x.*")
    told = folded.where("approx_p50 IS NOT NULL").select("column_name", "approx_p50", "approx_p95")
    ranks = long.join(told, "column_name").groupBy("column_name").agg(
        *[F.avg((F.col("v") < F.col(f"approx_{p}")).cast("double")).alias(f"below_{p}") for p in ("p50", "p95")],
        *[F.avg((F.col("v") <= F.col(f"approx_{p}")).cast("double")).alias(f"upto_{p}") for p in ("p50", "p95")],
    )
    near = {f"{p}_near": F.coalesce((F.col(f"below_{p}") <= q + 0.02) & (F.col(f"upto_{p}") >= q - 0.02), F.lit(True)) for p, q in (("p50", 0.5), ("p95", 0.95))}
    exact = lines.agg(*[F.count_distinct(c).alias(c) for c in FOLDED]).unpivot([], FOLDED, "column_name", "exact")
    number = F.when(F.col("approx_p50").isNotNull(), F.col("min_value").cast("double")).alias("low"), F.when(F.col("approx_p50").isNotNull(), F.col("max_value").cast("double")).alias("high")
    both = folded.join(ranks, "column_name", "left").join(exact, "column_name").withColumns(near)
    close = F.abs(F.col("approx_count_distinct") - F.col("exact")) <= F.greatest(F.col("exact") * 0.1, F.lit(0))
    return both.select("column_name", "row_count", "null_count", *number, "p50_near", "p95_near", close.alias("distinct_near"))


LISTED = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()


@query(
    "p2_top_values",
    "WITH c AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS count FROM lineitem GROUP BY 2" for c in LISTED)
    + """), r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value ASC NULLS FIRST) AS rank FROM c)
       SELECT column_name, value, count, count / (SELECT count(*) FROM lineitem) AS share, rank, true AS listed FROM r WHERE rank <= 10""",
)
def p2(spark, sf):
    """Every column of the table, keys of many values too. They are named, as the operator's own choice goes by a sketch's
    cut-off; that it takes in all that are clearly below that, and no key of many values, is a column of the answer."""
    lines = table(spark, sf, "lineitem")
    chosen = set(pr.listable_columns(lines))
    keys = lines.agg(*[F.count_distinct(c).alias(c) for c in lines.columns]).first().asDict()
    clear = all((c in chosen) == (n <= pr.TOP_MAX_DISTINCT) for c, n in keys.items() if abs(n - pr.TOP_MAX_DISTINCT) > 0.2 * pr.TOP_MAX_DISTINCT)
    return pr.top_values(lines, LISTED).withColumn("listed", F.lit(clear))


@query(
    "p3_latest_profile",
    """SELECT column_name, table_identifier, row_count FROM (SELECT event_type AS column_name, 't' || user_id AS table_identifier,
         event_id AS row_count, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) x
       WHERE rn = 1""",
)
def p3(spark, sf):
    stats = table(spark, sf, "events").select(
        F.col("event_type").alias("column_name"),
        F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("table_identifier"),
        F.col("event_id").alias("row_count"),
        F.col("ts").alias("computed_at"),
        F.col("event_id").alias("run_id"),
    )
    return pr.latest_profile(stats).select("column_name", "table_identifier", "row_count")


@query(
    "p4_commit_state",
    """SELECT 'merge' AS node, 1 AS snapshot_id, count(*) AS row_count, 'r1' AS last_writer_run_id, true AS has_files
         FROM orders WHERE o_orderstatus <> 'F'
       UNION ALL SELECT 'write', 0, count(*), 'r0', true FROM orders""",
)
def p4(spark, sf):
    orders = table(spark, sf, "orders")
    merged, written = (VersionedTable(spark, scratch_path(spark, n)) for n in ("merged", "written"))
    merged.merge(orders.where("o_orderstatus <> 'O'"), ["o_orderkey"], by=Provenance("r0"))
    merged.merge(orders.where("o_orderstatus <> 'F'"), ["o_orderkey"], by=Provenance("r1"))
    written.replace(orders, Provenance("r0"))
    rows = [
        cat.commit_state(t, pipeline="shop", node=n, output_key="default", name="orders")
        for n, t in (("merge", merged), ("write", written))
    ]
    files = (F.col("file_count") > 0) & (F.col("total_bytes") > 0)
    both = rows[0].unionByName(rows[1]).withColumn("has_files", files)
    return both.select("node", F.col("snapshot_id").cast("int").alias("snapshot_id"), "row_count", "last_writer_run_id", "has_files")


STATES = """SELECT 't' || CAST(o_custkey AS {s}) AS table_id, o_orderdate AS snapshot_ts, o_orderkey AS snapshot_id,
  CAST(floor(o_totalprice / 10000) AS BIGINT) AS file_count, CAST(floor(o_totalprice * 1000) AS BIGINT) AS total_bytes FROM orders"""


def states(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("given_orders")
    return spark.sql(STATES.replace("{s}", "STRING").replace("FROM orders", "FROM given_orders"))


def duck_states():
    return STATES.replace("{s}", "VARCHAR")


LATEST_STATES = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY snapshot_ts DESC, snapshot_id DESC) AS rn
  FROM ({duck_states()}) s) x WHERE rn = 1)"""


@query("p5_latest_state", f"SELECT table_id, snapshot_id, file_count, total_bytes FROM {LATEST_STATES} y")
def p5(spark, sf):
    return cat.latest_state(states(spark, sf)).drop("snapshot_ts")


COMMITS = """SELECT o_orderpriority AS table_id, o_orderkey AS version, CAST(floor(o_totalprice / 100) AS BIGINT) AS added,
  CASE WHEN o_orderstatus = 'P' THEN CAST(floor(o_totalprice / 1000) AS BIGINT) END AS updated,
  CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice / 90) AS BIGINT) END AS deleted,
  CASE WHEN o_orderpriority = '5-LOW' THEN o_orderkey * 10 END AS total,
  o_orderpriority IN ('2-HIGH', '3-MEDIUM') AND o_totalprice > 480000 AS replaces FROM orders"""


def commits(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("given_orders")
    return spark.sql(COMMITS.replace("FROM orders", "FROM given_orders"))


@query(
    "p6_row_counts",
    f"""WITH c AS ({COMMITS}), a AS (SELECT table_id, max(version) FILTER (replaces) AS reset, min(version) AS oldest,
               max(version) AS newest FROM c GROUP BY table_id),
             f AS (SELECT c.table_id, greatest(sum(added - coalesce(updated, 0) - coalesce(deleted, 0)), 0) AS fold FROM c JOIN a
               ON c.table_id = a.table_id WHERE reset IS NULL OR version >= reset GROUP BY c.table_id)
        SELECT a.table_id, CAST(CASE WHEN a.table_id = '1-URGENT' THEN (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') ELSE coalesce(c.total, fold) END AS BIGINT) AS row_count,
               a.table_id <> '1-URGENT' AND c.total IS NULL AND reset IS NULL AND oldest <> 0 AS approximate
        FROM a JOIN f ON a.table_id = f.table_id JOIN c ON c.table_id = a.table_id AND c.version = a.newest""",
)
def p6(spark, sf):
    rows = commits(spark, sf)
    exact = rows.groupBy("table_id").agg(F.count(F.lit(1)).alias("row_count")).where(F.col("table_id") < "2")
    return cat.row_counts(rows, exact=exact)


@query(
    "p6_timeline",
    f"""SELECT table_id, version, CASE WHEN version > 0 THEN version - 1 END AS parent_version, top + 1 AS total_commits, n > 20 AS truncated
        FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY version DESC) AS rn, max(version) OVER (PARTITION BY table_id) AS top,
                     count(*) OVER (PARTITION BY table_id) AS n FROM ({COMMITS}) c) x WHERE rn <= 20""",
)
def p6_timeline(spark, sf):
    rows = cat.timeline(commits(spark, sf), 20)
    return rows.select("table_id", "version", "parent_version", "total_commits", "truncated")


@query(
    "p7_live_files",
    """SELECT table_id, count(*) AS file_count, CAST(sum(path) * 10 AS BIGINT) AS total_bytes, CAST(sum(path) AS BIGINT) AS row_count
       FROM (SELECT l_suppkey AS table_id, l_partkey AS path, max_by(CASE WHEN l_returnflag = 'R' THEN 'remove' ELSE 'add' END,
               (l_shipdate, CASE WHEN l_returnflag = 'R' THEN 'remove' ELSE 'add' END)) AS action FROM lineitem GROUP BY 1, 2) x
       WHERE action = 'add' GROUP BY table_id""",
)
def p7(spark, sf):
    lines = table(spark, sf, "lineitem")
    actions = lines.select(
        F.col("l_suppkey").alias("table_id"),
        F.col("l_partkey").alias("path"),
        F.when(F.col("l_returnflag") == "R", "remove").otherwise("add").alias("action"),
        F.col("l_shipdate").alias("version"),
        (F.col("l_partkey") * 10).alias("bytes"),
        F.col("l_partkey").alias("rows"),
    )
    return cat.live_files(actions)


@query(
    "p7_file_facts",
    "SELECT t, true AS all_files, n AS rows FROM (SELECT 'orders' AS t, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem) x",
)
def p7_facts(spark, sf):
    def facts(n):
        listed = file_listing(spark, f"{sf}/{n}.parquet").where("bytes > 0").agg(F.count(F.lit(1))).scalar()
        found = cat.file_facts(table(spark, sf, n)).agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"))
        return found.select(F.lit(n).alias("t"), (F.col("files") == listed).alias("all_files"), "rows")

    frames = [facts(n) for n in ("orders", "lineitem")]
    return frames[0].unionByName(frames[1])


@query(
    "p8_file_health",
    f"""SELECT table_id, CASE WHEN file_count > 0 AND total_bytes > 0 THEN total_bytes / file_count END AS avg_file_bytes,
          CASE WHEN file_count <= 0 OR total_bytes <= 0 THEN 'unknown' WHEN file_count >= 16 AND total_bytes / file_count < 16777216
               THEN 'small' ELSE 'ok' END AS file_health FROM {LATEST_STATES} y""",
)
def p8(spark, sf):
    return cat.health(cat.latest_state(states(spark, sf))).select("table_id", "avg_file_bytes", "file_health")


SLA = """CASE o_orderpriority WHEN '1-URGENT' THEN '400d' WHEN '2-HIGH' THEN '12000h' WHEN '3-MEDIUM' THEN '90000000s'
  WHEN '4-NOT SPECIFIED' THEN 'soon' END"""


@query(
    "p9_freshness",
    f"""SELECT o_orderkey, CASE WHEN sla IS NULL THEN 'none' WHEN age / sla >= 1 THEN 'stale' WHEN age / sla >= 0.5 THEN 'aging' ELSE 'fresh' END AS freshness
        FROM (SELECT o_orderkey, greatest(epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(o_orderdate), 0) / 1000 AS age,
                CASE o_orderpriority WHEN '1-URGENT' THEN 400 * 86400 WHEN '2-HIGH' THEN 12000 * 3600 WHEN '3-MEDIUM' THEN 90000000 END AS sla
              FROM orders) x""",
)
def p9(spark, sf):
    orders = table(spark, sf, "orders").withColumn("sla", F.expr(SLA))
    now = F.lit(NOW).cast("timestamp")
    return cat.with_freshness(orders, now, committed="o_orderdate").select("o_orderkey", "freshness")


@query(
    "p10_inventory",
    f"""WITH w AS (SELECT 't' || c_custkey AS table_id, c_mktsegment AS owner, '400d' AS sla FROM customer)
        SELECT w.table_id, owner, column_name, s.snapshot_id, CASE WHEN s.snapshot_ts IS NULL THEN 'none' WHEN a >= 400 THEN 'stale'
               WHEN a >= 200 THEN 'aging' ELSE 'fresh' END AS freshness
        FROM w LEFT JOIN (SELECT *, date_diff('day', snapshot_ts, TIMESTAMP '{NOW}') AS a FROM {LATEST_STATES} y) s ON w.table_id = s.table_id,
             (VALUES ('id'), ('amount')) c(column_name)""",
)
def p10(spark, sf):
    customers = table(spark, sf, "customer")
    name = F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("table_id")
    owners = customers.select(name, F.col("c_mktsegment").alias("owner"), F.lit("400d").alias("sla"))
    columns = customers.select(name, F.explode(F.array(F.lit("id"), F.lit("amount"))).alias("column_name"))
    rows = cat.inventory(states(spark, sf), columns, owners, F.lit(NOW).cast("timestamp"))
    return rows.select("table_id", "owner", "column_name", "snapshot_id", "freshness")


@query(
    "p11_lineage",
    """WITH i AS (SELECT 'p' || l_linenumber AS pipeline, 'c' || l_orderkey AS node, 's' || CAST(l_quantity AS BIGINT) AS schema,
                    'n' || l_partkey || CASE WHEN l_tax > 0.04 THEN '__default' ELSE '' END AS tab,
                    CASE WHEN l_returnflag = 'N' THEN l_linestatus END AS source FROM lineitem),
            o AS (SELECT 'p' || p_size AS pipeline, 'n' || p_partkey AS node, 's' || p_size AS schema,
                    CASE WHEN p_type = 'ECONOMY' THEN 'extra' ELSE 'default' END AS output FROM part),
            n AS (SELECT *, node || '__' || output AS tab FROM o UNION ALL SELECT *, node FROM o WHERE output = 'default')
       SELECT coalesce(n.pipeline, '(external)') AS from_pipeline, coalesce(n.node, i.tab) AS from_node, i.pipeline AS to_pipeline,
              i.node AS to_node, i.schema || '.' || i.tab AS via_table,
              CASE WHEN n.pipeline IS NULL THEN 'external' WHEN n.pipeline <> i.pipeline THEN 'cross' ELSE 'local' END AS kind
       FROM i LEFT JOIN n ON i.schema = n.schema AND i.tab = n.tab WHERE source IS NULL
       UNION ALL SELECT '', 'sources.' || source, pipeline, node, '', 'source' FROM i WHERE source IS NOT NULL""",
)
def p11(spark, sf):
    s = lambda name: F.col(name).cast("string")
    inputs = table(spark, sf, "lineitem").select(
        F.concat(F.lit("p"), s("l_linenumber")).alias("pipeline"),
        F.concat(F.lit("c"), s("l_orderkey")).alias("node"),
        F.concat(F.lit("s"), F.col("l_quantity").cast("bigint").cast("string")).alias("schema"),
        F.concat(F.lit("n"), s("l_partkey"), F.when(F.col("l_tax") > 0.04, "__default").otherwise("")).alias("table"),
        F.when(F.col("l_returnflag") == "N", F.col("l_linestatus")).alias("source"),
    )
    outputs = table(spark, sf, "part").select(
        F.concat(F.lit("p"), s("p_size")).alias("pipeline"),
        F.concat(F.lit("n"), s("p_partkey")).alias("node"),
        F.concat(F.lit("s"), s("p_size")).alias("schema"),
        F.when(F.col("p_type") == "ECONOMY", "extra").otherwise("default").alias("output"),
    )
    return cat.lineage(inputs, outputs)
