"""Web analytics: A1 to A8, and ST3."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.ordering import exact_percentiles
from millrace.plans import web as a
from millrace.plans.recipes import top_groups
from millrace.queries._registry import query, table
from millrace.session import scratch_path
from millrace.streaming.ingest import file_stream, run_available
from millrace.streaming.sessions import stream_sessions

# An access log made of the events: fields are URL-encoded twice, as a tracker and a log writer do.
TWICE = "url_encode(replace(url_encode({}), '+', '%20'))"
QUERY_STRING = f"""concat('uid=', {TWICE.format("concat('u ', CAST(user_id AS STRING))")}, '&e=', {TWICE.format("event_type")},
  '&sid=', {TWICE.format("concat('s/', CAST(user_id AS STRING), '-', date_format(ts, 'dd'))")}, '&p=', {TWICE.format("concat('/p+', props)")},
  '&t=', IF(event_type = 'error', 'soon', CAST(unix_millis(CAST(ts AS TIMESTAMP)) AS STRING)), '&ref=', IF(value > 100, {TWICE.format("'https://x.org/?a=1&b=2'")}, ''),
  '&e=ignored')"""


def access_log(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("given_events")
    return spark.sql(
        f"""SELECT event_id, IF(event_type = 'signup', '/index.html', '/t.gif') AS stem,
            CASE WHEN value < 1 THEN '-' WHEN value < 2 THEN '' WHEN value < 3 THEN NULL ELSE {QUERY_STRING} END AS query FROM given_events"""
    )


BEACONS = """SELECT event_type AS event, 's/' || user_id || '-' || strftime(ts, '%d') AS session_id, 'u ' || user_id AS visitor_id,
  '/p+' || props AS path, CASE WHEN value > 100 THEN 'https://x.org/?a=1&b=2' ELSE '' END AS referrer,
  CASE WHEN event_type <> 'error' THEN epoch_us(ts) // 1000 END AS event_ms, CASE WHEN event_type <> 'error' THEN CAST(ts AS DATE) END AS day
  FROM events WHERE event_type <> 'signup' AND value >= 3"""


@query("a1_beacons", BEACONS)
def a1(spark, sf):
    return a.beacons(access_log(spark, sf)).withColumn("event_ms", F.unix_millis("event_ts")).drop("event_ts")


@query(
    "a2_daily_rollup",
    f"""SELECT day, count(DISTINCT session_id) AS sessions, count(DISTINCT visitor_id) AS visitors, count(*) AS events,
               count(DISTINCT CASE WHEN referrer <> '' THEN session_id END) AS referred_sessions FROM ({BEACONS}) b GROUP BY day""",
)
def a2(spark, sf):
    return a.daily_rollup(a.beacons(access_log(spark, sf)))


@query(
    "a3_top_pages_and_referrers",
    f"""(SELECT 'page' AS kind, path AS value, count(*) AS n FROM ({BEACONS}) b GROUP BY path ORDER BY n DESC, path LIMIT 10)
        UNION ALL (SELECT 'referrer', referrer, count(*) AS n FROM ({BEACONS}) b WHERE referrer <> '' GROUP BY referrer ORDER BY n DESC LIMIT 10)""",
)
def a3(spark, sf):
    events = a.beacons(access_log(spark, sf))
    pages = top_groups(events, "path", 10).select(F.lit("page").alias("kind"), F.col("path").alias("value"), "n")
    referrers = top_groups(events.where("referrer <> ''"), "referrer", 10)
    return pages.unionByName(referrers.select(F.lit("referrer").alias("kind"), F.col("referrer").alias("value"), "n"))


# Tracker events: an element per property value, a session per user and day.
TRACK = """SELECT CAST(user_id AS {s}) || '/' || CAST(day(ts) AS {s}) AS session_id, props AS element,
  CASE event_type WHEN 'view' THEN 'view' WHEN 'purchase' THEN 'displayed' WHEN 'click' THEN 'click' ELSE event_type END AS kind FROM events"""


def track(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("given_events")
    return spark.sql(TRACK.replace("{s}", "STRING").replace("FROM events", "FROM given_events"))


@query(
    "a4_element_rates",
    f"""WITH x AS (SELECT session_id, element, max(CASE WHEN kind = 'view' THEN 1 ELSE 0 END) AS v, max(CASE WHEN kind = 'displayed' THEN 1 ELSE 0 END) AS d,
                     max(CASE WHEN kind = 'click' THEN 1 ELSE 0 END) AS c FROM ({TRACK.replace("{s}", "VARCHAR")}) t GROUP BY 1, 2)
        SELECT element, CAST(sum(greatest(v, d, c)) AS BIGINT) AS views, CAST(sum(greatest(d, c)) AS BIGINT) AS displays,
               CAST(sum(c) AS BIGINT) AS clicks, sum(c) / nullif(sum(greatest(v, d, c)), 0) AS ctr FROM x GROUP BY element""",
)
def a4(spark, sf):
    return a.element_rates(track(spark, sf), "session_id", "element", "kind")


@query(
    "a4_funnel",
    f"""SELECT count(*) AS sessions, count(*) FILTER (saw) AS saw, count(*) FILTER (clicked) AS clicked FROM (
          SELECT session_id, bool_or(kind IN ('view', 'displayed', 'click')) AS saw, bool_or(kind = 'click') AS clicked
          FROM ({TRACK.replace("{s}", "VARCHAR")}) t GROUP BY 1) x""",
)
def a4_funnel(spark, sf):
    return a.funnel(track(spark, sf), "session_id", "kind")


def sessions_sql(gap_seconds: int) -> str:
    return f"""WITH g AS (SELECT user_id, epoch_us(ts) AS us, value, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= {gap_seconds}000000
                 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
       s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS sid FROM g)
       SELECT user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS events,
              CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM s GROUP BY user_id, sid"""


def money():
    return F.col("value").cast("decimal(18,2)")


@query("a5_sessions", sessions_sql(30 * 60))
def a5(spark, sf):
    found = a.sessions(table(spark, sf, "events"), "user_id", "ts", money())
    return found.withColumn("value", F.col("value").cast("double"))


@query("a5_sessions_long_gap", sessions_sql(12 * 3600))
def a5_long(spark, sf):
    found = a.sessions(table(spark, sf, "events"), "user_id", "ts", money(), gap_seconds=12 * 3600)
    return found.withColumn("value", F.col("value").cast("double"))


@query("st3_streaming_sessions", sessions_sql(30 * 60))
def st3(spark, sf):
    landing, out, state = (scratch_path(spark, n) for n in ("landing", "sessions", "state"))
    events = table(spark, sf, "events").select("user_id", "ts", "value")
    events.repartitionByRange(4, "ts").write.parquet(landing)
    # A last event far ahead moves the watermark past every real session's end.
    flush = spark.range(1).select(
        F.lit(-1).cast("bigint").alias("user_id"), F.lit("2030-01-01").cast("timestamp_ntz").alias("ts"), F.lit(0.0).alias("value")
    )
    stream = lambda: stream_sessions(file_stream(spark, landing, events.schema), "user_id", "ts", money())
    run_available(stream(), state, path=out)
    flush.write.mode("append").parquet(landing)
    run_available(stream(), state, path=out)
    return spark.read.parquet(out).where("user_id >= 0").withColumn("value", F.col("value").cast("double"))


# Addresses by arithmetic; ranges out of the nations: one wide block of addresses for each.
ADDRESS = "user_id * 7000001 + event_id * 131"
AGENT = """CASE event_type WHEN 'error' THEN 'Googlebot/2.1' WHEN 'signup' THEN NULL ELSE 'Mozilla/5.0' END"""
RANGES = """SELECT n_nationkey * 40000000 AS lo, n_nationkey * 40000000 + 25000000 AS hi,
  CASE WHEN n_nationkey < 10 THEN 'N' || CAST(n_nationkey AS {s}) ELSE 'M' || CAST(n_nationkey - 10 AS {s}) END AS country FROM nation"""


def hits(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("given_events")
    return spark.sql(f"SELECT event_id, CAST({ADDRESS} AS BIGINT) AS address, {AGENT} AS agent FROM given_events")


def ranges(spark, sf):
    table(spark, sf, "nation").createOrReplaceTempView("given_nation")
    return spark.sql(RANGES.replace("{s}", "STRING").replace("FROM nation", "FROM given_nation"))


@query(
    "a6_without_bots",
    f"""WITH r AS ({RANGES.replace("{s}", "VARCHAR")}), h AS (SELECT event_id, {ADDRESS} AS address, {AGENT} AS agent FROM events)
        SELECT event_id, address FROM h WHERE coalesce(NOT regexp_matches(lower(agent), 'bot|crawl|spider'), true)
          AND NOT EXISTS (SELECT 1 FROM r WHERE address BETWEEN lo AND hi)""",
)
def a6(spark, sf):
    kept = a.without_bots(hits(spark, sf), "agent", "address", "(?i)bot|crawl|spider", ranges(spark, sf), "lo", "hi")
    return kept.select("event_id", "address")


@query(
    "a7_countries",
    f"""WITH r AS ({RANGES.replace("{s}", "VARCHAR")}), h AS (SELECT event_id, {ADDRESS} AS address FROM events)
        SELECT event_id, country FROM h LEFT JOIN r ON address BETWEEN lo AND hi""",
)
def a7(spark, sf):
    found = a.with_country(hits(spark, sf), "address", ranges(spark, sf), "lo", "hi", "country")
    return found.select("event_id", "country")


@query(
    "a7_hot_address",
    f"""WITH r AS ({RANGES.replace("{s}", "VARCHAR")}), h AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 41000000 ELSE {ADDRESS} END AS address FROM events)
        SELECT coalesce(country, '-') AS country, count(*) AS hits, CAST(sum(event_id) AS BIGINT) AS ids FROM h LEFT JOIN r ON address BETWEEN lo AND hi GROUP BY 1""",
)
def a7_hot(spark, sf):
    """A third of the hits come from one address; addresses are as wide as those of version 6."""
    wide = F.lit("1000000000000000000000").cast("decimal(22,0)")
    address = F.when(F.col("event_id") % 3 == 0, 41000000).otherwise(F.col("address"))
    visits = hits(spark, sf).withColumn("address", (address.cast("decimal(14,0)") * wide).cast("decimal(38,0)"))
    places = ranges(spark, sf)
    for end in ("lo", "hi"):
        places = places.withColumn(end, (F.col(end).cast("decimal(14,0)") * wide).cast("decimal(38,0)"))
    found = a.with_country(visits, "address", places, "lo", "hi", "country")
    return found.groupBy(F.coalesce("country", F.lit("-")).alias("country")).agg(F.count(F.lit(1)).alias("hits"), F.sum("event_id").alias("ids"))


AUDIENCE = """SELECT {p} AS period, count(DISTINCT user_id) AS visitors, count(DISTINCT user_id) FILTER (event_type = 'view') AS seen,
  count(DISTINCT user_id) FILTER (event_type = 'click') AS clicked FROM events GROUP BY 1"""
BOTH = """SELECT period, count(*) AS clicked_of_seen FROM (SELECT DISTINCT {p} AS period, user_id FROM events WHERE event_type = 'view'
  INTERSECT SELECT DISTINCT {p}, user_id FROM events WHERE event_type = 'click') x GROUP BY 1"""


@query(
    "a4_audience_from_days",
    f"""SELECT period, true AS visitors, true AS seen, true AS clicked, true AS clicked_of_seen
        FROM ({AUDIENCE.replace("{p}", "CAST(floor((day(ts) - 1) / 7) AS BIGINT)")}) a JOIN ({BOTH.replace("{p}", "CAST(floor((day(ts) - 1) / 7) AS BIGINT)")}) b USING (period)""",
)
def a4_audience(spark, sf):
    """Weekly visitors, and those who clicked of those who saw, from the days' sketches; each figure is within three
    standard errors (of 4,096 entries) of the exact one."""
    events = table(spark, sf, "events")
    week = F.floor((F.day("day") - 1) / 7)
    told = a.audience_report(a.daily_audience(events, F.to_date("ts").alias("day"), "user_id", "event_type"), week)
    person = lambda kind: F.when(F.col("event_type") == kind, F.col("user_id"))
    weeks = events.withColumn("period", F.floor((F.day("ts") - 1) / 7))
    exact = weeks.groupBy("period").agg(
        F.count_distinct("user_id").alias("x_visitors"), F.count_distinct(person("view")).alias("x_seen"), F.count_distinct(person("click")).alias("x_clicked")
    )
    flags = weeks.groupBy("period", "user_id").agg(F.bool_or(F.col("event_type") == "view").alias("v"), F.bool_or(F.col("event_type") == "click").alias("c"))
    both = flags.where("v AND c").groupBy("period").agg(F.count(F.lit(1)).alias("x_clicked_of_seen"))
    met = told.join(exact, "period").join(both, "period")
    close = [(F.abs(F.col(n) - F.col(f"x_{n}")) <= 3 / 64 * F.col("x_visitors")).alias(n) for n in ("visitors", "seen", "clicked", "clicked_of_seen")]
    return met.select("period", *close)


FACTS = """SELECT user_id, day(ts) AS d, CAST(min(ts) AS DATE) AS started_on, epoch_ms(date_trunc('second', max(ts))) // 1000
    - epoch_ms(date_trunc('second', min(ts))) // 1000 AS duration_s, max(value) FILTER (event_type = 'view') AS max_scroll,
  max(value) FILTER (event_type = 'click') AS lcp, max(value) FILTER (event_type = 'purchase') AS cls,
  count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1, 2"""


def facts(spark, sf):
    kinds = F.create_map(*[F.lit(x) for x in ("view", "scroll", "click", "lcp", "purchase", "cls", "error", "error")])
    events = table(spark, sf, "events").select(
        F.struct("user_id", F.day("ts").alias("d")).alias("session"), "ts", kinds[F.col("event_type")].alias("kind"), "value"
    )
    return a.session_facts(events, "session", "ts", "kind", F.col("value"))


@query("a8_session_facts", f"SELECT user_id, CAST(d AS INTEGER) AS d, started_on, CAST(duration_s AS BIGINT) AS duration_s, max_scroll, lcp, cls, errors FROM ({FACTS}) f")
def a8(spark, sf):
    return facts(spark, sf).select("session.*", F.to_date("started_at").alias("started_on"), "duration_s", "max_scroll", "lcp", "cls", "errors")


@query(
    "a8_vitals",
    f"""SELECT quantile_disc(lcp, 0.5) AS lcp_p50, quantile_disc(lcp, 0.75) AS lcp_p75, quantile_disc(cls, 0.5) AS cls_p50,
               quantile_disc(cls, 0.75) AS cls_p75 FROM ({FACTS}) f""",
)
def a8_vitals(spark, sf):
    return a.vitals(facts(spark, sf))


@query(
    "a8_percentiles_by_day",
    """SELECT CAST(dd AS INTEGER) AS d, 'value' AS "column", share, CASE share WHEN 'p1' THEN p1 WHEN 'p75' THEN p75 ELSE p100 END AS value
       FROM (SELECT day(ts) AS dd, quantile_disc(value + event_id * 1e-7, 0.01) AS p1,
               quantile_disc(value + event_id * 1e-7, 0.75) AS p75, max(value + event_id * 1e-7) AS p100 FROM events GROUP BY 1) q,
            (VALUES ('p1'), ('p75'), ('p100')) v(share)""",
)
def a8_by_day(spark, sf):
    """Percentiles of values that are all different, by day."""
    events = table(spark, sf, "events").select(F.day("ts").alias("d"), (F.col("value") + F.col("event_id") * 1e-7).alias("value"))
    return exact_percentiles(events, ["value"], {"p1": 0.01, "p75": 0.75, "p100": 1.0}, ["d"])
