"""Web analytics: beacons out of access logs, rollups, sessions, funnels, bots and countries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.ranges import last_start
from millrace.functions.scalars import epoch_millis, has_query_value, with_query_parameters
from millrace.operators.ordering import exact_percentiles
from millrace.operators.sketches import audience, audience_over, how_many, in_both

# Beacon fields by output column, session timeout.
BEACON_FIELDS = {"event": "e", "session_id": "sid", "visitor_id": "uid", "path": "p", "referrer": "ref"}
SESSION_GAP_SECONDS = 30 * 60


def beacons(logs: DataFrame, stem: str = "stem", query: str = "query", pixel: str = "/t.gif") -> DataFrame:
    """One row per beacon hit with its fields decoded. Hits without an event are dropped."""
    q = F.col(query)
    hits = logs.where((F.col(stem) == pixel) & q.isNotNull() & ~q.isin("", "-")).select(q.alias("_query"))
    hits = hits.where(has_query_value("_query", BEACON_FIELDS["event"]))
    fields = with_query_parameters(hits, "_query", {**BEACON_FIELDS, "_at": "t"})
    at = epoch_millis(F.col("_at"))
    return fields.select(*BEACON_FIELDS, at.alias("event_ts"), F.to_date(at).alias("day"))


def daily_rollup(events: DataFrame) -> DataFrame:
    """Sessions, visitors, events and referred sessions per day.

    Spark counts the distinct values in two steps, by day and value and then by day, so a busy day is
    spread by its sessions and visitors; the events are read and parsed once.
    """
    referred = F.when(F.col("referrer") != "", F.col("session_id"))
    return events.groupBy("day").agg(
        F.count_distinct("session_id").alias("sessions"),
        F.count_distinct("visitor_id").alias("visitors"),
        F.count(F.lit(1)).alias("events"),
        F.count_distinct(referred).alias("referred_sessions"),
    )


def element_rates(events: DataFrame, session: str, element: str, kind: str) -> DataFrame:
    """Views, displays and clicks per element, each counted once per session, and the click-through rate.
    A click implies a display, a display implies a view."""
    seen = {k: F.max((F.col(kind) == k).cast("int")).alias(k) for k in ("view", "displayed", "click")}
    per_session = events.groupBy(session, element).agg(*seen.values())
    displayed = F.greatest("displayed", "click")
    return (
        per_session.groupBy(element)
        .agg(
            F.sum(F.greatest("view", displayed)).alias("views"),
            F.sum(displayed).alias("displays"),
            F.sum("click").alias("clicks"),
        )
        .withColumn("ctr", F.col("clicks") / F.nullif(F.col("views"), F.lit(0)))
    )


def funnel(events: DataFrame, session: str, kind: str) -> DataFrame:
    """Sessions, those that saw an element, and those that clicked one."""
    flags = events.groupBy(session).agg(
        F.bool_or(F.col(kind).isin("view", "displayed", "click")).alias("saw"),
        F.bool_or(F.col(kind) == "click").alias("clicked"),
    )
    return flags.agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if("saw").alias("saw"), F.count_if("clicked").alias("clicked")
    )


def sessions(
    events: DataFrame, user: str, ts: str, value: Column | None = None, gap_seconds: int = SESSION_GAP_SECONDS
) -> DataFrame:
    """Sessions per user, split where the pause exceeds the gap (a pause of exactly the gap stays).

    Events are first reduced to bins as wide as the gap: two events of one bin are never apart by more
    than the gap, so a bin lies within one session. The window then runs over bins, whose number per user
    depends on the time span and not on how many events the user has.
    """
    # Integer microseconds keep the boundary exact.
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = gap_seconds * 1_000_000
    value = F.lit(0.0) if value is None else value
    bins = (
        events.select(F.col(user), micros.alias("_at"), value.alias("_value"))
        .groupBy(user, F.floor(F.col("_at") / gap).alias("_bin"))
        .agg(
            F.min("_at").alias("_first"),
            F.max("_at").alias("_last"),
            F.count(F.lit(1)).alias("_n"),
            F.sum("_value").alias("_sum"),
        )
    )
    order = Window.partitionBy(user).orderBy("_bin")
    pause = F.col("_first") - F.lag("_last").over(order)
    started = bins.withColumn("_new", F.when(pause.isNull() | (pause > gap), 1).otherwise(0))
    numbered = started.withColumn("_session", F.sum("_new").over(order))
    return (
        numbered.groupBy(user, "_session")
        .agg(
            F.min("_first").alias("start_us"),
            F.max("_last").alias("end_us"),
            F.sum("_n").alias("events"),
            F.sum("_sum").alias("value"),
        )
        .drop("_session")
    )


def without_bots(hits: DataFrame, agent: str, address: str, crawler: str, datacenters: DataFrame, low: str, high: str) -> DataFrame:
    """Drop hits whose agent matches the crawler pattern or whose address is in a datacenter range; the ranges may
    overlap. Addresses may be of any type with an order."""
    human = hits.where(~F.coalesce(F.col(agent).rlike(crawler), F.lit(False)))
    ranges = datacenters.select(F.col(low).alias("_from"), F.col(high).alias("_upto")).where("_from <= _upto")
    met = last_start(human, address, ranges, "_from", {"_reach": (F.max, "_upto")})
    return met.where(~F.coalesce(F.col("_reach") >= F.col(f"`{address}`"), F.lit(False))).drop("_reach")


def with_country(hits: DataFrame, address: str, ranges: DataFrame, low: str, high: str, country: str) -> DataFrame:
    """Add the two-letter country of the address and drop the address; unknown addresses get NULL.
    The ranges must not overlap."""
    places = ranges.select(F.col(low).alias("_from"), F.struct(F.col(high).alias("upto"), F.col(country).alias("country")).alias("_place")).where("_from <= _place.upto")
    met = last_start(hits, address, places, "_from", {"_found": (F.last, "_place")})
    inside = F.col("_found.upto") >= F.col(f"`{address}`")
    return met.withColumn("country", F.when(inside, F.col("_found.country"))).drop(address, "_found")


def session_facts(events: DataFrame, session: str, ts: str, kind: str, value: Column) -> DataFrame:
    """Start, duration, deepest scroll, paint and shift figures, and errors per session."""
    at = F.col(ts)

    def of(name: str) -> Column:
        return F.when(F.col(kind) == name, value)

    return events.groupBy(session).agg(
        F.min(at).alias("started_at"),
        (F.unix_seconds(F.max(at).cast("timestamp")) - F.unix_seconds(F.min(at).cast("timestamp"))).alias("duration_s"),
        F.max(of("scroll")).alias("max_scroll"),
        F.max(of("lcp")).alias("lcp"),
        F.max(of("cls")).alias("cls"),
        F.count_if(F.col(kind) == "error").alias("errors"),
    )


def vitals(facts: DataFrame) -> DataFrame:
    """Median and 75th percentile of the paint and shift figures over sessions, exact, in one row. They are selected by
    ranges of values (see `exact_percentiles`), so no task holds all of them."""
    shares = {"p50": 0.5, "p75": 0.75}
    found = exact_percentiles(facts, ["lcp", "cls"], shares)
    return found.agg(*[F.max(F.when((F.col("column") == c) & (F.col("share") == n), F.col("value"))).alias(f"{c}_{n}") for c in ("lcp", "cls") for n in shares])


def daily_audience(events: DataFrame, day: Column, who: str, kind: str) -> DataFrame:
    """Sketches of each day's visitors, of those shown something and of those who clicked: rows to keep, as longer periods
    and funnels are merges of them."""
    sets = {"visitors": F.lit(True), "seen": F.col(kind).isin("view", "displayed"), "clicked": F.col(kind) == "click"}
    return audience(events, [day], who, sets)


def audience_report(daily: DataFrame, period: Column) -> DataFrame:
    """Visitors, those who saw, those who clicked, and those who did both, for each period, from the days' sketches."""
    over = audience_over(daily.withColumn("period", period), ["period"], ["visitors", "seen", "clicked"])
    return over.select("period", how_many("visitors").alias("visitors"), how_many("seen").alias("seen"), how_many("clicked").alias("clicked"), in_both("seen", "clicked").alias("clicked_of_seen"))
