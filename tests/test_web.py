import random
from urllib.parse import parse_qs, quote, unquote

from pyspark.sql import functions as F

from helpers import rows
from millrace.functions import ranges
from millrace.functions.ranges import range_join
from millrace.functions.scalars import ipv4_number
from millrace.plans import web as a
from millrace.session import scratch_path
from millrace.streaming.ingest import file_stream, run_available
from millrace.streaming.sessions import stream_sessions
from millrace.streaming.upsert import merge_batches
from millrace.tables.store import VersionedTable


def test_beacons_decode_as_a_browser_encoded(spark):
    values = ["/a b?x=1&y=2", "50% off", "ü+ö", "plain", "a%2Fb", "100%", "q=w=e"]
    lines = [f"e=view&sid=s{i}&uid=u&p={quote(quote(v, safe=''), safe='')}&t=1714000000000&ref=&e=late" for i, v in enumerate(values)]
    lines += ["e=&e=view&sid=x", "sid=only", "e&sid=x", "-", "", "e=click&p=a+b%2Bc&t=soon&sid=z", "e=ok&p=broken%zz%2Fpart&sid=w"]
    df = spark.createDataFrame([("/t.gif", q) for q in lines] + [("/x", lines[0]), ("/t.gif", None)], "stem string, query string")

    def parsed(q):
        return {k: unquote(v[0]) for k, v in parse_qs(q, keep_blank_values=True).items()}

    want = [p for p in map(parsed, lines) if p.get("e")]
    got = a.beacons(df)
    assert rows(got, "session_id", "event", "path", "referrer") == rows(
        spark.createDataFrame([(p.get("sid"), p["e"], p.get("p"), p.get("ref")) for p in want], "s string, e string, p string, r string")
    )
    assert got.where("event_ts IS NULL").count() == 2


def brute_sessions(events, gap):
    out = []
    for user in sorted({u for u, _ in events}):
        times = sorted(t for u, t in events if u == user)
        start = last = times[0]
        n = 1
        for t in times[1:]:
            if t - last > gap:
                out.append((user, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((user, start, last, n))
    return sorted(out)


def event_frame(spark, events):
    return spark.createDataFrame(events, "user_id long, s long").select("user_id", F.timestamp_seconds("s").alias("ts"))


def test_sessions_against_brute_force(spark):
    random.seed(7)
    gap = 1800
    events = [(random.choice([1, 1, 1, 2, 3]), random.randrange(0, 200_000, 60)) for _ in range(600)]
    events += [(9, 0), (9, 1800), (9, 3600), (9, 5401), (8, 1799), (8, 3599)]
    want = brute_sessions(events, gap)
    got = rows(a.sessions(event_frame(spark, events), "user_id", "ts"), "user_id", "start_us", "end_us", "events")
    assert [(u, s // 10**6, e // 10**6, n) for u, s, e, n in got] == want
    windows = event_frame(spark, events).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).count()
    assert windows.count() == len(want)


def test_streamed_sessions_equal_batch_and_drop_late_events(spark):
    landing, out, state = (scratch_path(spark, n) for n in ("land", "out", "state"))
    schema = "user_id long, ts timestamp"
    stream = lambda: stream_sessions(file_stream(spark, landing, schema), "user_id", "ts", late="10 minutes")
    for batch in ([(1, 0), (1, 600), (2, 100)], [(1, 50_000)], [(2, 200), (1, 50_600)], [(3, 900_000)]):
        event_frame(spark, batch).coalesce(1).write.mode("append").parquet(landing)
        run_available(stream(), state, path=out)
    got = rows(spark.read.parquet(out), "user_id", "start_us", "events")
    assert got == [(1, 0, 2), (1, 50_000 * 10**6, 2), (2, 100 * 10**6, 1)]


def test_replayed_batches_do_not_count_twice(spark):
    table = VersionedTable(spark, scratch_path(spark, "t"))
    write = merge_batches(table, "job", ["k"], {"n": "additive"})
    batch = spark.createDataFrame([("A", 2), ("B", 1)], "k string, n long")
    for batch_id in (0, 1, 1, 0):
        write(batch, batch_id)
    assert rows(table.read()) == [("A", 4), ("B", 2)] and table.version() == 1


def test_range_join_against_brute_force(spark):
    random.seed(3)
    points = [(i, random.randrange(0, 5000)) for i in range(400)] + [(i, 777) for i in range(400, 800)]
    spans = [(j, lo, lo + random.choice([0, 5, 900])) for j, lo in enumerate(random.sample(range(5000), 30))]
    want = sorted((i, j) for i, p in points for j, lo, hi in spans if lo <= p <= hi)
    p = spark.createDataFrame(points, "i long, p long")
    r = spark.createDataFrame(spans + [(99, 10, 5)], "j long, lo long, hi long")
    for width, salts in ((64, 1), (1000, 4)):
        got = range_join(p, "p", r, "lo", "hi", width, salts=salts)
        assert rows(got, "i", "j") == want
        assert "NestedLoop" not in got._jdf.queryExecution().toString()
        hit = {i for i, _ in want}
        assert range_join(p, "p", r, "lo", "hi", width, "left_anti", salts=salts).count() == 800 - len(hit)
        assert range_join(p, "p", r, "lo", "hi", width, "left", salts=salts).count() == len(want) + 800 - len(hit)


def test_range_join_of_intervals_of_any_length(spark):
    """Endless intervals cost two buckets each, not one for each width that they cover."""
    random.seed(4)
    points = [(i, random.randrange(-3000, 3000)) for i in range(300)]
    spans = [(j, lo, lo + random.choice([0, 3, 16, 64, 300, 10**12])) for j, lo in enumerate(random.sample(range(-3500, 3500), 60))]
    p, r = spark.createDataFrame(points, "i long, p long"), spark.createDataFrame(spans, "j long, lo long, hi long")
    got = range_join(p, "p", r, "lo", "hi", 4, salts=2)
    assert rows(got, "i", "j") == sorted((i, j) for i, at in points for j, lo, hi in spans if lo <= at <= hi)
    made = spark.range(50).select(F.lit(0).alias("lo"), (F.col("id") * 100_000).alias("hi"))
    assert ranges._buckets(made, F.col("lo"), F.col("hi"), 4, 1, True).count() <= 2 * 50


def test_addresses(spark):
    df = spark.createDataFrame([("1.2.3.4",), ("255.255.255.255",), ("256.1.1.1",), ("1.2.3",), ("x",), (None,)], "a string")
    assert [r[0] for r in df.select(ipv4_number(F.col("a"))).collect()] == [16909060, 4294967295, None, None, None, None]
    hits = spark.createDataFrame([(1, "bot/1", 5), (2, "m", 70000), (3, None, 200000)], "id long, agent string, ip long")
    dc = spark.createDataFrame([(65536, 131071, "DC")], "lo long, hi long, c string")
    assert rows(a.without_bots(hits, "agent", "ip", "(?i)bot", dc, "lo", "hi"), "id") == [(3,)]
    assert rows(a.with_country(hits, "ip", dc, "lo", "hi", "c"), "id", "country") == [(1, None), (2, "DC"), (3, None)]


def test_clicks_imply_views(spark):
    events = spark.createDataFrame([("s1", "b", "click"), ("s1", "b", "click"), ("s2", "b", "view"), ("s3", "b", "displayed"), ("s3", "c", "error")], "s string, el string, kind string")
    assert rows(a.element_rates(events, "s", "el", "kind"))[0][:4] == ("b", 3, 2, 1)
    assert rows(a.funnel(events, "s", "kind")) == [(3, 3, 1)]
