"""Percentiles by ranges, sweeps over ranges, and sketches."""

import bisect
import math
import random

from pyspark.sql import functions as F

from millrace.functions.ranges import last_start
from millrace.operators.ordering import exact_percentiles
from millrace.operators.profile import column_profile
from millrace.operators.sketches import audience, audience_over, folded_profile, how_many, in_both, in_first_only

SHARES = {"least": 0.0, "p1": 0.01, "p50": 0.5, "p95": 0.95, "most": 1.0}


def test_percentiles_equal_a_sort(spark):
    rng = random.Random(1)
    data = [(rng.choice(["a", "b", None]), rng.choice([rng.random(), 7.0, None]), rng.gauss(0, 1)) for _ in range(3000)]
    data += [("one", 1.0, None), ("none", None, None)]
    df = spark.createDataFrame(data, "g string, x double, y double").repartition(6)
    got = {(r.g, r.column, r.share): r.value for r in exact_percentiles(df, ["x", "y"], SHARES, ["g"]).collect()}
    want = {}
    for g in {d[0] for d in data}:
        for k, column in enumerate("xy"):
            values = sorted(d[1 + k] for d in data if d[0] == g and d[1 + k] is not None)
            want |= {(g, column, n): values[max(math.ceil(q * len(values) - 1e-9), 1) - 1] for n, q in SHARES.items() if values}
    assert got == want


def test_percentiles_of_nothing_and_of_one_hot_value(spark):
    empty = spark.createDataFrame([], "x double")
    assert exact_percentiles(empty, ["x"], SHARES).collect() == []
    hot = spark.range(100_000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id").cast("double")).alias("x"))
    values = sorted(5.0 if i % 3 == 0 else float(i) for i in range(100_000))
    got = {r.share: r.value for r in exact_percentiles(hot, ["x"], SHARES).collect()}
    assert got == {n: values[max(math.ceil(q * len(values) - 1e-9), 1) - 1] for n, q in SHARES.items()}


def test_last_start_equals_a_search(spark):
    rng = random.Random(2)
    starts = [(rng.choice("kl"), s, f"s{i}", rng.randint(0, 900)) for i, s in enumerate(sorted(rng.sample(range(1000), 60)))]
    points = [(i, rng.choice("klm"), rng.choice([rng.randint(-5, 1005), 500, None])) for i in range(4000)]
    p = spark.createDataFrame(points, "id long, key string, at long").repartition(7)
    s = spark.createDataFrame(starts, "key string, start long, name string, reach long")
    out = last_start(p, "at", s, "start", {"name": (F.last, "name"), "reach": (F.max, "reach")}, ["key"])
    assert out.columns == ["id", "key", "at", "name", "reach"]
    got = {r.id: (r.name, r.reach) for r in out.collect()}
    for i, key, at in points:
        own = sorted(x for x in starts if x[0] == key)
        k = 0 if at is None else bisect.bisect_right([x[1] for x in own], at)
        assert got[i] == ((own[k - 1][2], max(x[3] for x in own[:k])) if k else (None, None))


def test_points_of_one_place_fill_several_partitions(spark):
    p = spark.range(20_000).select("id", F.lit(10).cast("long").alias("at")).repartition(8)
    s = spark.createDataFrame([(3, "x")], "start long, name string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = last_start(p, "at", s, "start", {"name": (F.last, "name")})
        assert out.where("name = 'x'").count() == 20_000
        plan = out._jdf.queryExecution().toString()
        assert "FileScan parquet" in plan
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert last_start(p, "at", s.limit(0), "start", {"name": (F.last, "name")}).where("name IS NULL").count() == 20_000


def test_folded_profiles_equal_the_whole(spark):
    df = spark.range(5000).select((F.col("id") % 700).alias("k"), (F.col("id") / 7).alias("x"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("t"), (F.col("id") % 90).cast("string"))).alias("t"), F.lit(None).cast("int").alias("n"))
    parts = [df.where(f"x * 7 % 3 = {i}") for i in range(3)] + [df.limit(0)]
    sketches = parts[0].sparkSession.createDataFrame([], column_profile(df, sketches=True).schema)
    for part in parts:
        sketches = sketches.unionByName(column_profile(part, sketches=True))
    got = {r.column_name: r for r in folded_profile(sketches).collect()}
    whole = {r.column_name: r for r in column_profile(parts[0].unionByName(parts[1]).unionByName(parts[2])).collect()}
    for name, w in whole.items():
        g = got[name]
        assert (g.row_count, g.null_count, g.min_value, g.max_value, g.column_type) == (w.row_count, w.null_count, w.min_value, w.max_value, w.column_type)
    assert abs(got["k"].approx_count_distinct - 700) <= 35 and got["n"].approx_count_distinct == 0
    assert abs(got["x"].approx_p50 - 357) <= 0.02 * 714 and abs(got["x"].approx_p95 - 678) <= 0.02 * 714
    assert got["t"].approx_p50 is None and got["n"].approx_p95 is None


def test_audiences_are_merged_and_intersected(spark):
    visits = spark.range(20_000).select((F.col("id") % 20).alias("day"), (F.col("id") % 9001).alias("who"), (F.col("id") % 3 == 0).alias("seen"), (F.col("id") % 6 == 0).alias("clicked"))
    daily = audience(visits, ["day"], "who", {"all": F.lit(True), "seen": F.col("seen"), "clicked": F.col("clicked"), "none": F.lit(False)})
    assert daily.count() == 20
    week = audience_over(daily, [(F.col("day") >= 10).alias("late")], ["all", "seen", "clicked", "none"])
    got = {r.late: r for r in week.select("late", how_many("all").alias("a"), in_both("seen", "clicked").alias("b"), in_first_only("seen", "clicked").alias("o"), how_many("none").alias("z")).collect()}
    for late in (False, True):
        own = [(i % 9001, i % 3 == 0, i % 6 == 0) for i in range(20_000) if (i % 20 >= 10) == late]
        everyone, seen, clicked = {w for w, _, _ in own}, {w for w, s, _ in own if s}, {w for w, _, c in own if c}
        assert abs(got[late].a - len(everyone)) <= 3 / 64 * len(everyone) and got[late].z == 0
        assert abs(got[late].b - len(seen & clicked)) <= 3 / 64 * len(everyone) and abs(got[late].o - len(seen - clicked)) <= 3 / 64 * len(everyone)


