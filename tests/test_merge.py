import random
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import rows
from millrace.operators import merge as m
from millrace.operators.backfill import PromoteError, diff, key_overlap, promote, staging_name
from millrace.operators.changes import change_rows, repeated
from millrace.operators.ordering import latest_per_key, numbered
from millrace.operators.schema import schema_diff, schema_drifted
from millrace.operators.writes import append_rows, clustered


def frame(spark, data, schema="k string, v bigint"):
    return spark.createDataFrame(data, schema)


def expected_merge(target, source):
    """Row by row: NULL keys never match, a matched key takes the source's value."""
    new = {k: v for k, v in source if k is not None}
    seen = {k for k, _ in target if k is not None}
    kept = [(k, new.get(k, v)) if k is not None else (k, v) for k, v in target]
    return kept + [(k, v) for k, v in source if k is None or k not in seen]


def sort(data):
    return sorted(data, key=lambda r: [(v is not None, str(type(v)), v) for v in r])


keys = st.one_of(st.none(), st.integers(0, 12).map(str))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    target=st.lists(st.tuples(keys, st.integers(0, 9)), max_size=15),
    source=st.lists(st.tuples(keys, st.integers(10, 19)), max_size=15, unique_by=lambda r: r[0] if r[0] is not None else r),
)
def test_merge_equals_row_by_row(spark, target, source):
    t, s = frame(spark, target).coalesce(1), frame(spark, source).coalesce(1)
    assert rows(m.merge_upsert(t, s, ["k"])) == sort(expected_merge(target, source))
    assert rows(m.bounded_merge(t, s, ["k"])) == sort(expected_merge(target, source))


def test_bounded_merge_with_many_values_uses_the_range(spark):
    target = spark.range(0, 1000).select(F.col("id").alias("k"), F.lit(0).alias("v"))
    source = spark.range(500, 1500).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    out = m.bounded_merge(target, source, ["k"])
    assert rows(out.groupBy("v").agg(F.count(F.lit(1)).alias("n"))) == [(0, 500), (1, 1000)]
    few = source.where("k < 600")
    assert "IN" in str(m.column_bound(few, "k")._jc.toString()).upper()


@pytest.mark.parametrize("bad", [float("nan"), float("inf")])
def test_no_bound_from_values_without_a_literal(spark, bad):
    source = frame(spark, [(bad, 1), (1.0, 2)], "k double, v bigint")
    assert m.column_bound(source, "k") is None
    target = frame(spark, [(bad, 0), (2.0, 0)], "k double, v bigint")
    assert m.bounded_merge(target, source, ["k"]).where("v = 1").count() == 1  # NaN matches NaN


def test_bounds_survive_quotes_and_backslashes(spark):
    names = ["it's", "back\\slash", 'dou"ble', "ünï", ""]
    target = frame(spark, [(n, 0) for n in names + ["other"]])
    source = frame(spark, [(n, 1) for n in names])
    assert rows(m.bounded_merge(target, source, ["k"])) == sort([(n, 1) for n in names] + [("other", 0)])


def test_bound_columns():
    assert m.bound_columns(list("abcde")) == list("abcd")
    assert m.bound_columns(["a", "b"], cluster_by=["b", "z"], bound_by=["d", "b"]) == ["b", "d"]


def test_aggregate_rules(spark):
    schema = "k string, n bigint, lo bigint, hi bigint, total decimal(10,2), raw bigint, last string"
    target = frame(spark, [("A", 2, 5, 5, Decimal(1), 10, "x"), ("N", None, None, None, None, 0, "x")], schema)
    source = frame(spark, [("A", 1, 3, 4, Decimal(2), 5, "y"), ("N", 1, 7, 7, Decimal(7), 1, "y"), ("C", 1, 1, 1, Decimal(1), 1, "z")], schema)
    rules = {"n": "additive", "lo": "min", "hi": "max", "total": "additive", "raw": "target.raw - source.raw"}
    out = m.merge_upsert(target, source, ["k"], rules)
    assert out.schema["total"].dataType.simpleString() == "decimal(10,2)"
    assert rows(out, "k", "n", "lo", "hi", "raw", "last") == [
        ("A", 3, 3, 5, 5, "y"), ("C", 1, 1, 1, 1, "z"), ("N", None, 7, 7, -1, "y"),
    ]


def test_evolution_adds_columns_and_refuses_type_changes(spark):
    target = frame(spark, [("a.com", 1), ("b.com", 2)])
    source = frame(spark, [("a.com", 5, 9), ("c.com", 6, 8)], "k string, v bigint, scrolls bigint")
    out = m.merge_upsert(target, source, ["k"])
    assert rows(out) == [("a.com", 5, 9), ("b.com", 2, None), ("c.com", 6, 8)]
    narrow = m.merge_upsert(out, frame(spark, [("b.com", 7)]), ["k"])
    assert rows(narrow)[1] == ("b.com", 7, None)
    with pytest.raises(TypeError):
        m.merge_upsert(target, frame(spark, [("a", "x")], "k string, v string"), ["k"])
    with pytest.raises(TypeError):
        append_rows(target, frame(spark, [("a", "x")], "k string, v string"))


def test_duplicate_keys_only_matter_when_they_match(spark):
    target = frame(spark, [("A", 1)])
    new = frame(spark, [("B", 1), ("B", 2), (None, 1), (None, 2)])
    m.require_single_match(target, new, ["k"])
    assert m.merge_upsert(target, new, ["k"]).count() == 5
    with pytest.raises(m.MergeError):
        m.require_single_match(target, frame(spark, [("A", 1), ("A", 2)]), ["k"])


def test_one_key_may_fill_the_target(spark):
    target = spark.range(20000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.lit(0).alias("v"))
    source = frame(spark, [("hot", 7), ("cold", 8)], "k string, v int")
    out = m.merge_upsert(target, source, ["k"])
    assert rows(out.groupBy("v").agg(F.count(F.lit(1)).alias("n"))) == [(0, 13333), (7, 6667), (8, 1)]


def test_schema_shapes(spark):
    a, b = frame(spark, []).schema, frame(spark, [], "v bigint, k string").schema
    assert schema_drifted(a, b) and not schema_drifted(a, frame(spark, []).schema)
    assert schema_diff(a, frame(spark, [], "k string, v int, n date").schema) == ["~ v bigint -> int", "+ n date"]


def test_change_rows_cover_duplicates_and_nulls(spark):
    random.seed(1)
    pick = lambda: (random.choice([None, "a", "b", "c", "d"]), random.randint(0, 3))
    for _ in range(3):
        before, after = [pick() for _ in range(12)], [pick() for _ in range(12)]
        out = rows(change_rows(frame(spark, before).coalesce(1), frame(spark, after).coalesce(1), ["k"]))
        added, removed = list(after), list(before)
        for row in list(added):
            if row in removed:
                removed.remove(row)
                added.remove(row)
        has_new, has_old = {k for k, _ in added if k}, {k for k, _ in removed if k}
        want = [("update_postimage" if k in has_old else "insert", k, v) for k, v in added]
        want += [("update_preimage" if k in has_new else "delete", k, v) for k, v in removed]
        assert out == sort(want)


def test_many_copies_of_a_row(spark):
    df = frame(spark, [("a", 25_001), ("b", 1), ("c", 10_000)], "k string, n bigint")
    out = repeated(df, "n").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert rows(out) == [("a", 25_001), ("b", 1), ("c", 10_000)]


def test_one_value_spreads_over_several_files(spark):
    df = spark.range(0, 8000, 1, 8).select(F.lit(1).alias("k"))
    parts = clustered(df, ["k"], files=8).select(F.spark_partition_id().alias("p")).groupBy("p").count()
    assert parts.count() >= 6 and parts.agg(F.max("count")).first()[0] <= 3000


def test_numbering_spans_partitions(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, "big").otherwise("small").alias("g"), (F.col("id") % 7).alias("s"), "id")
    out = numbered(df, ["g"], [F.desc("s"), F.asc("id")])
    from pyspark.sql import Window

    plain = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("s"), F.asc("id")))
    assert out.withColumn("want", plain).where("rank <> want").count() == 0 and out.count() == 5000


def test_latest_per_key(spark):
    df = frame(spark, [("a", 1), ("a", 3), ("a", 2), (None, 1), (None, 5)])
    assert rows(latest_per_key(df, ["k"], ["v"])) == [(None, 5), ("a", 3)]


def test_promote_rules(spark):
    target, staging = frame(spark, [("1", 10), ("2", 20)]), frame(spark, [("2", 99), ("3", 30)])
    assert rows(promote(staging, target, "merge", ["k"])) == [("1", 10), ("2", 99), ("3", 30)]
    assert promote(staging, target, "append", allow_duplicates=True).count() == 4
    assert promote(staging, target, "append", force_dedup="k").count() == 3
    assert rows(promote(staging, None, "append")) == rows(staging)
    for mode, options in (("append", {}), ("replace", {}), ("merge", {"keys": ["k"], "update": {"v": "additive"}})):
        with pytest.raises(PromoteError):
            promote(staging, target, mode, **options)
    counters = promote(staging, target, "merge", ["k"], {"v": "additive"}, replace_counters=True)
    assert rows(counters) == [("1", 10), ("2", 99), ("3", 30)]


def test_diff_and_overlap(spark):
    target, staging = frame(spark, [("1", 10), ("2", 20), ("2", 21)]), frame(spark, [("2", 99), ("3", 30), (None, 1)])
    overlap = key_overlap(staging, target, ["k"]).first()
    assert (overlap["matching"], overlap["new"]) == (1, 2)
    with pytest.raises(ValueError):
        key_overlap(staging, target, ["nope"])
    row = diff(staging, target).first()
    assert (row["staging_rows"], row["target_rows"], row["schema_equal"], row["schema_diff"]) == (3, 3, True, "")
    assert diff(staging, None).first()["target_rows"] == -1
    assert staging_name("days", "r1") == "days__backfill__r1"
