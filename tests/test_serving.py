from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import rows
from millrace.operators.writes import OutputSpec
from millrace.plans import serving as s
from millrace.plans.staged import Chain, Stage, python_transform, run_transform
from millrace.session import scratch_path

NOW = datetime(2026, 4, 27, 12)


def test_templates_bind_values_as_literals(spark):
    spark.range(5).createOrReplaceTempView("numbers")
    got = s.dataset(spark, "SELECT id, {{ who.x-y }} AS w FROM numbers WHERE id >= CAST({{low}} AS INT)", {"low": "3", "who.x-y": "a b"})
    assert rows(got) == [(3, "a b"), (4, "a b")]
    with pytest.raises(KeyError):
        s.bind("SELECT {{missing}}", {})
    for bad in ("x'; DROP", 'a"b', "a\\b", "a\nb"):
        with pytest.raises(ValueError):
            s.bind("SELECT {{v}}", {"v": bad})


def test_time_ranges():
    length = lambda text: s.time_range(text, NOW)
    assert length("now-90m") == (NOW - timedelta(minutes=90), NOW)
    assert length("last_7d") == (NOW - timedelta(days=7), NOW) and length("now-2w") == (NOW - timedelta(weeks=2), NOW)
    for text in ("", None, "now-0d", "yesterday", "now-5y"):
        assert length(text) == (NOW - timedelta(days=30), NOW)
    controls = [s.Control("r", "time_range", "now-1h"), s.Control("c", options=["de", "fr"]), s.Control("d", default="x", options=["y"])]
    params = s.parameters(controls, {"d": "z"}, NOW)
    assert params == {"r.start": "2026-04-27T11:00:00Z", "r.end": "2026-04-27T12:00:00Z", "c": "de", "d": "z"}


def test_shapes(spark):
    data = [(c, v) for c, v in zip("abcdefghij", ["1", "2", "3", "4", "5", "6", "7", "8", "-1", "x"])]
    df = spark.createDataFrame(data, "name string, v string")
    assert rows(s.pie(df, "name", "v")) == [("Other", 1.0), *[(c, float(v)) for c, v in zip("bcdefgh", range(2, 9))]]
    assert s.pie(df.where("name < 'd'"), "name", "v").count() == 3
    assert rows(s.series(df.where("name = 'j'"), "name")) == [("j", "v", None)]
    codes = spark.createDataFrame([("DE", 276), ("DEU", 276), ("FR", 250)], "code string, region_id int")
    regions = spark.createDataFrame([(" de", "5", 1), ("DEU", "9", 2), ("fr", "1", 1), ("??", "99", 1), ("FR", "bad", 3)], "r string, v string, at int")
    assert rows(s.world_map(regions, "r", "v", "at", codes)) == [(250, 1.0, 0.25), (276, 9.0, 1.0)]
    assert rows(s.world_map(regions.where("r = 'fr'"), "r", "v", "at", codes)) == [(250, 1.0, 0.7)]
    roles = s.column_roles(spark.sql("SELECT 1 AS a, DATE '2020-01-01' AS b, 'x' AS c, array(1) AS d, 1.5 AS e"))
    assert [r["role"] for r in roles.collect()] == ["numeric", "temporal", "string", "other", "numeric"]


def test_queries_are_capped(spark):
    got, more = s.query(spark, "SELECT * FROM range(5)", n=4)
    assert got.count() == 4 and more
    assert s.query(spark, "SELECT * FROM not_there", strict=False) == (None, False)
    with pytest.raises(Exception):
        s.query(spark, "SELECT * FROM not_there")


def test_transform_contract(spark):
    with pytest.raises(ValueError):
        python_transform("x = 1")
    with pytest.raises(TypeError):
        run_transform(spark, lambda *_: [1], {})
    amounts = spark.createDataFrame([(5,), (20,), (30,)], "amount int")
    out = run_transform(spark, "SELECT count(*) AS n, sum(amount) AS total FROM orders WHERE amount > 10", {"orders": amounts})
    assert rows(out["default"]) == [(2, 50)]


def test_chain_is_incremental_skips_and_stops(spark):
    chain = Chain(spark, scratch_path(spark, "chain"))
    month = lambda days: spark.createDataFrame(days, "d string, v long")
    silver = Stage(
        "silver", "SELECT d, sum(v) AS v FROM raw GROUP BY d", {"raw": "bronze"},
        {"default": OutputSpec(merge_keys=["d"], merge_update={"v": "additive"})}, incremental=["raw"],
    )
    handled = []

    def count(spark, inputs):
        handled.append(inputs["days"].count())
        return {"default": inputs["days"]}

    gold = Stage("gold", count, {"days": "silver"}, {"default": OutputSpec(merge_keys=["d"])}, incremental=["days"])
    load = lambda days: Stage("bronze", lambda *_: {"default": month(days)}, {}, {"default": OutputSpec(mode="append")})
    assert [r.status for r in chain.run([load([("1", 1), ("2", 2)]), silver, gold])] == ["ok"] * 3
    assert [r.status for r in chain.run([load([("2", 5), ("3", 3)]), silver, gold])] == ["ok"] * 3
    assert handled == [2, 2]  # the second time only the changed days
    assert rows(chain.table("gold").read()) == [("1", 1), ("2", 7), ("3", 3)]
    assert [r.status for r in chain.run([silver, gold])] == ["skipped", "skipped"]
    assert [r.status for r in chain.run([silver, gold], forced=["gold"])] == ["skipped", "ok"]
    broken = Stage("broken", "SELECT nope FROM x", {"x": "gold"})
    after = Stage("after", "SELECT 1 AS one", {})
    assert [r.status for r in chain.run([broken, after])] == ["failed"]
