import datetime as dt
import gzip

import pytest
from pyspark.sql import functions as F

from helpers import rows
from millrace.operators.maintenance import zorder_key
from millrace.operators.writes import OutputSpec, write_json
from millrace.session import scratch_path
from millrace.sources import cursors as c
from millrace.sources.documents import json_rows, text_column_types, typed_text
from millrace.sources.formats import flat_name, partition_columns, read_named, read_path, table_name
from millrace.sources.sampling import newest_files, probe_prefixes, sample_newest, sample_rows

ORDERS = """order_id,amount,status,ts
a,150,new,2026-04-26 10:00:00
b,75.5,new,2026-04-26 11:00:00
c,0,void,2026-04-26 12:00:00
d,200,paid,2026-04-27 10:00:00
e,-10,refund,2026-04-27 11:00:00
f,50,paid,2026-04-27 12:00:00
"""


def test_csv_with_header_and_types(spark, tmp_path):
    (tmp_path / "orders.csv").write_text(ORDERS)
    df = read_path(spark, f"{tmp_path}/orders.csv", "csv")
    assert df.where("amount > 10").count() == 4
    assert dict(df.dtypes)["amount"] == "double"


def test_tsv_comments_names_and_gzip(spark, tmp_path):
    text = "#Version: 1.0\n#Fields: a b\n2026-01-01\t/t.gif\n2026-01-02\t/x\n"
    with gzip.open(tmp_path / "log.tsv.gz", "wt") as f:
        f.write(text)
    options = {"header": "false", "comment": "#", "columns": "day, stem"}
    df = read_path(spark, f"{tmp_path}/", "tsv", options, schema="day string, stem string")
    assert rows(df) == [("2026-01-01", "/t.gif"), ("2026-01-02", "/x")]


def test_unknown_format(spark):
    with pytest.raises(ValueError, match="unsupported source format"):
        read_path(spark, "/nowhere", "xml")


def test_prefix_keeps_partition_columns_and_recurses_elsewhere(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/parts/day=26/hour=01")
    spark.range(3).write.parquet(f"{tmp_path}/flat/2024/jan")
    assert partition_columns(spark, f"{tmp_path}/parts/") and not partition_columns(spark, f"{tmp_path}/gone/")
    assert set(read_path(spark, f"{tmp_path}/parts/").columns) == {"id", "day", "hour"}
    assert read_path(spark, f"{tmp_path}/flat/").count() == 3
    assert read_named(spark, f"{tmp_path}/flat/2024/jan").count() == 3


def tree(spark, tmp_path):
    for day, hour in (("2026-04-25", "23"), ("2026-04-26", "00"), ("2026-04-26", "01"), ("2026-04-27", "00")):
        spark.range(2).write.parquet(f"{tmp_path}/t/year=2026/month=04/day={day}/hour={hour}")
    return f"{tmp_path}/t", ["year", "month", "day", "hour"]


def test_cursor_window_and_newest(spark, tmp_path):
    path, columns = tree(spark, tmp_path)
    df = c.read_partitioned(spark, path)
    assert dict(df.dtypes)["month"] == "string"
    leaves = lambda x: rows(x.select("day", "hour").distinct())
    assert leaves(c.after_cursor(df, columns, ("2026", "04", "2026-04-26", "01"))) == [("2026-04-27", "00")]
    window = c.in_window(df, columns, ("2026", "04", "2026-04-26", "00"), ("2026", "04", "2026-04-27", "00"))
    assert len(leaves(window)) == 3
    assert len(leaves(c.in_window(df, columns, ("2026", "04"), ("2026", "04")))) == 4
    with pytest.raises(ValueError):
        c.in_window(df, columns, (), ("2026",))
    assert c.newest_partition(spark, path, columns) == ("2026", "04", "2026-04-27", "00")
    assert tuple(c.newest_cursor(df, columns).first()["cursor"]) == ("2026", "04", "2026-04-27", "00")
    pruned = c.after_cursor(df, columns, ("2026", "04", "2026-04-26", "01"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull" in pruned or "PartitionFilters: [(array" in pruned


def test_incremental_reads_advance_per_consumer(spark, tmp_path):
    path, columns = tree(spark, tmp_path)
    store = c.CursorTable(spark, f"{tmp_path}/cursors")
    first = c.read_incremental(spark, store, "a", path, columns)
    assert first.df.count() == 8
    assert c.read_incremental(spark, store, "a", path, columns).df.count() == 8  # not advanced yet
    store.advance("a", path, first.cursor)
    assert c.read_incremental(spark, store, "a", path, columns).skipped
    assert c.read_incremental(spark, store, "b", path, columns).df.count() == 8
    assert c.read_incremental(spark, store, "a", path, columns, forced=True).df.count() == 8
    spark.range(2).write.parquet(f"{path}/year=2026/month=04/day=2026-04-27/hour=01")
    assert c.read_incremental(spark, store, "a", path, columns).df.count() == 2


def test_start_from_now_keeps_its_baseline(spark, tmp_path):
    path, columns = tree(spark, tmp_path)
    store = c.CursorTable(spark, f"{tmp_path}/cursors")
    assert c.read_incremental(spark, store, "n", path, columns, start_from="now").skipped
    spark.range(2).write.parquet(f"{path}/year=2026/month=05/day=2026-05-01/hour=00")
    assert c.read_incremental(spark, store, "n", path, columns, start_from="now").df.count() == 2


def test_json_path_unions_keys_and_skips_scalars(spark):
    body = '{"data": {"items": [{"a": 1, "b": {"c": 2}}, 5, "x", null, {"d": "y"}]}}'
    df = spark.createDataFrame([(body,), ("not json",), ('{"data": {}}',)], "body string")
    out = json_rows(df, "body", "data.items")
    assert out.columns == ["a", "b", "d"]
    assert rows(out) == [(None, None, "y"), ("1", '{"c":2}', None)]


def test_text_types(spark):
    data = [("1", "1", "x", " ", "NaN", "9223372036854775808"), (" 2 ", "2.5", "1", "", "1e3", "1"), (None, "", "2", None, "-.5", "2")]
    df = spark.createDataFrame(data, "i string, f string, s string, b string, n string, big string")
    types = {r["column_name"]: r["column_type"] for r in text_column_types(df).collect()}
    assert types == {"i": "long", "f": "double", "s": "string", "b": "string", "n": "double", "big": "double"}
    assert rows(typed_text(df), "i") == [(None,), (1,), (2,)]


def test_samples(spark, tmp_path):
    df, more = sample_rows(spark.range(10), 4)
    assert df.count() == 4 and more
    assert not sample_rows(spark.range(4), 4)[1]
    day = dt.datetime(2026, 4, 27)
    spark.range(5).coalesce(1).write.json(f"{tmp_path}/y=2026/m=04/d=24")
    places = probe_prefixes(str(tmp_path), "y=%Y/m=%m/d=%d", day)
    assert [p.removeprefix(str(tmp_path)) for p in places] == [
        "/y=2026/m=04/d=27", "/y=2026/m=04/d=26", "/y=2026/m=04/d=24", "/y=2026/m=04", "",
    ]
    got = sample_newest(spark, str(tmp_path), "json", k=9, n=3, template="y=%Y/m=%m/d=%d", as_of=day)
    assert got.count() == 3 and newest_files(spark, str(tmp_path), 1).count() == 1


def test_names_and_output_specs():
    assert flat_name("my-pipe", "orders", "acme-1") == "acme_1__my_pipe.orders"
    assert table_name("trips", "default", ["default"]) == "trips"
    assert table_name("trips", "large", ["default", "large"]) == "trips__large"
    assert OutputSpec.parse("s3://b/x").kind == "path" and OutputSpec.parse("orders").mode == "replace"
    assert OutputSpec(merge_keys=["k"]).mode == "merge"
    assert OutputSpec(mode="append", merge_keys=["k"]).mode == "append"
    assert OutputSpec(merge_keys=list("abcde")).layout_columns() == list("abcd")


def test_json_document_limit(spark):
    with pytest.raises(ValueError):
        write_json(spark.range(5), scratch_path(spark, "json"), max_rows=4)


def test_zorder_keeps_neighbours_together(spark):
    grid = spark.range(64 * 64).select((F.col("id") % 64).alias("x"), F.floor(F.col("id") / 64).alias("y"))
    z = grid.withColumn("z", zorder_key(grid, ["x", "y"]))
    # A quarter of the key space is one quadrant of the grid.
    low = z.where("z < 1024").agg(F.max("x"), F.max("y")).first()
    assert max(low) <= 33 and z.select("z").distinct().count() > 3500


def test_variant_rows_have_the_union_of_keys_and_types(spark):
    from millrace.sources.documents import variant_items, variant_rows, variant_types

    body = '{"a":{"b":[{"n":1,"x":"t","it\'s":2},{"n":2.5,"o":{"k":1}},7,null,"s",{"x":true,"l":[1,2],"q\'\\"q":5}]}}'
    df = spark.createDataFrame([(1, body), (2, '{"a":{"b":[]}}'), (3, "no json"), (4, None), (5, '{"a":1}'), (6, '{"a":{"b":[{"x":null,"n":3}]}}')], "id long, doc string")
    found = variant_types(variant_items(df, "doc", "a.b"))
    assert sorted(found.names) == ["it's", "l", "n", "o", "q'\"q", "x"]
    out = variant_rows(df, "doc", "a.b", keep=["id"]).orderBy("id", "n")
    got = [(r["id"], None if r["n"] is None else float(r["n"]), r["x"], r["it's"], r["o"] and r["o"]["k"], r["l"]) for r in out.collect()]
    assert got == [(1, None, "true", None, None, [1, 2]), (1, 1.0, "t", 2, None, None), (1, 2.5, None, None, 1, None), (6, 3.0, None, None, None, None)]
    assert [r for r in out.select("`q'\"q`").collect() if r[0] is not None] == [(5,)]
    empty = df.limit(0)
    assert variant_rows(empty, "doc", "a.b", keep=["id"]).columns == ["id"]


def test_cell_classes(spark):
    from millrace.sources.documents import text_column_types

    cells = {"long": ["1", "+5", "-007", "9223372036854775807"], "double": ["1.", ".5", "-1e3", "1E-2", "inf", "-Infinity", "NaN", "9223372036854775808", "+nan"],
             "string": ["1d", "1.0f", "0x1p3", "1e999", "", "1 2", "abc", "1_000", "infinit", "5\t", "--1"]}
    for kind, some in cells.items():
        for cell in some:
            (row,) = text_column_types(spark.createDataFrame([(cell,)], "c string")).collect()
            assert row.column_type == kind, cell


def test_cursors_cost_one_small_file_each(spark, tmp_path):
    import glob

    store = c.CursorTable(spark, f"{tmp_path}/cursors")
    for k in range(5):
        store.advance("a", "in", (f"{k:02}",))
        store.advance("b", "in", (f"{k + 10}", "x"))
    assert store.get("a", "in") == ("04",) and store.get("b", "in") == ("14", "x") and store.get("a", "other") is None
    assert len(glob.glob(f"{tmp_path}/cursors/*/*/*.parquet")) == 2
    assert sorted((r.consumer, tuple(r.cursor)) for r in store.rows().collect()) == [("a", ("04",)), ("b", ("14", "x"))]
