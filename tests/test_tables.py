import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import rows
from millrace.operators.changes import latest_changes
from millrace.operators.maintenance import expire, recluster, sweep
from millrace.operators.merge import MergeError
from millrace.operators.writes import OutputSpec
from millrace.session import scratch_path
from millrace.sources.sampling import file_listing
from millrace.tables.store import FeedError, Provenance, VersionedTable, read_feed


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


@pytest.fixture
def table(spark):
    return VersionedTable(spark, scratch_path(spark, "table"))


def test_counts_add_up_over_merges(spark, table):
    schema = "k string, n bigint"
    table.merge(frame(spark, [("A", 2), ("B", 1)], schema), ["k"], {"n": "additive"})
    table.merge(frame(spark, [("A", 1), ("C", 1)], schema), ["k"], {"n": "additive"}, by=Provenance("r2", "event"))
    assert rows(table.read()) == [("A", 3), ("B", 1), ("C", 1)]
    assert rows(table.read(0)) == [("A", 2), ("B", 1)]
    head = table.commit()
    assert (head["inserted"], head["updated"], head["total_rows"], head["run_id"]) == (1, 1, 3, "r2")
    feed = read_feed(table, 0, ["k"])
    assert rows(feed.df) == [("A", 3), ("C", 1)] and feed.version == 1
    kinds = rows(table.changes(0), "_change_type", "k", "n")
    assert kinds == [("insert", "C", 1), ("update_postimage", "A", 3), ("update_preimage", "A", 2)]


def test_read_decisions(spark, table):
    assert read_feed(table, None).skipped
    table.append(frame(spark, [(1,)], "id long"))
    assert read_feed(table, None).full
    assert read_feed(table, 0).skipped
    assert read_feed(table, 0, forced=True).full
    assert read_feed(table, 7).full and read_feed(table, 7).version == 0
    table.append(frame(spark, [(2,)], "id long"))
    assert rows(read_feed(table, 0).df) == [(2,)]


def test_compaction_keeps_rows_and_emits_no_changes(spark, table):
    for value in ("A", "B", "C"):
        table.append(frame(spark, [(value,)], "k string"))
    before, files = rows(table.read()), table.commit()["file_count"]
    version = table.compact()
    assert rows(table.read()) == before and table.commit()["file_count"] < files
    assert read_feed(table, version - 1).df.count() == 0
    recluster(table, ["k"])
    recluster(table, ["k"], zorder=True)
    assert rows(table.read()) == before
    table.append(frame(spark, [("D",)], "k string"))
    assert rows(read_feed(table, version - 1).df) == [("D",)]


def test_append_evolves_and_replace_drifts(spark, table):
    table.append(frame(spark, [(1, 10)], "id long, amount long"))
    table.append(frame(spark, [(2, 20, "x")], "id long, amount long, note string"))
    assert rows(table.read(), "id", "note") == [(1, None), (2, "x")]
    table.replace(frame(spark, [(3, "now text")], "id long, amount string"))
    assert rows(table.read()) == [(3, "now text")]
    with pytest.raises(FeedError):  # `amount` has another type now: its old values can't be given
        table.changes(0)
    feed = read_feed(table, 0)
    assert feed.full and rows(feed.df) == [(3, "now text")]
    table.replace(frame(spark, [(4, "more")], "id long, amount string"))
    assert rows(table.changes(2), "_change_type", "id") == [("delete", 3), ("insert", 4)]


def test_partitioned_merge_rewrites_only_touched_partitions(spark):
    table = VersionedTable(spark, scratch_path(spark, "table"), ["d"])
    d1, d2, d3 = (dt.date(2024, 1, i) for i in (1, 2, 3))
    schema = "k string, d date, v long"
    table.merge(frame(spark, [("A", d1, 1), ("B", d2, 1)], schema), ["k"], bound_by=["d"])
    table.merge(frame(spark, [("A", d1, 9), ("C", d3, 1)], schema), ["k"], bound_by=["d"])
    assert rows(table.read(), "k", "d", "v") == [("A", d1, 9), ("B", d2, 1), ("C", d3, 1)]
    assert "_v=0/_k=insert/d=2024-01-02" in paths(table) and "_v=0/_k=insert/d=2024-01-01" not in paths(table)
    with pytest.raises(MergeError):
        table.merge(frame(spark, [("A", d1, 1), ("A", d2, 1)], schema), ["k"], bound_by=["d"])
    assert table.files().count() == table.commit()["file_count"] == 3


def test_duplicate_source_keys_fail_before_anything_is_written(spark, table):
    schema = "k string, v long"
    table.merge(frame(spark, [("A", 1)], schema), ["k"])
    with pytest.raises(MergeError):
        table.merge(frame(spark, [("A", 2), ("A", 3)], schema), ["k"])
    assert table.version() == 0


def test_same_key_twice_in_a_range_keeps_the_newest(spark, table):
    schema = "k string, v long"
    for v in (1, 2, 3):
        table.merge(frame(spark, [("A", v), (f"B{v}", v)], schema), ["k"])
    feed = read_feed(table, 0)  # the producer's own keys
    assert rows(feed.df) == [("A", 3), ("B2", 2), ("B3", 3)]
    assert read_feed(table, 0, keys=()).df.count() == 4
    assert latest_changes(table.changes(), ["k"]).count() == 4


def test_expire_goes_by_the_time_of_replacement(spark, table):
    for v in (1, 2):
        table.replace(frame(spark, [(v,)], "v long"))
    assert expire(table, retention_hours=1) == 0 and rows(table.read(0)) == [(1,)]  # replaced a moment ago
    assert expire(table, retention_hours=-1) == 1 and rows(table.read()) == [(2,)]
    assert read_feed(table, 0).full  # the rows of version 1 have no deletes any more


def test_expire_takes_dropped_directories_of_live_versions(spark):
    table = VersionedTable(spark, scratch_path(spark, "table"), ["p"])
    schema = "k long, p string, v long"
    table.replace(frame(spark, [(1, "a", 1), (2, "b", 1)], schema), merge_keys=["k"])
    table.merge(frame(spark, [(1, "a", 2)], schema), ["k"])
    assert expire(table, retention_hours=-1) == 2  # the rewritten partition and the rows before the update
    assert rows(table.read(), "k", "p", "v") == [(1, "a", 2), (2, "b", 1)] and expire(table, retention_hours=-1) == 0


def paths(table):
    return {r.path for r in table.dirs().collect()}


def test_sweep_records_failures(spark, table):
    table.replace(frame(spark, [(1,)], "v long"))
    missing = VersionedTable(spark, scratch_path(spark, "missing"))
    report = sweep({"b": table, "a": missing}, {"compact": lambda t: t.compact()})
    assert [(r["table"], r["status"]) for r in report.collect()] == [("a", "failed"), ("b", "ok")]


def test_write_follows_the_output_spec(spark, table):
    spec = OutputSpec.parse({"merge_keys": ["k"]})
    table.write(frame(spark, [("A", 1)], "k string, v long"), spec)
    table.write(frame(spark, [("A", 2)], "k string, v long"), spec)
    assert rows(table.read()) == [("A", 2)]
    table.write(frame(spark, [("A", 3)], "k string, v long"), OutputSpec(mode="append", merge_keys=["k"]))
    assert table.read().count() == 2
    for bad in ({"mode": "merge"}, {"mode": "upsert"}):
        with pytest.raises(ValueError):
            OutputSpec.parse(bad)


def test_merge_by_a_key_that_is_no_partition(spark):
    table = VersionedTable(spark, scratch_path(spark, "table"), ["p"])
    schema = "k long, p string, v long"
    data = [(k, f"p{k % 4}", 0) for k in range(40)]
    table.replace(frame(spark, data, schema).coalesce(1), merge_keys=["k"])  # one task writes all partitions
    table.append(frame(spark, [(k, f"p{k % 2}", 0) for k in range(40, 44)], schema).coalesce(1))
    table.merge(frame(spark, [(5, "p1", 7), (100, "p9", 7), (101, None, 7)], schema), ["k"])
    got = rows(table.read(), "k", "v")
    assert got == sorted([(k, 7 if k == 5 else 0) for k in range(44)] + [(100, 7), (101, 7)])
    head = table.commit()
    assert head["total_rows"] == 46 and (head["inserted"], head["updated"]) == (2, 1)
    assert {"_v=0/_k=insert/p=p0", "_v=1/_k=insert/p=p1"} <= paths(table) and "_v=0/_k=insert/p=p1" not in paths(table)
    assert rows(table.changes(1), "_change_type", "k") == [("insert", 100), ("insert", 101), ("update_postimage", 5), ("update_preimage", 5)]
    assert table.read(1).count() == 44 and table.files().count() == head["file_count"]


def test_merge_over_many_partitions(spark):
    table = VersionedTable(spark, scratch_path(spark, "table"), ["p"])
    many = spark.range(300).select(F.col("id").alias("p"), F.lit(0).alias("v"))
    table.replace(many, merge_keys=["p"])
    table.merge(many.where("p < 290").withColumn("v", F.lit(1)), ["p"])
    assert [tuple(r) for r in table.read().groupBy("v").count().orderBy("v").collect()] == [(0, 10), (1, 290)]


def test_commits_do_not_grow_with_history(spark, table):
    table.replace(frame(spark, [(0,)], "v long"))
    for v in range(1, 13):
        table.append(frame(spark, [(v,)], "v long"))
    size = lambda v: sum(r.bytes for r in file_listing(spark, f"{table.path}/log/version={v}").union(file_listing(spark, f"{table.path}/dirs/version={v}")).collect())
    assert abs(size(12) - size(2)) < 64 and table.read().count() == 13 and table.commit()["total_rows"] == 13


def test_layout_is_remembered_and_only_small_files_are_compacted(spark, table):
    ids = spark.range(4000).select(F.col("id").alias("k"), F.rand(1).alias("v"))
    table.replace(ids.repartition(4), cluster_by=["k"])
    table.append(ids.limit(10))
    table.append(ids.limit(10))
    assert list(table.commit()["cluster_by"]) == ["k"]
    recluster(table, ["v"])
    table.append(ids.limit(5))
    assert list(table.commit()["cluster_by"]) == ["v"]
    large = paths(table) - {p for p in paths(table) if p.startswith(f"_v={table.version()}/")}
    size = table.commit()["total_bytes"]
    table.append(ids.limit(5))
    table.compact(target_bytes=size // 20)
    assert large <= paths(table) and table.read().count() == 4030
    head = table.version()
    assert table.compact(target_bytes=1) == head


def test_forced_reads_matter_only_when_nothing_is_new(spark, table):
    table.append(frame(spark, [(1,), (2,), (3,)], "v long"))
    table.append(frame(spark, [(4,), (5,)], "v long"))
    behind, level = read_feed(table, 0, forced=True), read_feed(table, 1, forced=True)
    assert not behind.full and rows(behind.df) == [(4,), (5,)]
    assert level.full and level.df.count() == 5 and read_feed(table, 1).skipped


ODD_TEXTS = ["", None, "~", "~~x", "__HIVE_DEFAULT_PARTITION__", "~__HIVE_DEFAULT_PARTITION__", "a/b=c%2F +", "é", " ", "null", "x:y", "{}"]


def test_merges_into_odd_partitions_update_in_place(spark):
    table = VersionedTable(spark, scratch_path(spark, "table"), ["p"])
    schema = "p string, k long, v long"
    for v in (1, 2, 3):
        table.merge(frame(spark, [(p, i, v) for i, p in enumerate(ODD_TEXTS)], schema), ["p", "k"])
    want = sorted([(p, i, v) for i, p in enumerate(ODD_TEXTS) for v in ((1, 2, 3) if p is None else (3,))], key=str)
    assert sorted(rows(table.read(), "p", "k", "v"), key=str) == want
    head = table.commit()
    assert head["total_rows"] == len(want) and (head["inserted"], head["updated"]) == (1, len(ODD_TEXTS) - 1)
    assert sorted(rows(table.read().where("p = ''"), "k", "v")) == [(0, 3)]
    plan = table.read().where("p = '~'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_whole_versions_are_read_by_one_path(spark):
    table = VersionedTable(spark, scratch_path(spark, "table"), ["p"])
    many = spark.range(120).select((F.col("id") % 20).alias("p"), "id", F.lit(0).alias("v"))
    for k in range(3):
        table.append(many.where(F.col("id") % 3 == k))
    assert table._all_paths(table.commit()) == ["_v=0", "_v=1", "_v=2"]
    table.merge(many.where("id = 4").withColumn("v", F.lit(1)), ["id"])  # partition 4 of version 1
    paths = table._all_paths(table.commit())
    assert {"_v=0", "_v=2", "_v=3/_k=keep", "_v=3/_k=post"} <= set(paths) and "_v=1" not in paths
    assert len(paths) == 4 + len({p for p in paths if p.startswith("_v=1/")}) and table.read().count() == 120
    assert table.read().agg(F.sum("v")).first()[0] == 1 and table.read(2).agg(F.sum("v")).first()[0] == 0


def test_expiry_is_remembered(spark):
    table = VersionedTable(spark, scratch_path(spark, "table"), ["p"])
    schema = "k long, p string, v long"
    for v in range(3):
        table.replace(frame(spark, [(k, f"p{k % 5}", v) for k in range(20)], schema), merge_keys=["k"])
    assert expire(table, -1) == 10  # five directories of two versions
    assert table.expired(-1).count() == 0 and expire(table, -1) == 0
    assert not table._exists(f"{table.path}/data/_v=0") and table.read().count() == 20
    table.merge(frame(spark, [(1, "p1", 9)], schema), ["k"])
    assert expire(table, -1) == 2 and rows(table.read().where("k = 1"), "v") == [(9,)]
    assert table.dirs().count() == 6


def test_commits_without_rows_are_counted(spark, table):
    empty = frame(spark, [], "k long, v long")
    table.replace(empty)
    table.append(frame(spark, [(1, 1)], "k long, v long"))
    table.merge(empty, ["k"])
    told = [(r.inserted, r.updated, r.output_rows, r.total_rows) for r in table.log().orderBy("version").collect()]
    assert told == [(0, None, 0, 0), (1, None, 1, 1), (0, 0, None, 1)]
    assert rows(table.read()) == [(1, 1)]


def test_a_write_of_one_kind_sorts_nothing(spark, tmp_path, monkeypatch):
    """The kind is a constant right before the write, so Spark needs no sort by it, which would hold all that a task writes."""
    plans, frame = [], type(spark.range(1))
    write = frame.write.fget
    monkeypatch.setattr(frame, "write", property(lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df)))
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.replace(spark.range(100).repartition(4))
    t.append(spark.range(100, 200).repartition(4))
    before = t.commit()["file_count"]
    t.compact()
    tops = [p.splitlines()[0] for p in plans if "_k#" in p]
    assert len(tops) == 3 and all(top.startswith("Project") and " AS _k#" in top for top in tops)
    assert t.commit()["file_count"] < before and t.read().count() == 200
