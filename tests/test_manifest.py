"""Files by manifest, and what a chain does with them."""

import os
import time

from helpers import rows

from millrace.operators.writes import OutputSpec
from millrace.plans.staged import Chain, Stage
from millrace.sources.formats import InputSpec
from millrace.sources.manifest import FileManifest, read_unread
from millrace.tables.store import Provenance


def land(spark, path, day, values):
    spark.createDataFrame([(v,) for v in values], "v long").coalesce(1).write.mode("append").parquet(f"{path}/day={day}")


def test_late_files_are_read_once_and_in_bounded_batches(spark, tmp_path):
    path, manifest = f"{tmp_path}/in", FileManifest(spark, f"{tmp_path}/manifest")
    assert not os.path.exists(f"{tmp_path}/manifest") and manifest.rows().count() == 0
    for day, v in (("01", 1), ("02", 2), ("03", 3)):
        land(spark, path, day, [v])
    got = read_unread(manifest, "c", path, max_files=2, suffix=".parquet")
    assert got.n == 2 and got.more and rows(got.df, "v", "day") == [(1, "01"), (2, "02")]
    again = read_unread(manifest, "c", path, max_files=2, suffix=".parquet")
    assert rows(again.df) == rows(got.df)  # not done yet: a crash repeats the batch
    again.done()
    land(spark, path, "01", [7])  # into a partition that was read
    rest = read_unread(manifest, "c", path, suffix=".parquet")
    assert not rest.more and rows(rest.df, "v", "day") == [(3, "03"), (7, "01")]
    rest.done()
    assert read_unread(manifest, "c", path, suffix=".parquet").skipped
    assert read_unread(manifest, "c", path, suffix=".parquet", forced=True).df.count() == 4
    assert read_unread(manifest, "other", path, suffix=".parquet").n == 4


def test_a_file_that_is_written_again_is_new(spark, tmp_path):
    path, manifest = f"{tmp_path}/in", FileManifest(spark, f"{tmp_path}/manifest")
    land(spark, path, "01", [1])
    read_unread(manifest, "c", path, suffix=".parquet").done()
    (name,) = [f for f in os.listdir(f"{path}/day=01") if f.endswith(".parquet")]
    later = time.time() + 5
    os.utime(f"{path}/day=01/{name}", (later, later))
    assert read_unread(manifest, "c", path, suffix=".parquet").n == 1


def test_a_chain_sees_late_files(spark, tmp_path):
    path, chain = f"{tmp_path}/in", Chain(spark, f"{tmp_path}/chain")
    stage = Stage("all", "SELECT v, day FROM rows", {"rows": InputSpec(path, late_files=True)}, {"default": OutputSpec(mode="append")})
    land(spark, path, "05", [1])
    assert chain.run([stage], Provenance("r1"))[0].status == "ok"
    assert chain.run([stage], Provenance("r2"))[0].status == "skipped"
    land(spark, path, "01", [2])
    assert chain.run([stage], Provenance("r3"))[0].status == "ok"
    assert rows(chain.table("all").read(), "v", "day") == [(1, "05"), (2, "01")]
    told = chain.system("node_runs").orderBy("run_id").collect()
    assert [(r.run_id, r.status, r.output_rows) for r in told] == [("r1", "ok", 1), ("r2", "skipped", None), ("r3", "ok", 1)]


def test_a_failed_stage_does_not_consume_files(spark, tmp_path):
    path, chain = f"{tmp_path}/in", Chain(spark, f"{tmp_path}/chain")
    land(spark, path, "05", [1])
    bad = Stage("all", "SELECT raise_error('no') AS x FROM rows", {"rows": InputSpec(path, late_files=True)})
    good = Stage("all", "SELECT v FROM rows", {"rows": InputSpec(path, late_files=True)})
    assert [r.status for r in chain.run([bad])] == ["failed"]
    assert [r.status for r in chain.run([good])] == ["ok"] and chain.table("all").read().count() == 1
    assert [r.status for r in chain.system("node_runs").orderBy("started_at").collect()] == ["failed", "ok"]
