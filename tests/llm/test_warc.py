import gzip
import hashlib
import random

from pyspark.sql import functions as F

from millrace.llm.common import Scratch, open_folder
from millrace.llm.warc import digest, normalise, read_archives, records, write_archives


def expected(rows, least_bytes=0):
    best = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if i is not None and len(data) >= least_bytes:
            best[data] = max(best.get(data, i), i)
    out = []
    for i, url, html in rows:
        data = (html or "").encode()
        top = best.get(data)
        revisit = top is not None and i != top
        out.append((i, len(data), digest(data), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def sample():
    rng = random.Random(3)
    htmls = ["<p>" + "é" * rng.randint(0, 50) + "</p>" for _ in range(8)] + ["", None, "WARC/1.1\r\n\r\nWARC-Type: x\r\nContent-Length: 9999\r\n\r\n", "x" * 3_000_000]
    rows = [(i, rng.choice(["http://a/ü", None, "http://b/\r\nX: y"]), rng.choice(htmls)) for i in range(120)]
    return rows + [(500, "u", "same"), (500, "u", "same"), (None, "n", "same"), (None, None, "only nulls"), (7, "again", htmls[0])]


def test_round_trip(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).selectExpr("*", "1 as digest", "'f' as file", "2 as stored")
    for least in (0, 30):
        scratch = Scratch(spark, "t")
        archives = write_archives(df, scratch, least_bytes=least)
        assert archives.agg(F.sum("n_records")).first()[0] == len(rows)
        index = normalise(archives, scratch)
        got = read_archives(index).collect()
        assert sorted((tuple(r)[:5] for r in got), key=str) == expected(rows, least)
        stored = {hashlib.sha1(bytes(r.payload)).digest() for r in got if r.record_type == "response"}
        assert stored == {hashlib.sha1((h or "").encode()).digest() for _, _, h in rows}


def test_members_stand_alone_and_hold_what_the_stream_held(spark):
    scratch = Scratch(spark, "t")
    df = spark.createDataFrame(sample(), "page_id long, url string, html string").repartition(2)
    archives = write_archives(df, scratch)
    index = normalise(archives, scratch).collect()
    for row in archives.collect():
        files, path = open_folder(row.file)
        with files.open_input_stream(path, compression=None) as f:
            whole = gzip.decompress(f.read())
        with files.open_input_stream(path, compression=None) as f:
            assert b"".join(x for _, x in records(f)) == whole
        name = row.file.rsplit("/", 1)[1]
        mine = sorted((x for x in index if x.file.endswith("/" + name)), key=lambda x: x.offset)
        files, path = open_folder(mine[0].file)
        with files.open_input_file(path) as f:
            data = f.read()
        assert sum(x.length for x in mine) == len(data)
        assert b"".join(gzip.decompress(data[x.offset : x.offset + x.length]) for x in mine) == whole


def test_empty_table(spark):
    scratch = Scratch(spark, "t")
    index = normalise(write_archives(spark.createDataFrame([], "page_id long, url string, html string"), scratch), scratch)
    assert read_archives(index).count() == 0
