import io
import random

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from millrace.llm.common import Scratch
from millrace.llm.token_files import Reader, Writer, from_planes, read_ids, to_planes, write_ids
from millrace.llm.tokens import default_tokenizer


def test_planes_round_trip():
    rng = np.random.default_rng(0)
    for n in (1, 7, 8, 9, 1000):
        ids = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
        for kind in ("byte", "bit"):
            planes = to_planes(ids, kind)
            assert len(planes) == (4 if kind == "byte" else 32)
            assert (from_planes([p.tobytes() for p in planes], n, kind) == ids).all()


def test_file_round_trip():
    rng = np.random.default_rng(1)
    docs = [(int(i), rng.integers(0, 50257, n).astype(np.uint32)) for i, n in enumerate([0, 1, 5, 64, 65, 1000, 0, 3])] + [(None, np.array([9], np.uint32))]
    for kind in ("byte", "bit"):
        for block in (1, 7, 64, 100000):
            out = io.BytesIO()
            w = Writer(out, kind, block)
            for d in docs:
                w.add(*d)
            w.close()
            reader = Reader(pa.BufferReader(out.getvalue()))
            at = 0
            for (i, ids), (j, start, got) in zip(docs, reader.documents(), strict=True):
                assert i == j and start == at and (got == ids).all()
                at += len(ids)
            assert reader.n == at


def test_documents_come_back_in_order(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(-50, 10**6), " ".join(rng.choices(["a", "bb", "çç", "\n"], k=rng.randint(0, 60)))) for _ in range(300)]
    rows += [(5, "same"), (5, "same"), (6, None), (None, "null id"), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("*", "1 as uid", "2 as id", "3 as start")
    t = Tokenizer.from_file(default_tokenizer())
    for kind in ("byte", "bit"):
        got = read_ids(write_ids(df, Scratch(spark, "t"), kind=kind, block_ids=100)).collect()
        got = sorted(((r.start, r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in got), key=lambda x: x[0])
        order = [(i is not None, i or 0) for _, i, _ in got]
        assert order == sorted(order)
        at = 0
        for start, _, ids in got:
            assert start == at and ids[-1] == 0
            at += len(ids)
        want = sorted((str(i), t.encode(x or "", add_special_tokens=False).ids + [0]) for i, x in rows)
        assert sorted((str(i), ids) for _, i, ids in got) == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert read_ids(write_ids(empty, Scratch(spark, "t"))).count() == 0
