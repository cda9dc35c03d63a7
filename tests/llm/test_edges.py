"""Very long texts among short ones, and extra columns whose names an operator uses itself."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm.common import Scratch
from millrace.llm.decontaminate import benchmark_leaks
from millrace.llm.packing import pack
from millrace.llm.repeats import repeated_spans
from millrace.llm.simhash import fingerprint, simhash_groups
from millrace.llm.token_files import read_ids, write_ids
from millrace.llm.tokens import default_tokenizer
from millrace.llm.toxicity import train, with_scores
from millrace.llm.warc import digest, normalise, read_archives, write_archives
from millrace.llm.wrapper import main_text

NAMES = "uid id row fp key n text_ lang piece start length ids ids_crc32 shard island lengths block words count score host page page_ digest stored file offset number".split()


def long_text(seed, words):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnop é", k=rng.randint(2, 9))) for _ in range(words))


@pytest.fixture(scope="module")
def texts():
    big = long_text(1, 300_000)
    return {0: "a short one", 1: big, 2: "x" + big[1000:900_000], 3: "", 4: None, 5: "another short one"}


@pytest.fixture(scope="module")
def docs(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    return df.withColumns({n: F.lit(k) for k, n in enumerate(NAMES)})


def ids_of(texts):
    t = Tokenizer.from_file(default_tokenizer())
    return {i: t.encode(x or "", add_special_tokens=False).ids for i, x in texts.items()}


def test_packing_and_token_files(spark, docs, texts):
    want = ids_of(texts)
    pieces = pack(docs).collect()
    for i, ids in want.items():
        own = sorted((r for r in pieces if r.doc_id == i), key=lambda r: r.piece)
        assert [r.start for r in own] == list(np.cumsum([0, *[r.length for r in own]])[:-1]) and sum(r.length for r in own) == len(ids) + 1
        assert all(r.length == 1024 for r in own[1:])
    places = {}
    for r in pieces:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 1024 and [o for o, _ in sorted(p)] == list(np.cumsum([0, *[n for _, n in sorted(p)]])[:-1]) for p in places.values())
    got = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in read_ids(write_ids(docs, Scratch(spark, "t"))).collect()}
    assert got == {i: [*ids, 0] for i, ids in want.items()}


def test_repeats(docs, texts):
    got = {r.doc_id: r for r in repeated_spans(docs).collect()}
    assert bytes(got[1].kept) == texts[1].encode() and got[1].spans == []
    assert bytes(got[2].kept) == b"x" and [tuple(s) for s in got[2].spans] == [(1, len(texts[2].encode()) - 1)]


def test_fingerprints(docs, texts):
    got = {r.doc_id: r.fingerprint for r in simhash_groups(docs).collect()}
    assert got == {i: f"{fingerprint((x or '').encode()):016x}" for i, x in texts.items()}


def test_scores(spark, docs):
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (5, 0)], "doc_id long, toxic int")
    out = with_scores(docs, train(docs, labels, least_texts=1))
    scores = {r.doc_id: r.score for r in out.select("doc_id", "score").collect()}
    assert set(scores) == {0, 1, 2, 3, 4, 5} and all(0 <= s <= 1 for s in scores.values()) and scores[3] == scores[4]


def test_leaks_at_the_end_of_a_long_text(spark, texts):
    item = "what is the capital of the oldest kingdom in the northern hills it is called zanterburg"
    rows = [(i, None if x is None else x + (" " + item if i == 1 else "")) for i, x in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(k) for k, n in enumerate(NAMES)})
    found = benchmark_leaks(df, spark.createDataFrame([(7, item), (8, "an item that nobody has copied anywhere at all")], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(1, 7)]


def test_archives(spark, texts):
    html = {i: x for i, x in texts.items()}
    df = spark.createDataFrame([(i, f"http://h/{i}", x) for i, x in html.items()], "page_id long, url string, html string").withColumns({n: F.lit(k) for k, n in enumerate(NAMES)})
    scratch = Scratch(spark, "t")
    got = {r.page_id: r for r in read_archives(normalise(write_archives(df, scratch), scratch)).collect()}
    for i, x in html.items():
        payload = (x or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(payload), digest(payload))
        if got[i].record_type == "response":
            assert hashlib.sha1(bytes(got[i].payload)).digest() == hashlib.sha1(payload).digest()
    assert got[3].refers_to == 4 and got[4].record_type == "response"


def test_a_long_page(spark):
    body = " ".join(long_text(3, 200_000).split())
    rows = [(k, f"http://h.example/{k}", f"<body><div class='nav'>menu</div><article><h1>T{k}</h1><p>{body if k == 2 else 'short ' * 30}</p></article></body>") for k in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({n: F.lit(k) for k, n in enumerate(NAMES) if n not in ("page_id", "url", "html")})
    got = {r.row.page_id: r.text for r in main_text(df).collect()}
    assert got[2] == f"T2 {body}" and got[1] == "T1 " + " ".join(["short"] * 30)
