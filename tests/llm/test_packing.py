import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from millrace.llm.packing import best_fit, crossover, cuts, evolve, first_population, fitness, pack
from millrace.llm.tokens import default_tokenizer


def test_cuts():
    assert cuts(1, 4) == [(0, 1)] and cuts(4, 4) == [(0, 4)] and cuts(8, 4) == [(0, 4), (4, 4)]
    assert cuts(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_groupings_hold_and_never_get_worse():
    rng = np.random.default_rng(1)
    lengths, capacity = rng.integers(1, 100, 700), 100
    population = first_population(lengths, capacity, 6, rng)
    before = min(fitness(lengths, capacity, x) for x in population)
    for _ in range(10):
        child = crossover(lengths, capacity, population[0], population[3], rng)
        assert np.bincount(child, lengths).max() <= capacity and (np.bincount(child) > 0).all()
    after = evolve(lengths, capacity, population, 8, rng)
    assert fitness(lengths, capacity, after[0]) <= before
    assert np.bincount(after[0], lengths).max() <= capacity


def test_best_fit_takes_the_fullest_bin_that_fits():
    lengths = np.array([60, 70, 30, 40, 35])
    bins = best_fit(lengths, 100, np.full(5, -1), np.arange(5))
    assert bins.tolist() == [0, 1, 1, 0, 2]


def test_every_id_is_placed_once(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["alpha", "beta", "gämma", "x"]) for _ in range(rng.choice([0, 3, 30, 200, 900]))) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (502, texts[7]), (502, texts[7]), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 as piece", "'s' as shard", "0 as uid")
    out = [r.asDict() for r in pack(df, capacity=256, shard_pieces=60, with_ids=True).collect()]
    t = Tokenizer.from_file(default_tokenizer())
    want = sorted((str(i), tuple(t.encode(x or "", add_special_tokens=False).ids) + (2,)) for i, x in rows)
    by_doc, by_sequence = {}, {}
    for r in out:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) == r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        by_doc.setdefault(str(r["doc_id"]), []).append((r["piece"], r["start"], tuple(ids.tolist())))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    got = []
    for i, pieces in by_doc.items():
        twice = 2 if i == "502" else 1
        pieces.sort()
        for k in range(twice):
            mine = pieces[k::twice]
            ids = ()
            for number, (piece, start, part) in enumerate(mine):
                assert piece == number and start == len(ids)
                ids += part
            got.append((i, ids))
    assert sorted(got) == want
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r["length"] for r in out)
    assert len(by_sequence) <= 1.1 * total / 256 + 5


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
