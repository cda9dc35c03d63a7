import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import collocations as co
from millrace.llm.common import Scratch


def by_hand(rows, least, most=2000, longest=5):
    """{lang: [(phrase, a, l, r, n, score)]} in order."""
    import re

    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = {}
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if 2 <= len(p) and a >= least}
        inside = {q[i : i + k] for q, a in often.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * a >= 100 * f[q[i : i + k]]}
        rows = []
        for p, a in often.items():
            if p in inside:
                continue
            score, _, left, right = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((" ".join(p), a, left, right, totals[lang], score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        if rows:
            out[lang] = rows[:most]
    return out


def made_up(seed, n):
    rng, out = random.Random(seed), []
    words = [f"w{k}" for k in range(40)] + ["Zoo", "ÉA", "éa", "x\x00y", "a\x1fb", "New York", "new york city", "\t", "  ", ". ", ",", "in the end", "İ"]
    weights = [1 / (k + 1) for k in range(len(words))]
    for _ in range(n):
        out.append((rng.choice(["en", "de", None, "und", ""]), " ".join(rng.choices(words, weights, k=rng.randint(0, 60)))))
    return out + out[:20] + [("en", None), (None, None), ("fr", "one two"), ("en", "same same same same same same same same")]


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.lang, r.rank)):
        out.setdefault(r.lang, []).append((r.phrase, r.a, r.l, r.r, r.n, r.score))
        assert r.rank == len(out[r.lang])
    return out


@pytest.mark.parametrize(("least", "block"), [(3, 500), (10, 1 << 20), (100, 2000)])
def test_equals_brute_force(spark, least, block):
    rows = made_up(least, 400)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5).selectExpr("*", "1 as block", "2 as keys", "3 as n", "4 as phrase")
    got = collected(co.best_phrases(df, Scratch(spark, "t"), least=least, block_words=block, most=50))
    assert got == by_hand(rows, least, 50)


def test_a_hot_phrase_and_a_long_text(spark):
    rows = [("en", "to be or not to be " * 30_000)] + [("en", "to be")] * 500 + [("en", "not here. to be")] * 300
    df = spark.createDataFrame(rows, "lang string, text string")
    assert collected(co.best_phrases(df, Scratch(spark, "t"))) == by_hand(rows, 100)


def test_empty_table_and_nothing_frequent(spark):
    assert co.best_phrases(spark.createDataFrame([], "lang string, text string"), Scratch(spark, "t")).collect() == []
    assert co.best_phrases(spark.createDataFrame([("en", "one two three")], "lang string, text string"), Scratch(spark, "t")).collect() == []


def test_dense_tiles_and_coordinates_agree():
    rng = np.random.default_rng(4)
    x, y = (np.minimum(rng.geometric(0.0005, 50_000), 30_000).astype(np.int64) for _ in range(2))
    for least in (1, 500, 1 << 30):
        keys, counts, code = co.tiled(x, y, least)
        cell = keys & 0x3FFFFF
        pair = ((keys >> 42) * co.SIDE + (cell >> co.BITS)) << 32 | ((keys >> 22 & 0xFFFFF) * co.SIDE + (cell & (co.SIDE - 1)))
        assert (pair[code - 1] == x << 32 | y).all()
        pairs, want = np.unique(x << 32 | y, return_counts=True)
        order = np.argsort(pair)
        assert (pair[order] == pairs).all() and (counts[order] == want).all()
        tiles = keys >> 22
        starts = np.flatnonzero(np.r_[True, tiles[1:] != tiles[:-1]])
        assert len(np.unique(tiles)) == len(starts) and all((np.diff(part) > 0).all() for part in np.split(cell, starts[1:]))


def test_a_tile_turns_dense(monkeypatch):
    monkeypatch.setattr(co, "DENSE_CELLS", 1000)
    rng, tile, want = np.random.default_rng(5), co.Tile(), Counter()
    for _ in range(20):
        cells = rng.choice(co.SIDE * 2, 300, replace=False).astype(np.uint32)
        counts = rng.integers(1, 1 << 40, 300)
        tile.add(cells, counts)
        for c, n in zip(cells.tolist(), counts.tolist(), strict=True):
            want[c] += n
    assert tile.dense is not None
    cells, counts = tile.sums()
    assert dict(zip(cells.tolist(), counts.tolist(), strict=True)) == dict(want)


def test_scores_past_64_bits(spark):
    a, n, left, right = 7 * 10**11 + 3, 9 * 10**12 + 7, 8 * 10**11 + 1, 9 * 10**11 + 11
    df = spark.range(1).select(F.lit(a).alias("f"), F.lit(n).alias("n"), F.array(F.lit(left), F.lit(a)).alias("pf"), F.array(F.lit(right), F.lit(a)).alias("sf"))
    assert df.select(co._cut(1, 2).alias("c")).first().c.score == 1000 * a * n // (left * right)
