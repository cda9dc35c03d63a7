import random

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import decontaminate as dc
from millrace.llm.decontaminate import Items, benchmark_leaks, common_subsequence, decontaminate, passages, unit, words_of


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], max(row[k], row[k - 1], last + 1 if x == y else 0)
    return row[-1]


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghiklmnorstu", k=rng.randint(3, 8))) for _ in range(3000)]
    common = ["the", "of", "and", "to", "in", "a"]
    prose = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(prose(rng.randint(15, 60)))) for i in range(40)]
    docs = []
    for i in range(300):
        text = prose(rng.randint(0, 400))
        if i % 10 == 0:  # exact
            text[len(text) // 2 : len(text) // 2] = items[i % 40][1].split()
        elif i % 10 == 1:  # paraphrased: some words replaced, some left out
            near = [w if rng.random() > 0.12 else rng.choice(words) for w in items[i % 40][1].split() if rng.random() > 0.08]
            text[len(text) // 2 : len(text) // 2] = near
        docs.append((i, " ".join(text)))
    return docs, items


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(0, 40))] for _ in range(2))
        assert common_subsequence(a, b) == plain_lcs(a, b)


def test_passages_equal_a_plain_loop():
    rng = np.random.default_rng(2)
    rows = [rng.integers(-1, 9, n) for n in (0, 3, 64, 65, 96, 97, 200, 1)]
    passage, term, text, start = passages(rows, 64, 32, 9)
    got = {(int(text[p]), int(start[p]), int(t)) for p, t in zip(passage, term, strict=True)}
    want = set()
    for k, row in enumerate(rows):
        starts = {s for s in range(0, max(len(row) - 32, 1), 32)}
        want |= {(k, s, int(t)) for s in starts for t in row[s : s + 64] if t >= 0}
        assert not len(row) or max(starts) + 64 >= len(row)
    assert got == want


def test_finds_copies_and_paraphrases_and_nothing_else(spark):
    docs, items = corpus()
    extra = [(1000, None), (1001, ""), (1002, docs[0][1]), (1002, docs[0][1])]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string")
    bench = spark.createDataFrame(items + [(90, None), (91, "..."), (92, items[0][1])], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in benchmark_leaks(df, bench).collect()}
    want = {(i, i % 40) for i in range(300) if i % 10 in (0, 1)} | {(i, 92) for i in range(300) if i % 10 in (0, 1) and i % 40 == 0} | {(1002, 0), (1002, 92)}
    assert got == want


def test_recall_of_the_latent_search(spark):
    """Against brute force over plain TF-IDF cosines of passages and items."""
    docs, items = corpus()
    block = Items(items, 64, 32)
    rows = [np.array([block.terms.get(w, -1) for w in words_of(t)]) for _, t in docs]
    n = len(block.terms)
    df = np.zeros(n)
    for r in rows:
        df[np.unique(r[r >= 0])] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 0.1
    passage, term, text, _ = passages(rows, 64, 32, n)
    a, b = np.zeros((len(text), n)), np.zeros((int(block.passage.max()) + 1, n))
    a[passage, term], b[block.passage, block.term] = idf[term], idf[block.term]
    close = unit(a) @ unit(b).T >= 0.5
    want = {(int(text[p]), int(block.owner[k])) for p, k in zip(*np.nonzero(close), strict=True)}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in benchmark_leaks(frame, bench, min_share=0.0, answer_share=0.0, rank=32).collect()}
    assert len(want) > 50 and len(want & got) >= 0.9 * len(want)


def test_filter_keeps_columns_and_clean_rows(spark):
    docs, items = corpus()
    df = spark.createDataFrame(docs + [(7, docs[0][1]), (8, None)], "doc_id long, text string").withColumn("uid", F.lit("u")).withColumn("row", F.lit(None).cast("int"))
    out = decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), block_items=17)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted([i for i in range(300) if i % 10 > 1] + [8])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "some words of an item")], "item_id long, text string")
    assert benchmark_leaks(none, bench).count() == 0
    some = spark.createDataFrame([(1, "some words of an item")], "doc_id long, text string")
    assert benchmark_leaks(some, bench.limit(0)).count() == 0 and decontaminate(some, bench.limit(0)).count() == 1


def test_items_planted_once_are_found_at_defaults(spark):
    """Among rows that outweigh the items: copies, and light paraphrases; short items apart."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghiklmnorstu", k=7)) for _ in range(4000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(15, 20) if i % 2 else rng.randint(30, 60)))) for i in range(200)]
    docs = [(i, rng.choices(words, k=300)) for i in range(1500)]
    for i, item in items:
        docs[i][1][100:100] = item.split()
        docs[500 + i][1][100:100] = [rng.choice(words) if rng.random() < 0.15 else w for w in item.split() if rng.random() > 0.1]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in benchmark_leaks(frame, bench, answer_share=0.0).collect()}
    assert all((i, i) in got for i, _ in items)
    for short in (0, 1):
        true = [(500 + i, i) for i, t in items if i % 2 == short and common_subsequence(t.split(), docs[500 + i][1]) >= 0.6 * len(t.split())]
        assert len(set(true) & got) >= 0.97 * len(true)


def test_the_basis_is_fitted_on_every_row(spark, monkeypatch):
    seen, fit = [], dc.latent_basis
    monkeypatch.setattr(dc, "latent_basis", lambda texts, *rest: seen.append(texts.count()) or fit(texts, *rest))
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text "), F.col("id") % 50).alias("text"))
    bench = spark.createDataFrame([(1, "the words of an item about some text")], "item_id long, text string")
    benchmark_leaks(docs, bench).count()
    assert seen == [6000]
