import random

import numpy as np

from millrace.llm.toxicity import SIZES, Features, grams, logistic, train, with_scores


def corpus(n, seed):
    rng = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "é", "ü"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    bad = ["Scumbag", "idiotic", "Moronic", "saleté"]
    rows = []
    for i in range(n):
        words, toxic = [word() for _ in range(rng.randint(5, 200))], int(rng.random() < 0.2)
        for _ in range(toxic * rng.randint(1, 4)):
            words.insert(rng.randint(0, len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), toxic if rng.random() > 0.02 else 1 - toxic, toxic))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(1500, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4).selectExpr("*", "1 as toxic", "'q' as id", "2 as score")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 1000] + [(3, None), (None, 1), (99999, 1)], "doc_id long, toxic int")
    model = train(docs, labels)
    got = {r.doc_id: r.score for r in with_scores(docs, model).collect()}
    held = [r for r in rows if r[0] >= 1000]
    right = sum((got[r[0]] >= 0.3) == bool(r[3]) for r in held)
    assert right >= 0.97 * len(held) and all(0 <= s <= 1 for s in got.values())


def test_grams_equal_slices():
    text = ("Ab\tc dÉ" * 30).encode()
    plain = b" " + text.replace(b"\t", b" ").replace(b"A", b"a") + b" "
    slices = {n: [plain[i : i + n] for i in range(len(plain) - n + 1)] for n in SIZES}
    whole = list(grams(text))
    assert [len(h) for h in whole] == [len(slices[n]) for n in SIZES]
    for h, n in zip(whole, SIZES, strict=True):
        of = {}
        for x, s in zip(h.tolist(), slices[n], strict=True):
            assert of.setdefault(x, s) == s
        assert len(of) == len(set(slices[n]))
    in_pieces = list(grams(text, piece=16))
    for k, n in enumerate(SIZES):
        assert {x for h in in_pieces for x in h.tolist()} >= set(whole[k].tolist())
    assert sum(map(len, in_pieces)) == sum(map(len, whole))


def test_logistic_separates():
    rows = [np.array([0, 2]), np.array([1]), np.array([0]), np.array([1, 2]), np.empty(0, int)] * 20
    y = np.array([1, 0, 1, 0, 0] * 20, float)
    w, b = logistic(rows, y, np.array([2.0, -2.0, 0.1]), 1e-4, 300)
    assert all((b + w[r].sum() > 0) == t for r, t in zip(rows, y, strict=True))


def test_nulls_repeats_and_missing_classes(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "x"), (3, "a" * 300_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, toxic int")
    for given in (labels, labels.limit(0)):
        got = with_scores(docs, train(docs, given)).collect()
        assert len(got) == 5 and len({r.score for r in got}) == 1
    both = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    assert with_scores(docs, train(docs, both, least_texts=1)).count() == 5
    assert with_scores(docs.limit(0), train(docs.limit(0), labels)).count() == 0


def test_features_are_distinct():
    h = np.concatenate(list(grams(b"abcdef")))
    buckets = np.unique((h >> np.uint64(42)).astype(np.int64))
    got = Features(buckets).of(b"abcdef abcdef")
    assert sorted(got.tolist()) == list(range(len(buckets)))
