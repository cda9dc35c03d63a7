import random
import re

from pyspark.sql import functions as F

from millrace.llm.quality import cascade_order, default_rules, quality_filter, quality_report

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, at = {}, [False] * len(words)
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            for i in places:
                at[i : i + 8] = [True] * 8
    n, chars, repeats = len(words), sum(map(len, words)), sum(at)
    symbols, doubles = len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
    failed = n < 20 or 100 * repeats > 30 * n
    stutter = sum(a == b for a, b in zip(words, words[1:]))
    letters = sum(c.isalpha() for c in text)
    bad = 10 * symbols > n or (doubles >= 3 and 10 * doubles > 3 * len(lines)) or 10 * stutter > 3 * n or chars < 2 * n or chars > 15 * n or 2 * letters < chars
    return n, chars, symbols, doubles, repeats, failed, not failed and not bad


def sample():
    rng = random.Random(8)
    texts = [None, "", " \n\t", "\x0b\x0c\r", "one", " lead and trail ", "a b c d e f g h " * 2, "a b c d e f g h " * 20, "x " * 300, "same line here\n" * 30, "é ü " * 30]
    for _ in range(150):
        few = [f"w{k}" for k in range(rng.choice([3, 40, 4000]))]
        sep = rng.choice([" ", "  ", "\n", "\t"])
        texts.append(sep.join(rng.choice(few) + rng.choice(["", "", "", "#", "é"]) for _ in range(rng.randint(0, 120))))
    texts.append(" ".join(f"long{i % 9000}" for i in range(20_000)))
    return list(enumerate(texts)) + [(None, texts[20]), (3, texts[20]), (3, texts[20])]


def test_report_equals_brute_force(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_words", "'x' as _w", "2 as _kept")
    out = quality_report(df)
    got = sorted(((r.row.doc_id, *tuple(r)[1:]) for r in out.collect()), key=str)
    assert got == sorted(((i, *plain(t)) for i, t in rows), key=str)


def test_filter_is_the_same_verdict(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_words", "'x' as _t")
    out = quality_filter(df)
    assert out.columns == df.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(str((i, t)) for i, t in rows if plain(t)[-1])


def test_order_is_by_rejections_per_cost(spark):
    df = spark.createDataFrame(sample(), "doc_id long, text string")
    told = cascade_order(df, "text", default_rules(), sample_rows=100)
    worth = [share / max(cost, 1e-4) for _, cost, share in told]
    assert worth == sorted(worth, reverse=True) and len(told) == len(default_rules())


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert quality_report(df).count() == 0 and quality_filter(df).withColumn("x", F.lit(1)).count() == 0
