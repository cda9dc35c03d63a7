import hashlib
import random

from pyspark.sql import functions as F

from millrace.llm.repeats import remove_repeats, repeated_spans


def brute(rows, length):
    """(removed bytes, spans, kept) by row: every string of every text looked up by itself."""
    first = {}
    key = lambda i: float("inf") if i is None else i
    for i, t in rows:
        data = (t or "").encode()
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            first[w] = min(first.get(w, float("inf")), key(i))
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            if first[data[s : s + length]] < key(i):
                gone[s : s + length] = b"\1" * length
        spans = sum(1 for p in range(len(data)) if gone[p] and (p == 0 or not gone[p - 1]))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed, n, words):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeéß ", k=rng.randint(2, 7))) for _ in range(words)]
    passages = [" ".join(rng.choices(vocabulary, k=30)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 40))) for _ in range(3)]
        parts.insert(1, rng.choice(passages))
        rows.append((i, "\n".join(parts)))
    rows += [(n, rows[0][1]), (n + 1, rows[1][1]), (n + 2, None), (n + 3, ""), (n + 4, "x" * 500), (n + 5, "ab" * 200), (None, rows[2][1]), (None, rows[2][1])]
    rows += [(n + 6, "x" * 120), (n + 7, passages[0]), (n + 7, passages[0]), (n + 8, "y" + passages[0][:70]), (-5, passages[1] * 3), (n + 9, "short")]
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    for seed, n, words, parts in ((1, 60, 200, 5), (2, 90, 6, 3), (3, 20, 3, 1)):
        rows = rows_of(seed, n, words)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        out = repeated_spans(df).select(
            "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n"), F.size("spans").alias("s"), F.sha2("kept", 256).alias("h")
        )
        assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows, 50)


def test_small_blocks_and_buckets(spark, monkeypatch):
    from millrace.llm import repeats as R
    from millrace.llm.common import Scratch

    rows = rows_of(7, 80, 30)
    df = spark.createDataFrame(rows, "id long, text string").withColumn("uid", F.lit(0)).repartition(3)
    out = R.repeats(df, Scratch(spark, "t"), block_bytes=2000, bucket_triggers=64)
    got = sorted(((r.id, r.n_bytes, sum(r.lengths), len(r.starts), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out.collect()), key=str)
    assert got == brute(rows, 50)


def test_text_is_cut_and_other_columns_stay(spark):
    passage = "Ünïque wörds of à pässage that is löng enough to be seen twice in the corpus."
    rows = [(1, "A " + passage + " B", "x"), (2, "C " + passage + " D", "y"), (3, None, "z"), (4, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, uid string").withColumn("starts", F.lit(1)).withColumn("row", F.lit("r"))
    out = remove_repeats(df)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == rows[0][1] and got[3].text is None and got[4].text == ""
    # the blanks around the passage repeat as well
    assert got[2].text == "CD" and got[2].uid == "y" and got[2].row == "r"


def test_empty_table(spark):
    assert repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
