import random

from pyspark.sql import functions as F

from millrace.llm.chat import format_conversations, read_back, under_mask


def check(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).selectExpr("*", "1 as turns", "'x' as formatted", "2 as n")
    out = format_conversations(df)
    assert out.columns == ["conv_id", "formatted", "loss_spans"]
    out = out.select("conv_id", "formatted", read_back(F.col("formatted")).alias("t"), under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r.conv_id: ([(t.role, t.text) for t in r.t], r.loss, r.formatted) for r in out.collect()}
    want = {}
    for c, k, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {c: (t, "".join(x for r, x in t if r == "assistant")) for c, t in want.items()} == {c: g[:2] for c, g in got.items()}
    return got


def test_control_strings_survive(spark):
    rng = random.Random(1)
    bits = ["<|end|>", "<|next|>", "<|role:user|>", "\\", "<", "|", ">", "<|", "|>", "\\<|", "é😀", "\n", "$1", "### Assistant: </turn>", ""]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "a|>", "\\", "<|end|>", None]), rng.choice([None, "".join(rng.choices(bits, k=rng.randint(0, 8)))])))
    check(spark, rows)


def test_adjacent_turns_are_merged(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "assistant", ""), (1, 4, "assistant", None), (1, 4, "user", "d")]
    got = check(spark, rows)
    assert got[1][2] == "<|role:user|>a<|next|>b<|end|><|role:assistant|>c<|next|><|next|><|end|><|role:user|>d<|end|>"


def test_nulls_ties_and_repeats(spark):
    rows = [(None, None, None, None), (None, 1, "assistant", "x"), (2, 1, "user", "x"), (2, 1, "user", "x"), (2, None, "assistant", "first"), (3, 5, "assistant", "y" * 100_000)]
    check(spark, rows)


def test_empty_table(spark):
    assert format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_time_grows_with_the_turns_and_not_with_their_square(spark):
    import time

    def seconds(n):
        rows = [(1, t, "user" if t % 3 == 0 else "assistant", f"turn {t} <|end|> \\ é") for t in range(n)]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        out = format_conversations(df).select("formatted", under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"))
        began = time.monotonic()
        row = out.first()
        assert row.loss == "".join(t for _, _, r, t in rows if r == "assistant")
        return time.monotonic() - began

    seconds(1000)  # code is generated
    short, long = seconds(10_000), seconds(80_000)
    assert long < 24 * max(short, 0.5), (short, long)  # a square would be 64


def test_extra_columns_of_clashing_names(spark):
    rows = [(1, 0, "user", "a", 5, "x"), (1, 1, "assistant", "b", 6, "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv long, before string").selectExpr("*", "1 as at", "2 as n", "'z' as said", "3 as turns", "4 as first")
    assert format_conversations(df).first().formatted == format_conversations(df.select("conv_id", "turn", "role", "text")).first().formatted
