"""Quality rules as a short-circuit cascade: cost and selectivity from a sample decide the order of the rules.

Null text counts as no words, which fails the rule for short texts; an empty table gives an empty result; equal
rows get equal results; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import BLANK_RUN, BLANKS, Scratch, query, table


def words(text: Column) -> Column:
    """The words of a text: runs of anything but blanks."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def symbols(text: Column) -> Column:
    return F.coalesce(F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", "")), F.lit(0)).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines that hold a word and equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    return F.transform(F.array(lines), lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"))[0]


def with_repeats(df: DataFrame, words_col: str, out: str, window: int = 8) -> DataFrame:
    """Adds the number of words that lie in a window of `window` words found twice or more in the row.

    Windows are hashed by doubling. Only where two hashes are equal are windows sorted, and then the words
    themselves are compared, so the number is exact."""
    if window & (window - 1):
        raise ValueError("the window is a power of two")
    h = df.withColumn("_h", F.transform(words_col, lambda w: F.xxhash64(w)))
    step = 1
    while step < window:
        ahead = F.slice("_h", step + 1, F.greatest(F.size("_h") - step, F.lit(0)))
        h = h.withColumn("_h", F.zip_with(F.slice("_h", 1, F.greatest(F.size("_h") - step, F.lit(0))), ahead, lambda a, b: F.xxhash64(a, b)))
        step *= 2
    h = h.withColumn("_twice", F.size(F.array_distinct("_h")) < F.size("_h"))
    # in order of hash, then place
    order = F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    h = h.withColumn("_s", F.when(F.col("_twice"), order))
    same = lambda x, y: (x["h"] == y["h"]) & (F.slice(words_col, x["i"] + 1, window) == F.slice(words_col, y["i"] + 1, window))
    n = F.size("_s")
    at = lambda k: F.element_at("_s", k)
    found = F.filter("_s", lambda x, k: ((k > 0) & same(x, at(F.greatest(k, F.lit(1))))) | ((k < n - 1) & same(x, at(F.least(k + 2, n)))))
    h = h.withColumn("_p", F.when(F.col("_twice"), F.sort_array(F.transform(found, lambda x: x["i"]))))
    # each place adds the words up to the next place, or a whole window
    gaps = F.zip_with(
        F.slice("_p", 1, F.greatest(F.size("_p") - 1, F.lit(0))),
        F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0))),
        lambda a, b: F.least(b - a, F.lit(window)),
    )
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g) + window
    return h.withColumn(out, F.when(F.col("_twice") & (F.size("_p") > 0), covered).otherwise(F.lit(0).cast("long"))).drop("_h", "_twice", "_s", "_p")


@dataclass(frozen=True)
class Rule:
    """`rejects` is true for a text to reject; `needs` names the measures it reads."""

    name: str
    needs: tuple[str, ...]
    rejects: Column


#: Of the measures below. Each limit is a parameter of the rule list that a caller may replace.
def default_rules() -> list[Rule]:
    n, chars = F.col("n_words"), F.col("word_chars")
    return [
        Rule("few_words", ("n_words",), n < 20),
        Rule("repeated_windows", ("n_words", "n_repeat_words"), 100 * F.col("n_repeat_words") > 30 * n),
        Rule("symbols", ("n_words", "n_symbols"), 10 * F.col("n_symbols") > n),
        Rule("duplicate_lines", ("n_lines", "n_dup_lines"), (F.col("n_dup_lines") >= 3) & (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))),
        Rule("stutter", ("n_words", "n_stutter"), 10 * F.col("n_stutter") > 3 * n),
        Rule("word_length", ("n_words", "word_chars"), (chars < 2 * n) | (chars > 15 * n)),
        Rule("no_letters", ("n_letters", "word_chars"), 2 * F.col("n_letters") < chars),
    ]


def _with_words(docs: DataFrame, text_col: str) -> DataFrame:
    """The row as one struct, its text, and its words."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), docs[f"`{text_col}`"].alias("_t")).withColumn("_w", words(F.col("_t")))


def _measure(df: DataFrame, name: str) -> DataFrame:
    """Adds one measure of (_t, _w)."""
    if name == "n_repeat_words":
        return with_repeats(df, "_w", name)
    given = {
        "n_words": lambda: F.size("_w").cast("long"),
        "word_chars": lambda: F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": lambda: symbols(F.col("_t")),
        "n_dup_lines": lambda: duplicate_lines(F.col("_t")),
        "n_lines": lambda: F.size(F.filter(F.split(F.coalesce("_t", F.lit("")), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))).cast("long"),
        "n_stutter": lambda: F.size(F.filter("_w", lambda x, i: (i > 0) & (x == F.element_at("_w", F.greatest(i, F.lit(1)))))).cast("long"),
        "n_letters": lambda: F.length(F.regexp_replace(F.coalesce("_t", F.lit("")), "\\P{L}+", "")).cast("long"),
    }
    return df.withColumn(name, given[name]())


def _measure_all(df: DataFrame, names: list[str]) -> DataFrame:
    for name in names:
        df = _measure(df, name)
    return df


def cascade_order(docs: DataFrame, text_col: str, rules: list[Rule], sample_rows: int = 2000, seed: int = 7) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) in the order of rejections per second, most first, on about `sample_rows`
    rows drawn from the whole table. The sample decides an order, never a verdict."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    total = docs.count()
    if not total:
        return [(rule, 0.0, 0.0) for rule in rules]
    text = docs.select(docs[f"`{text_col}`"].alias("_t")).sample(min(1.0, sample_rows / total), seed)
    sample = scratch.write(text.withColumn("_w", words(F.col("_t"))), "sample")
    out = []
    for rule in rules:
        frame = _measure_all(sample, list(rule.needs))
        once = frame.agg(F.count("*").alias("n"), F.count(F.when(rule.rejects, 1)).alias("k"))
        once.first()  # compiled before it is timed
        began = time.perf_counter()
        got = once.first()
        out.append((rule, time.perf_counter() - began, got["k"] / max(got["n"], 1)))
    scratch.drop(sample)
    return sorted(out, key=lambda x: (-x[2] / max(x[1], 1e-4), x[0].name))


def judged(df: DataFrame, ordered: list[Rule], done: tuple[str, ...] = ()) -> DataFrame:
    """Adds `_kept` to rows of (_t, _w): the cascade stops at the first rule that rejects.

    A measure is computed only for rows that no earlier rule has rejected: it stands under a CASE."""
    have, df = set(done), df.withColumn("_kept", F.lit(True))
    for rule in ordered:
        todo = [m for m in rule.needs if m not in have]
        for name in todo:
            # words and text of rejected rows are hidden, which leaves nothing to measure
            gated = df.withColumnsRenamed({"_w": "_w0", "_t": "_t0"}).withColumns({"_w": F.when(F.col("_kept"), F.col("_w0")).otherwise(F.array().cast("array<string>")), "_t": F.when(F.col("_kept"), F.col("_t0"))})
            df = _measure(gated, name).drop("_w", "_t").withColumnsRenamed({"_w0": "_w", "_t0": "_t"})
            have.add(name)
        df = df.withColumn("_kept", F.col("_kept") & ~F.coalesce(rule.rejects, F.lit(False)))
    return df


def quality_filter(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, sample_rows: int = 2000) -> DataFrame:
    """The rows that every rule accepts, with their own columns. A row that a rule rejects does not reach the next."""
    rules = default_rules() if rules is None else rules
    df, have = _with_words(docs, text_col), set()
    for rule, _, _ in cascade_order(docs, text_col, rules, sample_rows):
        df = _measure_all(df, [m for m in rule.needs if m not in have])
        have |= set(rule.needs)
        # a verdict that is generated stands apart: as a plain filter it would be rewritten in terms of the text, with
        # every measure spelled out as often as it is mentioned
        df = df.withColumn("_ok", F.explode(F.array(~F.coalesce(rule.rejects, F.lit(False))))).filter("_ok").drop("_ok")
    return df.select("_row.*")


def quality_report(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, sample_rows: int = 2000) -> DataFrame:
    """Each row (as struct `row`) with the base measures, `base_failed` and `kept`. The base measures are wanted for
    every row, so they come first; the cascade runs the other rules only on rows whose base is right."""
    rules = default_rules() if rules is None else rules
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    df = _measure_all(_with_words(docs, text_col), base)
    df = df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    ordered = [rule for rule, _, _ in cascade_order(docs, text_col, rules, sample_rows)]
    df = judged(df, ordered, tuple(base))
    return df.select(F.col("_row").alias("row"), *base, "base_failed", (F.col("_kept") & ~F.col("base_failed")).alias("kept"))


_SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), grams AS (
  SELECT r, i, list_aggregate(ws[i:i + 7], 'string_agg', ' ') AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), twice AS (
  SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS j
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT r, sum(least(8, coalesce(j - i, 8))) AS n FROM twice GROUP BY r
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         len(ls) AS n_lines, len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_stutter, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS n_letters
  FROM w LEFT JOIN covered USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words
            OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines) OR 10 * n_stutter > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 2 * n_letters < word_chars) AS kept
FROM m
"""


@query("op6_quality_rules", _SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality_report(table(spark, sf_dir, "documents"))
    return report.select("row.doc_id", *[c for c in report.columns if c != "row"])
