"""Toxicity scores: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Labelled texts (at most `train_rows`, drawn by a hash of the id over the whole table) give, for each n-gram, how many
toxic and how many other texts have it. The n-grams that tell the classes apart most, by their likelihood ratio, are
kept; a text's feature is 1 or 0 for having it, times the log ratio of its smoothed shares. A logistic regression is
trained on these and scores every whole text, in one pass without a shuffle.

A null text is scored like an empty one. Labels may repeat: a text is toxic if any of its rows says so; null labels and
labels without a text are left out. Without labels of both classes the score is the smoothed share of toxic ones.
Repeated rows get equal scores. Texts are read whole, a piece at a time. Empty tables give no rows. Other columns are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, packed, query, rows_of, table, unpacked

SIZES = (4, 5, 6)
BITS, PARTS = 22, 64
_CODES = np.random.default_rng(606).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: ASCII capitals in lower case, ASCII white space as a blank.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def grams(text: bytes | None, piece: int = 1 << 16) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of a text between blanks, in parts."""
    data = np.frombuffer(b" " + (text or b"").translate(_PLAIN) + b" ", np.uint8)
    most = SIZES[-1]
    for at in range(0, len(data), piece):
        codes = _CODES[data[at : at + piece + most - 1]]
        h = codes
        for n in range(2, most + 1):
            if len(h) < 2:
                break
            h = h[:-1] * _STEP + codes[n - 1 :]
            if n in SIZES:
                out = h[:piece] ^ (h[:piece] >> np.uint64(31))
                yield out * _STEP


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of each class have each n-gram, as a task has seen them; a row for each part of the hashes."""
    counts = np.zeros((2, 1 << BITS), np.uint32)
    for batch in rows_of(batches):
        for text, toxic in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = [_bucket(h) for h in grams(text)]
            if found:
                counts[toxic, np.unique(np.concatenate(found))] += 1
    size = (1 << BITS) // PARTS
    parts = list(range(PARTS))
    columns = [pa.array([packed(counts[c, k * size : (k + 1) * size]) for k in parts], pa.binary()) for c in (0, 1)]
    yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *columns], names=["part", "others", "toxic"])


def _best(n_others: int, n_toxic: int, most: int, least_texts: int):
    """Of one part: the n-grams whose likelihood ratio statistic is the largest, with their log-count ratio."""

    def run(group: pa.Table) -> pa.Table:
        q, p = (sum(unpacked(x, np.uint32).astype(np.int64) for x in group[c].to_pylist()) for c in ("others", "toxic"))
        at = np.flatnonzero(p + q >= least_texts)
        p, q = p[at], q[at]
        ratio = np.log((p + 1) / (n_toxic + 2)) - np.log((q + 1) / (n_others + 2))
        share = (p + q) / (n_toxic + n_others)

        def surprise(k: np.ndarray, n: int) -> np.ndarray:
            with np.errstate(divide="ignore", invalid="ignore"):
                return np.where(k > 0, k * np.log(k / (n * share)), 0) + np.where(k < n, (n - k) * np.log((n - k) / (n * np.maximum(1 - share, 1e-12))), 0)

        strength = surprise(p, n_toxic) + surprise(q, n_others)
        best = np.argsort(-strength, kind="stable")[:most]
        bucket = group["part"][0].as_py() * ((1 << BITS) // PARTS) + at[best]
        return pa.table({"bucket": pa.array(bucket, pa.int64()), "ratio": ratio[best], "strength": strength[best]})

    return run


class Features:
    """The kept n-grams; `of` gives the numbers of those that a text has."""

    def __init__(self, buckets: np.ndarray):
        self.buckets = buckets
        self.number: np.ndarray | None = None

    def __getstate__(self):  # tasks build the table themselves
        return {"buckets": self.buckets, "number": None}

    def of(self, text: bytes | None) -> np.ndarray:
        if self.number is None:
            self.number = np.zeros(1 << BITS, np.uint16)
            self.number[self.buckets] = np.arange(1, len(self.buckets) + 1)
        found = [x[x > 0] for x in (self.number[_bucket(h)] for h in grams(text))]
        return np.unique(np.concatenate(found)).astype(np.int32) - 1 if found else np.empty(0, np.int32)


@dataclass
class Model:
    features: Features
    weights: np.ndarray
    bias: float

    def score(self, text: bytes | None) -> float:
        z = self.bias + float(self.weights[self.features.of(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _featured(features: Features):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            rows = [packed(features.of(x)) for x in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1)], names=["features", "toxic"])

    return run


def logistic(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, penalty: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights (ratios included) and bias, by Nesterov's accelerated gradient steps."""
    n, sizes = len(rows), np.array([len(r) for r in rows])
    column, row = np.concatenate(rows).astype(np.int64), np.repeat(np.arange(n), sizes)
    value = ratios[column]
    share = (y.sum() + 1) / (n + 2)
    w, bias = np.zeros(len(ratios)), float(np.log(share / (1 - share)))
    # a bound of the curvature by power steps on X'X
    v = np.ones(len(ratios))
    for _ in range(12):
        v = np.bincount(column, value * np.bincount(row, value * v[column], n)[row], len(ratios))
        norm = float(np.linalg.norm(v)) or 1.0
        v /= norm
    step = 1 / (0.25 * (norm + n) / n + penalty)
    last, last_bias = w.copy(), bias
    for k in range(rounds):
        ahead = k / (k + 3)
        at, at_bias = w + ahead * (w - last), bias + ahead * (bias - last_bias)
        z = np.bincount(row, value * at[column], n) + at_bias
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        gradient = np.bincount(column, value * error[row], len(ratios)) + penalty * at
        last, last_bias = w, bias
        w, bias = at - step * gradient, at_bias - step * float(error.sum())
    return w * ratios, bias


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = 20_000, most_features: int = 4096, least_texts: int = 5, penalty: float = 1e-4, rounds: int = 300) -> Model:
    """A model from at most `train_rows` labelled texts; the driver gets their kept features, no text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    given = labels.select(labels[f"`{id_col}`"].alias("id"), labels[f"`{label_col}`"].cast("int").alias("toxic")).filter("id IS NOT NULL AND toxic IN (0, 1)")
    chosen = given.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(train_rows)
    chosen = scratch.write(chosen, "labels")
    texts = docs.select(docs[f"`{id_col}`"].alias("id"), F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit("")).alias("text"))
    # at most train_rows ids with a label; of repeated ids one text
    found = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")
    rows = scratch.write(found, "texts")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    others, toxic = n.get(0, 0), n.get(1, 0)
    prior = float(np.log((toxic + 1) / (others + 1)))
    if not others or not toxic:
        return Model(Features(np.empty(0, np.int64)), np.empty(0), prior)
    counted = rows.mapInArrow(_counts, "part int, others binary, toxic binary")
    best = counted.groupBy("part").applyInArrow(_best(others, toxic, most_features, least_texts), "bucket long, ratio double, strength double")
    best = best.orderBy(F.desc("strength"), "bucket").limit(most_features).collect()  # bounded by most_features
    if not best:
        return Model(Features(np.empty(0, np.int64)), np.empty(0), prior)
    features = Features(np.array([r["bucket"] for r in best], np.int64))
    told = rows.mapInArrow(_featured(features), "features binary, toxic int").collect()  # bounded by train_rows
    weights, bias = logistic([unpacked(r["features"], np.int32) for r in told], np.array([r["toxic"] for r in told], float), np.array([r["ratio"] for r in best]), penalty, rounds)
    return Model(features, weights, bias)


def with_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            scores = [model.score(x) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    narrow = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text_col}`"].cast("string").alias("text"))
    return narrow.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(-1))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(fold(F.col("doc_id")) != 2))
    scored = with_scores(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
