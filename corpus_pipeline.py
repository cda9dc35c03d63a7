"""Documents to training sequences: each stage works on the rows that the one before has kept.

Every stage but the last returns the columns of documents; the last returns the pieces of all documents with their
places in sequences. Empty tables pass through; null texts are dropped by the first stage. Of repeated rows and copies the
near-dedup keeps the one of the smallest id, and of equal ids any one; later stages find no ties. Texts of any length are
handled whole. Columns beside those of documents pass through to the last stage, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Scratch
from millrace.llm.decontaminate import decontaminate
from millrace.llm.packing import pack
from millrace.llm.quality import quality_filter
from millrace.llm.repeats import remove_repeats
from millrace.llm.simhash import simhash_dedup

#: Near duplicates are looked for on shingles of this many words.
SHINGLE_WORDS = 5
#: And of this similarity of their shingle sets.
SIMILARITY = 0.8


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept."""
    return quality_filter(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: fingerprints of three bits' difference, or similar shingle sets."""
    return simhash_dedup(docs, shingle=SHINGLE_WORDS, similarity=SIMILARITY)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one of a smaller id has; `n_chars` follows the text."""
    cut = remove_repeats(docs)
    return cut.select(*[F.length("text").cast(cut.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in cut.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage, copied or paraphrased."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of at most 1024 tokens."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", drop_poor),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack_sequences),
]

#: Fingerprints, suffix orders, a decomposition and a genetic search are not SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, last = Scratch(spark, "pipeline"), None
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            scratch.drop(last)
        last = docs
    return docs
