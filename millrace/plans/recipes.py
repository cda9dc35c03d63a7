"""Documented analytics recipes as functions over frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import ladder, ratio
from millrace.operators.ordering import numbered


def pinned(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Select and cast, so that later stages see fixed types whatever the source sends."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items()])


def grouped_kpis(df: DataFrame, group: str, total: Column, part: Column, whole: Column) -> DataFrame:
    """Rows, rounded total and average percentage per group, largest total first."""
    return (
        df.where(F.col(group).isNotNull())
        .groupBy(group)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.sum(total), 2).alias("total"),
            F.round(F.avg(ratio(part, whole)) * 100, 1).alias("avg_pct"),
        )
        .orderBy(F.desc("total"))
    )


def zscores(df: DataFrame, column: str, name: str = "z") -> DataFrame:
    """Distance from the mean in standard deviations. The two statistics are one scalar subquery, so the
    rows are scanned twice but never moved."""
    value = F.col(f"`{column}`")
    stats = df.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return df.withColumn(name, ratio(value - stats.select("mean").scalar(), stats.select("sd").scalar()))


def outliers(df: DataFrame, z: str = "z", limit: float = 3.0) -> DataFrame:
    return df.where(F.abs(F.col(z)) > limit)


def rate_bucket(df: DataFrame, numerator: str, denominator: str, steps: Sequence[tuple[float, str]], above: str) -> DataFrame:
    rate = ratio(F.col(numerator), F.col(denominator))
    return df.withColumn("rate", rate).withColumn("bucket", ladder(F.col("rate"), steps, above))


def share_of_total(df: DataFrame, group: str, value: Column) -> DataFrame:
    """Each group's sum and its percentage of the whole."""
    groups = df.groupBy(group).agg(F.sum(value).alias("amount"))
    whole = df.agg(F.sum(value)).scalar()
    return groups.withColumn("share_pct", F.round(F.col("amount") * 100 / whole, 2))


def ranked_batch(df: DataFrame, batch: str, score: str, unique: str) -> DataFrame:
    """Rank by score inside each batch; one batch may be any share of the data."""
    return numbered(df, [batch], [F.desc(score), F.asc(unique)], "rank")


def top_groups(df: DataFrame, group: str, n: int, name: str = "n") -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), F.asc(group)).limit(n)
