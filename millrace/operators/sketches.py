"""Sketches that are kept and merged: profiles of batches folded into a table's, and re-aggregable distinct counts.

A batch is sketched once, when it is written. What a longer period or the whole table has is then a merge of a few small
binary values, and never a scan of the rows again. Quantiles come from KLL sketches, whose error is a share of the rows
in rank (about 1.4 % for the default size), distinct counts from HLL sketches, and counts of people in several sets at
once from theta sketches, which know intersections (a standard error of 1.6 % of the union for 4,096 entries; exact below
that).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of a theta sketch, as a power of 2.
THETA_BITS = 12
QUANTILES = {"p50": 0.5, "p95": 0.95}


def _end(value: str, kind: str, largest: bool) -> Column:
    """The least or greatest of values kept as text, in the order of their type."""
    number = F.col("column_type").rlike("^(tinyint|smallint|int|bigint|float|double|decimal)")
    by = F.max_by if largest else F.min_by
    plain = F.max if largest else F.min
    exact = F.when(number & ~F.col("column_type").isin("float", "double"), F.col(value).try_cast("decimal(38,10)"))
    # an order for values only: a batch without any has none
    order = F.when(number & F.col(value).isNotNull(), F.struct(exact, F.col(value).try_cast("double")))
    of_number = by(F.when(number, F.col(value)), order)
    return F.coalesce(F.when(F.bool_or(number), of_number), plain(F.when(~number, F.col(value)))).alias(kind)


def folded_profile(sketches: DataFrame, by: Sequence[str] = ("column_name",), quantiles: Mapping[str, float] = QUANTILES) -> DataFrame:
    """The profile of everything that was sketched, from rows of `column_profile(..., sketches=True)`: one row for each
    `by`. Counts and ends are exact; approx_count_distinct and the quantiles are within the sketches' errors."""
    merged = sketches.groupBy(*by).agg(
        F.max("column_type").alias("column_type"), F.sum("row_count").alias("row_count"), F.sum("null_count").alias("null_count"),
        _end("min_value", "min_value", False), _end("max_value", "max_value", True),
        F.hll_union_agg("distinct_sketch").alias("_distinct"), F.kll_merge_agg_double("quantile_sketch").alias("_quantiles"),
        F.count("distinct_sketch").alias("_with_values"), F.count("quantile_sketch").alias("_with_numbers"),
    )
    share = F.when(F.col("row_count") > 0, F.col("null_count") / F.col("row_count")).otherwise(0.0)
    told = [F.when(F.col("_with_numbers") > 0, F.kll_sketch_get_quantile_double("_quantiles", F.lit(q))).alias(f"approx_{n}") for n, q in quantiles.items()]
    distinct = F.when(F.col("_with_values") > 0, F.hll_sketch_estimate("_distinct")).otherwise(0)
    return merged.select(*by, "column_type", "row_count", "null_count", share.alias("null_pct"), distinct.alias("approx_count_distinct"), "min_value", "max_value", *told)


def table_profile(stats: DataFrame) -> DataFrame:
    """The profile of each table now, folded from its `column_stats` rows: the newest one that covers the whole table and
    those of the batches after it. Batches of merges count updated rows as rows."""
    keys = ["table_identifier", "column_name"]
    whole = stats.where("scope = 'table'").groupBy(*keys).agg(F.max("snapshot_id").alias("_whole"))
    since = stats.join(whole, keys, "left").where("_whole IS NULL OR snapshot_id >= _whole")
    return folded_profile(since, keys)


# -- people in several sets


def audience(df: DataFrame, by: Sequence[str | Column], who: str | Column, sets: Mapping[str, Column], bits: int = THETA_BITS) -> DataFrame:
    """A theta sketch of who is in each set, for each `by`. `sets` are conditions by name; nobody is an empty sketch."""
    person = F.col(who) if isinstance(who, str) else who
    return df.groupBy(*by).agg(*[F.theta_sketch_agg(F.when(condition, person), F.lit(bits)).alias(name) for name, condition in sets.items()])


def audience_over(sketches: DataFrame, by: Sequence[str | Column], names: Sequence[str], bits: int = THETA_BITS) -> DataFrame:
    """The sketches of longer periods or wider groups, from those of shorter ones."""
    return sketches.groupBy(*by).agg(*[F.theta_union_agg(n, F.lit(bits)).alias(n) for n in names])


def how_many(sketch: str | Column) -> Column:
    return F.theta_sketch_estimate(sketch)


def in_both(first: str | Column, second: str | Column) -> Column:
    """How many are in both sets."""
    return F.theta_sketch_estimate(F.theta_intersection(first, second))


def in_first_only(first: str | Column, second: str | Column) -> Column:
    return F.theta_sketch_estimate(F.theta_difference(first, second))
