"""Column profiles: one aggregation for the facts, one for the frequent values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from millrace.operators.ordering import latest_per_key, top_per_group
from millrace.session import freeze

# When frequent values are listed, and how many.
TOP_MAX_DISTINCT = 1000
TOP_VALUES = 10
TOP_MAX_COLUMNS = 20
#: Size of KLL sketches; the rank error of 200 is about 1.4 %.
KLL_SIZE = 200


def _facts(df: DataFrame, columns: Sequence[str], sketches: bool = False) -> list[Column]:
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(columns):
        column = F.col(f"`{name}`")
        aggs += [
            F.count_if(column.isNull()).alias(f"nulls{i}"),
            F.approx_count_distinct(column).alias(f"distinct{i}"),
            F.min(column).cast("string").alias(f"min{i}"),
            F.max(column).cast("string").alias(f"max{i}"),
        ]
        if isinstance(df.schema[name].dataType, NumericType):
            aggs.append(F.percentile_approx(column.cast("double"), [0.5, 0.95]).alias(f"pct{i}"))
            if sketches:
                aggs.append(F.kll_sketch_agg_double(column.cast("double"), F.lit(KLL_SIZE)).alias(f"kll{i}"))
        if sketches:
            aggs.append(F.hll_sketch_agg(column.cast("string")).alias(f"hll{i}"))
    return aggs


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, sketches: bool = False) -> DataFrame:
    """One row per column: rows, nulls and their share, approximate distinct count, least and greatest
    value as text, approximate median and 95th percentile of numbers. All columns in a single pass. On demand with
    `distinct_sketch` (HLL) and `quantile_sketch` (KLL, of numbers), NULL without a value, which `folded_profile` merges."""
    names = list(columns or df.columns)
    no_number = F.lit(None).cast("double")
    rows = []
    for i, name in enumerate(names):
        numeric = isinstance(df.schema[name].dataType, NumericType)
        pct = F.col(f"pct{i}") if numeric else None
        share = F.when(F.col("rows") > 0, F.col(f"nulls{i}") / F.col("rows")).otherwise(0.0)
        rows.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.lit(df.schema[name].dataType.simpleString()).alias("column_type"),
                F.col("rows").alias("row_count"),
                F.col(f"nulls{i}").alias("null_count"),
                share.cast("double").alias("null_pct"),
                F.col(f"distinct{i}").alias("approx_count_distinct"),
                F.col(f"min{i}").alias("min_value"),
                F.col(f"max{i}").alias("max_value"),
                (pct[0] if numeric else no_number).alias("approx_p50"),
                (pct[1] if numeric else no_number).alias("approx_p95"),
                *(_kept_sketches(i, numeric) if sketches else []),
            )
        )
    return df.agg(*_facts(df, names, sketches)).select(F.inline(F.array(*rows)))


def _kept_sketches(i: int, numeric: bool) -> list[Column]:
    some = F.col(f"nulls{i}") < F.col("rows")
    quantiles = F.when(some, F.col(f"kll{i}")) if numeric else F.lit(None).cast("binary")
    return [F.when(some, F.col(f"hll{i}")).alias("distinct_sketch"), quantiles.alias("quantile_sketch")]


def listable_columns(df: DataFrame, max_distinct: int = TOP_MAX_DISTINCT, max_columns: int | None = TOP_MAX_COLUMNS, profile: DataFrame | None = None) -> list[str]:
    """The columns with few enough distinct values to list, the first `max_columns` of them (None: all). A profile
    of the frame, if given, spares the scan; one small row or one for each column comes back."""
    plain = [c for c, t in df.dtypes if not t.startswith(("array", "map", "struct", "binary"))]
    if not plain:
        return []
    if profile is not None:
        found = {r["column_name"]: r["approx_count_distinct"] for r in profile.select("column_name", "approx_count_distinct").collect()}
    else:
        row = df.agg(*[F.approx_count_distinct(f"`{c}`").alias(f"d{i}") for i, c in enumerate(plain)]).first()
        found = {c: row[f"d{i}"] for i, c in enumerate(plain)}
    return [c for c in plain if 0 < found[c] <= max_distinct][:max_columns]


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = TOP_VALUES, max_distinct: int = TOP_MAX_DISTINCT, max_columns: int | None = TOP_MAX_COLUMNS) -> DataFrame:
    """`column_name, value, count, share, rank`: the most frequent values of each column, NULL included.
    One pass for all columns; ties are broken by value. The counts of a column add up to its rows."""
    names = list(listable_columns(df, max_distinct, max_columns) if columns is None else columns)
    # Column positions, not names, so that names with dots need no care.
    cells = df.select(*[F.col(f"`{n}`").cast("string").alias(f"c{i}") for i, n in enumerate(names)])
    long = cells.unpivot([], [f"c{i}" for i in range(len(names))], "position", "value")
    counts = long.groupBy("position", "value").agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy("position").agg(F.sum("count").alias("total"))  # a row for each column
    labels = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(f"c{i}"), F.lit(n))])
    best = top_per_group(counts, ["position"], [F.desc("count"), F.asc_nulls_first("value")], k).join(totals, "position")
    return best.select(
        labels[F.col("position")].alias("column_name"),
        "value",
        "count",
        (F.col("count") / F.col("total")).alias("share"),
        F.col("rank").cast("bigint").alias("rank"),
    )


def profile_rows(df: DataFrame, *, run_id: str, table: str, version: int | None, scope: str) -> DataFrame:
    """Rows for the `column_stats` table: the profile with its top values. `scope` says what was profiled
    (`table`, or `batch` when an append or merge profiles only what it wrote)."""
    profile = freeze(column_profile(df, sketches=True))  # a row for each column, which also says what to list
    tops = top_values(df, listable_columns(df, profile=profile)).groupBy("column_name").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "value", "count"))),  # at most ten per column
            lambda t: F.struct(t["value"].alias("value"), t["count"].alias("count")),
        ).alias("top_10")
    )
    return (
        profile.join(tops, "column_name", "left")
        .withColumns(
            {
                "run_id": F.lit(run_id),
                "table_identifier": F.lit(table),
                "snapshot_id": F.lit(version).cast("bigint"),
                "scope": F.lit(scope),
                "computed_at": F.current_timestamp(),
            }
        )
    )


def latest_profile(stats: DataFrame) -> DataFrame:
    """The newest profile row of each column of each table."""
    return latest_per_key(stats, ["table_identifier", "column_name"], ["computed_at", "run_id"])
