"""Dashboard datasets: parameterised queries, time ranges, and the shapes widgets need."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Parameter syntax, time-range presets, row limits, chart limits.
_PLACEHOLDER = re.compile(r"\{\{\s*([A-Za-z_][A-Za-z0-9_.\-]*)\s*\}\}")
_SAFE_VALUE = re.compile(r"[A-Za-z0-9 _.:+\-T/]*")
_RELATIVE = re.compile(r"now-([0-9]+)([mhdw])")
_UNITS = {"m": "minutes", "h": "hours", "d": "days", "w": "weeks"}
PRESETS = {"last_24h": "now-24h", "last_7d": "now-7d", "last_30d": "now-30d", "last_90d": "now-90d"}
DEFAULT_RANGE = timedelta(days=30)
QUERY_ROWS, RENDER_ROWS = 1000, 10_000
PIE_SLICES = 7
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
TEMPORAL = ("date", "timestamp", "timestamp_ntz", "time")


def bind(template: str, params: Mapping[str, str]) -> tuple[str, dict[str, str]]:
    """Turn `{{name}}` into Spark's named parameter markers and check the values."""
    args: dict[str, str] = {}

    def marker(match: re.Match[str]) -> str:
        name = match[1]
        if name not in params:
            raise KeyError(f"the query uses {{{{{name}}}}} but nothing sets it")
        if not _SAFE_VALUE.fullmatch(params[name]):
            raise ValueError(f"parameter {name!r} has characters outside A-Z a-z 0-9 space _ . : + - / ")
        key = "p_" + "".join(c if c.isalnum() else f"_{ord(c):x}_" for c in name)
        args[key] = params[name]
        return f":{key}"

    return _PLACEHOLDER.sub(marker, template), args


def dataset(spark: SparkSession, template: str, params: Mapping[str, str]) -> DataFrame:
    """Run a dataset's query. Values reach Spark as literals, never as SQL text."""
    query, args = bind(template, params)
    return spark.sql(query, args=args)


def time_range(expression: str | None, now: datetime) -> tuple[datetime, datetime]:
    """Start and end of `now-<n><m|h|d|w>` or an old preset name; anything else is thirty days."""
    text = (expression or "").strip()
    match = _RELATIVE.fullmatch(PRESETS.get(text, text))
    if match is None or int(match[1]) == 0:
        return now - DEFAULT_RANGE, now
    return now - timedelta(**{_UNITS[match[2]]: int(match[1])}), now


@dataclass(frozen=True)
class Control:
    """A dashboard control: a time range, or a choice from options."""

    name: str
    kind: str = "select"
    default: str = ""
    options: Sequence[str] = ()


def parameters(controls: Sequence[Control], given: Mapping[str, str], now: datetime) -> dict[str, str]:
    """Control defaults, overridden by explicit parameters."""
    params: dict[str, str] = {}
    for control in controls:
        if control.kind == "time_range":
            start, end = time_range(given.get(control.name) or control.default, now)
            params[f"{control.name}.start"] = start.strftime("%Y-%m-%dT%H:%M:%SZ")
            params[f"{control.name}.end"] = end.strftime("%Y-%m-%dT%H:%M:%SZ")
        elif control.default or control.options:
            params[control.name] = control.default or control.options[0]
    return {**params, **given}


def capped(df: DataFrame, n: int) -> tuple[DataFrame, bool]:
    """At most `n` rows to show, and whether there were more."""
    return df.limit(n), df.limit(n + 1).count() > n


def query(spark: SparkSession, sql: str, n: int = QUERY_ROWS, strict: bool = True) -> tuple[DataFrame | None, bool]:
    """An ad-hoc query with a row limit. A missing table is an error, or an empty answer if not strict."""
    try:
        return capped(spark.sql(sql), n)
    except Exception as error:
        if not strict and "TABLE_OR_VIEW_NOT_FOUND" in str(error):
            return None, False
        raise


@dataclass(frozen=True)
class Widget:
    id: str
    dataset: str


@dataclass
class Rendered:
    rows: dict[str, DataFrame] = field(default_factory=dict)
    truncated: dict[str, bool] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)


def render(
    spark: SparkSession, datasets: Mapping[str, str], widgets: Sequence[Widget], params: Mapping[str, str]
) -> Rendered:
    """Run each dataset once for all its widgets; a dataset's error shows on its widgets only.
    The shared frames hold at most the row limit; unpersist them when the dashboard closes."""
    result, shared = Rendered(), {}
    for name in dict.fromkeys(w.dataset for w in widgets):
        try:
            frame = dataset(spark, datasets[name], params).limit(RENDER_ROWS + 1).persist()
            shared[name] = (frame, frame.count() > RENDER_ROWS, "")
        except Exception as error:  # shown on the widget instead of failing the dashboard
            shared[name] = (None, False, str(error))
    for widget in widgets:
        frame, more, error = shared[widget.dataset]
        if frame is None:
            result.errors[widget.id] = error
        else:
            result.rows[widget.id], result.truncated[widget.id] = frame.limit(RENDER_ROWS), more
    return result


# -- widget shapes


def options(df: DataFrame, column: str | None = None) -> DataFrame:
    """Distinct values of a column (the first by default), in order."""
    name = column or df.columns[0]
    return df.select(F.col(f"`{name}`").alias("value")).distinct().orderBy("value")


def pie(df: DataFrame, name: str, value: str, slices: int = PIE_SLICES) -> DataFrame:
    """The largest positive slices and the rest as `Other`. `Other` is the total less the named slices, so
    only the few largest rows are ever ranked."""
    number = F.col(f"`{value}`").try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (number > 0) & (number < float("inf"))
    label = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
    rows = df.where(finite).select(label.alias("name"), number.alias("value"))
    top = rows.orderBy(F.desc("value"), F.asc("name")).limit(slices)
    total = rows.agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("n"))
    named = top.agg(F.sum("value")).scalar()
    other = total.where(F.col("n") > slices).select(F.lit("Other").alias("name"), (F.col("v") - named).alias("value"))
    return top.unionByName(other)


def series(df: DataFrame, x: str, columns: Sequence[str] | None = None) -> DataFrame:
    """`x, series, y`: chosen columns (all others by default) as numbers; what is not a number is NULL."""
    names = list(columns or [c for c in df.columns if c != x])
    numbers = [F.col(f"`{n}`").try_cast("double").alias(f"y{i}") for i, n in enumerate(names)]
    wide = df.select(F.col(f"`{x}`").alias("x"), *numbers)
    long = wide.unpivot(["x"], [f"y{i}" for i in range(len(names))], "position", "y")
    labels = F.create_map(*[part for i, n in enumerate(names) for part in (F.lit(f"y{i}"), F.lit(n))])
    return long.select("x", labels[F.col("position")].alias("series"), "y")


def world_map(df: DataFrame, region: str, value: str, order: str, codes: DataFrame) -> DataFrame:
    """`region_id, value, opacity`: the last value of each known region, tinted by its place between the
    least and greatest value. `codes` maps every accepted `code` to a `region_id`."""
    number = F.col(f"`{value}`").try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    rows = df.where(finite).select(
        F.upper(F.trim(F.col(f"`{region}`"))).alias("code"), number.alias("value"), F.col(f"`{order}`").alias("_at")
    )
    # Per code first: the code table then joins a handful of rows, however many values there are.
    per_code = rows.groupBy("code").agg(
        F.max(F.struct("_at", "value")).alias("_last"), F.min("value").alias("_min"), F.max("value").alias("_max")
    )
    known = per_code.join(codes.select(F.upper("code").alias("code"), "region_id"), "code")
    bounds = known.agg(F.min("_min").alias("low"), F.max("_max").alias("high"))
    low, high = bounds.select("low").scalar(), bounds.select("high").scalar()
    last = known.groupBy("region_id").agg(F.max("_last").alias("_last"))
    share = F.least(F.greatest((F.col("value") - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return last.select("region_id", F.col("_last.value").alias("value")).withColumn(
        "opacity", F.when(low == high, 0.7).otherwise(0.25 + 0.75 * share)
    )


def column_roles(df: DataFrame) -> DataFrame:
    """`column_name, column_type, role` with the role numeric, temporal, string or other."""

    def role(kind: str) -> str:
        base = kind.split("(")[0]
        if base in NUMERIC:
            return "numeric"
        if base in TEMPORAL:
            return "temporal"
        return "string" if base in ("string", "char", "varchar") else "other"

    rows = [(n, t, role(t)) for n, t in df.dtypes]
    return df.sparkSession.createDataFrame(rows, "column_name string, column_type string, role string")
