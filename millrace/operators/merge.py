"""Keyed upsert as a DataFrame function: target and source in, the next table contents out.

The target goes once through a LEFT join to the source, and the inserts are the source rows whose key is
not among the target's matching keys. Not one FULL OUTER join, because Spark can broadcast a small batch
and split a skewed side in these joins, but in a full outer join neither: with a small batch the target is
never shuffled. Rows with a NULL in a key never match, so they bypass the joins rather than pile up in one
task.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.schema import evolve
from millrace.session import freeze

# The update rules a merge column may name.
UPDATE_RULES = ("additive", "min", "max", "sketch")

MAX_LAYOUT_COLUMNS = 4
MAX_BOUND_VALUES = 200


class MergeError(ValueError):
    """A merge source that has no single meaning."""


def _any_null(keys: Sequence[str]) -> Column:
    return reduce(Column.__or__, [F.col(f"`{k}`").isNull() for k in keys])


def present_keys(target: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct keys of the other frame that the target has.

    Spark moves the semi join below the DISTINCT when the other side is small enough to broadcast, so the
    target is not shuffled. Otherwise the keys are made distinct where they are read, which takes the
    weight out of a key that fills the target.
    """
    names = [F.col(f"`{k}`") for k in keys]
    return target.select(*names).distinct().join(other.select(*names).distinct(), list(keys), "left_semi")


def _updated(column: str, rule: str | None) -> Column:
    old, new = F.col(f"target.`{column}`"), F.col(f"source.`{column}`")
    if rule is None:
        return new
    if rule == "additive":
        return old + new
    if rule == "min":
        return F.least(old, new)
    if rule == "max":
        return F.greatest(old, new)
    if rule == "sketch":
        return F.hll_union(old, new)
    return F.expr(rule)


@dataclass
class MergeParts:
    """A merge taken apart, so that table contents and change rows come from the same joins."""

    joined: DataFrame  # keyed target rows: `matched`, `before` and `after` structs
    untouched: DataFrame  # target rows with a NULL key
    inserts: DataFrame  # source rows without a match

    def table(self) -> DataFrame:
        kept = self.joined.select("after.*")
        return kept.unionByName(self.untouched).unionByName(self.inserts)

    def by_kind(self, column: str) -> DataFrame:
        """Every row once, with what it is: `keep`, `pre` and `post` of an update, `insert`."""
        kinds = F.when(
            F.col("matched"),
            F.array(F.struct(F.lit("pre").alias(column), F.col("before").alias("row")), F.struct(F.lit("post").alias(column), F.col("after").alias("row"))),
        ).otherwise(F.array(F.struct(F.lit("keep").alias(column), F.col("after").alias("row"))))
        joined = self.joined.select(F.inline(kinds)).select("row.*", column)
        untouched = self.untouched.withColumn(column, F.lit("keep"))
        return joined.unionByName(untouched).unionByName(self.inserts.withColumn(column, F.lit("insert")))

    def changes(self) -> DataFrame:
        """`insert`, `update_preimage` and `update_postimage` rows with `_change_type` in front."""
        names = {"insert": "insert", "pre": "update_preimage", "post": "update_postimage"}
        kind = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("_kind")]
        rows = self.by_kind("_kind").where("_kind <> 'keep'")
        return rows.select(kind.alias("_change_type"), *[F.col(f"`{c}`") for c in rows.columns if c != "_kind"])


def merge_parts(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update: Mapping[str, str] | None = None,
    present: DataFrame | None = None,
) -> MergeParts:
    """Evolve the target by the source's new columns, then match on the keys. `present` are the distinct keys of the
    source that the target has, if they are known already."""
    if not keys:
        raise MergeError("a merge needs keys")
    update = update or {}
    target = evolve(target, source.schema)
    names = target.columns
    from_source = set(source.columns)

    keyed_target = target.where(~_any_null(keys)).alias("target")
    keyed_source = source.where(~_any_null(keys))
    lookup = keyed_source.withColumn("_matched", F.lit(True)).alias("source")
    on = reduce(Column.__and__, [F.col(f"target.`{k}`") == F.col(f"source.`{k}`") for k in keys])
    matched = F.col("source._matched").isNotNull()

    types = {f.name: f.dataType for f in target.schema}

    def after(name: str) -> Column:
        old = F.col(f"target.`{name}`")
        if name in keys or name not in from_source:
            return old.alias(name)
        new = _updated(name, update.get(name)).cast(types[name])  # a sum of decimals is wider than its parts
        return F.when(matched, new).otherwise(old).alias(name)

    joined = keyed_target.join(lookup, on, "left").select(
        matched.alias("matched"),
        F.struct(*[F.col(f"target.`{n}`").alias(n) for n in names]).alias("before"),
        F.struct(*[after(n) for n in names]).alias("after"),
    )
    present = present_keys(keyed_target, keyed_source, keys) if present is None else present
    new_rows = keyed_source.join(present, list(keys), "left_anti")
    null_keyed = source.where(_any_null(keys))
    inserts = new_rows.unionByName(null_keyed).select(
        *[F.col(f"`{n}`") if n in from_source else F.lit(None).cast(types[n]).alias(n) for n in names]
    )
    return MergeParts(joined, target.where(_any_null(keys)), inserts)


def merge_upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update: Mapping[str, str] | None = None,
) -> DataFrame:
    """Matched rows take the source's values (or combine with them, per `update`), unmatched source rows
    are inserted, all other target rows stay. `update` maps a column to `additive`, `min`, `max`,
    `sketch`, or a SQL expression over `target.` and `source.`. As in SQL, `additive` with a NULL on
    either side is NULL, while `min` and `max` skip NULLs."""
    return merge_parts(target, source, keys, update).table()


def _repeated(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    groups = source.where(~_any_null(keys)).groupBy(*[F.col(f"`{k}`") for k in keys])
    return groups.agg(F.count(F.lit(1)).alias("source_rows")).where("source_rows > 1")


def duplicate_source_keys(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source keys that occur more than once and exist in the target, with their count. Such a merge
    has no single result. Repeated keys without a match are plain inserts."""
    repeated = _repeated(source, keys)
    return repeated.join(present_keys(target, repeated, keys), list(keys), "left_semi")


def require_single_match(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> None:
    """Raise if a target row has several source rows. The target is looked at only if keys repeat at all."""
    if _repeated(source, keys).isEmpty():
        return
    example = duplicate_source_keys(target, source, keys).first()
    if example is not None:
        raise MergeError(f"several source rows match one target row, for example {example.asDict()}")


# -- bounded merge -------------------------------------------------------------------------------


def bound_columns(
    keys: Sequence[str], cluster_by: Sequence[str] = (), bound_by: Sequence[str] = ()
) -> list[str]:
    """Columns worth bounding: merge keys the table is laid out by, then those the author named."""
    layout = list(cluster_by or keys)[:MAX_LAYOUT_COLUMNS]
    return list(dict.fromkeys([k for k in keys if k in layout] + list(bound_by)))


def _is_literal(value: object) -> bool:
    if isinstance(value, float):
        return math.isfinite(value)
    if isinstance(value, Decimal):
        return value.is_finite()
    return True


def column_bounds(source: DataFrame, columns: Sequence[str], max_values: int = MAX_BOUND_VALUES) -> list[Column]:
    """Predicates on the target that every row matching the source satisfies: for each column its values when they are
    few, else the true range. None for a column of which a value has no exact literal (NaN matches NaN, yet no range).
    One job tells the values of all columns, a second one all ranges that are needed."""
    odd = ("array", "map", "struct", "binary", "variant")
    names = [c for c in dict.fromkeys(columns) if source.schema[c].dataType.typeName() not in odd]
    if not names:
        return []

    def values_of(i: int) -> DataFrame:
        rows = source.select(F.col(f"`{names[i]}`").alias("v")).where("v IS NOT NULL").distinct().limit(max_values + 1)
        typed = [F.col("v") if k == i else F.lit(None).cast(source.schema[n].dataType) for k, n in enumerate(names)]
        return rows.select(F.lit(i).alias("i"), *[t.alias(f"v{k}") for k, t in enumerate(typed)])

    told: list[list] = [[] for _ in names]
    for row in reduce(DataFrame.unionByName, [values_of(i) for i in range(len(names))]).collect():
        told[row["i"]].append(row[f"v{row['i']}"])
    many = [i for i, values in enumerate(told) if len(values) > max_values]
    if many:
        ends = source.agg(*[f(f"`{names[i]}`").alias(f"{k}{i}") for i in many for k, f in (("low", F.min), ("high", F.max))]).first()
    bounds = []
    for i, values in enumerate(told):
        column = F.col(f"`{names[i]}`")
        if i in many:
            low, high = ends[f"low{i}"], ends[f"high{i}"]
            if _is_literal(low) and _is_literal(high):
                bounds.append(column.between(F.lit(low), F.lit(high)))
        elif values and all(_is_literal(v) for v in values):
            bounds.append(column.isin(values))
    return bounds


def column_bound(source: DataFrame, column: str, max_values: int = MAX_BOUND_VALUES) -> Column | None:
    """The bound of one column, None if it has none."""
    bounds = column_bounds(source, [column], max_values)
    return bounds[0] if bounds else None


def bound_violations(source: DataFrame, keys: Sequence[str], bound_by: Sequence[str]) -> DataFrame:
    """Keys that come with more than one `bound_by` tuple in the batch: the bound would be unsound."""
    pairs = source.select(*keys, *[c for c in bound_by if c not in keys]).distinct()
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("tuples")).where("tuples > 1")


def require_bound(source: DataFrame, keys: Sequence[str], bound_by: Sequence[str]) -> None:
    if bound_by:
        example = bound_violations(source, keys, bound_by).first()
        if example is not None:
            raise MergeError(f"bound_by is not determined by the keys, for example {example.asDict()}")


def split_by_bound(
    target: DataFrame, source: DataFrame, keys: Sequence[str], cluster_by: Sequence[str] = (), bound_by: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame | None]:
    """(target rows the source can touch, the rest). The rest is None when nothing can be ruled out. The
    source is read several times and must not change in between."""
    bounds = column_bounds(source, bound_columns(keys, cluster_by, bound_by))
    if not bounds:
        return target, None
    inside = reduce(Column.__and__, bounds)
    return target.where(inside), target.where(~F.coalesce(inside, F.lit(False)))


def bounded_merge(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update: Mapping[str, str] | None = None,
    cluster_by: Sequence[str] = (),
    bound_by: Sequence[str] = (),
    path: str | None = None,
) -> DataFrame:
    """`merge_upsert` that joins only the slice of the target the batch can touch. The bound reaches the
    Parquet scan, the rest of the target passes through without a shuffle."""
    source = freeze(source, path)  # the bound and the merge must see the same batch
    require_bound(source, keys, bound_by)
    touched, rest = split_by_bound(target, source, keys, cluster_by, bound_by)
    merged = merge_upsert(touched, source, keys, update)
    return merged if rest is None else evolve(rest, source.schema).unionByName(merged)
