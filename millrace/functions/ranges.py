"""Joins of points to intervals without comparing every pair.

`last_start` is a sweep: points and starts of intervals are sorted together, and each point takes what the starts before
it say. It needs an order only, so it serves addresses of any width, and asks for no bucket width and no salt. It tells
one thing per point: the last interval, where intervals don't overlap, or how far any of them reaches.

`range_join` gives every pair, for intervals that overlap. Both sides get a bucket of fixed width: an interval one row per bucket it covers, a point its own bucket.
The join is then an equi join on the bucket with the exact bounds as a filter. Intervals are first cut to where there
are points, so that one without an end costs no more buckets than the points span. Choose the width so that typical
intervals cover few buckets. An inner join puts longer intervals into buckets four times as wide, or sixteen times, and
so on, so that each covers two at most; a point then has a bucket of each width. A bucket that holds a large share of the points is spread by a salt
that is taken from the point's row; the (small) interval side is repeated once per salt value.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import freeze


def _level(length: Column, width: int) -> Column:
    """How often a bucket of a width has to grow fourfold to be as long."""
    return F.greatest(F.lit(0), F.ceil(F.log(4.0, length / width)).cast("int"))


def _bucket(at: Column, width: int, level: Column) -> Column:
    return F.floor(at / (F.pow(F.lit(4.0), level) * width)).cast("bigint")


def _buckets(df: DataFrame, low: Column, high: Column, width: int, salts: int, levels: bool) -> DataFrame:
    df = df.withColumn("_level", _level(high.cast("double") - low.cast("double"), width) if levels else F.lit(0))
    first, last = (_bucket(end, width, F.col("_level")) for end in (low, high))
    spread = df.withColumn("_bucket", F.explode(F.sequence(first, last)))
    if salts == 1:
        return spread.withColumn("_salt", F.lit(0))
    return spread.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def _points(df: DataFrame, point: Column, width: int, salts: int, most: Column | None) -> DataFrame:
    plain = [F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith("map")]
    salt = F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int") if salts > 1 else F.lit(0)
    salted = df.withColumns({"_salt": salt, "_point": point})
    level = F.lit(0) if most is None else F.explode(F.sequence(F.lit(0), most))
    return salted.withColumn("_level", level).withColumn("_bucket", _bucket(F.col("_point"), width, F.col("_level")))


def range_join(
    points: DataFrame,
    point: str,
    ranges: DataFrame,
    low: str,
    high: str,
    width: int,
    how: str = "inner",
    keys: Sequence[str] = (),
    salts: int = 1,
) -> DataFrame:
    """`points` joined to the `ranges` whose closed interval holds the point; `how` is `inner`, `left`,
    `left_semi` or `left_anti`. `keys` are further columns, of the same name on both sides, to be equal."""
    column = F.col(f"`{point}`").cast("bigint")
    bounds = {"_low": F.col(f"`{low}`").cast("bigint"), "_high": F.col(f"`{high}`").cast("bigint")}
    valid = ranges.withColumns(bounds).where("_low <= _high")
    span = points.agg(F.min(column).alias("least"), F.max(column).alias("most"))
    least, most = span.select("least").scalar(), span.select("most").scalar()
    levels = how == "inner"  # a point of several buckets meets an interval once, but has no single row to keep
    highest = F.coalesce(_level(most.cast("double") - least.cast("double"), width), F.lit(0))
    left = _points(points, column, width, salts, highest if levels else None).alias("p")
    reached = valid.withColumns({"_from": F.greatest("_low", least), "_upto": F.least("_high", most)}).where("_from <= _upto")
    right = _buckets(reached, F.col("_from"), F.col("_upto"), width, salts, levels).alias("r")
    on = (F.col("p._level") == F.col("r._level")) & (F.col("p._bucket") == F.col("r._bucket"))
    if salts > 1:
        on = on & (F.col("p._salt") == F.col("r._salt"))
    for key in keys:
        on = on & (F.col(f"p.`{key}`") == F.col(f"r.`{key}`"))
    on = on & F.col("p._point").between(F.col("r._low"), F.col("r._high"))
    joined = left.join(right, on, how)
    own = [F.col(f"p.`{c}`") for c in points.columns]
    if how in ("left_semi", "left_anti"):
        return joined.select(*own)
    others = [c for c in ranges.columns if c not in keys]
    return joined.select(*own, *[F.col(f"r.`{c}`") for c in others])


def last_start(
    points: DataFrame,
    point: str,
    starts: DataFrame,
    start: str,
    take: Mapping[str, tuple[Callable[..., Column], str]],
    keys: Sequence[str] = (),
    path: str | None = None,
) -> DataFrame:
    """`points` with columns from the `starts` at or before each point (of equal `keys`): `take` maps a new column to an
    aggregate and a column of `starts`: `F.last` for that of the last start (of equal starts any), `F.max` for the greatest
    so far. NULL where no start comes before; a NULL point has none.

    A prefix scan over range partitions. Rows are sorted by key, place, and the number of the task they come from, so that
    points of one place, however many, fill several partitions. Partitions are scanned by themselves, and what comes into
    each from those before it is a scan over one row for each key and partition. The sorted rows are written, so that both
    scans see the same partitions; give a `path` to remove them when the result has been used."""
    key = [F.col(f"`{k}`") for k in keys]
    place = F.col(f"`{point}`")
    typed = points.schema[point].dataType
    none = {c: F.lit(None).cast(starts.schema[c].dataType).alias(f"_t_{c}") for _, c in take.values()}
    left = points.select(*key, place.alias("_place"), F.lit(1).alias("_kind"), F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("_row"), *none.values())
    row_type = left.schema["_row"].dataType
    given = [F.col(f"`{c}`").alias(f"_t_{c}") for c in none]
    right = starts.where(F.col(f"`{start}`").isNotNull()).select(*key, F.col(f"`{start}`").cast(typed).alias("_place"), F.lit(0).alias("_kind"), F.lit(None).cast(row_type).alias("_row"), *given)
    both = left.unionByName(right).withColumn("_task", F.when(F.col("_kind") == 1, F.spark_partition_id()).otherwise(-1))
    order = [*key, F.col("_place"), F.col("_kind"), F.col("_task")]
    placed = both.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = freeze(placed.withColumn("_part", F.shiftright("_at", 33)).drop("_task"), path)

    def over(f: Callable[..., Column], column: Column, window) -> Column:
        return (f(column, ignorenulls=True) if f is F.last else f(column)).over(window)

    by_part = [F.max_by(f"_t_{c}", F.when(F.col("_kind") == 0, F.col("_at"))).alias(n) if f is F.last else f(f"_t_{c}").alias(n) for n, (f, c) in take.items()]
    ends = ranged.groupBy(*key, "_part").agg(*by_part)
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*key, "_part", *[over(f, F.col(n), before).alias(f"_c_{n}") for n, (f, _) in take.items()])
    within = Window.partitionBy(*key, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.select(*key, "_place", "_part", "_kind", "_row", *[over(f, F.col(f"_t_{c}"), within).alias(f"_o_{n}") for n, (f, c) in take.items()]).where("_kind = 1")
    same = [F.col("o._part") == F.col("c._part")] + [F.col(f"o.`{k}`").eqNullSafe(F.col(f"c.`{k}`")) for k in keys]
    met = own.alias("o").join(carried.alias("c"), same, "left")
    known = F.col("o._place").isNotNull()

    def final(name: str, f: Callable[..., Column]) -> Column:
        mine, carry = F.col(f"o._o_{name}"), F.col(f"c._c_{name}")
        both = F.coalesce(mine, carry) if f is F.last else F.greatest(mine, carry)
        return F.when(known, both).alias(name)

    return met.select("o._row.*", *[final(n, f) for n, (f, _) in take.items()])
