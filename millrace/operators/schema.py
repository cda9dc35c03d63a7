"""Schema comparison and additive evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shape(schema: StructType) -> list[tuple[str, str]]:
    """Ordered (name, type) pairs. Nullability is left out: it never forces a rewrite."""
    return [(f.name, f.dataType.simpleString()) for f in schema]


def schema_drifted(before: StructType, after: StructType) -> bool:
    return shape(before) != shape(after)


def schema_diff(before: StructType, after: StructType) -> list[str]:
    """`+ name type`, `- name type` and `~ name old -> new`, in column order."""
    old, new = dict(shape(before)), dict(shape(after))
    lines = [f"- {n} {t}" for n, t in old.items() if n not in new]
    lines += [f"~ {n} {old[n]} -> {t}" for n, t in new.items() if n in old and old[n] != t]
    return lines + [f"+ {n} {t}" for n, t in new.items() if n not in old]


def evolve(target: DataFrame, source_schema: StructType) -> DataFrame:
    """Add the source's new columns to the target as NULLs. A changed type is an error."""
    have = dict(shape(target.schema))
    for f in source_schema:
        kind = f.dataType.simpleString()
        if f.name in have and have[f.name] != kind:
            raise TypeError(f"column {f.name!r} is {have[f.name]} in the table and {kind} in the batch")
    new = {f.name: F.lit(None).cast(f.dataType) for f in source_schema if f.name not in have}
    return target.withColumns(new) if new else target
