"""JSON documents as rows, and careful typing of text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

MAX_COLUMNS = 10_000
_INT = r"^[+-]?[0-9]+$"
_NON_FINITE = [sign + word for sign in ("", "+", "-") for word in ("inf", "infinity", "nan")]
#: What Spark's cast takes beside plain decimal notation: type suffixes, hexadecimal floats, control characters around.
_NOT_PLAIN = r"[dDfFxX\x00-\x20]"


def json_items(df: DataFrame, document: str, json_path: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per object of the array at a dotted path; other elements are dropped.

    The object stays whole in a `map<string,string>` column named `item`.
    """
    path = "$" + "".join(f".{part}" for part in json_path.split(".") if part)
    elements = F.from_json(F.get_json_object(F.col(document), path), "array<string>")
    return (
        df.select(*keep, F.explode(elements).alias("element"))
        .where(F.ltrim("element").startswith("{"))
        .select(*keep, F.from_json("element", "map<string,string>").alias("item"))
    )


def json_rows(
    df: DataFrame, document: str, json_path: str, columns: Sequence[str] | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """The objects at a path as columns, missing keys NULL. Without `columns` the union of all keys is
    found first, which is a separate pass that brings only the key names to the driver."""
    items = json_items(df, document, json_path, keep)
    if columns is None:
        names = items.select(F.explode(F.map_keys("item")).alias("name")).distinct()
        columns = sorted(row["name"] for row in names.limit(MAX_COLUMNS + 1).collect())
        if len(columns) > MAX_COLUMNS:
            raise ValueError(f"more than {MAX_COLUMNS} different keys: name the columns, or keep the map")
    return items.select(*keep, *[F.col("item").getItem(c).alias(c) for c in columns])


def variant_items(df: DataFrame, document: str, json_path: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per object of the array at a dotted path, as a VARIANT named `item`; other elements are dropped, and so are
    documents that are no JSON."""
    path = "$" + "".join(f".{part}" for part in json_path.split(".") if part)
    exploded = df.select(*keep, F.explode(F.try_variant_get(F.try_parse_json(F.col(document)), path, "array<variant>")).alias("item"))
    return exploded.where(F.schema_of_variant("item").startswith("OBJECT<"))


def variant_types(items: DataFrame, column: str = "item") -> StructType:
    """The union of all keys with the type that fits all their values, from one pass over the rows of which one short text
    comes back. A key whose values have no common type is a `variant`."""
    told = items.agg(F.schema_of_variant_agg(column)).first()[0]
    if told is None or not told.startswith("OBJECT<"):
        return StructType()
    found = items.sparkSession.sql(f"SELECT CAST(NULL AS STRUCT<{told[len('OBJECT<') : -1].replace('OBJECT<', 'STRUCT<')}>) AS s").schema["s"].dataType
    return found if isinstance(found, StructType) else StructType()


def variant_rows(df: DataFrame, document: str, json_path: str, keep: Sequence[str] = (), types: StructType | None = None) -> DataFrame:
    """The objects at a path as typed columns, missing keys NULL. Keys of several types are text, as JSON but for plain
    texts. `types` spares the pass that finds them."""
    items = variant_items(df, document, json_path, keep)
    types = variant_types(items) if types is None else types
    if len(types) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} different keys: name the columns, or keep the variant")

    def column(field: StructField) -> Column:
        mixed = "variant" in field.dataType.simpleString() or field.dataType.simpleString() == "void"
        kind = "string" if mixed else field.dataType.simpleString()
        if "'" in field.name and '"' in field.name:  # no path has a way to say this
            value = F.variant_get("item", "$", "map<string, variant>").getItem(field.name)
            return F.variant_get(value, "$", kind).alias(field.name)
        quote = '"' if "'" in field.name else "'"
        return F.variant_get("item", f"$[{quote}{field.name}{quote}]", kind).alias(field.name)

    return items.select(*keep, *[column(f) for f in types])


_TYPES = ("long", "double", "string")


def _cell_class(cell: Column) -> Column:
    """Which of the types the narrowest is that takes a cell's text. Most cells are told by their digits alone; the cast to
    a number and the patterns are for the others."""
    digits = (F.translate(cell, "0123456789", "") == "") & (F.length(cell) <= 18)
    whole = digits | (cell.rlike(_INT) & cell.try_cast("bigint").isNotNull())
    value = cell.try_cast("double")
    finite = value.isNotNull() & (F.abs(value) != float("inf")) & ~F.isnan(value) & ~cell.rlike(_NOT_PLAIN)
    return F.when(whole, 0).when(finite | F.lower(cell).isin(_NON_FINITE), 1).otherwise(2)


def text_column_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per text column: `long`, `double` or `string`, judged over every non-blank cell; `string` if all are
    blank. One pass, in which a cell is classed once."""
    names = list(columns or [c for c, t in df.dtypes if t == "string"])
    cells = [F.trim(F.col(f"`{name}`")) for name in names]
    widest = [F.max(F.when(cell != "", _cell_class(cell))).alias(f"c{i}") for i, cell in enumerate(cells)]
    kinds = F.array(*[F.lit(t) for t in _TYPES])
    verdicts = [
        F.struct(F.lit(name).alias("column_name"), F.get(kinds, F.coalesce(F.col(f"c{i}"), F.lit(2))).alias("column_type"))
        for i, name in enumerate(names)
    ]
    return df.agg(*widest).select(F.inline(F.array(*verdicts)))


def typed_text(df: DataFrame, columns: Sequence[str] | None = None, types: DataFrame | None = None) -> DataFrame:
    """Cast each text column to the type all its cells allow; blank cells become NULL. `types` spares the pass that
    finds them."""
    found = text_column_types(df, columns) if types is None else types
    types = {r["column_name"]: r["column_type"] for r in found.collect()}  # a row for each column

    def cast(name: str) -> Column:
        kind = types.get(name, "string")
        cell = F.col(f"`{name}`")
        return cell if kind == "string" else F.trim(cell).try_cast(kind).alias(name)

    return df.select(*[cast(c) for c in df.columns])
