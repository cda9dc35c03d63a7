"""Reads by format: one file, a prefix, a partitioned prefix, or an explicit list of files."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class InputSpec:
    """What a stage reads: a table name, or a path with its format and options. With partitions it is read by their
    cursor; with `late_files` by a manifest of the files read, which also sees what lands in partitions already read."""

    source: str
    format: str = "parquet"
    options: Mapping[str, str] = field(default_factory=dict)
    partitions: tuple[str, ...] = ()
    start_from: str = "all"
    late_files: bool = False


@dataclass(frozen=True)
class Format:
    """A Spark reader: its name, what it is always given, and how a caller's options are passed on to it."""

    reader: str
    fixed: Mapping[str, str] = field(default_factory=dict)
    renamed: Mapping[str, str] = field(default_factory=dict)  # a caller's name for an option of the reader


_TEXT_OPTIONS = {"delimiter": "sep", "header": "header", "infer": "inferSchema", "comment": "comment"}
_TEXT_DEFAULTS = {"header": "true", "inferSchema": "true"}
FORMATS: dict[str, Format] = {
    "parquet": Format("parquet"),
    "json": Format("json"),
    "ndjson": Format("json"),
    "csv": Format("csv", {"sep": ",", **_TEXT_DEFAULTS}, _TEXT_OPTIONS),
    "tsv": Format("csv", {"sep": "\t", **_TEXT_DEFAULTS}, _TEXT_OPTIONS),
}
COLUMN_NAMES = "columns"  # names for the columns of a text file without a header


def _read(spark: SparkSession, paths: list[str], fmt: str, given: Mapping[str, str], schema: StructType | str | None, **how: str) -> DataFrame:
    kind = FORMATS.get(fmt or "parquet")
    if kind is None:
        raise ValueError(f"unsupported source format {fmt!r} (one of {', '.join(FORMATS)})")
    unknown = set(given) - set(kind.renamed) - ({COLUMN_NAMES} if kind.renamed else set())
    if unknown:
        raise ValueError(f"{fmt} has no option {', '.join(sorted(unknown))}")
    options = {**kind.fixed, **{kind.renamed[k]: str(v) for k, v in given.items() if k in kind.renamed and str(v)}}
    if schema is not None:
        options.pop("inferSchema", None)
    reader = spark.read.format(kind.reader).options(**options, **how)
    df = (reader if schema is None else reader.schema(schema)).load(paths)
    named = [name.strip() for name in given.get(COLUMN_NAMES, "").split(",")] if given.get(COLUMN_NAMES) else []
    return df.toDF(*named) if named else df


def partition_columns(spark: SparkSession, path: str) -> list[str]:
    """The columns that Spark discovers in directory names below a path, from a listing; none if there is no path."""
    plain = {"path", "modificationTime", "length", "content"}
    try:
        return [c for c in spark.read.format("binaryFile").load(path).columns if c not in plain]
    except AnalysisException:  # the read itself will say what is wrong with the path
        return []


def read_path(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
    schema: StructType | str | None = None,
) -> DataFrame:
    """Read a file or prefix. Give a schema on big text inputs: inferring one is a second full scan.

    A prefix (trailing slash) is read recursively, unless directory names hold columns: those are kept.
    """
    how = {"recursiveFileLookup": "true"} if path.endswith("/") and not partition_columns(spark, path) else {}
    return _read(spark, [path], fmt, options or {}, schema, **how)


def read_files(
    spark: SparkSession,
    files: Iterable[str],
    fmt: str,
    base_path: str,
    options: Mapping[str, str] | None = None,
    schema: StructType | str | None = None,
) -> DataFrame:
    """Read listed files; partition columns come from the path below `base_path`."""
    return _read(spark, list(files), fmt, options or {}, schema, basePath=base_path)


def read_named(spark: SparkSession, name: str) -> DataFrame:
    """A bare string input: a Parquet path if it has a slash, a catalog table if not."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def flat_name(schema: str, table: str, catalog: str = "") -> str:
    """`catalog__schema.table`, with dashes as underscores: three levels in a two-level catalog."""
    parts = [p for p in (catalog, schema) if p]
    return ("__".join(parts) + "." + table).replace("-", "_")


def table_name(node: str, output: str, outputs: Iterable[str]) -> str:
    """The bare node name for a single `default` output, `node__output` otherwise."""
    name = node if list(outputs) == ["default"] else f"{node}__{output}"
    return name.replace("-", "_")
