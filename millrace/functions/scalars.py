"""Column expressions. All but one are built from Spark's own functions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Magnitude suffixes, file health limits, duration units in seconds.
MAGNITUDES = {"K": 1e3, "M": 1e6, "B": 1e9, "T": 1e12}
SMALL_FILE_MIN_COUNT = 16
SMALL_FILE_AVG_BYTES = 16 * 1024 * 1024
DURATION_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}

_MAGNITUDE = r"^([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)([KMBT]?)$"


def ratio(numerator: Column, denominator: Column) -> Column:
    """NULL where the denominator is zero or NULL."""
    return numerator / F.nullif(denominator, F.lit(0))


def ladder(value: Column, steps: Sequence[tuple[float, str]], above: str, unknown: str = "unknown") -> Column:
    """The label of the first step the value is below; `above` past the last, `unknown` for NULL."""
    result = F.when(value.isNull(), unknown)
    for limit, label in steps:
        result = result.when(value < limit, label)
    return result.otherwise(above)


def parse_magnitude(text: Column) -> Column:
    """`1.5K`, `200M`, `3.2B`, `1T` as a double; blank or malformed text is NULL."""
    cleaned = F.upper(F.trim(text))
    number = F.nullif(F.regexp_extract(cleaned, _MAGNITUDE, 1), F.lit("")).try_cast("double")
    suffix = F.regexp_extract(cleaned, _MAGNITUDE, 2)
    factor = F.create_map(F.lit(""), F.lit(1.0), *[F.lit(x) for kv in MAGNITUDES.items() for x in kv])
    return number * factor[suffix]


def parse_magnitude_udf():
    """The same as a vectorised function, for comparison; the expression above is the one to use.

    Made inside a function so that workers get its code and need not import this package.
    """
    pattern, factors = _MAGNITUDE, {"": 1.0, **MAGNITUDES}

    def parse(text: pd.Series) -> pd.Series:
        parts = text.str.strip().str.upper().str.extract(pattern)
        return pd.to_numeric(parts[0], errors="coerce") * parts[1].map(factors)

    return F.pandas_udf(parse, DoubleType())


def truncated(text: Column, limit: int = 4096) -> Column:
    """Text of at most `limit` characters, the last three being dots when something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 3)), F.lit("..."))).otherwise(text)


def duration_seconds(text: Column) -> Column:
    """`30m`, `4h`, `7d`, `120s` in seconds; anything else is NULL."""
    number = F.nullif(F.regexp_extract(text, r"^([0-9]+)[smhd]$", 1), F.lit("")).try_cast("bigint")
    unit = F.create_map(*[F.lit(x) for kv in DURATION_UNITS.items() for x in kv])
    return number * unit[F.right(text, F.lit(1))]


def freshness(age_seconds: Column, sla: Column) -> Column:
    """`stale` at or past the SLA, `aging` from half of it, else `fresh`; `none` without SLA or age."""
    limit = duration_seconds(sla)
    share = F.greatest(age_seconds, F.lit(0)) / limit
    return (
        F.when(limit.isNull() | (limit <= 0) | age_seconds.isNull(), "none")
        .when(share >= 1, "stale")
        .when(share >= 0.5, "aging")
        .otherwise("fresh")
    )


def average_file_bytes(files: Column, size: Column) -> Column:
    return F.when((files > 0) & (size > 0), size / files)


def file_health(files: Column, size: Column) -> Column:
    """`small` for many files of small average size, `unknown` without figures, else `ok`."""
    average = average_file_bytes(files, size)
    small = (files >= SMALL_FILE_MIN_COUNT) & (average < SMALL_FILE_AVG_BYTES)
    return F.when(average.isNull(), "unknown").when(small, "small").otherwise("ok")


def _url_decoded(text: Column) -> Column:
    """Decoded text; a percent sign that starts no code stays as it is (and costs a second attempt)."""
    repaired = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(text), F.url_decode(repaired))


def _query_pair(query: str, key: str) -> Column:
    """The first `key=value` of a query string with what separates it, empty when there is none."""
    return F.regexp_extract(query, rf"(?:^|&){re.escape(key)}(?:=[^&]*)?(?=&|$)", 0)


def has_query_value(query: str, key: str) -> Column:
    """Whether the first value of a parameter is there and not empty; nothing is decoded for it."""
    return _query_pair(query, key).rlike("=.")


def with_query_parameters(df: DataFrame, query: str, fields: Mapping[str, str]) -> DataFrame:
    """Add a column per field with the first value of its parameter in a query string that was encoded
    twice. The outer layer is a form (plus means space), the inner one is not.

    All fields go through one lambda: a projection that spells the steps out for each field is too long
    for the JVM to compile.
    """

    def decoded(pair: Column) -> Column:
        after = F.instr(pair, "=")
        value = F.when(after > 0, F.substr(pair, after + 1)).when(pair != "", "")
        return _url_decoded(F.replace(_url_decoded(value), F.lit("+"), F.lit("%2B")))

    values = F.transform(F.array(*[_query_pair(query, key) for key in fields.values()]), decoded)
    parsed = df.withColumn("_values", values)
    return parsed.withColumns({name: F.col("_values")[i] for i, name in enumerate(fields)}).drop("_values")


def epoch_millis(text: Column) -> Column:
    """A timestamp from a millisecond count in text; malformed text is NULL."""
    return F.timestamp_millis(text.try_cast("bigint"))


def ipv4_number(text: Column) -> Column:
    """A dotted IPv4 address as a number; malformed text is NULL."""
    parts = F.split(text, "[.]")
    octets = [F.get(parts, F.lit(i)).try_cast("bigint") for i in range(4)]
    number = F.lit(0).cast("bigint")
    for octet in octets:
        number = number * 256 + F.when(octet.between(0, 255), octet)
    return F.when(F.size(parts) == 4, number)
