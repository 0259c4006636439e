"""Small column functions: times, identities, texts, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(text: Column) -> Column:
    """A text with a T is ISO 8601 (naive: UTC), any other a number of seconds since 1970; what fails is null."""
    iso = F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))
    epoch = F.timestamp_micros((F.expr("1") * F.round(text.try_cast("double") * 1_000_000)).cast("long"))
    return F.when(text.contains("T"), iso).otherwise(epoch)


def null_if_empty(json: Column) -> Column:
    """Empty JSON arrays, objects and texts are stored as null. The text is made once and looked at, not made again."""
    return F.get(F.filter(F.array(json), lambda j: ~j.isin("[]", "{}", "null", '""')), F.lit(0))


def row_key(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def identity(path: Column, line: Column, occurrence: Column) -> Column:
    """Which line of which file: equal lines of a file are told apart by their occurrence, so a second scan gives the same identities."""
    return F.sha2(F.concat_ws("\x1f", path, line, occurrence.cast("string")), 256)


def notebook_hash(path: Column) -> Column:
    return F.substring(F.sha2(path.cast("binary"), 256), 1, 8)


def notebook_name(path: Column) -> Column:
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.regexp_replace(stem, r"[^\p{L}\p{N}_-]", "_")


def line_count(source: Column) -> Column:
    return F.when(source == "", 0).otherwise(F.size(F.split(source, "\n", -1)))


def elapsed_ms(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1000.0


def megabytes(size: Column) -> Column:
    return size / 1048576.0


def excerpt(text: Column, most: int = 100) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def ratio(x: Column, y: Column) -> Column:
    """x / y where y is positive, else null."""
    return F.when(y > 0, x / y)
