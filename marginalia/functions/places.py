"""Places in texts: line and column to byte, ranges, and sub-spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SYSTEMS = ("0-based-utf8", "1-based-utf8", "1-based-utf16", "1-based-char")


def byte_offset(text: Column, line: Column, column: Column, system: str) -> Column:
    """The byte of (line, column) in UTF-8 `text`; null outside the text or inside a character.

    A column right behind the line's end is inside; the carriage return of a line counts as its content.
    """
    base = 0 if system.startswith("0") else 1
    row, at = line - F.lit(base), column - F.lit(base)
    parts = F.split(text, "\n")
    content = F.try_element_at(parts, (row + 1).cast("int"))
    before = F.when(row > 0, F.octet_length(F.array_join(F.slice(parts, F.lit(1), row.cast("int")), "\n")) + 1).otherwise(F.lit(0))
    if system.endswith("char"):
        within = F.when(at <= F.length(content), F.octet_length(F.substring(content, F.lit(1), at.cast("int"))))
    else:
        unit = "UTF-16BE" if system.endswith("utf16") else "UTF-8"
        width = 2 if system.endswith("utf16") else 1
        chars = F.split(content, "")
        # Running widths of the line's characters: the column must be the sum of a whole number of them.
        sizes = F.transform(F.filter(chars, lambda c: c != ""), lambda c: (F.octet_length(F.encode(c, unit)) / width).cast("int"))
        count = F.aggregate(
            sizes,
            F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n")),
            lambda acc, s: F.when(acc["sum"] < at, F.struct((acc["sum"] + s).alias("sum"), (acc["n"] + 1).alias("n"))).otherwise(acc),
        )
        within = F.when(count["sum"] == at, F.octet_length(F.substring(content, F.lit(1), count["n"])))
    return F.when((row >= 0) & (at >= 0) & content.isNotNull(), (before + within).cast("bigint"))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")


def overlaps(a: Column, b: Column) -> Column:
    """Whether two half-open byte ranges share a byte."""
    return (a["start_byte"] < b["end_byte"]) & (b["start_byte"] < a["end_byte"])


def contains_byte(a: Column, byte: Column) -> Column:
    return (a["start_byte"] <= byte) & (byte < a["end_byte"])


def length_bytes(a: Column) -> Column:
    return F.greatest(a["end_byte"] - a["start_byte"], F.lit(0))


def sub_span(span: Column, offset: Column, length: Column) -> Column:
    """A range `offset` bytes into another, on the same lines."""
    start = (span["start_byte"] + offset).cast("bigint")
    return F.struct(start.alias("start_byte"), (start + length).cast("bigint").alias("end_byte"), span["start_line"].alias("start_line"), span["end_line"].alias("end_line"))
