"""Text and number formats. Offsets are code points and count from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = ("Bytes", "KB", "MB", "GB", "TB", "PB", "EB")


def _plain(number: Column) -> Column:
    """A number without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(number, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def format_file_size(size: Column, decimals: int = 2) -> Column:
    """Base 1024, at most ``decimals`` decimals, no trailing zeros: 1536 is 1.5 KB."""
    n = size.cast("double")
    step = sum((F.when(n >= 1024.0**k, 1).otherwise(0) for k in range(1, len(_UNITS))), F.lit(0))
    scaled = F.round(n / F.pow(F.lit(1024.0), step), max(0, decimals)).cast(f"decimal(38,{max(0, decimals)})").cast("string")
    unit = F.element_at(F.array(*map(F.lit, _UNITS)), step + 1)
    return F.when(n == 0, "0 Bytes").otherwise(F.concat_ws(" ", _plain(scaled) if decimals > 0 else scaled, unit))


def format_duration(ms: Column) -> Column:
    """850ms, 12s, 3m 5s, 1h 0m 7s."""
    seconds = F.floor(ms / 1000)
    m, s = F.floor(seconds / 60), (seconds % 60).cast("string")
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s")))
        .when(m < 60, F.concat(m.cast("string"), F.lit("m "), s, F.lit("s")))
        .otherwise(F.concat(F.floor(m / 60).cast("string"), F.lit("h "), (m % 60).cast("string"), F.lit("m "), s, F.lit("s")))
    )


def leading_number(text: Column) -> Column:
    """The number that a text starts with ("1.27 ms"), else 0; a leading minus is not accepted."""
    return F.coalesce(F.regexp_extract(text, r"^([0-9.]+)", 1).try_cast("double"), F.lit(0.0))


def parse_json(text: Column, schema: str, default: Column) -> Column:
    """The parsed value, or ``default`` where the text is no such JSON."""
    return F.coalesce(F.from_json(text, schema), default)


def snippet(text: Column, at: Column, length: Column | int = 1, context: int = 50) -> Column:
    """The text around a match, with ... on the sides that are cut."""
    n = F.lit(length) if isinstance(length, int) else length
    start, end = F.greatest(at - context, F.lit(0)), F.least(at + n + context, F.length(text))
    dots = F.lit("...")
    return F.concat(F.when(start > 0, dots).otherwise(""), F.substring(text, start + 1, end - start), F.when(end < F.length(text), dots).otherwise(""))


def line_number(text: Column, at: Column) -> Column:
    """The line (from 1) of a position."""
    return F.size(F.split(F.substring(text, F.lit(1), at), r"\r?\n"))


def column_number(text: Column, at: Column) -> Column:
    """The place in its line (from 1) of a position."""
    return F.length(F.element_at(F.split(F.substring(text, F.lit(1), at), r"\r?\n"), -1)) + 1


def truncate(text: Column, n: int, ellipsis: str = "...") -> Column:
    """At most n characters, the dots included."""
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n - len(ellipsis)), F.lit(ellipsis)))


def preview(text: Column, n: int) -> Column:
    """The first n characters, with dots after them if there is more."""
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n), F.lit("...")))


def first_lines(text: Column, n: int = 50) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), 1, n), "\n")


def split_lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def join_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def normalise(text: Column) -> Column:
    return F.lower(F.trim(text))


def fingerprint(text: Column) -> Column:
    """The first 16 hex digits of the MD5."""
    return F.substring(F.md5(text), 1, 16)


def sampled_fingerprint(text: Column, part: int = 500, least: int = 1000) -> Column:
    """As ``fingerprint``, of start, middle and end only from ``least`` characters on."""
    n = F.length(text)
    middle = F.floor(n / 2) - part // 2
    sample = F.concat(F.substring(text, 1, part), F.substring(text, middle.cast("int") + 1, F.lit(part)), F.substring(text, n - part + 1, F.lit(part)))
    return fingerprint(F.when(n < least, text).otherwise(sample))


def size_to_bytes(value: float | None, unit: str) -> int | None:
    """Base 1024; None for nothing, NaN and negative numbers."""
    if value is None or value != value or value < 0:
        return None
    return int(value * 1024 ** ("Bytes", "KB", "MB", "GB").index(unit))


def split_and_clean(text: Column) -> Column:
    """Parts between commas or line ends, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, "[\n,]+"), lambda p: F.trim(p)), lambda p: p != "")
