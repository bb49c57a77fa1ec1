"""String building blocks with the whitespace and case rules the analytics rely on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Trim every Unicode space, not just blanks."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", "")


def words(c: Column) -> Column:
    """Non-empty pieces between runs of Unicode spaces."""
    return F.filter(F.split(c, SPACE + "+"), lambda w: w != "")


def contains_any(c: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for needle in needles:
        out = out | F.contains(c, F.lit(needle))
    return out


def count_true(flags: list[Column]) -> Column:
    total = F.lit(0)
    for flag in flags:
        total = total + F.coalesce(flag, F.lit(False)).cast("int")
    return total


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_filled(*cs: Column) -> Column:
    """First value that is neither null nor empty, else the empty string."""
    return F.coalesce(*[blank_to_null(c) for c in cs], F.lit(""))


def thousands(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"\B(?=(\d{3})+(?!\d))", ",")


def byte_size(c: Column) -> Column:
    """1024-based size with two decimals, up to GB; 0 and null show as N/A."""
    size = c.cast("double")
    shown = F.concat(F.format_string("%.2f", size / 1024**3), F.lit(" GB"))
    for power, unit in ((2, "MB"), (1, "KB"), (0, "B")):
        shown = F.when(
            size < 1024 ** (power + 1),
            F.concat(F.format_string("%.2f", size / 1024**power), F.lit(f" {unit}")),
        ).otherwise(shown)
    return F.when(size.isNull() | (size == 0), F.lit("N/A")).otherwise(shown)


def epoch_date(c: Column) -> Column:
    return F.when(c.isNull() | (c == 0), F.lit("N/A")).otherwise(
        F.date_format(F.timestamp_seconds(c), "M/d/yyyy"))


def title_case(c: Column) -> Column:
    """Upper-case the first word character after every word boundary."""
    pieces = F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), F.lit(1))
    return F.array_join(
        F.transform(pieces, lambda p: F.when(p.rlike("^[a-z]"), F.concat(
            F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))).otherwise(p)), "")


def truncate(c: Column, length: int, ending: str = "...") -> Column:
    return F.when(F.length(c) > length,
                  F.concat(F.substring(c, 1, length - len(ending)), F.lit(ending))).otherwise(c)


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def entropy(c: Column) -> Column:
    """Shannon entropy of the characters of a short string; 0 for an empty one.

    Each distinct character is counted by the bytes its removal saves. For long texts see
    ``stats.text_entropy``.
    """
    size = F.octet_length(c)
    counts = F.transform(F.array_distinct(F.split(c, "")), lambda ch: (
        (size - F.octet_length(F.replace(c, ch, F.lit("")))) / F.octet_length(ch)))
    total = lambda s: -F.aggregate(
        s["counts"], F.lit(0.0), lambda acc, k: acc + k / s["n"] * F.log2(k / s["n"]))
    return F.when(c.isNull() | (c == ""), F.lit(0.0)).otherwise(
        let(F.struct(counts.alias("counts"), F.length(c).alias("n")), total))


def to_local_time(c: Column, zone: str = "Asia/Singapore") -> Column:
    """UTC text to local text; anything unparsable is returned unchanged."""
    ts = F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.coalesce(
        F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd HH:mm:ss"), c)
