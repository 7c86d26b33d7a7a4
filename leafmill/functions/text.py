"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s"


def word_count(text: Column) -> Column:
    """Words between runs of Unicode white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")).cast("bigint")


def char_count(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit(""))).cast("bigint")


def alnum_count(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]", "")).cast("bigint")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)\S")


def tidy(text: Column) -> Column:
    """Line ends unified, lines right-stripped, runs of blank lines made one, ends stripped."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"(?U)[\s&&[^\n]]+(?=\n|$)", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return stripped(t)


def snippet(text: Column, query: str, window: int = 90) -> tuple[Column, Column, Column]:
    """(before, match, after) of the first case-insensitive hit, in the text's own case."""
    at = F.locate(query.lower(), F.lower(text))  # 1-based, 0 where absent
    start = F.greatest(F.lit(1), at - window)
    end = at + len(query)
    before = F.concat(F.when(start > 1, F.lit("…")).otherwise(F.lit("")), F.replace(F.substring(text, start, at - start), F.lit("\n"), F.lit(" ")))
    after = F.concat(
        F.replace(F.substring(text, end, F.lit(window)), F.lit("\n"), F.lit(" ")), F.when(F.length(text) >= end + window, F.lit("…")).otherwise(F.lit(""))
    )
    return before, F.substring(text, at, F.lit(len(query))), after


def occurrences(text: Column, query: str) -> Column:
    """Non-overlapping case-insensitive occurrences of a literal."""
    quoted = "\\Q" + query.lower().replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return (F.size(F.split(F.lower(F.coalesce(text, F.lit(""))), quoted, -1)) - 1).cast("bigint")


def marked(text: Column, query: str) -> Column:
    """The text with every case-insensitive hit of a literal between « and »."""
    quoted = "(?iu)(\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E)"
    return F.regexp_replace(text, quoted, "«$1»")


def duration(seconds: Column) -> Column:
    """0s, 59s, 12m 3s, 2h 5m."""
    s = F.coalesce(seconds, F.lit(0)).cast("bigint")
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), F.floor((s % 3600) / 60).cast("string"), F.lit("m")))
    )


def byte_size(n: Column) -> Column:
    """Bytes in the unit that leaves the number below 1024."""
    out = F.concat(F.coalesce(n, F.lit(0)).cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(n >= 1024**power, F.concat(F.format_string("%.1f", n / float(1024**power)), F.lit(f" {unit}"))).otherwise(out)
    return out


def safe_relpath(name: Column) -> Column:
    """A relative path without backslashes, NULs, empty, '.' and '..' parts."""
    parts = F.split(F.replace(F.replace(name, F.lit("\\"), F.lit("/")), F.lit("\0"), F.lit("")), "/")
    return F.array_join(F.filter(parts, lambda p: ~p.isin("", ".", "..")), "/")
