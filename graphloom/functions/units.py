"""Column functions on durations, sizes, versions and long strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration_days(text: Column) -> Column:
    """Days of '7', '7d', '7days'; null for anything else."""
    number = F.regexp_replace(F.trim(text), "(?:DAYS)*(?:DAY)*(?:days)*(?:day)*D*d*$", "")
    return F.when(number.rlike(r"^\+?[0-9]+$"), number.cast("long"))


def size_bytes(text: Column) -> Column:
    """Bytes of '10', '1.5 MB', '2g'; null for anything else, and for negative sizes."""
    upper = F.upper(F.trim(text))
    number, unit = F.trim(F.regexp_replace(upper, "(?:[GMK]B?|B)$", "")), F.regexp_extract(upper, "([GMK]?)B?$", 1)
    power = F.when(unit == "G", 1024**3).when(unit == "M", 1024**2).when(unit == "K", 1024).otherwise(1)
    return F.when(number.rlike(r"^\+?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"), F.floor(number.cast("double") * power).cast("long"))


def shown_size(n: Column) -> Column:
    """'1.5 MB': the largest of B, KB, MB and GB that leaves at least 1."""
    out = F.when(n < 1024, F.format_string("%.1f B", n.cast("double")))
    for k, unit in ((1, "KB"), (2, "MB")):
        out = out.when(n < 1024 ** (k + 1), F.format_string(f"%.1f {unit}", F.bround(n / 1024**k, 1)))
    return out.otherwise(F.format_string("%.1f GB", F.bround(n / 1024**3, 1)))


def short_path(path: Column, most: int) -> Column:
    """The end of a path that is too long, after three dots."""
    return F.when(F.octet_length(path) <= most, path).otherwise(F.concat(F.lit("..."), F.right(path, F.lit(most - 3))))


def short_text(text: Column, most: int) -> Column:
    """The begin of a text that is too long, before three dots."""
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most - 3)), F.lit("...")))


def version_parts(version: Column) -> Column:
    """The numbers at the begin of a version, cut at . - and +."""
    parts = F.split(version, r"[.\-+]")
    plain = F.transform(parts, lambda p: p.rlike("^[0-9]*$"))
    stop = F.array_position(plain, F.lit(False)).cast("int")
    head = F.when(stop > 0, F.slice(parts, F.lit(1), stop - 1)).otherwise(parts)
    return F.transform(F.filter(head, lambda p: p != ""), lambda p: p.cast("long"))


def newer_version(candidate: Column, current: Column) -> Column:
    """Whether a version is later than another; missing parts count as 0."""
    apart = F.zip_with(version_parts(candidate), version_parts(current), lambda a, b: F.signum(F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0))))
    return F.coalesce(F.get(F.filter(apart, lambda x: x != 0), F.lit(0)) > 0, F.lit(False))
