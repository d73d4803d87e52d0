"""Column functions on source text: normalised bodies, byte grams, annotation tags."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: One alternation, so that a text is read once from left to right; in order: line comment, block comment, three quoted strings, number, white space, a run of what begins none of these, any character.
_TOKENS = r"""(?s)//[^\n]*|/\*(?:.*?\*/|.*\z)|"(?:\\.|[^"\\])*(?:"|\\?\z)|'(?:\\.|[^'\\])*(?:'|\\?\z)|`(?:\\.|[^`\\])*(?:`|\\?\z)|(?:[0-9]|\.[0-9])[0-9._xob]*|\s+|[^/"'`0-9.\s]+|."""
#: Annotation tags in order of precedence.
TAGS = ("TODO", "FIXME", "HACK", "NOTE", "BUG", "OPTIMIZE", "WARN", "XXX")


def normalized_body(text: Column) -> Column:
    """Comments dropped, strings S, numbers N, runs of white space one space, trimmed."""

    def shape(t: Column) -> Column:
        out = F.when(F.startswith(t, F.lit("//")) | F.startswith(t, F.lit("/*")), "").when(F.substring(t, 1, 1).isin('"', "'", "`"), "S")
        return out.when(t.rlike(r"^(?:[0-9]|\.[0-9])"), "N").when(t.rlike(r"^\s"), " ").otherwise(t)

    return F.trim(F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)), shape), ""))


def byte_grams(text: Column, n: int = 4) -> Column:
    """Distinct strings of n bytes, as hex; none for shorter texts."""
    places = F.sequence(F.lit(1), F.octet_length(text) - F.lit(n - 1))
    grams = F.array_distinct(F.transform(places, lambda i: F.hex(F.substring(text.cast("binary"), i, F.lit(n)))))
    return F.when(F.octet_length(text) >= n, grams).otherwise(F.array().cast("array<string>"))


def text_similarity(a: Column, b: Column) -> Column:
    """Jaccard of 4-byte grams; two empty texts are equal, else texts without grams share nothing."""
    ga, gb = byte_grams(a), byte_grams(b)
    common = F.size(F.array_intersect(ga, gb))
    union = F.size(ga) + F.size(gb) - common
    return F.when((F.octet_length(a) == 0) & (F.octet_length(b) == 0), 1.0).when((F.size(ga) == 0) | (F.size(gb) == 0), 0.0).otherwise(common / union)


def tag_of(line: Column) -> Column:
    """The first of TAGS that stands in the line as a word of its own; null for none."""
    return F.coalesce(*(F.when(line.rlike(rf"(?<![A-Za-z0-9_]){t}(?![A-Za-z0-9_])"), F.lit(t)) for t in TAGS))


def fingerprint(text: Column) -> Column:
    return F.sha2(normalized_body(text), 256)


def short_hash(text: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)


def snippet(content: Column, first: int, last: int) -> Column:
    """Lines first to last, clamped, as an array of (line, text)."""
    lines = F.split(content, "\n")
    numbered = F.transform(lines, lambda t, k: F.struct((k + 1).alias("line"), t.alias("text")))
    return F.filter(numbered, lambda x: x["line"].between(max(1, first), max(first, last)))


def register(spark: SparkSession) -> None:
    """SQL names for use in rules: they are macros over built-in functions, so nothing leaves the JVM."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION text_hash(t STRING) RETURNS STRING RETURN sha2(t, 256)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION path_basename(p STRING) RETURNS STRING RETURN regexp_extract(p, '[^/]*$', 0)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION risk_bucket(n BIGINT) RETURNS STRING RETURN CASE WHEN n > 50 THEN 'CRITICAL' WHEN n > 20 THEN 'HIGH' WHEN n > 5 THEN 'MEDIUM' ELSE 'LOW' END")
