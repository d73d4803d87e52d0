"""Table functions for SQL rules: what a parser sees in a text, and the grams of a body, called by lateral joins.

    SELECT f.path, s.name FROM files f, LATERAL parse_source(f.path, f.language, f.content, 'nodes') s
    SELECT b.id, g.gram FROM bodies b, LATERAL near_clone_grams(b.body) g

parse_source() runs the registered parsers where the rows are; its columns follow from its last argument, a constant: nodes, edges, tags or
errors. A null text is an empty one, a null or unknown language has no rows. near_clone_grams() and normalized_text() are built-in functions under a name, so nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from graphloom.functions import text
from graphloom.operators.storage import ship
from graphloom.schemas import typed
from graphloom.sources import parse

COLUMNS = {
    "nodes": "id string, kind string, name string, line_start int, line_end int, exported boolean, complexity double, doc_comment string",
    "edges": "src string, dst string, kind string, confidence double",
    "tags": "tag_type string, text string, line int, comment_type string",
    "errors": "message string",
}


class ParseSource:
    """(path, language, content, what): a row for each element of that kind."""

    @staticmethod
    def analyze(path: AnalyzeArgument, language: AnalyzeArgument, content: AnalyzeArgument, what: AnalyzeArgument) -> AnalyzeResult:
        if not what.isConstantExpression or what.value not in COLUMNS:
            raise ValueError(f"parse_source: the last argument is one of {', '.join(COLUMNS)}")
        return AnalyzeResult(typed(COLUMNS[what.value]))

    def eval(self, path: str, language: str, content: str, what: str) -> Iterator[tuple]:
        found, error = parse.parse(path or "", language or "", content or "")
        if what == "errors":
            if error:
                yield (error,)
        else:
            yield from getattr(found, what)


def register(spark: SparkSession) -> None:
    """Makes the table functions, and the scalar ones of text.register(), known to the session's SQL."""
    ship(spark)
    text.register(spark)
    spark.udtf.register("parse_source", udtf(ParseSource, useArrow=True))
    places = "sequence(1, octet_length(t) - 3)"
    grams = f"CASE WHEN octet_length(t) >= 4 THEN array_distinct(transform({places}, i -> hex(substring(CAST(t AS BINARY), i, 4)))) ELSE array() END"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION near_clone_grams(t STRING) RETURNS TABLE (gram STRING) RETURN SELECT explode({grams}) AS gram")
    tokens = text._TOKENS.replace("\\", "\\\\").replace("'", "\\'")
    shape = "CASE WHEN startswith(x, '//') OR startswith(x, '/*') THEN '' WHEN left(x, 1) IN ('\"', '\\'', '`') THEN 'S' WHEN x RLIKE '^(?:[0-9]|\\\\.[0-9])' THEN 'N' WHEN x RLIKE '^\\\\s' THEN ' ' ELSE x END"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION normalized_text(t STRING) RETURNS STRING RETURN trim(array_join(transform(regexp_extract_all(t, '{tokens}', 0), x -> {shape}), ''))")
