"""Schemas of the graph tables and what their enumerations may hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_KINDS = ("File", "Function", "Class", "Variable", "Type", "Module", "Author")
EDGE_KINDS = ("CALLS", "IMPORTS", "INHERITS", "EXPORTS", "CO_CHANGES", "OWNS", "DEPENDS_ON", "TESTS")

#: Types by their SQL names.
_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()), "map<string,double>": T.MapType(T.StringType(), T.DoubleType()),
}


def typed(text: str) -> T.StructType:
    """Of 'name type' pairs; needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (pair.split() for pair in text.split(", "))])


NODES = typed(
    "id string, kind string, name string, path string, line_start int, line_end int, language string, churn double, coupling double, "
    "community bigint, in_degree bigint, out_degree bigint, exported boolean, is_dead_candidate boolean, dead_reason string, "
    "complexity double, doc_comment string, is_test_file boolean, test_count bigint, is_tested boolean"
)
EDGES = typed("id string, src string, dst string, kind string, weight double, confidence double")
FILES = typed("path string, language string, content string, size_bytes bigint")
TAGS = typed("id string, file_path string, tag_type string, text string, line int, comment_type string")
CLONES = typed("id string, node_a string, node_b string, kind string, similarity float")
COMMUNITIES = typed("id bigint, label string, node_count bigint, top_nodes array<string>")
FILE_HASHES = typed("path string, hash string, indexed_at timestamp")
#: Kept up by deltas: degrees of ids, and how many files have each number of incoming edges.
DEGREES = typed("id string, in_degree bigint, out_degree bigint, test_count bigint")
HISTOGRAM = typed("degree bigint, files bigint")
SNAPSHOTS = typed("id string, commit_sha string, commit_date string, commit_msg string, node_count bigint, edge_count bigint, file_count bigint, insertions bigint, deletions bigint")
COMMITS = typed("sha string, ts timestamp, author_name string, author_email string, path string")
BLAME = typed("path string, author_name string, author_email string, lines bigint")
DEPS = typed("name string, version string, ecosystem string, manifest string, dep_kind string")
REPOS = typed("id string, name string, path string, db_path string, indexed_at timestamp, node_count bigint, edge_count bigint, language_breakdown map<string,double>, last_used_at timestamp")

#: Values of columns that a writer leaves out.
NODE_DEFAULTS = {
    "line_start": 0, "line_end": 0, "language": "", "churn": 0.0, "coupling": 0.0, "community": 0, "in_degree": 0, "out_degree": 0, "exported": False,
    "is_dead_candidate": False, "complexity": 0.0, "is_test_file": False, "test_count": 0, "is_tested": False,
}
EDGE_DEFAULTS = {"weight": 1.0, "confidence": 1.0}


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """df with exactly the schema's columns, in its types; what is missing or null takes the default, else null."""
    defaults, there = defaults or {}, set(df.columns)
    columns = []
    for f in schema.fields:
        value = df[f.name].cast(f.dataType) if f.name in there else F.lit(None).cast(f.dataType)
        if f.name in defaults:
            value = F.coalesce(value, F.lit(defaults[f.name]).cast(f.dataType))
        columns.append(value.alias(f.name))
    return df.select(*columns)


def as_nodes(df: DataFrame) -> DataFrame:
    return conform(df, NODES, NODE_DEFAULTS)


def as_edges(df: DataFrame) -> DataFrame:
    """Edges with their natural key: src|kind|dst."""
    keyed = df if "id" in df.columns else df.withColumn("id", F.concat_ws("|", "src", "kind", "dst"))
    return conform(keyed, EDGES, EDGE_DEFAULTS)
