"""Point lookups, searches and filters over nodes, tags, clones and snapshots.

Results that are cut are cut after a total order; every ranking ends in the id, so it is reproducible.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SYMBOLS = ("Function", "Class")


def get_node(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("id") == node_id)


def _holds(column: str, text: str) -> Column:
    """Case-insensitive substring."""
    return F.contains(F.lower(column), F.lit(text.lower()))


def find(nodes: DataFrame, name: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """Name or id holds the text; exact names first, then by in_degree."""
    hit = nodes.where(_holds("name", name) | _holds("id", name))
    if kind:
        hit = hit.where(F.lower("kind") == kind.lower())
    return hit.orderBy(F.desc(F.lower("name") == name.lower()), F.desc("in_degree"), "id").limit(limit)


def find_symbol(nodes: DataFrame, name: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """The same predicate in order of id, fewer columns."""
    hit = nodes.where(_holds("name", name) | _holds("id", name))
    if kind:
        hit = hit.where(F.lower("kind") == kind.lower())
    return hit.select("id", "kind", "name", "path", "line_start", "in_degree", "out_degree").orderBy("id").limit(limit)


def search(nodes: DataFrame, text: str, limit: int | None = 20) -> DataFrame:
    """Name or path holds the text."""
    hit = nodes.where(_holds("name", text) | _holds("path", text)).orderBy("id")
    return hit.limit(limit) if limit else hit


def resolve(nodes: DataFrame, text: str, with_paths: bool = False) -> DataFrame:
    """The one node meant: by exact id, else name, else part of a name (else path, else file: name), smallest id first."""
    rank = F.when(F.col("id") == text, 0).when(F.lower("name") == text.lower(), 1).when(_holds("name", text), 2)
    if with_paths:
        rank = rank.when(F.lower("path") == text.lower(), 3).when(F.col("id") == f"file:{text}", 4)
    return nodes.withColumn("rank", rank).where("rank IS NOT NULL").orderBy("rank", "id").limit(1)


def in_community(nodes: DataFrame, community: int) -> DataFrame:
    return nodes.where(F.col("community") == community)


def tags(tag_rows: DataFrame, tag_type: str | None = None, comment_type: str | None = None) -> DataFrame:
    if tag_type:
        tag_rows = tag_rows.where(F.col("tag_type") == tag_type.upper())
    if comment_type:
        tag_rows = tag_rows.where(F.col("comment_type") == comment_type)
    return tag_rows.orderBy("file_path", "line")


def clones(clone_rows: DataFrame, least: float = 0.0, kind: str | None = None) -> DataFrame:
    if kind:
        clone_rows = clone_rows.where(F.col("kind") == kind)
    return clone_rows.where(F.col("similarity") >= F.lit(least).cast("float")).orderBy(F.desc("similarity"), "id")


def public_api(nodes: DataFrame, prefix: str | None = None, community: int | None = None) -> DataFrame:
    """Exported symbols of a path prefix or a community."""
    hit = nodes.where(F.col("exported") & ~F.col("kind").isin("File", "Author", "Module"))
    if prefix is not None:
        hit = hit.where(F.startswith("path", F.lit(prefix)))
    if community is not None:
        hit = hit.where(F.col("community") == community)
    return hit.orderBy("path", "line_start", "id")


def by_complexity(nodes: DataFrame, limit: int = 20, least: float = 0.0) -> DataFrame:
    return nodes.where((F.col("kind") == "Function") & (F.col("complexity") >= least)).orderBy(F.desc("complexity"), "id").limit(limit)


def snapshots(rows: DataFrame, limit: int | None = None) -> DataFrame:
    out = rows.orderBy(F.desc("commit_date"), "commit_sha")
    return out.limit(limit) if limit else out


def snapshot_by_sha(rows: DataFrame, sha: str) -> DataFrame:
    """Exact or by prefix."""
    return rows.where(F.startswith("commit_sha", F.lit(sha))).orderBy(F.desc(F.col("commit_sha") == sha), "commit_sha").limit(1)


def doc_comment(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("id") == node_id).select("id", "doc_comment")


def view(nodes: DataFrame, edges: DataFrame, prefix: str | None = None, kinds: tuple[str, ...] | None = None, community: int | None = None, text: str | None = None, edge_kinds: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes that pass all filters and the edges between them."""
    if prefix:
        nodes = nodes.where(F.startswith("path", F.lit(prefix)))
    if kinds:
        nodes = nodes.where(F.col("kind").isin(*kinds))
    if community is not None:
        nodes = nodes.where(F.col("community") == community)
    if text:
        nodes = nodes.where(_holds("name", text) | _holds("path", text) | _holds("kind", text))
    if edge_kinds:
        edges = edges.where(F.col("kind").isin(*edge_kinds))
    return nodes, induced(nodes, edges)


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select(F.col("id").alias("_n"))
    return edges.join(ids, edges["src"] == F.col("_n"), "left_semi").join(ids, edges["dst"] == F.col("_n"), "left_semi")


def folder(nodes: DataFrame, prefix: str, exported: int = 15, hot: int = 3) -> tuple[DataFrame, DataFrame]:
    """Of a folder: its exported symbols, and its files by churn times coupling."""
    mine = nodes.where(F.startswith("path", F.lit(prefix)) & (F.col("kind") != "Author"))
    top = mine.where(F.col("exported") & F.col("kind").isin(*SYMBOLS)).orderBy(F.desc("in_degree"), "id").limit(exported)
    return top, mine.where("kind = 'File'").orderBy(F.desc(F.col("churn") * F.col("coupling")), "id").limit(hot)


def watched(path: Column) -> Column:
    """Whether a changed path matters to a watcher: not under the ignored directories, not one of the ignored kinds."""
    # Parts and ends of paths to ignore.
    parts = ("/.git/", "/node_modules/", "/target/", "/dist/", "/build/", "/__pycache__/", "/.graphloom/", "/.next/", "/.venv/", "/venv/")
    ends = ("AGENTS.md", "~", ".tmp", ".swp", ".swx", ".DS_Store")
    ignored = F.lit(False)
    for part in parts:
        ignored = ignored | F.contains(path, F.lit(part))
    for end in ends:
        ignored = ignored | F.endswith(path, F.lit(end))
    return ~ignored


#: Words that a question's keywords leave out.
STOP_WORDS = (
    "the", "is", "are", "a", "an", "what", "who", "how", "where", "why", "when", "can", "does",
    "do", "did", "was", "were", "be", "has", "have", "had", "will", "would", "could", "should",
    "may", "might", "this", "that", "these", "those", "it", "its", "in", "on", "at", "to",
    "for", "of", "with", "about", "from", "by", "or", "and", "not", "but", "if", "then",
    "else", "tell", "show", "find", "get", "give", "make", "explain", "describe", "help", "me",
    "my", "our", "your", "their", "codebase", "file", "files", "code", "any", "some", "all",
    "just", "like",
)


def keywords(text: Column) -> Column:
    """Distinct lower-case words of more than one character, in order of first use, without stop words."""
    words = F.split(F.lower(text), "[^\\p{L}\\p{N}]+")
    return F.array_distinct(F.filter(words, lambda w: (F.octet_length(w) > 1) & ~w.isin(*STOP_WORDS)))


def retrieved(nodes: DataFrame, edges: DataFrame, words: Sequence[str], selected: str | None = None, most: int = 15, with_neighbours: int = 20) -> DataFrame:
    """What a question is answered from: nodes whose name or id holds a keyword, earlier keywords first, then ids, `most` at most;
    with neighbours of a selected node up to `with_neighbours`. Most churned first."""
    hit = F.coalesce(*(F.when(F.contains(F.lower("name"), F.lit(w)) | F.contains(F.lower("id"), F.lit(w)), F.lit(k)) for k, w in enumerate(words)), F.lit(None).cast("int"))
    found = nodes.withColumn("_k", hit).where("_k IS NOT NULL").orderBy("_k", "id").limit(most).drop("_k")
    if selected is not None:
        ends = edges.where(F.col("src") == selected).select(F.col("dst").alias("_end")).union(edges.where(F.col("dst") == selected).select("src")).where(F.col("_end") != selected).distinct()
        near = nodes.join(ends, nodes["id"] == F.col("_end"), "left_semi").join(F.broadcast(found.select(F.col("id").alias("_id"))), F.col("id") == F.col("_id"), "left_anti")
        both = found.withColumn("_n", F.lit(0)).unionByName(near.orderBy("id").limit(with_neighbours).withColumn("_n", F.lit(1)))
        found = both.orderBy("_n", "id").limit(with_neighbours).drop("_n")
    return found.select("id", "name", "kind", "path", "churn", "community").orderBy(F.desc("churn"), "id")


def guarded_sql(spark: SparkSession, sql: str, **views: DataFrame) -> DataFrame:
    """One SELECT over the named views; anything else is refused. The views are there only while the statement is read; views of the caller's that have their names come back."""
    if ";" in sql:
        raise ValueError("only one statement, without ';'")
    words = sql.split()
    if not words or words[0].upper() != "SELECT":
        raise ValueError("only SELECT statements")
    own = {t.name: spark.table(t.name) for t in spark.catalog.listTables() if t.isTemporary and t.name in views}
    try:
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        return spark.sql(sql)
    finally:
        for name in views:
            spark.catalog.dropTempView(name)
        for name, df in own.items():
            df.createOrReplaceTempView(name)
