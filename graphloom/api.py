"""One stored graph behind named tools: the library's front door, and a small command line.

A graph folder holds the Parquet tables nodes, edges, tags, clones, communities and snapshots (those that exist).
"""

from __future__ import annotations

import argparse
import json
import sys
import tomllib
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.export import formats
from graphloom.operators import clones, community, dead, enrich, lookup, rank, reports, rules, traverse
from graphloom.sources import parse, repo
from graphloom.streaming import watch

TABLES = ("nodes", "edges", "tags", "clones", "communities", "snapshots")
#: What a configuration file may set, with the values used otherwise.
SETTINGS = {"churn_days": enrich.CHURN_DAYS, "cochange_days": enrich.COCHANGE_DAYS, "cochange_least": enrich.COCHANGE_LEAST, "largest_file": repo.LARGEST, "clone_threshold": clones.THRESHOLD, "quiet_ms": 500}


def settings(text: str = "") -> dict:
    """SETTINGS with what a TOML document says; names that are not known are an error."""
    found = tomllib.loads(text)
    if unknown := set(found) - set(SETTINGS):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return SETTINGS | found


def repos(spark: SparkSession, text: str) -> DataFrame:
    """The repos table of a registry, a JSON list of objects."""
    from graphloom.schemas import REPOS, conform

    rows = [json.dumps(r) for r in json.loads(text)]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in REPOS.fields)
    read = spark.createDataFrame([(r,) for r in rows], "j string").select(F.from_json("j", fields).alias("r")).select("r.*")
    return conform(read, REPOS)


def analyze(spark: SparkSession, path: str, with_history: bool = True, config: dict | None = None) -> dict[str, DataFrame]:
    """All tables of a repository: files parsed and resolved, history and ownership added, nodes enriched."""
    config = config or SETTINGS
    files = repo.repo_files(spark, path, config["largest_file"])
    parsed = parse.extract(files).persist()
    nodes, edges = watch.graph(parsed)
    if with_history:
        commits = repo.commits(spark, path).persist()
        known = nodes.where("kind = 'File'").select("path")
        owned = enrich.owners(repo.blame(spark, path, known))
        pairs = enrich.cochange(commits.join(known, "path", "left_semi"), days=config["cochange_days"], least=config["cochange_least"])
        extra = enrich.ownership_edges(owned).unionByName(enrich.cochange_edges(pairs))
        from graphloom.schemas import as_edges, as_nodes

        edges = edges.unionByName(as_edges(extra))
        nodes = enrich.with_churn(nodes.unionByName(as_nodes(enrich.author_nodes(owned))), enrich.churn(commits, days=config["churn_days"]))
    nodes = enrich.with_test_coverage(enrich.with_coupling(enrich.with_degrees(nodes, edges)), edges)
    parts = community.detect(nodes, edges).withColumnRenamed("community", "_c")
    nodes = nodes.join(parts, "id").withColumn("community", F.col("_c")).select(*nodes.columns)
    nodes = dead.marked(nodes, dead.detect(nodes, edges))
    bodies = parsed.select("path", F.explode("nodes").alias("n")).where("n.kind = 'Function'").join(files.select("path", "content"), "path")
    lines = F.slice(F.split("content", "\n"), F.col("n.line_start"), F.greatest(F.col("n.line_end") - F.col("n.line_start") + 1, F.lit(1)))
    found = clones.clones(bodies.select(F.col("n.id").alias("id"), F.array_join(lines, "\n").alias("body")), config["clone_threshold"])
    return {"nodes": nodes, "edges": edges, "tags": parse.tags_of(parsed), "clones": found, "communities": rank.communities(nodes)}


def save(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


class Graph:
    """Tools over a stored graph; each returns a DataFrame."""

    def __init__(self, spark: SparkSession, path: str | None = None, **tables: DataFrame):
        self.spark, self.path, self.given = spark, path, tables

    def table(self, name: str) -> DataFrame:
        return self.given[name] if name in self.given else self.spark.read.parquet(f"{self.path}/{name}")

    @cached_property
    def nodes(self) -> DataFrame:
        return self.table("nodes")

    @cached_property
    def edges(self) -> DataFrame:
        return self.table("edges")

    def _id(self, name: str) -> str:
        row = lookup.resolve(self.nodes, name, with_paths=True).first()
        if row is None:
            raise LookupError(f"no such node: {name}")
        return row["id"]

    def get_repo_summary(self) -> DataFrame:
        """One row with nested counts, languages, communities, hotspots, most referenced nodes and dead code."""
        n = self.nodes
        gather = lambda df, key: df.agg(F.sort_array(F.collect_list(F.struct(*df.columns)), asc=False).alias(key))
        parts = [
            rank.counts(n, self.edges),
            gather(rank.language_breakdown(n).select("share", "language"), "languages"),
            gather(rank.communities(n).orderBy(F.desc("node_count"), "id").limit(5).select("node_count", "id", "label"), "top_communities"),
            n.where("community > 0").agg(F.count_distinct("community").alias("community_count")),
            gather(rank.hotspots(n, 5, churned_only=True).select("score", "path", "churn", F.col("in_degree").alias("callers")), "hotspots"),
            gather(rank.most_referenced(n).select("in_degree", "id", "name", "kind"), "god_nodes"),
            dead.stats(n).toDF("dead_total", "dead_severe"),
        ]
        out = parts[0]
        for part in parts[1:]:  # each of one row
            out = out.join(F.broadcast(part))
        return out

    def find_symbol(self, name: str, kind: str | None = None) -> DataFrame:
        return lookup.find_symbol(self.nodes, name, kind)

    def find(self, name: str, kind: str | None = None) -> DataFrame:
        return lookup.find(self.nodes, name, kind)

    def get_neighbors(self, node: str, depth: int = 1) -> DataFrame:
        return traverse.neighbours(self.nodes, self.edges, self._id(node), depth)

    def get_call_chain(self, source: str, target: str, by_name: bool = False) -> DataFrame:
        return traverse.chain_between(self.nodes, self.edges, self._id(source), self._id(target), by_name)

    def get_blast_radius(self, node: str, depth: int = traverse.DEPTH, direction: str = "in") -> DataFrame:
        seed = self.spark.createDataFrame([(self._id(node),)], "seed string")
        return traverse.blast_radius(self.nodes, self.edges, seed, depth, direction)

    def get_community(self, number: int) -> DataFrame:
        return lookup.in_community(self.nodes, number).orderBy(F.desc("in_degree"), "id")

    def search_graph(self, text: str, limit: int = 20) -> DataFrame:
        return lookup.search(self.nodes, text, limit)

    def get_hotspots(self, limit: int = 20) -> DataFrame:
        return rank.hotspots_with_owner(self.nodes, self.edges, limit)

    def get_file_owners(self, path: str) -> DataFrame:
        return reports.owners_of(self.nodes, self.edges, path)

    def run_query(self, sql: str) -> DataFrame:
        views = {t: self.table(t) for t in TABLES if t in self.given or (self.path and t in sql)}
        return lookup.guarded_sql(self.spark, sql, **views)

    def get_dead_code(self, **filters) -> DataFrame:
        return dead.filtered(dead.detect(self.nodes, self.edges), **filters)

    def context(self, node: str) -> DataFrame:
        return reports.symbol_context(self.nodes, self.edges, self._id(node))

    def file_context(self, path: str, limit: int = 5) -> DataFrame:
        """(kind, name, in_degree, line_start, n_symbols, file_in_degree, churn): the most referenced symbols of a file."""
        own = self.nodes.where((F.col("path") == path) & (F.col("kind") != "File"))
        counts = own.agg(F.count("*").alias("n_symbols"))
        file = self.nodes.where((F.col("path") == path) & (F.col("kind") == "File")).select(F.col("in_degree").alias("file_in_degree"), "churn")
        top = own.orderBy(F.desc("in_degree"), "id").limit(limit).select("kind", "name", "in_degree", "line_start")
        return top.join(F.broadcast(counts)).join(F.broadcast(file))

    def clones(self, least: float = clones.THRESHOLD, kind: str | None = None) -> DataFrame:
        return lookup.clones(self.table("clones"), least, kind)

    def todos(self, tag_type: str | None = None, comment_type: str | None = None) -> DataFrame:
        return lookup.tags(self.table("tags"), tag_type, comment_type)

    def check(self, toml: str, only: str | None = None) -> DataFrame:
        return rules.run(self.spark, rules.load(toml), self.nodes, self.edges, only)[0]

    def bisect(self, toml: str, violations: int | None = None) -> DataFrame:
        return rules.bisect(rules.load_predicates(toml), self.nodes, violations)

    def docs_coverage(self, by_community: bool = False) -> DataFrame:
        return reports.docs_coverage(self.nodes, by_community)

    def test_gaps(self, limit: int = 20) -> DataFrame:
        return reports.test_gaps(self.nodes, limit)

    def file_facts(self) -> DataFrame:
        return reports.file_facts(self.nodes, self.edges)

    def export(self, how: str, most: int = 100) -> DataFrame:
        makers: dict[str, Callable[[], DataFrame]] = {
            "mermaid": lambda: formats.mermaid(self.nodes, self.edges, most),
            "dot": lambda: formats.dot(self.nodes, self.edges),
            "svg": lambda: formats.svg(self.nodes, self.edges),
            "graphml": lambda: formats.graphml(self.nodes, self.edges),
        }
        return makers[how]()


#: Tools that call() knows by name.
TOOLS = ("get_repo_summary", "find_symbol", "get_neighbors", "get_call_chain", "get_blast_radius", "get_community", "search_graph", "get_hotspots", "get_file_owners", "run_query", "get_dead_code")


def call(graph: Graph, tool: str, arguments: dict | None = None) -> list[dict]:
    """The rows of a tool as plain values; for answers that people or editors read."""
    if tool not in TOOLS:
        raise LookupError(f"no such tool: {tool}")
    return [row.asDict(recursive=True) for row in getattr(graph, tool)(**(arguments or {})).collect()]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="graphloom")
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("analyze", help="index a repository into a graph folder")
    index.add_argument("repository")
    index.add_argument("graph")
    index.add_argument("--no-history", action="store_true")
    ask = commands.add_parser("ask", help="call a tool on a graph folder")
    ask.add_argument("graph")
    ask.add_argument("tool", choices=TOOLS)
    ask.add_argument("arguments", nargs="?", default="{}", help="a JSON object")
    draw = commands.add_parser("export", help="write a graph folder in a text format")
    draw.add_argument("graph")
    draw.add_argument("format", choices=("mermaid", "dot", "svg", "graphml"))
    draw.add_argument("path")
    given = parser.parse_args(argv)
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    if given.command == "analyze":
        save(analyze(spark, given.repository, not given.no_history), given.graph)
    elif given.command == "ask":
        json.dump(call(Graph(spark, given.graph), given.tool, json.loads(given.arguments)), sys.stdout, default=str)
        print()
    else:
        formats.write(Graph(spark, given.graph).export(given.format), given.path)
    return 0


if __name__ == "__main__":
    sys.exit(main())
