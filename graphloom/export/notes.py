"""A vault of Markdown notes: one a file, grouped in folders, and index notes; written where the facts changed."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.export.formats import yaml_escape
from graphloom.functions.paths import file_group, safe_filename
from graphloom.operators import lookup, rank, reports
from graphloom.operators.storage import ship
from graphloom.streaming.watch import changed_notes

BEGIN, END = "<!-- prompt:begin -->", "<!-- prompt:end -->"


def file_notes(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, note, text): a note for each file, with its facts and symbols."""
    symbols = nodes.where(F.col("kind").isin("Function", "Class")).select("path", F.struct("line_start", F.format_string("- %s `%s` (line %d, %d references)%s", "kind", "name", "line_start", "in_degree", F.when(F.col("exported"), ", exported").otherwise("")).alias("line")).alias("s"))
    listed = symbols.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["line"]), "\n").alias("symbols"))
    head = F.concat(F.lit("---\npath: "), yaml_escape(F.col("path")), F.lit("\nrole: "), F.col("role"), F.lit("\ngroup: "), yaml_escape(F.col("file_group")), F.lit("\ncommunity: "), F.col("community").cast("string"), F.lit("\n---\n\n"))
    body = F.concat(F.lit("# "), F.col("path"), F.lit("\n\n"), reports.tldr(), F.lit("\n\n## Symbols\n\n"), F.coalesce("symbols", F.lit("None.")), F.lit(f"\n\n{BEGIN}\n{END}\n"))
    note = F.concat(F.lit("files/"), F.col("file_group"), F.lit("/"), safe_filename(F.regexp_replace("path", "/", "-")), F.lit(".md"))
    return facts.join(listed, "path", "left").select("path", note.alias("note"), F.concat(head, body).alias("text"))


def _listing(rows: DataFrame, note: Column, title: Column, line: Column) -> DataFrame:
    """(note, text) of the lines of each note, sorted; a note gathers what belongs to one folder or community."""
    lines = rows.select(note.alias("note"), title.alias("title"), line.alias("line")).groupBy("note", "title").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("t"))
    return lines.select("note", F.concat(F.lit("# "), "title", F.lit("\n\n"), "t", F.lit("\n")).alias("text"))


def public_api_notes(nodes: DataFrame) -> DataFrame:
    """(note, text): the exported symbols of each community."""
    place = F.concat(F.lit("index/public-api/community-"), F.col("community").cast("string"), F.lit(".md"))
    title = F.concat(F.lit("Public API of community "), F.col("community").cast("string"))
    return _listing(lookup.public_api(nodes), place, title, F.format_string("- `%s` (%s) in %s:%d", "name", "kind", "path", "line_start"))


def entry_point_notes(nodes: DataFrame) -> DataFrame:
    """(note, text): the entry points of each group of files."""
    group = file_group(F.col("path"))
    return _listing(rank.listed_entry_points(nodes), F.concat(F.lit("index/entry-points/"), group, F.lit(".md")), F.concat(F.lit("Entry points of "), group), F.format_string("- `%s` in %s: %s", "name", "path", "reason"))


NAVIGATE = """# How to find things

- `files/` has a note for each file: its role, its symbols and who refers to them.
- `index/public-api/` lists what each community exports, `index/entry-points/` what nothing refers to.
- `index/architecture.md` has the links between communities, `index/ownership.md` who owns how much.
- `index/hotspots.md` and `index/complexity.md` say where changes are risky.
- Text between the prompt markers of a note is yours and is kept.
"""


def index_notes(nodes: DataFrame, facts: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(note, text) of the index notes: overview, navigation, glossary, public symbols, architecture, entry points, risk (hotspots, complexity), coverage, roles, ownership.

    Lists that grow with the code are cut by community or group of files; the others are rankings of fixed length or have a line a community or author.
    """
    spark = nodes.sparkSession

    def note(name: str, title: str, rows: DataFrame, line) -> DataFrame:
        lines = rows.select(line.alias("line")).agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("t"))
        return lines.select(F.lit(f"index/{name}.md").alias("note"), F.concat(F.lit(f"# {title}\n\n"), F.when(F.col("t") == "", "None.").otherwise(F.col("t")), F.lit("\n")).alias("text"))

    parts = [
        spark.createDataFrame([("index/navigation.md", NAVIGATE)], "note string, text string"),
        public_api_notes(nodes),
        entry_point_notes(nodes),
        note("overview", "Overview", rank.counts_by_kind(nodes).unionByName(rank.language_breakdown(nodes).select(F.col("language").alias("kind"), "n")), F.format_string("- %s: %d", "kind", "n")),
        note("hotspots", "Hotspots", rank.hotspots(nodes, 30, churned_only=True), F.format_string("- %s (score %.3f)", "path", "score")),
        note("roles", "Roles", facts.groupBy("role").agg(F.count("*").alias("n")), F.format_string("- %s: %d", "role", "n")),
        note("groups", "Groups", reports.group_sizes(nodes), F.format_string("- %s: %d files, %d exported symbols", "file_group", "files", "exported")),
        note("glossary", "Glossary", rank.glossary(nodes), F.format_string("- %s %s: %d", "section", "name", "n")),
        note("docs-coverage", "Documentation coverage", reports.docs_coverage(nodes, by_community=True), F.format_string("- community %d: %.1f %%", "community", "pct")),
        note("complexity", "Complexity", rank.complex_functions(nodes), F.format_string("- `%s` in %s: %.2f", "name", "path", "complexity")),
    ]
    if edges is not None:
        crossing = rank.cross_cluster(nodes, edges, rank.communities(nodes))
        parts += [
            note("architecture", "Architecture", crossing, F.format_string("- %s to %s: %d links", "src_label", "dst_label", "edge_count")),
            note("ownership", "Ownership", rank.ownership(nodes, edges), F.format_string("- %s: %d files (%.1f %%)", "name", "files", F.col("share") * 100)),
        ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write(notes: DataFrame, root: str) -> int:
    """Writes (note, text) below a folder that all workers share; how many."""
    ship(notes.sparkSession)

    def put(batches: Iterator) -> Iterator:
        for pdf in batches:
            for name, text in zip(pdf["note"], pdf["text"], strict=True):
                path = os.path.join(root, name)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "w") as out:
                    out.write(text)
            yield pdf[["note"]]

    return notes.select("note", "text").mapInPandas(put, "note string").count()


def generate(nodes: DataFrame, edges: DataFrame, root: str, saved: DataFrame | None = None) -> tuple[int, DataFrame]:
    """(notes written, hashes to save): the notes of files whose facts differ from the saved (path, hash), and the indices."""
    facts = reports.file_facts(nodes, edges)
    hashes = reports.slice_hashes(facts, nodes)
    notes = file_notes(facts, nodes)
    if saved is not None:
        state = changed_notes(hashes, saved).where("state <> 'unchanged'").select("path")
        notes = notes.join(state, "path", "left_semi")
    return write(notes, root) + write(index_notes(nodes, facts, edges), root), hashes


def unfilled(spark: SparkSession, root: str) -> DataFrame:
    """(note, path): notes whose part between the markers is still empty."""
    texts = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("note"), "value")
    empty = texts.where(F.col("value").rlike(re.escape(BEGIN) + r"\s*" + re.escape(END)))
    return empty.select("note", F.regexp_extract("value", r'(?s)^---\n.*?\bpath: "?([^"\n]*)"?', 1).alias("path"))


def readme_excerpt(text: str, most: int = 600) -> str:
    """The first paragraph that is prose, cut at a word."""
    for block in re.split(r"\n\s*\n", text):
        plain = re.sub(r"[*_`]|!?\[([^\]]*)\]\([^)]*\)", r"\1", block).strip()
        if plain and not plain.startswith(("#", "<", "|", "-", ">", "!")):
            plain = re.sub(r"\s+", " ", plain)
            return plain if len(plain) <= most else plain[:most].rsplit(" ", 1)[0] + "…"
    return ""
