"""Graph text formats as DataFrames of lines (section, k, line); sort by section and k, then write `line`.

Lines are built by column expressions, so an export of any size is written by all executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.lookup import induced
from graphloom.operators.storage import positions

MOST = 500
#: Keys of GraphML: id, what for, type.
GRAPHML_KEYS = (("kind", "node", "string"), ("name", "node", "string"), ("path", "node", "string"), ("churn", "node", "double"), ("coupling", "node", "double"), ("community", "node", "long"), ("rel", "edge", "string"), ("weight", "edge", "double"))
#: Colours and arrows by kind.
NODE_COLORS = {"Function": "#00ff88", "Class": "#3b82f6", "File": "#f59e0b", "Module": "#8b5cf6", "Author": "#ec4899", "Variable": "#06b6d4", "Type": "#f97316"}
OTHER_NODE = "#888888"
EDGE_COLORS = {"CALLS": "#50fa7b", "IMPORTS": "#4a9eff", "CO_CHANGES": "#ff5555", "OWNS": "#ffb86c"}
ARROWS = {"CALLS": "-->", "IMPORTS": "-.->", "CO_CHANGES": "==>"}


def _by(column: str, table: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for key, value in table.items():
        out = F.when(F.col(column) == key, value).otherwise(out)
    return out


def _lines(rows: DataFrame, section: int, key: Column | str, line: Column) -> DataFrame:
    return rows.select(F.lit(section).alias("section"), (F.col(key) if isinstance(key, str) else key).cast("string").alias("k"), line.alias("line"))


def _fixed(rows: DataFrame, section: int, *lines: str) -> DataFrame:
    return rows.sparkSession.createDataFrame([(section, f"{k:04d}", line) for k, line in enumerate(lines)], "section int, k string, line string")


def mermaid_id(column: Column) -> Column:
    return F.regexp_replace(column, r"[:./\-()\[\] <>|]", "_")


def mermaid_label(column: Column) -> Column:
    return F.substring(F.translate(column, '"[]', "'()"), 1, 40)


def dot_escape(column: Column) -> Column:
    return F.regexp_replace(F.replace(column, F.lit('"'), F.lit('\\"')), r"[\n\r]", " ")


def xml_escape(column: Column) -> Column:
    # Entities, the ampersand first.
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        column = F.replace(column, F.lit(raw), F.lit(entity))
    return column


def yaml_escape(column: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(column, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def selected(nodes: DataFrame, edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of highest degree among resolved edges, and at most as many edges between them."""
    most = max(1, min(most, MOST))
    inside = induced(nodes, edges)
    degree = inside.select(F.explode(F.array("src", "dst")).alias("_id")).groupBy("_id").agg(F.count("*").alias("_d"))
    top = nodes.join(degree, nodes["id"] == F.col("_id"), "left").withColumn("_d", F.coalesce("_d", F.lit(0))).orderBy(F.desc("_d"), "id").limit(most).select(*nodes.columns, "_d")
    return top, induced(top, edges).orderBy("src", "kind", "dst").limit(most)


def mermaid(nodes: DataFrame, edges: DataFrame, most: int = 100) -> DataFrame:
    top, kept = selected(nodes, edges, most)
    shown = _lines(top, 1, F.format_string("%020d%s", F.lit(10**18) - F.col("_d"), "id"), F.concat(F.lit("  "), mermaid_id(F.col("id")), F.lit('["'), mermaid_label(F.col("name")), F.lit('"]')))
    arrows = _lines(kept, 2, F.concat_ws("|", "src", "kind", "dst"), F.concat(F.lit("  "), mermaid_id(F.col("src")), F.lit(" "), _by("kind", ARROWS, "-->"), F.lit(" "), mermaid_id(F.col("dst"))))
    counts = nodes.agg(F.count("*").alias("n")).join(F.broadcast(edges.agg(F.count("*").alias("e")))).join(F.broadcast(top.agg(F.count("*").alias("t")))).join(F.broadcast(kept.agg(F.count("*").alias("x"))))
    note = _lines(counts.where("t < n"), 3, F.lit(""), F.format_string("  %%%% Showing %d/%d nodes (%d edges filtered)", "t", "n", F.col("e") - F.col("x")))
    return _fixed(nodes, 0, "graph TD").unionByName(shown).unionByName(arrows).unionByName(note)


def dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Width by churn, pen width by weight."""
    top = nodes.agg(F.greatest(F.max("churn"), F.lit(0.01)).alias("_top"))
    sized = nodes.join(F.broadcast(top)).withColumn("_w", F.lit(0.3) + F.lit(0.7) * F.col("churn") / F.col("_top"))
    shown = _lines(sized, 1, "id", F.format_string('  "%s" [label="%s", color="%s", width=%.2f];', dot_escape(F.col("id")), dot_escape(F.col("name")), _by("kind", NODE_COLORS, OTHER_NODE), "_w"))
    pen = F.least(F.greatest(F.col("weight") * 1.5, F.lit(0.5)), F.lit(5.0))
    lines = _lines(induced(nodes, edges), 2, F.concat_ws("|", "src", "kind", "dst"), F.format_string('  "%s" -> "%s" [color="%s", penwidth=%.2f];', dot_escape(F.col("src")), dot_escape(F.col("dst")), _by("kind", EDGE_COLORS, "#999999"), pen))
    return _fixed(nodes, 0, "digraph graph_view {", "  node [shape=circle, style=filled];").unionByName(shown).unionByName(lines).unionByName(_fixed(nodes, 3, "}"))


def circle(nodes: DataFrame, most: int = 200, radius: float = 400.0) -> DataFrame:
    """(id, name, kind, k, x, y) of the first nodes by id, on a circle."""
    first = nodes.orderBy("id").limit(most).select("id", "name", "kind")
    placed = first.withColumn("k", F.row_number().over(W.orderBy("id")) - 1).join(F.broadcast(first.agg(F.count("*").alias("n"))))
    angle = F.lit(2 * math.pi) * F.col("k") / F.col("n")
    return placed.select("id", "name", "kind", "k", (F.lit(500.0) + F.lit(radius) * F.cos(angle)).alias("x"), (F.lit(500.0) + F.lit(radius) * F.sin(angle)).alias("y"))


def grid(nodes: DataFrame, width: float, height: float, padding: float = 0.08) -> DataFrame:
    """(id, x, y): all nodes by id on a grid as square as can be, inside a border."""
    placed = positions(nodes.select("id"), "id").join(F.broadcast(nodes.agg(F.count("*").alias("n"))))
    columns = F.ceil(F.sqrt("n"))
    rows = F.ceil(F.col("n") / columns)
    step = lambda many, whole: F.when(many > 1, F.lit(whole * (1 - 2 * padding)) / (many - 1)).otherwise(0.0)
    k = F.col("position")
    return placed.select("id", (F.lit(width * padding) + (k % columns) * step(columns, width)).alias("x"), (F.lit(height * padding) + F.floor(k / columns) * step(rows, height)).alias("y"))


def bounds(placed: DataFrame) -> DataFrame:
    """One row: the smallest and largest x and y."""
    return placed.agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def svg(nodes: DataFrame, edges: DataFrame, most_nodes: int = 200, most_edges: int = 400) -> DataFrame:
    placed = circle(nodes, most_nodes)
    at = placed.select("id", "x", "y")
    lines = edges.join(F.broadcast(at.toDF("src", "x1", "y1")), "src").join(F.broadcast(at.toDF("dst", "x2", "y2")), "dst").orderBy("src", "kind", "dst").limit(most_edges)
    drawn = _lines(lines, 1, F.concat_ws("|", "src", "kind", "dst"), F.format_string('<line x1="%.1f" y1="%.1f" x2="%.1f" y2="%.1f" stroke="%s"/>', "x1", "y1", "x2", "y2", _by("kind", EDGE_COLORS, "#999999")))
    dots = _lines(placed, 2, "id", F.format_string('<circle cx="%.1f" cy="%.1f" r="5" fill="%s"><title>%s</title></circle>', "x", "y", _by("kind", NODE_COLORS, OTHER_NODE), xml_escape(F.col("name"))))
    head = _fixed(nodes, 0, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 1000 1000">')
    return head.unionByName(drawn).unionByName(dots).unionByName(_fixed(nodes, 3, "</svg>"))


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    head = _fixed(nodes, 0, '<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *(f'  <key id="{k}" for="{on}" attr.name="{k}" attr.type="{kind}"/>' for k, on, kind in GRAPHML_KEYS), '  <graph id="G" edgedefault="directed">')
    data = lambda k, c: F.concat(F.lit(f'<data key="{k}">'), xml_escape(c.cast("string")), F.lit("</data>"))
    shown = _lines(nodes, 1, "id", F.concat(F.lit('    <node id="'), xml_escape(F.col("id")), F.lit('">'), *(data(k, F.col(k)) for k in ("kind", "name", "path", "churn", "coupling", "community")), F.lit("</node>")))
    lines = _lines(edges, 2, F.concat_ws("|", "src", "kind", "dst"), F.concat(F.lit('    <edge source="'), xml_escape(F.col("src")), F.lit('" target="'), xml_escape(F.col("dst")), F.lit('">'), data("rel", F.col("kind")), data("weight", F.col("weight")), F.lit("</edge>")))
    return head.unionByName(shown).unionByName(lines).unionByName(_fixed(nodes, 3, "  </graph>", "</graphml>"))


def json_rows(nodes: DataFrame, edges: DataFrame, communities: DataFrame | None = None) -> DataFrame:
    """(part, json): a row an object; parts are nodes, edges, communities and meta."""
    parts = [(n, df) for n, df in (("nodes", nodes), ("edges", edges), ("communities", communities)) if df is not None]
    rows = [df.select(F.lit(n).alias("part"), F.to_json(F.struct(*df.columns)).alias("json")) for n, df in parts]
    meta = nodes.agg(F.count("*").alias("node_count")).join(F.broadcast(edges.agg(F.count("*").alias("edge_count"))))
    out = meta.select(F.lit("meta").alias("part"), F.to_json(F.struct("node_count", "edge_count")).alias("json"))
    for r in rows:
        out = out.unionByName(r)
    return out


def write(lines: DataFrame, path: str) -> None:
    """The lines as one text file, in order."""
    lines.repartitionByRange(1, "section", "k").sortWithinPartitions("section", "k").select("line").write.mode("overwrite").text(path)
