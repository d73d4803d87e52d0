"""Registered queries on resolution, parsing, communities, exports, incremental runs and the remaining reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.export import formats
from graphloom.functions import paths, text
from graphloom.operators import community, enrich, lookup, rank, reports, resolve, storage, traverse
from graphloom.plans.projection import Graph
from graphloom.plans.queries import COMMUNITIES, FACTS, NORMAL, query
from graphloom.sources import parse
from graphloom.streaming import watch

# Resolution and parsing


@query("J11_import_resolution", ", e AS (SELECT src, CASE WHEN right(src, 1) IN ('1', '2', '3') THEN 'file:nowhere-' || substr(dst, 6) ELSE 'file:' || regexp_replace(f.path, '\\.ts$', '') END AS raw, 'file:' || f.path AS full_path FROM edges JOIN files f ON dst = 'file:' || CAST(f.p_partkey AS VARCHAR) WHERE kind = 'IMPORTS') SELECT src, CASE WHEN starts_with(raw, 'file:nowhere-') THEN raw ELSE full_path END AS dst, CAST(1 AS DOUBLE) AS confidence FROM e")
def import_resolution(g: Graph) -> DataFrame:
    files = g.files.withColumn("file_id", F.concat(F.lit("file:"), F.col("p_partkey").cast("string")))
    raw = F.when(F.substring("src", -1, 1).isin("1", "2", "3"), F.concat(F.lit("file:nowhere-"), F.substring(F.col("dst"), F.lit(6), F.lit(30)))).otherwise(F.concat(F.lit("file:"), F.regexp_replace("path", r"\.ts$", "")))
    edges = g.edges.where("kind = 'IMPORTS'").join(files, F.col("dst") == F.col("file_id")).select("src", raw.alias("dst"), "kind", "weight", "confidence")
    return resolve.imports(edges, resolve.file_nodes(g.files)).select("src", "dst", "confidence")


@query("J12_call_resolution", ", n AS (SELECT id, name FROM raw_nodes WHERE kind = 'Function'), e AS (SELECT c.src, n.name FROM edges c JOIN n ON n.id = c.dst WHERE c.kind = 'CALLS') SELECT DISTINCT e.src, n.id AS dst, 'CALLS' AS kind, CAST(0.8 AS DOUBLE) AS confidence FROM e JOIN n USING (name)")
def call_resolution(g: Graph) -> DataFrame:
    names = g.raw_nodes.where("kind = 'Function'")
    edges = g.edges.where("kind = 'CALLS'").join(names.select(F.col("id").alias("_id"), "name"), F.col("dst") == F.col("_id")).select("src", F.col("name").alias("dst"), "kind", "weight", "confidence")
    return resolve.calls(edges, names).select("src", "dst", "kind", "confidence")


@query("J13_tests", ", t AS (SELECT id, contains(lower(path), '/tests/') AS t FROM raw_nodes) SELECT e.src, e.dst, CASE WHEN s.t AND NOT d.t THEN 'TESTS' ELSE 'CALLS' END AS kind FROM edges e LEFT JOIN t s ON s.id = e.src LEFT JOIN t d ON d.id = e.dst WHERE e.kind IN ('CALLS', 'TESTS')")
def reclassified(g: Graph) -> DataFrame:
    calls = g.edges.where(F.col("kind").isin("CALLS", "TESTS")).withColumn("kind", F.lit("CALLS"))
    return resolve.with_tests(calls, g.raw_nodes).select("src", "dst", "kind")


_SOURCES = """, fns AS (SELECT path, o_orderkey AS k, o_orderstatus = 'O' AS exported, row_number() OVER (PARTITION BY path ORDER BY o_orderkey) AS r FROM orders JOIN (SELECT l_orderkey, min(l_partkey) AS p FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey JOIN files f ON f.p_partkey = p)
"""


def _sources(g: Graph) -> DataFrame:
    """TypeScript files written from orders: a commented function of four lines for each."""
    first = g.table("lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p"))
    fns = g.table("orders").join(first, F.col("o_orderkey") == F.col("l_orderkey")).join(g.files, F.col("p") == F.col("p_partkey"))
    line = F.concat(F.lit("// TODO: see "), F.col("o_orderkey").cast("string"), F.lit("\n"), F.when(F.col("o_orderstatus") == "O", "export function fn_").otherwise("function fn_"), F.col("o_orderkey").cast("string"), F.lit("(x) {\n  if (x && x.ok) { helper(x); }\n}\n"))
    return fns.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("t")))), lambda s: s["t"]), "").alias("content")).withColumn("language", F.lit("typescript"))


@query("P1_parse_nodes", _SOURCES + "SELECT 'fn:' || path || ':fn_' || k AS id, 'Function' AS kind, 'fn_' || k AS name, CAST(4 * r - 2 AS INT) AS line_start, CAST(4 * r AS INT) AS line_end, exported, 0.015 AS complexity FROM fns")
def parse_nodes(g: Graph) -> DataFrame:
    return parse.nodes_of(parse.extract(_sources(g))).select("id", "kind", "name", "line_start", "line_end", "exported", "complexity")


@query("P1d_parse_edges", _SOURCES + "SELECT DISTINCT 'fn:' || path || ':fn_' || k AS src, 'helper' AS dst, 'CALLS' AS kind, CAST(0.7 AS DOUBLE) AS confidence FROM fns UNION ALL SELECT 'file:' || path, 'fn:' || path || ':fn_' || k, 'EXPORTS', 1.0 FROM fns")
def parse_edges(g: Graph) -> DataFrame:
    return parse.edges_of(parse.extract(_sources(g))).select("src", "dst", "kind", "confidence")


@query("P1g_parse_tags", _SOURCES + "SELECT path AS file_path, 'TODO' AS tag_type, 'TODO: see ' || k AS text, CAST(4 * r - 3 AS INT) AS line FROM fns")
def parse_tags(g: Graph) -> DataFrame:
    return parse.tags_of(parse.extract(_sources(g))).select("file_path", "tag_type", "text", "line")


@query("F7_tags", _SOURCES + "SELECT path AS file_path, CAST(4 * r - 3 AS INT) AS line FROM fns")
def tags(g: Graph) -> DataFrame:
    return lookup.tags(parse.tags_of(parse.extract(_sources(g))), "todo", "code").select("file_path", "line")


@query("A30_parse_totals", _SOURCES + "SELECT count(*) AS functions, CAST(0 AS BIGINT) AS classes, CAST(0 AS BIGINT) AS imports FROM fns")
def parse_totals(g: Graph) -> DataFrame:
    parsed = parse.extract(_sources(g))
    kinds = parsed.select(F.size(F.filter("nodes", lambda n: n["kind"] == "Function")).alias("f"), F.size(F.filter("nodes", lambda n: n["kind"] == "Class")).alias("c"), F.size(F.filter("edges", lambda e: e["kind"] == "IMPORTS")).alias("i"))
    return kinds.agg(F.sum("f").alias("functions"), F.sum("c").alias("classes"), F.sum("i").alias("imports"))


@query("S16_snippet", _SOURCES + "SELECT path, 'export function fn_' || k || '(x) {' AS text FROM fns WHERE r = 1 AND exported")
def snippets(g: Graph) -> DataFrame:
    lines = _sources(g).select("path", F.explode(text.snippet(F.col("content"), 2, 2)).alias("s"))
    return lines.select("path", "s.text").where(F.startswith("text", F.lit("export")))


@query("M2_incremental", _SOURCES + "SELECT 'fn:' || path || ':fn_' || k AS id FROM fns")
def incremental(g: Graph) -> DataFrame:
    """A first run over two thirds of the files, some since deleted or changed, then one that parses the rest and what changed."""
    files = _sources(g)
    k = F.pmod(F.crc32(F.col("path").cast("binary")), F.lit(3))
    before = files.where(k != 0).withColumn("content", F.when(k == 1, F.concat("content", F.lit("function old() {}\n"))).otherwise(F.col("content")))
    gone = files.limit(0).unionByName(g.spark.createDataFrame([("gone.ts", "function g() {}", "typescript")], "path string, content string, language string"))
    parsed, hashes = watch.incremental(before.unionByName(gone), g.spark.createDataFrame([], "path string, hash string"), parse.extract(files.limit(0)))
    parsed, _ = watch.incremental(files, storage.stored(hashes, "hashes"), storage.stored(parsed, "parsed"))
    return parse.nodes_of(parsed).select("id")


@query("M1_bursts", "SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS \"end\", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, burst", graph=False)
def bursts(g: Graph) -> DataFrame:
    return watch.bursts(g.table("events"), "user_id", "1 hour")


@query("J28_docs_status", "SELECT path, CASE WHEN p_partkey % 3 = 0 THEN 'new' WHEN p_partkey % 3 = 1 THEN 'changed' ELSE 'unchanged' END AS state FROM files")
def docs_status(g: Graph) -> DataFrame:
    k = F.col("p_partkey") % 3
    now = g.files.select("path", F.sha2("path", 256).alias("hash"))
    saved = g.files.where(k != 0).select("path", F.when(k == 1, F.lit("old")).otherwise(F.sha2("path", 256)).alias("hash"))
    return watch.changed_notes(now, saved)


# Communities


@query("G8_communities")
def communities(g: Graph) -> DataFrame:
    return community.detect(g.raw_nodes, g.edges)


@query(
    "X12_labels",
    COMMUNITIES
    + ", p AS (SELECT community, min(path) AS p0, max(path) AS p1, min(regexp_replace(path, '[^/]*$', '')) AS d0, max(regexp_replace(path, '[^/]*$', '')) AS d1 FROM nodes WHERE path <> '' GROUP BY community), "
    "s AS (SELECT *, string_split(d0, '/') AS a, string_split(d1, '/') AS b, regexp_extract(d0, '([^/]*)/$', 1) AS tail, regexp_replace(regexp_extract(p0, '[^/]*$', 0), '\\.[^.]*$', '') AS stem FROM p), "
    "c AS (SELECT *, regexp_replace(array_to_string(a[1:list_max(list_filter(range(0, 20), lambda k: k <= len(a) AND k <= len(b) AND a[1:k] = b[1:k]))], '/'), '/+$', '') AS prefix FROM s), "
    "o AS (SELECT community, CASE WHEN p0 = p1 THEN CASE WHEN tail IN ('', 'src', '.') THEN stem ELSE tail || '/' || stem END WHEN prefix <> '' THEN prefix END AS own FROM c) "
    "SELECT community, coalesce(own, CASE WHEN trim(label) <> '' AND NOT starts_with(label, 'File:') AND NOT starts_with(label, 'Function:') THEN trim(label) END, 'community-' || community) AS label FROM o LEFT JOIN comm ON comm.id = o.community",
)
def labels(g: Graph) -> DataFrame:
    return paths.community_labels(g.raw_nodes, rank.communities(g.nodes))


# Exports


@query("K10_json")
def json_rows(g: Graph) -> DataFrame:
    return formats.json_rows(g.nodes, g.edges)


@query("K10_json_values", "SELECT 'nodes' AS part, id, kind, name, path, round(churn, 9) AS number FROM nodes UNION ALL SELECT 'edges', src || '|' || kind || '|' || dst, kind, src, dst, round(weight, 9) FROM edges UNION ALL SELECT 'meta', NULL, NULL, NULL, NULL, CAST((SELECT count(*) FROM nodes) AS DOUBLE)")
def json_values(g: Graph) -> DataFrame:
    """The whole export, read as JSON again: values of every row."""
    field = lambda *names: F.coalesce(*(F.get_json_object("json", f"$.{n}") for n in names))
    return formats.json_rows(g.nodes, g.edges).select("part", field("id").alias("id"), field("kind").alias("kind"), field("name", "src").alias("name"), field("path", "dst").alias("path"), F.round(field("churn", "weight", "node_count").cast("double"), 9).alias("number"))


@query("K11_mermaid", ", inside AS (SELECT e.* FROM edges e WHERE e.src IN (SELECT id FROM nodes) AND e.dst IN (SELECT id FROM nodes)), deg AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM inside UNION ALL SELECT dst FROM inside) GROUP BY id), top AS (SELECT n.*, coalesce(d, 0) AS d FROM nodes n LEFT JOIN deg USING (id) ORDER BY coalesce(d, 0) DESC, id LIMIT 50), kept AS (SELECT * FROM inside WHERE src IN (SELECT id FROM top) AND dst IN (SELECT id FROM top) ORDER BY src, kind, dst LIMIT 50) SELECT 'graph TD' AS line UNION ALL SELECT '  ' || regexp_replace(id, '[:./\\-()\\[\\] <>|]', '_', 'g') || '[\"' || left(name, 40) || '\"]' FROM top UNION ALL SELECT '  ' || regexp_replace(src, '[:./\\-()\\[\\] <>|]', '_', 'g') || CASE kind WHEN 'IMPORTS' THEN ' -.-> ' WHEN 'CO_CHANGES' THEN ' ==> ' ELSE ' --> ' END || regexp_replace(dst, '[:./\\-()\\[\\] <>|]', '_', 'g') FROM kept UNION ALL SELECT '  %% Showing 50/' || (SELECT count(*) FROM nodes) || ' nodes (' || ((SELECT count(*) FROM edges) - (SELECT count(*) FROM kept)) || ' edges filtered)'")
def mermaid(g: Graph) -> DataFrame:
    return formats.mermaid(g.raw_nodes, g.edges, 50).select("line")


def _case(column: str, table: dict[str, str], other: str) -> str:
    return f"CASE {column} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())} ELSE '{other}' END"


def _fixed(lines: list[str], section: int) -> str:
    """The fixed lines of a section, as SQL rows."""
    listed = ", ".join("'" + line.replace("'", "''") + "'" for line in lines)
    return f"SELECT {section} AS section, unnest([{listed}]) AS line"


#: Two decimals, halves up in the decimal form, as the JVM prints.
_TWO = "CAST(round(CAST({} AS DECIMAL(18, 10)), 2) AS VARCHAR)"
_DOT = "replace({}, '\"', '\\\"')"
_XML = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


@query(
    "K12_dot",
    ", top AS (SELECT greatest(max(churn), 0.01) AS top FROM nodes) "
    + _fixed(["digraph graph_view {", "  node [shape=circle, style=filled];"], 0)
    + f" UNION ALL SELECT 1, '  \"' || {_DOT.format('id')} || '\" [label=\"' || {_DOT.format('name')} || '\", color=\"' || {_case('kind', formats.NODE_COLORS, formats.OTHER_NODE)} || '\", width=' || {_TWO.format('0.3 + 0.7 * churn / (SELECT top FROM top)')} || '];' FROM nodes"
    + f" UNION ALL SELECT 2, '  \"' || {_DOT.format('src')} || '\" -> \"' || {_DOT.format('dst')} || '\" [color=\"' || {_case('kind', formats.EDGE_COLORS, '#999999')} || '\", penwidth=' || {_TWO.format('least(greatest(weight * 1.5, 0.5), 5.0)')} || '];' FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes) UNION ALL "
    + _fixed(["}"], 3),
)
def dot(g: Graph) -> DataFrame:
    """All lines of the whole graph."""
    return formats.dot(g.nodes, g.edges).select("section", "line")


@query(
    "K13_svg",
    ", c AS (SELECT id, name, kind, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS n FROM (SELECT * FROM nodes ORDER BY id LIMIT 200)), p AS (SELECT id, name, kind, 500 + 400 * cos(2 * pi() * k / n) AS x, 500 + 400 * sin(2 * pi() * k / n) AS y FROM c), "
    "l AS (SELECT e.kind, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM edges e JOIN p a ON a.id = e.src JOIN p b ON b.id = e.dst ORDER BY e.src, e.kind, e.dst LIMIT 400) "
    + _fixed(['<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 1000 1000">'], 0)
    + f" UNION ALL SELECT 1, printf('<line x1=\"%.1f\" y1=\"%.1f\" x2=\"%.1f\" y2=\"%.1f\" stroke=\"%s\"/>', x1, y1, x2, y2, {_case('kind', formats.EDGE_COLORS, '#999999')}) FROM l"
    + f" UNION ALL SELECT 2, printf('<circle cx=\"%.1f\" cy=\"%.1f\" r=\"5\" fill=\"%s\"><title>%s</title></circle>', x, y, {_case('kind', formats.NODE_COLORS, formats.OTHER_NODE)}, {_XML.format('name')}) FROM p UNION ALL "
    + _fixed(["</svg>"], 3),
)
def svg(g: Graph) -> DataFrame:
    """All lines of the picture, which shows 200 nodes and 400 edges at most."""
    return formats.svg(g.nodes, g.edges).select("section", "line")


def _data(key: str, value: str) -> str:
    return f"'<data key=\"{key}\">' || {_XML.format(f'CAST({value} AS VARCHAR)')} || '</data>'"


@query(
    "K14_graphml",
    _fixed(['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *(f'  <key id="{k}" for="{on}" attr.name="{k}" attr.type="{kind}"/>' for k, on, kind in formats.GRAPHML_KEYS), '  <graph id="G" edgedefault="directed">'], 0)
    + f" UNION ALL SELECT 1, '    <node id=\"' || {_XML.format('id')} || '\">' || {' || '.join(_data(k, k) for k in ('kind', 'name', 'path', 'churn', 'coupling', 'community'))} || '</node>' FROM nodes"
    + f" UNION ALL SELECT 2, '    <edge source=\"' || {_XML.format('src')} || '\" target=\"' || {_XML.format('dst')} || '\">' || {_data('rel', 'kind')} || {_data('weight', 'weight')} || '</edge>' FROM edges UNION ALL "
    + _fixed(["  </graph>", "</graphml>"], 3),
)
def graphml(g: Graph) -> DataFrame:
    """All lines of the whole graph."""
    return formats.graphml(g.nodes, g.edges).select("section", "line")


# Other reports


@query("A27_public_by_community", "SELECT community, count(*) AS n FROM nodes WHERE exported AND kind NOT IN ('File', 'Author', 'Module') GROUP BY community")
def public_by_community(g: Graph) -> DataFrame:
    return lookup.public_api(g.raw_nodes).groupBy("community").agg(F.count("*").alias("n"))


@query("A35_entry_points_by_file", "SELECT path, count(*) AS n FROM nodes WHERE in_degree = 0 AND kind NOT IN ('File', 'Author', 'Module') AND NOT is_test_file GROUP BY path")
def entry_points_by_file(g: Graph) -> DataFrame:
    return rank.listed_entry_points(g.nodes).groupBy("path").agg(F.count("*").alias("n"))


_DEPS = "SELECT DISTINCT p_name AS name, p_brand AS version, p_type AS ecosystem FROM part"
_ADVISORIES = "SELECT DISTINCT p_name AS name, p_brand AS version, p_type AS ecosystem, 'CVE-' || CAST(p_size AS VARCHAR) AS cve_id FROM part WHERE p_size % 5 = 0"


@query("A28_dependency_health", f"WITH d AS ({_DEPS}), a AS (SELECT name, version, ecosystem, count(DISTINCT cve_id) AS n FROM ({_ADVISORIES}) GROUP BY ALL) SELECT name, version, ecosystem, coalesce(n, 0) AS cve_count, least(coalesce(n, 0), 5) / 5.0 AS risk_score, CASE WHEN coalesce(n, 0) >= 3 THEN 'CRITICAL' WHEN coalesce(n, 0) >= 1 THEN 'HIGH' ELSE 'OK' END AS label FROM d LEFT JOIN a USING (name, version, ecosystem)", graph=False)
def dependency_health(g: Graph) -> DataFrame:
    part = g.table("part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("version"), F.col("p_type").alias("ecosystem"), "p_size")
    advisories = part.where("p_size % 5 = 0").select("name", "version", "ecosystem", F.concat(F.lit("CVE-"), F.col("p_size").cast("string")).alias("cve_id"))
    return reports.dependency_health(part.drop("p_size").distinct(), advisories).select("name", "version", "ecosystem", "cve_count", "risk_score", "label")


@query("J18_name_fallback", ", e AS (SELECT c.src, CASE WHEN right(c.src, 1) = '7' THEN n.name ELSE c.dst END AS dst FROM edges c JOIN raw_nodes n ON n.id = c.dst WHERE c.kind = 'CALLS') SELECT DISTINCT e.src, n.id AS dst FROM e JOIN raw_nodes n ON n.id = e.dst OR (n.name = e.dst AND e.dst NOT IN (SELECT id FROM raw_nodes))")
def name_fallback(g: Graph) -> DataFrame:
    named = g.edges.where("kind = 'CALLS'").join(g.raw_nodes.select(F.col("id").alias("dst"), "name"), "dst")
    raw = named.select("src", F.when(F.substring("src", -1, 1) == "7", F.col("name")).otherwise(F.col("dst")).alias("dst"))
    return traverse.with_name_fallback(g.raw_nodes, raw)


@query("D6_anti_join", "SELECT DISTINCT author_email FROM blame WHERE author_email NOT IN (SELECT src FROM edges WHERE kind = 'OWNS')")
def unowned(g: Graph) -> DataFrame:
    return g.blame.select("author_email").distinct().join(g.edges.where("kind = 'OWNS'").select(F.col("src").alias("author_email")), "author_email", "left_anti")


@query("K_owns_edges", ", r AS (SELECT *, lines / CAST(sum(lines) OVER (PARTITION BY path) AS DOUBLE) AS share, row_number() OVER (PARTITION BY path ORDER BY lines DESC, author_email) AS r FROM blame) SELECT 'author:' || author_email AS src, 'file:' || path AS dst, round(share, 9) AS weight FROM r WHERE r <= 3")
def owns_edges(g: Graph) -> DataFrame:
    return enrich.ownership_edges(enrich.owners(g.blame)).select("src", "dst", F.round("weight", 9).alias("weight"))


_JOINED = " FROM nodes f LEFT JOIN sy ON sy.path = f.path LEFT JOIN cr ON cr.path = f.path LEFT JOIN ce ON ce.path = f.path LEFT JOIN te ON te.path = f.path"


@query("M3_slice_hashes", FACTS + ", own AS (SELECT path, string_agg(s, ';' ORDER BY s) AS own FROM (SELECT path, id || ':' || line_start || ':' || line_end AS s FROM nodes WHERE kind IN ('Function', 'Class', 'Variable', 'Type')) GROUP BY path) SELECT f.path, sha256(concat_ws(chr(1), f.path, f.community, coalesce(own, ''), coalesce(cr.n, 0), coalesce(ce.n, 0), coalesce(te.n, 0), CAST(floor(coalesce(sy.cx, 0) / 10) AS BIGINT))) AS hash" + _JOINED + " LEFT JOIN own ON own.path = f.path WHERE f.kind = 'File'")
def slice_hashes(g: Graph) -> DataFrame:
    return reports.slice_hashes(reports.file_facts(g.nodes, g.edges), g.raw_nodes)


@query(
    "X22_tldr",
    FACTS
    + "SELECT f.path, '> **' || CASE WHEN f.language = '' THEN 'Source' ELSE f.language END || ' · ' || CASE WHEN contains(lower(f.path), '/tests/') THEN 'test' WHEN coalesce(sy.ex, 0) >= 8 AND coalesce(cr.n, 0) <= 3 THEN 'library' ELSE 'other' END || '** — ' || CASE WHEN coalesce(sy.ex, 0) > 0 THEN sy.ex || ' exported symbol' || CASE WHEN sy.ex = 1 THEN '' ELSE 's' END ELSE 'internal-only' END || ', ' "
    "|| CASE WHEN coalesce(cr.n, 0) = 0 AND coalesce(ce.n, 0) = 0 THEN 'no cross-file edges' WHEN coalesce(ce.n, 0) = 0 THEN 'called by ' || cr.n || ' other file(s)' WHEN coalesce(cr.n, 0) = 0 THEN 'calls into ' || ce.n || ' other file(s)' ELSE 'called by ' || cr.n || ' · calls into ' || ce.n END || '.' || CASE WHEN f.churn >= 0.5 OR coalesce(sy.cx, 0) >= 10 THEN ' · ⚠ hotspot' ELSE '' END AS line"
    + _JOINED
    + " WHERE f.kind = 'File'",
)
def tldr(g: Graph) -> DataFrame:
    return reports.file_facts(g.nodes, g.edges).select("path", reports.tldr().alias("line"))


@query("X3_normalized_bodies", f"SELECT doc_id, {NORMAL} AS body FROM documents", graph=False)
def normalized(g: Graph) -> DataFrame:
    return g.table("documents").select("doc_id", text.normalized_body(F.col("text")).alias("body"))


@query("G11_induced", ", m AS (SELECT id FROM raw_nodes WHERE kind IN ('Class', 'Module')) SELECT src, dst, kind FROM edges WHERE kind IN ('INHERITS', 'DEPENDS_ON') AND src IN (SELECT id FROM m) AND dst IN (SELECT id FROM m)")
def induced(g: Graph) -> DataFrame:
    return traverse.induced_by(g.raw_nodes.where(F.col("kind").isin("Class", "Module")), g.edges, ("INHERITS", "DEPENDS_ON")).select("src", "dst", "kind")
