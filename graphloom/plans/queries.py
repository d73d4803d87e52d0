"""Registered queries over the projected graph, each with DuckDB SQL of its own where SQL can say it.

Keys start with the ids of the operator inventory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import paths, text
from graphloom.operators import clones, dead, enrich, lookup, rank, reports, rules, storage, traverse
from graphloom.plans.projection import PRELUDE, Graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, graph: bool = True):
    """Registers a function of a Graph; sql continues the graph's common table expressions where graph is set."""

    def add(f: Callable[[Graph], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Graph(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = (PRELUDE + sql) if graph else sql
        return f

    return add


# Scans, counts, lookups


@query("S9_all_nodes", "SELECT id, kind, name, path, line_start, line_end, language, community, in_degree, out_degree, exported, is_test_file, test_count, is_tested, round(churn, 9) AS churn, round(coupling, 9) AS coupling, round(complexity, 9) AS complexity, doc_comment FROM nodes")
def all_nodes(g: Graph) -> DataFrame:
    rounded = g.nodes.withColumns({c: F.round(c, 9) for c in ("churn", "coupling", "complexity")})
    return rounded.select("id", "kind", "name", "path", "line_start", "line_end", "language", "community", "in_degree", "out_degree", "exported", "is_test_file", "test_count", "is_tested", "churn", "coupling", "complexity", "doc_comment")


@query("S9_all_edges", "SELECT src || '|' || kind || '|' || dst AS id, src, dst, kind, weight, confidence FROM edges")
def all_edges(g: Graph) -> DataFrame:
    return g.edges.select("id", "src", "dst", "kind", "weight", "confidence")


@query("A1_counts", "SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count")
def counts(g: Graph) -> DataFrame:
    return rank.counts(g.raw_nodes, g.edges)


@query("A2_counts_by_kind", "SELECT kind, count(*) AS n FROM nodes GROUP BY kind")
def counts_by_kind(g: Graph) -> DataFrame:
    return rank.counts_by_kind(g.raw_nodes)


@query("A3_language_breakdown", "SELECT language, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 9) AS share FROM nodes WHERE language <> '' GROUP BY language")
def language_breakdown(g: Graph) -> DataFrame:
    return rank.language_breakdown(g.raw_nodes).withColumn("share", F.round("share", 9))


@query("A4_degrees", "SELECT id, in_degree, out_degree FROM nodes")
def degrees(g: Graph) -> DataFrame:
    return enrich.with_degrees(g.raw_nodes, g.edges).select("id", "in_degree", "out_degree")


@query("A5_coupling", "SELECT path, in_degree, round(coupling, 9) AS coupling FROM nodes WHERE kind = 'File'")
def coupling(g: Graph) -> DataFrame:
    return enrich.with_coupling(enrich.with_degrees(g.raw_nodes, g.edges)).where("kind = 'File'").select("path", "in_degree", F.round("coupling", 9).alias("coupling"))


@query("A19_churn", "SELECT path, n AS commits, round(CAST(n AS DOUBLE) / (SELECT max(n) FROM counted), 9) AS churn FROM counted")
def churn(g: Graph) -> DataFrame:
    return g.churn.withColumn("churn", F.round("churn", 9))


_PAIRS = """, recent AS (SELECT DISTINCT sha, path FROM commits WHERE ts >= (SELECT max(ts) FROM commits) - INTERVAL 365 DAY),
pairs AS (SELECT a.path AS a, b.path AS b, count(*) AS commits FROM recent a JOIN recent b ON a.sha = b.sha AND a.path < b.path GROUP BY a.path, b.path)
"""


@query("A20_cochange", _PAIRS + "SELECT a, b, commits, round(CAST(commits AS DOUBLE) / (SELECT max(commits) FROM pairs), 9) AS weight FROM pairs WHERE commits >= 2")
def cochange(g: Graph) -> DataFrame:
    return enrich.cochange(g.commits).withColumn("weight", F.round("weight", 9))


@query("G12_cochange_edges", _PAIRS + "SELECT 'file:' || a AS src, 'file:' || b AS dst, round(CAST(commits AS DOUBLE) / (SELECT max(commits) FROM pairs), 9) AS weight FROM pairs WHERE commits >= 2 UNION ALL SELECT 'file:' || b, 'file:' || a, round(CAST(commits AS DOUBLE) / (SELECT max(commits) FROM pairs), 9) FROM pairs WHERE commits >= 2")
def cochange_edges(g: Graph) -> DataFrame:
    return enrich.cochange_edges(enrich.cochange(g.commits)).select("src", "dst", F.round("weight", 9).alias("weight"))


@query("A21_owners", "SELECT path, author_name, author_email, lines, round(share, 9) AS share, CAST(r AS INT) AS rank FROM (SELECT *, lines / CAST(sum(lines) OVER (PARTITION BY path) AS DOUBLE) AS share, row_number() OVER (PARTITION BY path ORDER BY lines DESC, author_email) AS r FROM blame) WHERE r <= 3")
def owners(g: Graph) -> DataFrame:
    return enrich.owners(g.blame).withColumn("share", F.round("share", 9))


@query("F1_get_node", "SELECT id, kind, name, path, in_degree, out_degree FROM nodes WHERE id = 'fn:100'")
def get_node(g: Graph) -> DataFrame:
    return lookup.get_node(g.nodes, "fn:100").select("id", "kind", "name", "path", "in_degree", "out_degree")


@query("F2_find", "SELECT id, kind, name, in_degree FROM nodes WHERE contains(lower(name), 'fn_12') OR contains(lower(id), 'fn_12') ORDER BY lower(name) = 'fn_12' DESC, in_degree DESC, id LIMIT 20")
def find(g: Graph) -> DataFrame:
    return lookup.find(g.nodes, "fn_12").select("id", "kind", "name", "in_degree")


@query("F3_find_symbol", "SELECT id, kind, name, path, line_start, in_degree, out_degree FROM nodes WHERE (contains(lower(name), 'customer#00000001') OR contains(lower(id), 'customer#00000001')) AND lower(kind) = 'class' ORDER BY id LIMIT 20")
def find_symbol(g: Graph) -> DataFrame:
    return lookup.find_symbol(g.nodes, "Customer#00000001", "class")


@query("F4_search", "SELECT id, kind, name, path FROM nodes WHERE contains(lower(name), 'widget') OR contains(lower(path), 'widget')")
def search(g: Graph) -> DataFrame:
    return lookup.search(g.raw_nodes, "Widget", None).select("id", "kind", "name", "path")


@query("F5_resolve", "SELECT id, rank FROM (SELECT id, CASE WHEN id = 'NATION_3' THEN 0 WHEN lower(name) = 'nation_3' THEN 1 WHEN contains(lower(name), 'nation_3') THEN 2 WHEN lower(path) = 'nation_3' THEN 3 WHEN id = 'file:NATION_3' THEN 4 END AS rank FROM nodes) WHERE rank IS NOT NULL ORDER BY rank, id LIMIT 1")
def resolve(g: Graph) -> DataFrame:
    return lookup.resolve(g.raw_nodes, "NATION_3", with_paths=True).select("id", "rank")


@query("F6_community", "SELECT id, kind, name FROM nodes WHERE community = 5")
def in_community(g: Graph) -> DataFrame:
    return lookup.in_community(g.raw_nodes, 5).select("id", "kind", "name")


@query("F9_public_api_path", "SELECT id, kind, name, path, line_start FROM nodes WHERE exported AND kind NOT IN ('File', 'Author', 'Module') AND starts_with(path, 'economy/')")
def public_api_path(g: Graph) -> DataFrame:
    return lookup.public_api(g.raw_nodes, prefix="economy/").select("id", "kind", "name", "path", "line_start")


@query("F9_public_api_community", "SELECT id, kind, name, path, line_start FROM nodes WHERE exported AND kind NOT IN ('File', 'Author', 'Module') AND community = 3")
def public_api_community(g: Graph) -> DataFrame:
    return lookup.public_api(g.raw_nodes, community=3).select("id", "kind", "name", "path", "line_start")


@query("F10_by_complexity", "SELECT id, name, path, round(complexity, 9) AS complexity FROM nodes WHERE kind = 'Function' AND complexity >= 0.1 ORDER BY nodes.complexity DESC, id LIMIT 20")
def by_complexity(g: Graph) -> DataFrame:
    return lookup.by_complexity(g.raw_nodes, 20, 0.1).select("id", "name", "path", F.round("complexity", 9).alias("complexity"))


@query("F12_doc_comment", "SELECT id, doc_comment FROM nodes WHERE id = 'fn:7'")
def doc_comment(g: Graph) -> DataFrame:
    return lookup.doc_comment(g.raw_nodes, "fn:7")


@query("F13_test_paths", "SELECT path, contains(lower(path), '/tests/') AS is_test FROM files")
def test_paths(g: Graph) -> DataFrame:
    return g.files.select("path", enrich.is_test_path(F.col("path")).alias("is_test"))


@query("F16_view", ", k AS (SELECT id FROM nodes WHERE starts_with(path, 'small/')) SELECT e.src, e.dst, e.kind FROM edges e WHERE e.src IN (SELECT id FROM k) AND e.dst IN (SELECT id FROM k)")
def view(g: Graph) -> DataFrame:
    return lookup.view(g.raw_nodes, g.edges, prefix="small/")[1].select("src", "dst", "kind")


@query("F17_folder_exports", "SELECT id, kind, name, path FROM nodes WHERE starts_with(path, 'economy/brand2/') AND kind IN ('Function', 'Class') AND exported ORDER BY in_degree DESC, id LIMIT 15")
def folder_exports(g: Graph) -> DataFrame:
    return lookup.folder(g.nodes, "economy/brand2/")[0].select("id", "kind", "name", "path")


@query("F17_folder_hotspots", "SELECT id, path, round(churn * coupling, 9) AS heat FROM nodes WHERE starts_with(path, 'economy/brand2/') AND kind = 'File' ORDER BY churn * coupling DESC, id LIMIT 3")
def folder_hotspots(g: Graph) -> DataFrame:
    return lookup.folder(g.nodes, "economy/brand2/")[1].select("id", "path", F.round(F.col("churn") * F.col("coupling"), 9).alias("heat"))


@query("F18_run_query", "SELECT kind, count(*) AS n, max(in_degree) AS most FROM nodes GROUP BY kind")
def run_query(g: Graph) -> DataFrame:
    return lookup.guarded_sql(g.spark, "SELECT kind, count(*) AS n, max(in_degree) AS most FROM nodes GROUP BY kind", nodes=g.nodes, edges=g.edges)


@query(
    "F20_keywords",
    f"""SELECT conv_id, turn, array_to_string(kw, ' ') AS keywords FROM (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: strlen(w) > 1 AND w NOT IN ({", ".join(f"'{w}'" for w in lookup.STOP_WORDS)})) AS all_words,
    list_filter(all_words, lambda w, i: list_position(all_words, w) = i) AS kw FROM conversations)""",
    graph=False,
)
def keywords(g: Graph) -> DataFrame:
    return g.table("conversations").select("conv_id", "turn", F.array_join(lookup.keywords(F.col("text")), " ").alias("keywords"))


# Joins


@query("J4_community_edges", "SELECT DISTINCT e.src, e.dst, e.kind, e.weight FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.community = 5 AND b.community = 5")
def community_edges(g: Graph) -> DataFrame:
    return rank.community_edges(g.raw_nodes, g.edges, 5)


COMMUNITIES = """, ranked AS (SELECT community, kind || ':' || name AS t, row_number() OVER (PARTITION BY community ORDER BY in_degree DESC, name, id) AS r, count(*) OVER (PARTITION BY community) AS n FROM nodes WHERE community > 0),
comm AS (SELECT community AS id, max(CASE WHEN r = 1 THEN t END) AS label, any_value(n) AS node_count, string_agg(t, ',' ORDER BY r) AS top_nodes FROM ranked WHERE r <= 5 GROUP BY community)
"""


@query("A6_communities", COMMUNITIES + "SELECT id, label, node_count, top_nodes FROM comm")
def communities(g: Graph) -> DataFrame:
    return rank.communities(g.nodes).withColumn("top_nodes", F.array_join("top_nodes", ","))


@query("J5_cross_cluster", COMMUNITIES + "SELECT a.community AS src_community, coalesce(ca.label, '') AS src_label, b.community AS dst_community, coalesce(cb.label, '') AS dst_label, count(*) AS edge_count, sum(e.weight) AS total_weight FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst LEFT JOIN comm ca ON ca.id = a.community LEFT JOIN comm cb ON cb.id = b.community WHERE a.community <> b.community AND a.community > 0 AND b.community > 0 AND e.kind IN ('CALLS', 'IMPORTS', 'INHERITS', 'DEPENDS_ON') GROUP BY 1, 2, 3, 4")
def cross_cluster(g: Graph) -> DataFrame:
    return rank.cross_cluster(g.nodes, g.edges, rank.communities(g.nodes))


@query("J3_ownership", "SELECT name, count(*) AS files, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 9) AS share FROM edges e JOIN nodes a ON a.id = e.src WHERE e.kind = 'OWNS' AND a.kind = 'Author' GROUP BY name")
def ownership(g: Graph) -> DataFrame:
    return rank.ownership(g.raw_nodes, g.edges).withColumn("share", F.round("share", 9))


_FILE = "(SELECT path FROM files WHERE p_partkey = 1)"


def _path(g: Graph, key: int) -> str:
    return g.files.where(F.col("p_partkey") == key).first()["path"]


@query("J6_cross_file_callers", f"SELECT DISTINCT n.id, n.kind, n.path FROM nodes n JOIN edges e ON e.src = n.id JOIN nodes t ON t.id = e.dst WHERE t.path = {_FILE} AND n.path <> {_FILE} AND e.kind IN ('CALLS', 'IMPORTS', 'INHERITS') AND n.kind NOT IN ('File', 'Author')")
def cross_file_callers(g: Graph) -> DataFrame:
    return reports.cross_file(g.raw_nodes, g.edges, _path(g, 1), True).select("id", "kind", "path")


@query("J6_cross_file_callees", f"SELECT DISTINCT n.id, n.kind, n.path FROM nodes n JOIN edges e ON e.dst = n.id JOIN nodes s ON s.id = e.src WHERE s.path = {_FILE} AND n.path <> {_FILE} AND e.kind IN ('CALLS', 'IMPORTS', 'INHERITS') AND n.kind NOT IN ('File', 'Author')")
def cross_file_callees(g: Graph) -> DataFrame:
    return reports.cross_file(g.raw_nodes, g.edges, _path(g, 1), False).select("id", "kind", "path")


@query("J7_tests_of", f"SELECT DISTINCT n.id, n.kind, n.path FROM nodes n JOIN edges e ON e.src = n.id JOIN nodes t ON t.id = e.dst WHERE t.path = {_FILE} AND n.is_test_file")
def tests_of(g: Graph) -> DataFrame:
    return reports.tests_of(g.raw_nodes, g.edges, _path(g, 1)).select("id", "kind", "path")


@query("J8_owners_of", f"SELECT a.name, e.weight, CAST(round(e.weight * greatest(f.line_end - f.line_start, 1)) AS BIGINT) AS lines FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes f ON f.id = e.dst WHERE f.path = {_FILE} AND f.kind = 'File' AND e.kind = 'OWNS' AND a.kind = 'Author' ORDER BY e.weight DESC, a.name LIMIT 10")
def owners_of(g: Graph) -> DataFrame:
    return reports.owners_of(g.raw_nodes, g.edges, _path(g, 1))


@query("J15_hotspots_with_owner", ", h AS (SELECT id, path, churn, coupling, churn * coupling + 0.01 * in_degree AS score FROM nodes WHERE kind = 'File' AND (churn > 0 OR in_degree > 0) ORDER BY score DESC, path LIMIT 20) SELECT path, round(churn, 9) AS churn, round(coupling, 9) AS coupling, round(score, 9) AS score, coalesce((SELECT a.name FROM edges e JOIN nodes a ON a.id = e.src WHERE e.dst = h.id AND e.kind = 'OWNS' ORDER BY e.weight DESC, a.name LIMIT 1), '') AS owner FROM h")
def hotspots_with_owner(g: Graph) -> DataFrame:
    return rank.hotspots_with_owner(g.nodes, g.edges).withColumns({c: F.round(c, 9) for c in ("churn", "coupling", "score")})


@query("J17_symbol_context", """, c AS (SELECT 'caller' AS role, id, name, kind, path, in_degree FROM nodes WHERE id IN (SELECT src FROM edges WHERE kind IN ('CALLS', 'INHERITS', 'TESTS') AND dst IN ('fn:100', (SELECT name FROM nodes WHERE id = 'fn:100'))) AND id <> 'fn:100'
UNION ALL SELECT 'dependency', id, name, kind, path, in_degree FROM nodes WHERE id IN (SELECT dst FROM edges WHERE kind IN ('CALLS', 'IMPORTS', 'INHERITS') AND src = 'fn:100') AND id <> 'fn:100'
UNION ALL (SELECT 'peer', id, name, kind, path, in_degree FROM nodes WHERE community = (SELECT community FROM nodes WHERE id = 'fn:100') AND community > 0 AND id <> 'fn:100' AND kind IN ('Function', 'Class') ORDER BY in_degree DESC, id LIMIT 3))
SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY in_degree DESC, id) AS r FROM c) WHERE r <= 5""")
def symbol_context(g: Graph) -> DataFrame:
    return reports.symbol_context(g.nodes, g.edges, "fn:100")


FACTS = """, ends AS (SELECT e.*, a.path AS sp, a.kind AS sk, a.is_test_file AS st, b.path AS dp, b.kind AS dk FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst),
cr AS (SELECT dp AS path, count(DISTINCT src) AS n FROM ends WHERE kind IN ('CALLS', 'IMPORTS', 'INHERITS') AND sp <> dp AND sk NOT IN ('File', 'Author') GROUP BY dp),
ce AS (SELECT sp AS path, count(DISTINCT dst) AS n FROM ends WHERE kind IN ('CALLS', 'IMPORTS', 'INHERITS') AND sp <> dp AND dk NOT IN ('File', 'Author') GROUP BY sp),
te AS (SELECT dp AS path, count(DISTINCT src) AS n FROM ends WHERE st GROUP BY dp),
sy AS (SELECT path, count(*) AS n, max(complexity) AS cx, count(*) FILTER (exported) AS ex FROM nodes WHERE kind IN ('Function', 'Class', 'Variable', 'Type') GROUP BY path)
"""


@query("Q15_file_facts", FACTS + "SELECT f.path, f.language, round(f.churn, 9) AS churn, f.community, round(coalesce(sy.cx, 0), 9) AS complexity, coalesce(sy.ex, 0) AS exported_count, coalesce(sy.n, 0) AS n_symbols, coalesce(cr.n, 0) AS n_callers, coalesce(ce.n, 0) AS n_callees, coalesce(te.n, 0) AS n_tests FROM nodes f LEFT JOIN sy ON sy.path = f.path LEFT JOIN cr ON cr.path = f.path LEFT JOIN ce ON ce.path = f.path LEFT JOIN te ON te.path = f.path WHERE f.kind = 'File'")
def file_facts(g: Graph) -> DataFrame:
    facts = reports.file_facts(g.nodes, g.edges).drop("role", "file_group")
    return facts.withColumns({c: F.round(c, 9) for c in ("churn", "complexity")})


@query("A24_roles", FACTS + "SELECT CASE WHEN contains(lower(f.path), '/tests/') THEN 'test' WHEN coalesce(sy.ex, 0) >= 8 AND coalesce(cr.n, 0) <= 3 THEN 'library' ELSE 'other' END AS role, count(*) AS n FROM nodes f LEFT JOIN sy ON sy.path = f.path LEFT JOIN cr ON cr.path = f.path WHERE f.kind = 'File' GROUP BY 1")
def roles(g: Graph) -> DataFrame:
    return reports.file_facts(g.nodes, g.edges).groupBy("role").agg(F.count("*").alias("n"))


@query("A25_groups", "SELECT regexp_extract(path, '^[^/]*/[^/]*', 0) AS file_group, count(*) AS n FROM files GROUP BY 1")
def groups(g: Graph) -> DataFrame:
    return g.files.groupBy(paths.file_group(F.col("path")).alias("file_group")).agg(F.count("*").alias("n"))


@query("W9_collisions", ", p AS (SELECT regexp_replace(path, '-[0-9]+\\.ts$', '.ts') AS path FROM files) SELECT path, regexp_extract(path, '^[^/]*/[^/]*', 0) AS file_group, regexp_extract(path, '[^/]*$', 0) AS basename, count(*) OVER (PARTITION BY regexp_extract(path, '^[^/]*/[^/]*', 0), regexp_extract(path, '[^/]*$', 0)) > 1 AS collides FROM p")
def collisions(g: Graph) -> DataFrame:
    """Without the number that keeps the names of files apart."""
    return reports.name_collisions(g.files.withColumn("path", F.regexp_replace("path", r"-[0-9]+\.ts$", ".ts")))


# Aggregations and rankings


@query("A10_docs_coverage", "SELECT count(*) AS total, count(*) FILTER (coalesce(doc_comment, '') <> '') AS documented, round(coalesce(100.0 * count(*) FILTER (coalesce(doc_comment, '') <> '') / nullif(count(*), 0), 0), 6) AS pct FROM nodes WHERE kind IN ('Function', 'Class') AND NOT contains(path, 'test')")
def docs_coverage(g: Graph) -> DataFrame:
    return reports.docs_coverage(g.raw_nodes).withColumn("pct", F.round("pct", 6))


@query("A11_docs_by_community", "SELECT community, count(*) AS total, count(*) FILTER (coalesce(doc_comment, '') <> '') AS documented, round(100.0 * count(*) FILTER (coalesce(doc_comment, '') <> '') / count(*), 6) AS pct FROM nodes WHERE kind IN ('Function', 'Class') AND NOT contains(path, 'test') GROUP BY community")
def docs_by_community(g: Graph) -> DataFrame:
    return reports.docs_coverage(g.raw_nodes, by_community=True).withColumn("pct", F.round("pct", 6))


@query("A12_undocumented", "SELECT id, name, path, in_degree FROM nodes WHERE kind = 'Function' AND coalesce(doc_comment, '') = '' ORDER BY in_degree DESC, id LIMIT 10")
def undocumented(g: Graph) -> DataFrame:
    return reports.undocumented(g.nodes).select("id", "name", "path", "in_degree")


@query("A13_test_flags", "SELECT id, test_count, is_tested FROM nodes")
def test_flags(g: Graph) -> DataFrame:
    return enrich.with_test_coverage(g.raw_nodes, g.edges).select("id", "test_count", "is_tested")


@query("A14_test_coverage", "SELECT count(*) AS total, count(*) FILTER (is_tested) AS tested, count(*) FILTER (NOT is_tested) AS untested, round(100.0 * count(*) FILTER (is_tested) / count(*), 6) AS pct FROM nodes WHERE kind IN ('Function', 'Class') AND NOT is_test_file")
def test_coverage(g: Graph) -> DataFrame:
    return reports.test_coverage(g.nodes).withColumn("pct", F.round("pct", 6))


@query("A15_tests_by_community", "SELECT community, count(*) AS total, count(*) FILTER (is_tested) AS tested FROM nodes WHERE kind = 'Function' AND NOT is_test_file GROUP BY community ORDER BY total DESC, community LIMIT 20")
def tests_by_community(g: Graph) -> DataFrame:
    return reports.test_coverage_by_community(g.nodes)


@query("A16_tests_edges", "SELECT count(*) AS n FROM edges WHERE kind = 'TESTS'")
def tests_edges(g: Graph) -> DataFrame:
    return g.edges.where("kind = 'TESTS'").agg(F.count("*").alias("n"))


@query("A26_glossary", "SELECT 'kind' AS section, kind AS name, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'community', CAST(community AS VARCHAR), count(*) FROM nodes GROUP BY community UNION ALL SELECT 'singletons', '', count(*) FILTER (n = 1) FROM (SELECT count(*) AS n FROM nodes GROUP BY community)")
def glossary(g: Graph) -> DataFrame:
    return rank.glossary(g.raw_nodes)


@query("A29_community_main_file", "SELECT path, count(*) AS n FROM nodes WHERE community = 4 AND path <> '' GROUP BY path ORDER BY n DESC, path LIMIT 1")
def community_main_file(g: Graph) -> DataFrame:
    return rank.community_doc(g.raw_nodes, 4)[0]


@query("A34_eviction", "SELECT s_suppkey AS id, CAST(floor(s_acctbal + 1000) AS BIGINT) AS size, (SELECT sum(CAST(floor(s_acctbal + 1000) AS BIGINT)) FROM supplier) - coalesce(sum(CAST(floor(s_acctbal + 1000) AS BIGINT)) OVER (ORDER BY s_nationkey, s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 100000 AS evict FROM supplier", graph=False)
def eviction(g: Graph) -> DataFrame:
    repos = g.table("supplier").select(F.col("s_suppkey").alias("id"), F.floor(F.col("s_acctbal") + 1000).cast("long").alias("size"), F.col("s_nationkey").alias("last_used_at"))
    return storage.evicted(repos, 100_000)


@query("T1_hotspots", "SELECT path, round(churn, 9) AS churn, round(coupling, 9) AS coupling, in_degree, round(churn * coupling + 0.01 * in_degree, 9) AS score FROM nodes WHERE kind = 'File' AND (churn > 0 OR in_degree > 0) ORDER BY churn * coupling + 0.01 * in_degree DESC, path LIMIT 20")
def hotspots(g: Graph) -> DataFrame:
    return rank.hotspots(g.nodes).withColumns({c: F.round(c, 9) for c in ("churn", "coupling", "score")})


@query("T1b_churned_hotspots", "SELECT path, round(churn * coupling + 0.01 * in_degree, 9) AS score FROM nodes WHERE kind = 'File' AND churn > 0 ORDER BY churn * coupling + 0.01 * in_degree DESC, path LIMIT 30")
def churned_hotspots(g: Graph) -> DataFrame:
    return rank.hotspots(g.nodes, 30, churned_only=True).select("path", F.round("score", 9).alias("score"))


@query("T2_entry_points", "SELECT id, kind, name, out_degree FROM nodes WHERE in_degree = 0 AND kind NOT IN ('File', 'Author') ORDER BY out_degree DESC, id LIMIT 20")
def entry_points(g: Graph) -> DataFrame:
    return rank.entry_points(g.nodes).select("id", "kind", "name", "out_degree")


@query("T3_listed_entry_points", "SELECT id, kind, name, path, line_start, exported, out_degree, CASE WHEN exported THEN 'exported, no callers' WHEN kind IN ('Function', 'Method') THEN 'no callers in graph (CLI entry / event handler / dead candidate)' ELSE 'no incoming references' END AS reason FROM nodes WHERE in_degree = 0 AND kind NOT IN ('File', 'Author', 'Module') AND NOT is_test_file")
def listed_entry_points(g: Graph) -> DataFrame:
    return rank.listed_entry_points(g.nodes)


@query("T4_god_nodes", "SELECT id, kind, name, in_degree FROM nodes WHERE in_degree > 0 AND kind NOT IN ('File', 'Author') ORDER BY in_degree DESC, id LIMIT 20")
def god_nodes(g: Graph) -> DataFrame:
    return rank.god_nodes(g.nodes).select("id", "kind", "name", "in_degree")


@query("W3_god_names", "SELECT name, id, kind, in_degree FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY in_degree DESC, id) AS r FROM nodes WHERE in_degree > 0 AND kind NOT IN ('File', 'Author')) WHERE r = 1 ORDER BY in_degree DESC, name LIMIT 20")
def god_names(g: Graph) -> DataFrame:
    return rank.god_names(g.nodes)


@query("T5_most_referenced", "SELECT id, kind, name, in_degree FROM nodes WHERE kind <> 'File' ORDER BY in_degree DESC, id LIMIT 5")
def most_referenced(g: Graph) -> DataFrame:
    return rank.most_referenced(g.nodes).select("id", "kind", "name", "in_degree")


@query("T6_combined_complexity", ", pool AS (SELECT id, name, path, complexity FROM nodes WHERE kind = 'Function' ORDER BY complexity DESC, id LIMIT 100) SELECT p.id, p.name, p.path, round(p.complexity, 9) AS complexity, round(coalesce(f.churn, 0), 9) AS file_churn, round(p.complexity * coalesce(f.churn, 0), 9) AS score FROM pool p LEFT JOIN nodes f ON f.kind = 'File' AND f.path = p.path ORDER BY p.complexity * coalesce(f.churn, 0) DESC, p.complexity DESC, p.id LIMIT 20")
def combined_complexity(g: Graph) -> DataFrame:
    return rank.combined_complexity(g.nodes).withColumns({c: F.round(c, 9) for c in ("complexity", "file_churn", "score")})


@query("T7_test_gaps", "SELECT id, name, path, in_degree, round(churn * in_degree + in_degree * 0.5, 9) AS weight, CASE WHEN 1 - (1 - churn) * (1 - coupling) > 0.7 THEN 'HIGH' WHEN 1 - (1 - churn) * (1 - coupling) > 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk, CASE WHEN contains(path, '/') THEN 'tests/' || regexp_replace(path, '(\\.ts)+$', '') || '.test.ts' ELSE 'tests/' || lower(name) || '.test.ts' END AS suggested FROM nodes WHERE kind IN ('Function', 'Class') AND NOT is_test_file AND NOT is_tested ORDER BY churn * in_degree + in_degree * 0.5 DESC, id LIMIT 20")
def test_gaps(g: Graph) -> DataFrame:
    return reports.test_gaps(g.nodes).withColumn("weight", F.round("weight", 9))


@query("T8_complex_functions", "SELECT id, round(complexity, 9) AS complexity FROM nodes WHERE kind = 'Function' AND complexity > 0 ORDER BY nodes.complexity DESC, id LIMIT 40")
def complex_functions(g: Graph) -> DataFrame:
    return rank.complex_functions(g.raw_nodes).select("id", F.round("complexity", 9).alias("complexity"))


# Traversals


def _hops(seeds: str, depth: int, step: str) -> str:
    """Unrolled breadth-first levels from a SELECT of (seed, id)."""
    out = f", walk AS ({step}), h0 AS ({seeds}), s0 AS (SELECT seed, id, 0 AS hops FROM h0)"
    for k in range(1, depth + 1):
        out += f", h{k} AS (SELECT DISTINCT h.seed, w.t AS id FROM h{k - 1} h JOIN walk w ON w.a = h.id JOIN raw_nodes n ON n.id = w.t WHERE NOT EXISTS (SELECT 1 FROM s{k - 1} s WHERE s.seed = h.seed AND s.id = w.t)), s{k} AS (SELECT * FROM s{k - 1} UNION ALL SELECT seed, id, {k} FROM h{k})"
    return out


_BOTH = "SELECT DISTINCT src AS a, dst AS t FROM edges UNION SELECT DISTINCT dst, src FROM edges"
_BACK = "SELECT DISTINCT dst AS a, src AS t FROM edges"


@query("G1_neighbours", _hops("SELECT 'fn:100' AS seed, 'fn:100' AS id", 3, _BOTH) + "SELECT id, hops FROM s3 WHERE hops > 0")
def neighbours(g: Graph) -> DataFrame:
    return traverse.neighbours(g.raw_nodes, g.edges, "fn:100", 3).select("id", "hops")


@query("G2_dependents", _hops("SELECT 'mod:3' AS seed, 'mod:3' AS id", 3, _BACK) + "SELECT id, hops FROM s3 WHERE hops > 0")
def dependents(g: Graph) -> DataFrame:
    return traverse.dependents(g.raw_nodes, g.edges, "mod:3", 3).select("id", "hops")


@query(
    "G3_blast_radius",
    _hops("SELECT id AS seed, id FROM raw_nodes", 3, _BACK)
    + ", k AS (SELECT seed, n.kind, count(*) AS n FROM s3 JOIN raw_nodes n USING (id) WHERE hops > 0 GROUP BY 1, 2), t AS (SELECT seed, CAST(sum(n) AS BIGINT) AS total, string_agg(kind || '=' || n, ',' ORDER BY kind || '=' || n) AS by_kind FROM k GROUP BY seed) SELECT h0.seed, coalesce(total, 0) AS total, coalesce(by_kind, '') AS by_kind, CASE WHEN coalesce(total, 0) > 50 THEN 'CRITICAL' WHEN coalesce(total, 0) > 20 THEN 'HIGH' WHEN coalesce(total, 0) > 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM h0 LEFT JOIN t USING (seed)",
)
def blast_radius(g: Graph) -> DataFrame:
    """Of every node."""
    return traverse.blast_radius(g.raw_nodes, g.edges, g.raw_nodes.select(F.col("id").alias("seed")))


@query("G4_call_chain", "SELECT CAST(count(*) - 1 AS INT) AS hops, string_agg('fn:' || CAST(o_orderkey AS VARCHAR), '>' ORDER BY o_orderdate, o_orderkey) AS path FROM orders WHERE o_custkey = 10", graph=False)
def call_chain(g: Graph) -> DataFrame:
    own = g.table("orders").where("o_custkey = 10").orderBy("o_orderdate", "o_orderkey").select("o_orderkey").collect()
    chain = traverse.shortest_chain(g.edges, f"fn:{own[0][0]}", f"fn:{own[-1][0]}")
    return chain.select("hops", F.array_join("path", ">").alias("path"))


def _chain(depth: int) -> str:
    """Levels of a breadth-first search with the smallest parent of each id, and the way back from t."""
    out = ", e AS (SELECT DISTINCT src, dst FROM edges), s AS (SELECT min(src) AS id FROM edges WHERE kind = 'OWNS'), t AS (SELECT 'fn:' || CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_custkey = 10 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1), l0 AS (SELECT id, CAST(NULL AS VARCHAR) AS parent FROM s)"
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM l{j}" for j in range(k))
        out += f", l{k} AS (SELECT dst AS id, min(src) AS parent FROM e JOIN l{k - 1} l ON l.id = e.src WHERE dst NOT IN ({seen}) GROUP BY dst)"
    ways = []
    for k in range(1, depth + 1):
        joins = "".join(f" JOIN l{j} ON l{j}.id = l{j + 1}.parent" for j in range(k - 1, -1, -1))
        ways.append(f"SELECT {k} AS hops, {' || chr(62) || '.join(f'l{j}.id' for j in range(k + 1))} AS path FROM l{k}{joins} WHERE l{k}.id = (SELECT id FROM t)")
    return out + ", ways AS (" + " UNION ALL ".join(ways) + ") SELECT CAST(hops AS INT) AS hops, path FROM ways"


@query("G4_chain_over_kinds", _chain(6))
def chain_over_kinds(g: Graph) -> DataFrame:
    """From an author to the last order of customer 10, over files and functions."""
    last = g.table("orders").where("o_custkey = 10").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).first()["o_orderkey"]
    first = g.edges.where("kind = 'OWNS'").agg(F.min("src")).first()[0]
    return traverse.shortest_chain(g.edges, first, f"fn:{last}").select("hops", F.array_join("path", ">").alias("path"))


@query(
    "G5_impact",
    ", e AS (SELECT DISTINCT dst AS a, src AS t FROM edges), c AS (SELECT id FROM raw_nodes WHERE starts_with(path, 'economy/brand2/')), "
    "r AS (WITH RECURSIVE w AS (SELECT id FROM c UNION SELECT e.t FROM w JOIN e ON e.a = w.id) SELECT id FROM w) SELECT r.id, CASE WHEN r.id IN (SELECT id FROM c) THEN 'changed' ELSE 'impacted' END AS role FROM r JOIN raw_nodes USING (id)",
)
def impact(g: Graph) -> DataFrame:
    changed = g.files.where(F.startswith("path", F.lit("economy/brand2/"))).select("path")
    return traverse.impact(g.raw_nodes, g.edges, changed).select("id", "role")


@query("A31_impact_report", ", e AS (SELECT DISTINCT dst AS a, src AS t FROM edges), f AS (SELECT path FROM files WHERE starts_with(path, 'economy/brand2/')), c AS (SELECT id FROM raw_nodes WHERE path IN (SELECT path FROM f)), r AS (WITH RECURSIVE w AS (SELECT id FROM c UNION SELECT e.t FROM w JOIN e ON e.a = w.id) SELECT id FROM w JOIN raw_nodes USING (id)) SELECT (SELECT count(*) FROM f) AS changed_files, (SELECT count(*) FROM c) AS changed_nodes, (SELECT count(*) FROM r) - (SELECT count(*) FROM c) AS impacted_nodes, (SELECT count(*) FROM r) AS total")
def impact_report(g: Graph) -> DataFrame:
    return reports.impact_report(g.raw_nodes, g.edges, g.files.where(F.startswith("path", F.lit("economy/brand2/"))))


@query("G7_cycles", ", e AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'IMPORTS' AND src <> dst), r AS (WITH RECURSIVE w AS (SELECT src AS a, dst AS b FROM e UNION SELECT w.a, e.dst FROM w JOIN e ON e.src = w.b) SELECT a, b FROM w) SELECT e.src, e.dst FROM e JOIN r ON r.a = e.dst AND r.b = e.src")
def cycles(g: Graph) -> DataFrame:
    return traverse.cyclic_edges(g.edges.where("kind = 'IMPORTS'"))


@query("G9_ego", _hops("SELECT 'fn:100' AS seed, 'fn:100' AS id", 1, _BOTH) + "SELECT id, hops FROM s1")
def ego(g: Graph) -> DataFrame:
    around = traverse.neighbours(g.raw_nodes, g.edges, "fn:100", 1).select("id", "hops")
    return around.unionByName(lookup.get_node(g.raw_nodes, "fn:100").select("id", F.lit(0).alias("hops")))


# Rules, dead code, clones


_DEAD = """, cin AS (SELECT DISTINCT dst FROM edges WHERE kind = 'CALLS'), cout AS (SELECT DISTINCT src FROM edges WHERE kind = 'CALLS'),
q1 AS (SELECT id FROM nodes WHERE kind IN ('Function', 'Class', 'Variable', 'Type') AND exported AND id NOT IN (SELECT dst FROM cin) AND path NOT LIKE '%test%' AND path NOT LIKE '%spec%' AND path NOT LIKE '%.d.ts'),
q2 AS (SELECT id FROM nodes WHERE kind = 'Function' AND name <> 'constructor' AND NOT exported AND id NOT IN (SELECT dst FROM cin) AND path NOT LIKE '%test%'),
q4 AS (SELECT id FROM nodes WHERE id NOT IN (SELECT dst FROM cin) AND id NOT IN (SELECT src FROM cout) AND kind NOT IN ('File', 'Module', 'Author') AND path NOT LIKE '%test%' AND id NOT IN (SELECT id FROM q1) AND id NOT IN (SELECT id FROM q2)),
q5 AS (SELECT id FROM nodes WHERE kind = 'File' AND id NOT IN (SELECT dst FROM edges WHERE kind = 'IMPORTS') AND id IN (SELECT src FROM edges) AND path NOT LIKE '%test%'),
dead AS (SELECT id, 'unreferenced_export' AS reason FROM q1 UNION ALL SELECT id, 'unreachable' FROM q2 UNION ALL SELECT id, 'disconnected' FROM q4 UNION ALL SELECT id, 'zombie_file' FROM q5),
judged AS (SELECT d.id, n.kind, n.name, n.path, d.reason, CASE WHEN n.kind = 'Type' THEN 'low' WHEN d.reason = 'zombie_file' THEN 'medium' ELSE 'high' END AS confidence FROM dead d JOIN nodes n USING (id))
"""


@query("R9_dead_code", _DEAD + "SELECT * FROM judged")
def dead_code(g: Graph) -> DataFrame:
    return dead.detect(g.raw_nodes, g.edges).select("id", "kind", "name", "path", "reason", "confidence")


@query("A18_dead_summary", _DEAD + "SELECT coalesce(reason, 'total') AS reason, count(*) AS total, count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'medium') AS medium, count(*) FILTER (confidence = 'low') AS low FROM judged GROUP BY ROLLUP (reason)")
def dead_summary(g: Graph) -> DataFrame:
    return dead.summary(dead.detect(g.raw_nodes, g.edges))


@query("A17_dead_stats", _DEAD + "SELECT count(*) AS total, count(*) FILTER (reason IN ('unreachable', 'disconnected')) AS severe FROM dead")
def dead_stats(g: Graph) -> DataFrame:
    return dead.stats(dead.marked(g.raw_nodes, dead.detect(g.raw_nodes, g.edges)))


@query("R10_marked", _DEAD + "SELECT n.id, d.id IS NOT NULL AS is_dead_candidate, d.reason AS dead_reason FROM nodes n LEFT JOIN dead d USING (id)")
def marked(g: Graph) -> DataFrame:
    return dead.marked(g.raw_nodes, dead.detect(g.raw_nodes, g.edges)).select("id", "is_dead_candidate", "dead_reason")


@query("F14_dead_filtered", _DEAD + "SELECT id, reason FROM judged WHERE reason = 'unreachable' AND confidence = 'high' AND starts_with(path, 'economy/')")
def dead_filtered(g: Graph) -> DataFrame:
    return dead.filtered(dead.detect(g.raw_nodes, g.edges), reason="unreachable", prefix="economy/", safe=True).select("id", "reason")


@query("R2_max_coupling", "SELECT path AS file, name || ' has ' || in_degree || ' callers (threshold: 30)' AS message FROM nodes WHERE kind <> 'Author' AND in_degree > 30 ORDER BY in_degree DESC, id LIMIT 20")
def max_coupling(g: Graph) -> DataFrame:
    return rules.max_coupling(g.nodes)


@query("R3_max_complexity", "SELECT path AS file, name || printf(' has complexity %.2f (threshold: 0.30)', complexity) AS message FROM nodes WHERE kind = 'Function' AND complexity > 0.3 ORDER BY complexity DESC, id LIMIT 20")
def max_complexity(g: Graph) -> DataFrame:
    return rules.max_complexity(g.raw_nodes)


@query("R4_undocumented_public", "SELECT path AS file, 'Public ' || name || ' has no doc comment' AS message FROM nodes WHERE kind IN ('Function', 'Class') AND exported AND coalesce(doc_comment, '') = '' ORDER BY name, id LIMIT 50")
def undocumented_public(g: Graph) -> DataFrame:
    return rules.undocumented_public(g.raw_nodes)


@query("R5_sql_rule", "SELECT path AS file, path || ', ' || name || ', ' || in_degree AS message FROM nodes WHERE kind = 'Module' AND in_degree > 10")
def sql_rule(g: Graph) -> DataFrame:
    return rules.sql_rule(g.spark, "SELECT path, name, in_degree FROM nodes WHERE kind = 'Module' AND in_degree > 10", g.nodes, g.edges)


@query("R7_verdict", "SELECT (SELECT least(count(*), 20) FROM nodes WHERE kind = 'Function' AND complexity > 0.3) AS errors, (SELECT least(count(*), 50) FROM nodes WHERE kind IN ('Function', 'Class') AND exported AND coalesce(doc_comment, '') = '') AS warnings, (SELECT count(*) FROM nodes WHERE kind = 'Function' AND complexity > 0.3) > 0 AS failed")
def verdict(g: Graph) -> DataFrame:
    wanted = [rules.Rule("complexity", built_in="max_complexity"), rules.Rule("docs", severity="warning", built_in="require_docs_for_public")]
    return rules.verdict(rules.run(g.spark, wanted, g.raw_nodes, g.edges)[0])


@query("R8_bisect", "SELECT 'nodes_exist:fn:1' AS predicate, true AS passed, 'found' AS detail UNION ALL SELECT 'nodes_missing:fn:-1', true, 'absent' UNION ALL SELECT 'nodes_alive:fn:2', true, 'alive' UNION ALL SELECT 'node_count_min', count(*) >= 100, 'required ≥ 100, got ' || count(*) FROM nodes UNION ALL SELECT 'node_count_max', count(*) <= 100, 'required ≤ 100, got ' || count(*) FROM nodes")
def bisect(g: Graph) -> DataFrame:
    asked = rules.Predicates(node_count_min=100, node_count_max=100, nodes_exist=["fn:1"], nodes_missing=["fn:-1"], nodes_alive=["fn:2"])
    return rules.bisect(asked, g.raw_nodes)


#: A text's comments dropped, strings S, numbers N, white space one space, in one pass from left to right.
_TOKENS = r"""(?s)//[^\n]*|/\*(?:.*?\*/|.*\z)|"(?:\\.|[^"\\])*(?:"|\\?\z)|''(?:\\.|[^''\\])*(?:''|\\?\z)|`(?:\\.|[^`\\])*(?:`|\\?\z)|(?:[0-9]|\.[0-9])[0-9._xob]*|[\t\n\x0B\f\r ]+|[^/"''`0-9.\t\n\x0B\f\r ]+|."""
NORMAL = f"""trim(array_to_string(list_transform(regexp_extract_all(text, '{_TOKENS}'), lambda t: CASE WHEN starts_with(t, '//') OR starts_with(t, '/*') THEN '' WHEN left(t, 1) IN ('"', '''', '`') THEN 'S' WHEN regexp_matches(t, '^([0-9]|\\.[0-9])') THEN 'N' WHEN regexp_matches(t, '^[\\t\\n\\x0B\\f\\r ]') THEN ' ' ELSE t END), ''), ' ')"""


def _bodies(g: Graph) -> DataFrame:
    return g.table("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))


@query("J24_exact_clones", f"WITH n AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS first FROM (SELECT doc_id, {NORMAL} AS body FROM documents WHERE text IS NOT NULL)) SELECT first AS node_a, doc_id AS node_b, 'exact' AS kind FROM n WHERE doc_id <> first", graph=False)
def exact_clones(g: Graph) -> DataFrame:
    return clones.exact_clones(_bodies(g)).select("node_a", "node_b", "kind")


@query("J23_near_clones", ", g AS (SELECT id, list_distinct(list_transform(range(1, strlen(c) - 2), lambda i: substr(c, i, 4))) AS gr FROM (SELECT min(p_partkey) AS id, trim(regexp_replace(p_name || ' ' || lower(p_type) || ' ' || lower(p_brand), '([0-9]|\\.[0-9])[0-9._xob]*', 'N', 'g')) AS c FROM part GROUP BY c)) SELECT a.id AS node_a, b.id AS node_b, round(len(list_intersect(a.gr, b.gr)) / CAST(len(a.gr) + len(b.gr) - len(list_intersect(a.gr, b.gr)) AS DOUBLE), 5) AS similarity FROM g a JOIN g b ON a.id < b.id WHERE len(list_intersect(a.gr, b.gr)) / CAST(len(a.gr) + len(b.gr) - len(list_intersect(a.gr, b.gr)) AS DOUBLE) >= 0.8")
def near_clones(g: Graph) -> DataFrame:
    body = F.concat_ws(" ", "p_name", F.lower("p_type"), F.lower("p_brand"))
    found = clones.near_clones(g.table("part").select(F.col("p_partkey").alias("id"), body.alias("body")))
    return found.select("node_a", "node_b", F.round(F.col("similarity").cast("double"), 5).alias("similarity"))


@query("J23_near_clones_bodies")
def near_clone_bodies(g: Graph) -> DataFrame:
    """Among all whole documents, as J24; J23_near_clones keeps the short strings that its SQL can compare."""
    found = clones.near_clones(_bodies(g))
    return found.select("node_a", "node_b", F.round(F.col("similarity").cast("double"), 5).alias("similarity"))


@query("X6_content_hashes", "SELECT doc_id, sha256(text) AS hash, substr(sha256(text), 1, 16) AS short FROM documents", graph=False)
def content_hashes(g: Graph) -> DataFrame:
    return g.table("documents").select("doc_id", storage.content_hash(F.col("text")).alias("hash"), text.short_hash(F.col("text")).alias("short"))


@query("P1c_import_paths", "SELECT p_partkey, 'a/' || p_size || '/lib/' || lower(p_type) AS resolved FROM part", graph=False)
def import_paths(g: Graph) -> DataFrame:
    current = F.concat(F.lit("a/"), F.col("p_size").cast("string"), F.lit("/src/x.ts"))
    return g.table("part").select("p_partkey", paths.joined(current, F.concat(F.lit("./../lib/./"), F.lower("p_type"))).alias("resolved"))


# Differences and storage


@query("J21_graph_diff", ", b AS (SELECT * FROM nodes WHERE NOT (kind = 'Function' AND line_start = 7)), a AS (SELECT * REPLACE (CASE WHEN kind = 'Class' AND line_start = 9 THEN name || '!' ELSE name END AS name) FROM nodes WHERE NOT (kind = 'Function' AND line_start = 8)) SELECT 'node' AS element, coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' ELSE 'modified' END AS change FROM b FULL JOIN a ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.name <> b.name UNION ALL SELECT 'edge', src || '|' || kind || '|' || dst, 'removed' FROM edges WHERE kind = 'DEPENDS_ON' UNION ALL SELECT 'edge', src || '|' || kind || '|' || dst, 'added' FROM edges WHERE kind = 'INHERITS'")
def graph_diff(g: Graph) -> DataFrame:
    n, e = g.raw_nodes, g.edges
    before = n.where(~((F.col("kind") == "Function") & (F.col("line_start") == 7)))
    after = n.where(~((F.col("kind") == "Function") & (F.col("line_start") == 8))).withColumn("name", F.when((F.col("kind") == "Class") & (F.col("line_start") == 9), F.concat("name", F.lit("!"))).otherwise(F.col("name")))
    return reports.graph_diff(before, e.where("kind <> 'INHERITS'"), after, e.where("kind <> 'DEPENDS_ON'"))


@query("J25_changed_files", "SELECT path, CASE WHEN k % 5 = 0 THEN 'new' WHEN k % 5 = 1 THEN 'deleted' ELSE 'changed' END AS change FROM (SELECT path, p_partkey AS k FROM files) WHERE k % 5 IN (0, 1, 2)")
def changed_files(g: Graph) -> DataFrame:
    k = F.col("p_partkey") % 5
    now = g.files.where(k != 1).select("path", F.sha2("path", 256).alias("hash"))
    then = g.files.where(k != 0).select("path", F.when(k == 2, F.lit("old")).otherwise(F.sha2("path", 256)).alias("hash"))
    return storage.changed_files(now, then)


@query("J26_kept_edges", ", ok AS (SELECT id FROM nodes WHERE path NOT IN (SELECT path FROM files WHERE p_partkey % 5 = 0)) SELECT src, dst, kind FROM edges WHERE src IN (SELECT id FROM ok) AND dst IN (SELECT id FROM ok)")
def kept_edges(g: Graph) -> DataFrame:
    return storage.kept_edges(g.edges, g.raw_nodes, g.files.where("p_partkey % 5 = 0")).select("src", "dst", "kind")


@query("K1_upsert", "SELECT id, CASE WHEN kind = 'Module' THEN name || '-2' ELSE name END AS name FROM nodes UNION ALL SELECT 'mod:new', 'fresh'")
def upsert(g: Graph) -> DataFrame:
    current = g.raw_nodes.select("id", "name")
    changed = g.raw_nodes.where("kind = 'Module'").select("id", F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.concat("name", F.lit("-1")).alias("name")), F.struct(F.lit(2).alias("seq"), F.concat("name", F.lit("-2")).alias("name")))).alias("v")).select("id", "v.name", "v.seq")
    return storage.upsert(current, changed.unionByName(g.spark.createDataFrame([("mod:new", "fresh", 1)], "id string, name string, seq int")), order="seq")


@query("K7_delete_paths", ", gone AS (SELECT id FROM nodes WHERE path IN (SELECT path FROM files WHERE p_partkey % 3 = 0)) SELECT src, dst, kind FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)")
def delete_paths(g: Graph) -> DataFrame:
    return storage.delete_paths(g.raw_nodes, g.edges, g.files.where("p_partkey % 3 = 0"))[1].select("src", "dst", "kind")


@query("K9_update_by_id", "SELECT id, CASE WHEN kind = 'Type' THEN 1.0 ELSE round(complexity, 9) END AS complexity FROM nodes")
def update_by_id(g: Graph) -> DataFrame:
    changes = g.raw_nodes.where("kind = 'Type'").select("id", F.lit(1.0).alias("complexity"))
    return storage.update_by_id(g.raw_nodes.select("id", F.round("complexity", 9).alias("complexity")), changes)


@query(
    "A32_review",
    _hops("SELECT id AS seed, id FROM raw_nodes WHERE kind <> 'Author' AND path IN (SELECT path FROM files WHERE p_partkey IN (1, 2, 3))", 2, _BOTH)
    + ", ch AS (SELECT * FROM nodes WHERE kind <> 'Author' AND path IN (SELECT path FROM files WHERE p_partkey IN (1, 2, 3))), bl AS (SELECT count(DISTINCT s.id) AS blast FROM s2 s JOIN raw_nodes n USING (id) WHERE hops > 0 AND n.path NOT IN (SELECT path FROM files WHERE p_partkey IN (1, 2, 3))), ct AS (SELECT count(*) AS changed_nodes, count(*) FILTER (churn > 0.7 AND coupling > 0.6) AS hotspots, count(*) FILTER (kind IN ('Function', 'Class') AND NOT is_tested) AS missing_tests, count(*) FILTER (kind IN ('Function', 'Class') AND coalesce(doc_comment, '') = '') AS missing_docs FROM ch), "
    "rv AS (SELECT string_agg(name, ', ' ORDER BY w DESC, name) AS reviewers FROM (SELECT a.name, sum(e.weight) AS w FROM edges e JOIN nodes a ON a.id = e.src WHERE e.kind = 'OWNS' AND e.dst IN (SELECT id FROM ch WHERE kind = 'File') GROUP BY a.name ORDER BY w DESC, a.name LIMIT 3)) "
    "SELECT changed_nodes, hotspots, missing_tests, missing_docs, blast, CAST(0 AS BIGINT) AS todos, reviewers, CASE WHEN hotspots > 0 OR blast > 20 THEN 'HIGH' WHEN blast > 5 OR missing_tests > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM ct, bl, rv",
)
def review(g: Graph) -> DataFrame:
    return reports.review(g.nodes, g.edges, g.files.where(F.col("p_partkey").isin(1, 2, 3)).select("path"))
