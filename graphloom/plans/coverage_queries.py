"""Registered queries on the remaining lookups, formats and helpers, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.export import formats, notes
from graphloom.functions import paths, purpose, text, units
from graphloom.operators import lookup, reports, storage, traverse
from graphloom.plans.projection import Graph
from graphloom.plans.queries import NORMAL, query
from graphloom.sources import manifests

# Lookups


_CLONES = "SELECT 'c' || CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 3 = 0 THEN 'exact' ELSE 'near' END AS kind, CAST((p_partkey % 100) / 100.0 AS FLOAT) AS similarity FROM part"


@query("F8_clones", f"SELECT id, kind, round(CAST(similarity AS DOUBLE), 5) AS similarity FROM ({_CLONES}) WHERE kind = 'near' AND similarity >= CAST(0.8 AS FLOAT)", graph=False)
def clones(g: Graph) -> DataFrame:
    k = F.col("p_partkey")
    rows = g.table("part").select(F.concat(F.lit("c"), k.cast("string")).alias("id"), F.when(k % 3 == 0, "exact").otherwise("near").alias("kind"), ((k % 100) / 100.0).cast("float").alias("similarity"))
    return lookup.clones(rows, 0.8, "near").withColumn("similarity", F.round(F.col("similarity").cast("double"), 5))


_SNAPSHOTS = "SELECT 'snap:' || left(sha256(CAST(o_orderkey AS VARCHAR)), 8) AS id, sha256(CAST(o_orderkey AS VARCHAR)) AS commit_sha, strftime(o_orderdate, '%Y-%m-%d') AS commit_date, o_orderkey AS n FROM orders"


def _snapshots(g: Graph) -> DataFrame:
    sha = F.sha2(F.col("o_orderkey").cast("string"), 256)
    return g.table("orders").select(F.concat(F.lit("snap:"), F.substring(sha, 1, 8)).alias("id"), sha.alias("commit_sha"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("commit_date"), F.col("o_orderkey").alias("n"))


@query("F11_snapshots", f"SELECT * FROM ({_SNAPSHOTS}) ORDER BY commit_date DESC, commit_sha LIMIT 100", graph=False)
def snapshots(g: Graph) -> DataFrame:
    return lookup.snapshots(_snapshots(g), 100)


@query("F11_snapshot_by_sha", f"SELECT * FROM ({_SNAPSHOTS}) WHERE starts_with(commit_sha, left(sha256('7'), 12)) ORDER BY commit_sha LIMIT 1", graph=False)
def snapshot_by_sha(g: Graph) -> DataFrame:
    import hashlib

    return lookup.snapshot_by_sha(_snapshots(g), hashlib.sha256(b"7").hexdigest()[:12])


@query("F15_view_filters", ", k AS (SELECT id FROM nodes WHERE kind IN ('Function', 'Class') AND community = 5 AND (contains(lower(name), '1') OR contains(lower(path), '1') OR contains(lower(kind), '1'))) SELECT e.src, e.dst, e.kind FROM edges e WHERE e.kind = 'CALLS' AND e.src IN (SELECT id FROM k) AND e.dst IN (SELECT id FROM k)")
def view_filters(g: Graph) -> DataFrame:
    return lookup.view(g.raw_nodes, g.edges, kinds=("Function", "Class"), community=5, text="1", edge_kinds=("CALLS",))[1].select("src", "dst", "kind")


@query("F19_watched", "SELECT p, NOT (contains(p, '/target/') OR contains(p, '/.git/') OR ends_with(p, '~') OR ends_with(p, '.tmp')) AS watched FROM (SELECT path || CASE p_partkey % 6 WHEN 0 THEN '~' WHEN 1 THEN '.tmp' WHEN 2 THEN '/target/x.rs' WHEN 3 THEN '/.git/HEAD' WHEN 4 THEN '/targets/x.rs' ELSE '' END AS p FROM files)")
def watched(g: Graph) -> DataFrame:
    k = F.col("p_partkey") % 6
    tail = F.when(k == 0, "~").when(k == 1, ".tmp").when(k == 2, "/target/x.rs").when(k == 3, "/.git/HEAD").when(k == 4, "/targets/x.rs").otherwise("")
    named = g.files.select(F.concat("path", tail).alias("p"))
    return named.select("p", lookup.watched(F.col("p")).alias("watched"))


_WORDS = ("widget", "fn", "12", "handled")


@query(
    "F20_retrieve",
    ", hit AS (SELECT *, CASE "
    + " ".join(f"WHEN contains(lower(name), '{w}') OR contains(lower(id), '{w}') THEN {k}" for k, w in enumerate(_WORDS))
    + " END AS k FROM nodes), found AS (SELECT *, 0 AS n FROM hit WHERE k IS NOT NULL ORDER BY k, id LIMIT 15), near AS (SELECT *, 1 AS n FROM hit WHERE id <> 'mod:3' AND id IN (SELECT dst FROM edges WHERE src = 'mod:3' UNION SELECT src FROM edges WHERE dst = 'mod:3') AND id NOT IN (SELECT id FROM found)), "
    "merged AS (SELECT * FROM (SELECT * FROM found UNION ALL SELECT * FROM near) ORDER BY n, id LIMIT 20) SELECT id, name, kind, path, round(churn, 9) AS churn, community FROM merged",
)
def retrieve(g: Graph) -> DataFrame:
    """For 'Where is widget fn_12 handled?' with mod:3 selected."""
    asked = g.spark.createDataFrame([("Where is widget fn_12 handled?",)], "q string")
    words = asked.select(lookup.keywords(F.col("q"))).first()[0]
    return lookup.retrieved(g.nodes, g.edges, words, "mod:3").withColumn("churn", F.round("churn", 9))


@query("J27_callers_of_node", "SELECT DISTINCT n.id, n.name FROM edges e JOIN nodes n ON n.id = e.src WHERE e.kind = 'CALLS' AND e.dst IN (SELECT dst FROM edges WHERE kind = 'CALLS' AND src = 'fn:100')")
def callers_of_node(g: Graph) -> DataFrame:
    """Who else calls what fn:100 calls."""
    callees = g.edges.where("kind = 'CALLS' AND src = 'fn:100'").select("dst").distinct()
    back = g.edges.where("kind = 'CALLS'").join(F.broadcast(callees), "dst", "left_semi").select(F.col("src").alias("id")).distinct()  # of one node
    return g.raw_nodes.join(back, "id", "left_semi").select("id", "name")


@query("Q12_file_context", ", p AS (SELECT path FROM files WHERE p_partkey = 1), o AS (SELECT * FROM nodes WHERE path IN (SELECT path FROM p) AND kind <> 'File') SELECT kind, name, in_degree, line_start, (SELECT count(*) FROM o) AS n_symbols, (SELECT in_degree FROM nodes WHERE kind = 'File' AND path IN (SELECT path FROM p)) AS file_in_degree, round((SELECT churn FROM nodes WHERE kind = 'File' AND path IN (SELECT path FROM p)), 9) AS churn FROM o ORDER BY in_degree DESC, id LIMIT 5")
def file_context(g: Graph) -> DataFrame:
    from graphloom import api

    path = g.files.where("p_partkey = 1").first()["path"]
    return api.Graph(g.spark, nodes=g.nodes, edges=g.edges).file_context(path).withColumn("churn", F.round("churn", 9))


@query("A7_summary", ", h AS (SELECT path FROM nodes WHERE kind = 'File' AND churn > 0 ORDER BY churn * coupling + 0.01 * in_degree DESC, path LIMIT 5), r AS (SELECT id FROM nodes WHERE kind <> 'File' ORDER BY in_degree DESC, id LIMIT 5) SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count, (SELECT count(DISTINCT community) FROM nodes WHERE community > 0) AS community_count, (SELECT count(DISTINCT language) FROM nodes WHERE language <> '') AS languages, (SELECT string_agg(path, ',' ORDER BY path) FROM h) AS hotspots, (SELECT string_agg(id, ',' ORDER BY id) FROM r) AS god_nodes")
def summary(g: Graph) -> DataFrame:
    from graphloom import api

    row = api.Graph(g.spark, nodes=g.nodes.withColumns({"is_dead_candidate": F.lit(False), "dead_reason": F.lit(None).cast("string")}), edges=g.edges).get_repo_summary()
    named = lambda column, field: F.array_join(F.array_sort(F.transform(column, lambda x: x[field])), ",")
    return row.select("node_count", "edge_count", "community_count", F.size("languages").cast("long").alias("languages"), named("hotspots", "path").alias("hotspots"), named("god_nodes", "id").alias("god_nodes"))


# Reports, formats, layout


@query("A25_group_exports", ", f AS (SELECT path, regexp_extract(path, '^[^/]*/[^/]*', 0) AS file_group FROM files), s AS (SELECT path, count(*) FILTER (exported) AS n FROM nodes WHERE kind IN ('Function', 'Class', 'Variable', 'Type') GROUP BY path) SELECT file_group, count(*) AS files, CAST(coalesce(sum(s.n), 0) AS BIGINT) AS exported FROM f LEFT JOIN s USING (path) GROUP BY file_group")
def group_exports(g: Graph) -> DataFrame:
    return reports.group_sizes(g.raw_nodes)


@query("G10_grid", ", g AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k, CAST(ceil(sqrt(count(*) OVER ())) AS BIGINT) AS c, count(*) OVER () AS n FROM nodes) SELECT id, round(8.0 + (k % c) * (84.0 / (c - 1)), 6) AS x, round(4.0 + (k // c) * (42.0 / (CAST(ceil(n / CAST(c AS DOUBLE)) AS BIGINT) - 1)), 6) AS y FROM g")
def grid(g: Graph) -> DataFrame:
    return formats.grid(g.raw_nodes, 100.0, 50.0).withColumns({c: F.round(c, 6) for c in ("x", "y")})


@query("A33_bounds", ", g AS (SELECT max(churn) AS churn FROM nodes) SELECT 8.0 AS min_x, 92.0 AS max_x, 4.0 AS min_y, 46.0 AS max_y, round(churn, 9) AS max_churn FROM g")
def bounds(g: Graph) -> DataFrame:
    found = formats.bounds(formats.grid(g.raw_nodes, 100.0, 50.0)).join(F.broadcast(g.nodes.agg(F.max("churn").alias("max_churn"))))
    return found.select(*(F.round(c, 9).alias(c) for c in found.columns))


@query("X11_links", "SELECT p_partkey, '[[files/' || lower(replace(p_name, ' ', '-')) || '|' || p_name || ']]' AS wiki, '[' || p_name || '](files/' || lower(replace(p_name, ' ', '-')) || '.md)' AS markdown, lower(replace(p_type, '/', '-')) || '-x' AS slug FROM part", graph=False)
def links(g: Graph) -> DataFrame:
    target = F.concat(F.lit("files/"), F.lower(paths.safe_filename(F.col("p_name"))))
    return g.table("part").select("p_partkey", paths.link(target, F.col("p_name")).alias("wiki"), paths.link(target, F.col("p_name"), "markdown").alias("markdown"), paths.community_slug(F.concat("p_type", F.lit("/x ")), F.col("p_partkey")).alias("slug"))


_DEP = "CASE p_partkey % 6 WHEN 0 THEN 'serde' WHEN 1 THEN '@types/x' || p_partkey WHEN 2 THEN 'tree-sitter-l' || p_partkey WHEN 3 THEN 'my-logger' || p_partkey WHEN 4 THEN 'eslint-x' ELSE 'other' || p_partkey END"


@query("X14_purposes", f"SELECT name, CASE WHEN name = 'serde' THEN 'Serialise/deserialise framework' WHEN starts_with(name, '@types/') THEN 'TypeScript types for `' || substr(name, 8) || '`' WHEN starts_with(name, 'tree-sitter-') THEN 'Tree-sitter grammar for ' || substr(name, 13) WHEN name LIKE 'eslint-%' THEN 'ESLint plugin' WHEN contains(name, 'logger') THEN 'Logging' ELSE '{purpose.UNKNOWN}' END AS purpose FROM (SELECT {_DEP} AS name FROM part)", graph=False)
def purposes(g: Graph) -> DataFrame:
    k, n = F.col("p_partkey") % 6, F.col("p_partkey").cast("string")
    name = F.when(k == 0, "serde").when(k == 1, F.concat(F.lit("@types/x"), n)).when(k == 2, F.concat(F.lit("tree-sitter-l"), n)).when(k == 3, F.concat(F.lit("my-logger"), n)).when(k == 4, "eslint-x").otherwise(F.concat(F.lit("other"), n))
    return purpose.with_purpose(g.table("part").select(name.alias("name")))


@query("X17_durations", "SELECT p_partkey, CASE WHEN p_partkey % 7 = 6 THEN NULL ELSE CAST(p_size AS BIGINT) END AS days FROM part", graph=False)
def durations(g: Graph) -> DataFrame:
    k, n = F.col("p_partkey") % 7, F.col("p_size").cast("string")
    said = F.when(k == 0, n).when(k == 1, F.concat(n, F.lit("d"))).when(k == 2, F.concat(n, F.lit("days"))).when(k == 3, F.concat(F.lit(" "), n, F.lit("D "))).when(k == 4, F.concat(n, F.lit("day"))).when(k == 5, F.concat(n, F.lit("DAYS"))).otherwise(F.concat(n, F.lit("w")))
    return g.table("part").select("p_partkey", units.duration_days(said).alias("days"))


@query("X18_snapshot_json", "SELECT o_orderkey, o_orderkey % 97 AS file_count, o_orderkey % 89 AS insertions, o_orderkey % 83 AS deletions FROM orders", graph=False)
def snapshot_json(g: Graph) -> DataFrame:
    """Written as JSON and read again."""
    from graphloom.sources import repo

    k = F.col("o_orderkey")
    written = repo.snapshot_json(g.table("orders").select(k, (k % 97).alias("file_count"), (k % 89).alias("insertions"), (k % 83).alias("deletions")))
    return repo.snapshot_counts(written.select("o_orderkey", "snapshot_data"))


_STEP = "CASE WHEN n < 1024 THEN 1.0 WHEN n < 1048576 THEN 1024.0 WHEN n < 1073741824 THEN 1048576.0 ELSE 1073741824.0 END"


@query("X19_sizes", f"SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN s WHEN 1 THEN s * 1024 WHEN 2 THEN s * 1048576 + 524288 WHEN 3 THEN s * 1073741824 WHEN 4 THEN s END AS bytes, printf('%.1f', round_even(n / {_STEP}, 1)) || CASE WHEN n < 1024 THEN ' B' WHEN n < 1048576 THEN ' KB' WHEN n < 1073741824 THEN ' MB' ELSE ' GB' END AS shown FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS s, CAST(p_partkey AS BIGINT) * 12345 AS n FROM part)", graph=False)
def sizes(g: Graph) -> DataFrame:
    k, n = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    said = F.when(k == 0, n).when(k == 1, F.concat(n, F.lit("KB"))).when(k == 2, F.concat(n, F.lit(".5 mb"))).when(k == 3, F.concat(n, F.lit("G"))).when(k == 4, F.concat(n, F.lit("b"))).otherwise(F.concat(F.lit("-"), n))
    return g.table("part").select("p_partkey", units.size_bytes(said).alias("bytes"), units.shown_size(F.col("p_partkey").cast("long") * 12345).alias("shown"))


@query("X19_versions", "SELECT p_partkey, (p_partkey % 5, p_size % 10, p_partkey % 3) > (2, p_size % 7, 0) AS newer FROM part", graph=False)
def versions(g: Graph) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size")
    said = F.concat_ws(".", (k % 5).cast("string"), (n % 10).cast("string"), (k % 3).cast("string"))
    return g.table("part").select("p_partkey", units.newer_version(F.concat(said, F.lit("-rc1")), F.concat(F.lit("2."), (n % 7).cast("string"))).alias("newer"))


@query("X19_short_names", "SELECT p_partkey, CASE WHEN length(path) <= 24 THEN path ELSE '...' || right(path, 21) END AS path, CASE WHEN length(path) <= 24 THEN path ELSE left(path, 21) || '...' END AS text FROM files")
def short_names(g: Graph) -> DataFrame:
    return g.files.select("p_partkey", units.short_path(F.col("path"), 24).alias("path"), units.short_text(F.col("path"), 24).alias("text"))


@query("X4_text_similarity", "SELECT p_partkey, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / CAST(len(a) + len(b) - len(list_intersect(a, b)) AS DOUBLE) END, 6) AS similarity FROM (SELECT p_partkey, list_distinct(list_transform(range(1, strlen(p_name) - 2), lambda i: substr(p_name, i, 4))) AS a, list_distinct(list_transform(range(1, strlen(p_name || p_type) - 2), lambda i: substr(p_name || p_type, i, 4))) AS b FROM part)", graph=False)
def text_similarity(g: Graph) -> DataFrame:
    return g.table("part").select("p_partkey", F.round(text.text_similarity(F.col("p_name"), F.concat("p_name", "p_type")), 6).alias("similarity"))


@query("X5_fingerprints", f"SELECT doc_id, sha256({NORMAL}) AS fingerprint FROM documents", graph=False)
def fingerprints(g: Graph) -> DataFrame:
    return g.table("documents").select("doc_id", text.fingerprint(F.col("text")).alias("fingerprint"))


# Storage


@query("K3_tags", "SELECT 'tag:' || path AS id, CASE WHEN p_partkey % 2 = 0 THEN 'new' ELSE 'old' END AS text FROM files WHERE p_partkey % 5 <> 0 OR p_partkey % 2 = 0")
def tags(g: Graph) -> DataFrame:
    """Old tags of some files are deleted, then those of every second file replaced."""
    old = g.files.select(F.concat(F.lit("tag:"), "path").alias("id"), F.col("path").alias("file_path"), F.lit("old").alias("text"), "p_partkey")
    left = storage.delete_tags(old, g.files.where("p_partkey % 5 = 0"))
    return storage.upsert_tags(left, old.where("p_partkey % 2 = 0").withColumn("text", F.lit("new"))).select("id", "text")


@query("M4_missing_snapshots", f"SELECT commit_sha AS sha FROM ({_SNAPSHOTS}) WHERE n % 4 <> 0", graph=False)
def missing_snapshots(g: Graph) -> DataFrame:
    known = _snapshots(g).where("n % 4 = 0")
    return storage.snapshots_missing(_snapshots(g).select(F.col("commit_sha").alias("sha")), known)


@query("M7_touched", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 1 THEN 1000 ELSE CAST(s_nationkey AS BIGINT) END AS last_used_at FROM supplier", graph=False)
def touched(g: Graph) -> DataFrame:
    repos = g.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("last_used_at"))
    return storage.touched(repos, repos.where("id % 4 = 1").select("id"), F.lit(1000))


@query("D6_registry", "SELECT path, CASE WHEN p_partkey % 4 = 0 THEN 'orphaned' ELSE 'kept' END AS state FROM files UNION ALL SELECT 'db/' || p_partkey || '.db', 'untracked' FROM files WHERE p_partkey % 4 = 0")
def registry(g: Graph) -> DataFrame:
    """Entries whose path is gone, and stored files that no kept entry names."""
    db = F.concat(F.lit("db/"), F.col("p_partkey").cast("string"), F.lit(".db"))
    entries = storage.registry(g.files.select("path", db.alias("db_path")), g.files.where("p_partkey % 4 <> 0"))
    loose = storage.untracked(g.files.select(db.alias("path")), entries.where("state = 'kept'"))
    return entries.select("path", "state").unionByName(loose.select("path", F.lit("untracked").alias("state")))


@query("G5_impact_depths", ", e AS (SELECT DISTINCT dst AS a, src AS t FROM edges), w AS (WITH RECURSIVE r AS (SELECT 'file:1' AS id, 0 AS hops UNION SELECT e.t, r.hops + 1 FROM r JOIN e ON e.a = r.id WHERE r.hops < 4) SELECT id, min(hops) AS hops FROM r GROUP BY id) SELECT hops, count(*) AS n FROM w JOIN raw_nodes USING (id) GROUP BY hops")
def impact_depths(g: Graph) -> DataFrame:
    """How many nodes lie how far above file:1, up to four steps."""
    seed = g.spark.createDataFrame([("file:1",)], "seed string")
    found = traverse.within(g.raw_nodes, g.edges, seed, 4, "in").groupBy("hops").agg(F.count("*").alias("n"))
    return found.unionByName(g.spark.createDataFrame([(0, 1)], "hops int, n long"))


@query("K15_public_api_notes", "SELECT 'index/public-api/community-' || community || '.md' AS note, '# Public API of community ' || community || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY line) || chr(10) AS text FROM (SELECT community, '- `' || name || '` (' || kind || ') in ' || path || ':' || line_start AS line FROM nodes WHERE exported AND kind NOT IN ('File', 'Author', 'Module')) GROUP BY community")
def public_api_notes(g: Graph) -> DataFrame:
    return notes.public_api_notes(g.raw_nodes)


@query("K15_entry_point_notes", ", e AS (SELECT CASE WHEN contains(path, '/') THEN CASE WHEN contains(regexp_replace(path, '/[^/]*$', ''), '/') THEN regexp_extract(path, '^[^/]*/[^/]*', 0) ELSE regexp_extract(path, '^[^/]*', 0) END ELSE 'root' END AS g, '- `' || name || '` in ' || path || ': ' || CASE WHEN exported THEN 'exported, no callers' WHEN kind IN ('Function', 'Method') THEN 'no callers in graph (CLI entry / event handler / dead candidate)' ELSE 'no incoming references' END AS line FROM nodes WHERE in_degree = 0 AND kind NOT IN ('File', 'Author', 'Module') AND NOT is_test_file) SELECT 'index/entry-points/' || replace(g, ' ', '-') || '.md' AS note, '# Entry points of ' || replace(g, ' ', '-') || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY line) || chr(10) AS text FROM e GROUP BY 1, g")
def entry_point_notes(g: Graph) -> DataFrame:
    return notes.entry_point_notes(g.nodes)


@query("S11_merged_dependencies", "SELECT 'dep' || (p_partkey // 3) AS name, coalesce(max(CASE WHEN p_partkey % 3 = 0 AND p_size % 2 = 0 THEN '1.' || p_size END), max(CASE WHEN p_partkey % 3 = 1 THEN '2.' || p_size END), max(CASE WHEN p_partkey % 3 = 2 THEN '3.' || p_size END), '') AS version, CASE WHEN count(*) FILTER (p_partkey % 3 = 2) > 0 THEN 'crates/member/Cargo.toml' WHEN count(*) FILTER (p_partkey % 3 = 1) > 0 THEN 'crates/m/Cargo.toml' ELSE 'Cargo.toml' END AS manifest FROM part GROUP BY p_partkey // 3", graph=False)
def merged_dependencies(g: Graph) -> DataFrame:
    """Of up to three manifests; every second root manifest tells no version."""
    k, n = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    version = F.when(k == 0, F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("1."), n)).otherwise("")).when(k == 1, F.concat(F.lit("2."), n)).otherwise(F.concat(F.lit("3."), n))
    manifest = F.when(k == 0, "Cargo.toml").when(k == 1, "crates/m/Cargo.toml").otherwise("crates/member/Cargo.toml")
    deps = g.table("part").select(F.concat(F.lit("dep"), F.floor(F.col("p_partkey") / 3).cast("string")).alias("name"), version.alias("version"), F.lit("crates.io").alias("ecosystem"), manifest.alias("manifest"), F.lit("normal").alias("dep_kind"))
    return manifests.merged(deps).select("name", "version", "manifest")


@query("J20_usage", "SELECT 'dep' || (p_partkey % 50) AS name, count(*) AS use_count FROM part GROUP BY 1 UNION ALL SELECT 'unused', 0", graph=False)
def usage(g: Graph) -> DataFrame:
    """Each part is a TypeScript file that imports one of fifty dependencies, twice."""
    name = F.concat(F.lit("dep"), (F.col("p_partkey") % 50).cast("string"))
    content = F.concat(F.lit("import x from '"), name, F.lit("/sub';\nconst y = require('"), name, F.lit("');\nimport z from './"), name, F.lit("';\n"))
    files = g.table("part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".ts")).alias("path"), F.lit("typescript").alias("language"), content.alias("content"))
    deps = g.table("part").select(name.alias("name")).distinct().unionByName(g.spark.createDataFrame([("unused",)], "name string")).withColumn("ecosystem", F.lit("npm"))
    return manifests.usage(deps, files).select("name", "use_count")
