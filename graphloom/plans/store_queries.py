"""Registered queries over the versioned store, each with SQL of its own: the projected graph through three batches, every version read back; streams into it; its history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import deltas, enrich, grams, history, lineage, rank, rules
from graphloom.operators.storage import scratch
from graphloom.operators.store import GraphStore
from graphloom.plans.projection import PRELUDE, Graph
from graphloom.plans.queries import ORACLES, query
from graphloom.streaming import closing

#: The four states as SQL over raw_nodes and edges: loaded; modules renamed and classes added; every third file gone; functions come back under other paths.
_STATES = """, n1 AS (SELECT id, name, path FROM raw_nodes),
fresh AS (SELECT 'new:' || CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, 'new/' || CAST(n_nationkey AS VARCHAR) || '.ts' AS path, 'mod:' || CAST(n_nationkey AS VARCHAR) AS dst FROM nation),
n2 AS (SELECT id, CASE WHEN starts_with(id, 'mod:') THEN name || '-1' ELSE name END AS name, path FROM n1 UNION ALL SELECT id, name, path FROM fresh),
gonepaths AS (SELECT path FROM files WHERE p_partkey % 3 = 0), lost AS (SELECT id FROM n2 WHERE path IN (SELECT path FROM gonepaths)),
n3 AS (SELECT * FROM n2 WHERE path NOT IN (SELECT path FROM gonepaths)),
back AS (SELECT id, name, 'moved/' || path AS path FROM raw_nodes WHERE kind = 'Function' AND line_start % 50 = 0),
n4 AS (SELECT * FROM n3 WHERE id NOT IN (SELECT id FROM back) UNION ALL SELECT * FROM back),
e1 AS (SELECT src, dst, kind, weight FROM edges), e2 AS (SELECT * FROM e1 UNION ALL SELECT id, dst, 'CALLS', 2 FROM fresh),
e3 AS (SELECT * FROM e2 WHERE src NOT IN (SELECT id FROM lost) AND dst NOT IN (SELECT id FROM lost)),
calls AS (SELECT src, dst, kind, 9 AS weight FROM edges WHERE kind = 'CALLS' AND src IN (SELECT id FROM back)),
e4 AS (SELECT * FROM e3 WHERE NOT (kind = 'CALLS' AND (src, dst) IN (SELECT (src, dst) FROM calls)) UNION ALL SELECT * FROM calls)
"""


def _stored(g: Graph) -> GraphStore:
    """A new store with the three batches; the last one is given twice."""
    store = GraphStore(g.spark, scratch(g.spark, "store"))
    nodes, edges, nation = g.raw_nodes, g.edges, g.table("nation")
    store.commit("load", {"nodes": nodes, "edges": edges})
    number = F.col("n_nationkey").cast("string")
    fresh = nation.select(F.concat(F.lit("new:"), number).alias("id"), F.lit("Class").alias("kind"), F.col("n_name").alias("name"), F.concat(F.lit("new/"), number, F.lit(".ts")).alias("path"))
    renamed = nodes.where("kind = 'Module'").withColumn("name", F.concat("name", F.lit("-1"))).select("id", "kind", "name", "path")
    links = nation.select(F.concat(F.lit("new:"), number).alias("src"), F.concat(F.lit("mod:"), number).alias("dst"), F.lit("CALLS").alias("kind"), F.lit(2.0).alias("weight"))
    store.commit("rename", {"nodes": renamed.unionByName(fresh), "edges": links})
    store.commit("delete", gone=g.files.where("p_partkey % 3 = 0").select("path"))
    back = nodes.where("kind = 'Function' AND line_start % 50 = 0").withColumn("path", F.concat(F.lit("moved/"), "path"))
    calls = edges.where("kind = 'CALLS'").join(back.select(F.col("id").alias("src")), "src", "left_semi").withColumn("weight", F.lit(9.0))
    for _ in range(2):
        store.commit("move", {"nodes": back, "edges": calls})
    return store


def _all_versions(store: GraphStore, table: str, *columns: str) -> DataFrame:
    parts = [store.read(table, v).select(F.lit(v).alias("version"), *columns) for v in store.versions()]
    return reduce(DataFrame.unionByName, parts)


@query("K1_store_nodes", _STATES + "SELECT 1 AS version, * FROM n1 UNION ALL SELECT 2, * FROM n2 UNION ALL SELECT 3, * FROM n3 UNION ALL SELECT 4, * FROM n4")
def store_nodes(g: Graph) -> DataFrame:
    """Nodes as each version has them."""
    return _all_versions(_stored(g), "nodes", "id", "name", "path")


@query("K2_store_edges", _STATES + "SELECT 1 AS version, src, dst, kind, CAST(weight AS DOUBLE) AS weight FROM e1 UNION ALL SELECT 2, * FROM e2 UNION ALL SELECT 3, * FROM e3 UNION ALL SELECT 4, * FROM e4")
def store_edges(g: Graph) -> DataFrame:
    """Edges as each version has them."""
    return _all_versions(_stored(g), "edges", "src", "dst", "kind", "weight")


@query(
    "K4_cleared",
    ", t AS (SELECT count(*) AS n FROM files WHERE p_partkey % 2 = 0), u AS (SELECT count(*) AS n FROM files WHERE p_partkey % 4 = 0), m AS (SELECT count(*) AS n FROM raw_nodes WHERE kind = 'File') "
    "SELECT 1 AS version, 'tags' AS tab, n FROM t UNION ALL SELECT 1, 'nodes', n FROM m UNION ALL SELECT 2, 'tags', n FROM u UNION ALL SELECT 2, 'nodes', n FROM m UNION ALL SELECT 3, 'tags', 0 FROM t UNION ALL SELECT 3, 'nodes', 0 FROM m",
)
def store_cleared(g: Graph) -> DataFrame:
    """How many tags and nodes are left after tags were cleared and written anew, then both cleared."""
    store = GraphStore(g.spark, scratch(g.spark, "store"))
    tags = g.files.where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("id"), F.col("path").alias("file_path"), F.lit("TODO").alias("tag_type"))
    store.commit("load", {"nodes": g.raw_nodes.where("kind = 'File'"), "tags": tags})
    store.commit("tags", {"tags": tags.where("CAST(id AS BIGINT) % 4 = 0")}, clear=("tags",))
    store.commit("all", clear=("tags", "nodes"))
    parts = [store.read(t, v).agg(F.count("*").alias("n")).select(F.lit(v).alias("version"), F.lit(t).alias("tab"), "n") for v in store.versions() for t in ("tags", "nodes")]
    return reduce(DataFrame.unionByName, parts)


@query("K5_store_history", _STATES + "SELECT * FROM (VALUES (1, 'load'), (2, 'rename'), (3, 'delete'), (4, 'move')) v(version, batch) JOIN (SELECT 1 AS version, count(*) AS n_nodes FROM n1 UNION ALL SELECT 2, count(*) FROM n2 UNION ALL SELECT 3, count(*) FROM n3 UNION ALL SELECT 4, count(*) FROM n4) c USING (version)")
def store_history(g: Graph) -> DataFrame:
    """Batches and sizes of all versions."""
    store = _stored(g)
    sizes = _all_versions(store, "nodes", "id").groupBy("version").agg(F.count("*").alias("n_nodes"))
    return store.history().join(sizes, "version")


# Streams

_CLOSED = """WITH ev AS (SELECT event_type AS root, 'file:' || CAST(user_id AS VARCHAR) AS path, ts FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL),
fresh AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY root ORDER BY ts, path) + INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS f FROM ev),
numbered AS (SELECT *, sum(f) OVER (PARTITION BY root ORDER BY ts, path) AS burst FROM fresh),
closed AS (SELECT root, burst, min(ts) AS start, max(ts) + INTERVAL 20 MINUTE AS "end", count(*) AS n, count(DISTINCT path) AS n_paths FROM numbered GROUP BY root, burst HAVING max(ts) + INTERVAL 20 MINUTE <= (SELECT max(ts) FROM ev) - INTERVAL 10 MINUTE)
"""
_GAP_MS, _LATE = 20 * 60_000, "10 minutes"


def _change_events(g: Graph) -> DataFrame:
    """The events as a stream of changes: an event's type is the root, its user the file."""
    events = g.table("events")
    stream = g.spark.readStream.schema(events.schema).parquet(f"{g.sf_dir}/events.parque[t]")  # a pattern may be a file or a folder
    return stream.select(F.col("event_type").alias("root"), F.concat(F.lit("file:"), F.col("user_id").cast("string")).alias("path"), F.col("ts").cast("timestamp").alias("ts"))


@query("M1_closed_bursts", _CLOSED + 'SELECT root, start, "end", n, n_paths FROM closed', graph=False)
def closed_bursts(g: Graph) -> DataFrame:
    """Bursts over all files of a root, closed by the stream's timers; each micro-batch's are written under its number, so one given again replaces itself."""
    place = scratch(g.spark, "closed-bursts")

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/batch={number}")

    closing.start(closing.closed_bursts(_change_events(g), _GAP_MS, _LATE), each, scratch(g.spark, "checkpoint")).awaitTermination()
    rows = g.spark.read.schema(closing.BURSTS).parquet(f"{place}/batch=*")
    return rows.groupBy("root", "start", "end").agg(F.first("n").alias("n"), F.count("*").alias("n_paths"))


@query("M2_stream", PRELUDE + ", " + _CLOSED.removeprefix("WITH ") + "SELECT id, name, path FROM raw_nodes WHERE id IN (SELECT path FROM numbered JOIN closed USING (root, burst))", graph=False)
def stream_into_store(g: Graph) -> DataFrame:
    """Files of closed bursts, re-indexed into a versioned store by idempotent transactions."""
    store, nodes = GraphStore(g.spark, scratch(g.spark, "store")), g.raw_nodes

    def reindex(paths: DataFrame) -> dict[str, DataFrame]:
        return {"nodes": nodes.join(paths.withColumnRenamed("path", "id"), "id", "left_semi")}

    closing.watch_into(store, _change_events(g), reindex, scratch(g.spark, "checkpoint"), _GAP_MS, _LATE).awaitTermination()
    return store.read("nodes").select("id", "name", "path")


# History

#: Orders as functions that come on their date and, when fulfilled, go 90 days later, customers as classes from their first order on; calls while both ends are there.
_LIVES = """, lives AS (SELECT 'fn:' || CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderdate AS DATE) AS valid_from, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 90 END AS valid_to FROM orders
UNION ALL SELECT 'cls:' || CAST(o_custkey AS VARCHAR), min(CAST(o_orderdate AS DATE)), NULL FROM orders GROUP BY o_custkey),
calls AS (SELECT e.src, e.dst, greatest(a.valid_from, b.valid_from) AS valid_from, least(a.valid_to, b.valid_to) AS valid_to FROM edges e JOIN lives a ON a.id = e.src JOIN lives b ON b.id = e.dst WHERE e.kind IN ('CALLS', 'TESTS')),
living AS (SELECT * FROM calls WHERE valid_to IS NULL OR valid_from < valid_to),
nd AS (SELECT v, sum(c) AS came, sum(w) AS went FROM (SELECT valid_from AS v, 1 AS c, 0 AS w FROM lives UNION ALL SELECT valid_to, 0, 1 FROM lives WHERE valid_to IS NOT NULL) GROUP BY v),
ed AS (SELECT v, sum(c) AS came, sum(w) AS went FROM (SELECT valid_from AS v, 1 AS c, 0 AS w FROM living UNION ALL SELECT valid_to, 0, 1 FROM living WHERE valid_to IS NOT NULL) GROUP BY v),
versions AS (SELECT v FROM nd UNION SELECT v FROM ed),
tallied AS (SELECT v AS version, coalesce(nd.came, 0) AS nodes_came, coalesce(nd.went, 0) AS nodes_went, coalesce(ed.came, 0) AS edges_came, coalesce(ed.went, 0) AS edges_went,
  sum(coalesce(nd.came, 0) - coalesce(nd.went, 0)) OVER (ORDER BY v) AS n_nodes, sum(coalesce(ed.came, 0) - coalesce(ed.went, 0)) OVER (ORDER BY v) AS n_edges FROM versions LEFT JOIN nd USING (v) LEFT JOIN ed USING (v)),
least_order AS (SELECT o_orderkey AS k FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1), least_life AS (SELECT l.* FROM lives l, least_order WHERE l.id = 'fn:' || CAST(k AS VARCHAR)),
verdicts AS (SELECT version, n_nodes > (SELECT count(*) FROM orders) / 4 AS too_many, NOT EXISTS (SELECT 1 FROM least_life WHERE valid_from <= version AND (valid_to IS NULL OR valid_to > version)) AS lost FROM tallied WHERE nodes_came + nodes_went > 0)
"""


def _lives(g: Graph) -> DataFrame:
    orders = g.table("orders")
    day, number = F.col("o_orderdate").cast("date"), F.concat(F.lit("fn:"), F.col("o_orderkey").cast("string"))
    functions = orders.select(number.alias("id"), day.alias("valid_from"), F.when(F.col("o_orderstatus") == "F", F.date_add(day, 90)).alias("valid_to"))
    classes = orders.groupBy("o_custkey").agg(F.min(day).alias("valid_from")).select(F.concat(F.lit("cls:"), F.col("o_custkey").cast("string")).alias("id"), "valid_from", F.lit(None).cast("date").alias("valid_to"))
    return functions.unionByName(classes)


@query(
    "F11_counts_by_version",
    _LIVES + "SELECT version, CAST(nodes_came AS BIGINT) AS nodes_came, CAST(nodes_went AS BIGINT) AS nodes_went, CAST(edges_came AS BIGINT) AS edges_came, CAST(edges_went AS BIGINT) AS edges_went, CAST(n_nodes AS BIGINT) AS nodes, CAST(n_edges AS BIGINT) AS edges FROM tallied",
)
def counts_by_version(g: Graph) -> DataFrame:
    """A timeline: nodes and edges of every day's graph, and what came and went."""
    lives = _lives(g)
    calls = g.edges.where("kind IN ('CALLS', 'TESTS')").select("src", "dst")
    return history.counts_by_version(nodes=lives, edges=history.edge_history(calls, lives))


@query(
    "R8_first_bad",
    _LIVES + ", started AS (SELECT min(version) AS v FROM verdicts WHERE NOT too_many AND NOT lost), bad AS (SELECT * FROM verdicts, started WHERE (too_many OR lost) AND version > started.v ORDER BY version LIMIT 1) "
    "SELECT bad.version, array_to_string(list_filter([CASE WHEN too_many THEN 'node_count_max' END, CASE WHEN lost THEN 'nodes_exist' END], lambda x: x IS NOT NULL), ',') AS failed, (SELECT max(version) FROM verdicts g WHERE NOT too_many AND NOT lost AND g.version < bad.version) AS good_before FROM bad",
)
def first_bad(g: Graph) -> DataFrame:
    """The first day on which the graph is too large or has lost a function that it had, after a good day."""
    first = g.table("orders").orderBy("o_orderdate", "o_orderkey").first()["o_orderkey"]
    asked = rules.Predicates(node_count_max=g.table("orders").count() // 4, nodes_exist=[f"fn:{first}"])
    bad = history.first_bad(history.judged(asked, _lives(g)))
    return bad.select("version", F.array_join("failed", ",").alias("failed"), "good_before")


@query("K6_history_of_store", _STATES + """, s AS (SELECT 1 AS v, * FROM n1 UNION ALL SELECT 2, * FROM n2 UNION ALL SELECT 3, * FROM n3 UNION ALL SELECT 4, * FROM n4),
starts AS (SELECT v, id, name, path FROM s WHERE NOT EXISTS (SELECT 1 FROM s p WHERE p.id = s.id AND p.v = s.v - 1 AND p.name = s.name AND p.path = s.path))
SELECT id, name, path, v AS valid_from, (SELECT min(e.v) + 1 FROM s e WHERE e.id = starts.id AND e.v >= starts.v AND e.v < 4 AND NOT EXISTS (SELECT 1 FROM s n WHERE n.id = e.id AND n.v = e.v + 1 AND n.name = e.name AND n.path = e.path)) AS valid_to FROM starts""")
def history_of_store(g: Graph) -> DataFrame:
    """Since when and until when each node was as it was, from the buckets that each version wrote."""
    return history.of_store(_stored(g), "nodes", ["name", "path"]).select("id", "name", "path", "valid_from", "valid_to")


# Lines without git: a conversation is a file, each turn a version of it


def _versions(g: Graph) -> DataFrame:
    return g.table("conversations").select(F.concat(F.lit("talk/"), F.col("conv_id").cast("string")).alias("path"), F.col("turn").alias("version"), F.col("role").alias("author"), F.col("text").alias("content"))


@query("S5_line_changes")
def line_changes(g: Graph) -> DataFrame:
    """Lines added and removed by every version: smallest differences, which SQL cannot say."""
    return lineage.line_changes(_versions(g))


_LINES = r"CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(text) - len(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END END"


@query("S5_line_balance", f"SELECT 'talk/' || CAST(conv_id AS VARCHAR) AS path, turn AS version, role AS author, n AS n_lines, n - coalesce(lag(n) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS net FROM (SELECT conv_id, turn, role, {_LINES} AS n FROM conversations)", graph=False)
def line_balance(g: Graph) -> DataFrame:
    """What the differences must add up to: lines of each version, and how many more they are than before."""
    return lineage.line_changes(_versions(g)).select("path", "version", "author", "n_lines", (F.col("added") - F.col("removed")).alias("net"))


@query("A21_line_owners")
def line_owners(g: Graph) -> DataFrame:
    """Owners of each file by the lines that are left of what they brought."""
    owned = enrich.owners(lineage.as_blame(lineage.lines_left(_versions(g))))
    return owned.select("path", "author_name", "lines", F.round("share", 9).alias("share"), "rank")


@query("A21_lines_in_all", f"SELECT 'talk/' || CAST(conv_id AS VARCHAR) AS path, n AS lines FROM (SELECT conv_id, {_LINES} AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1 AND n > 0", graph=False)
def lines_in_all(g: Graph) -> DataFrame:
    """All owners' lines of a file are the lines of its last version."""
    return lineage.lines_left(_versions(g)).groupBy("path").agg(F.sum("lines").alias("lines"))


@query(
    "S7_changed_between",
    "WITH s AS (SELECT 'talk/' || CAST(conv_id AS VARCHAR) AS path, max_by(text, turn) FILTER (turn <= 1) AS a, max_by(text, turn) FILTER (turn <= 3) AS b, count(*) FILTER (turn <= 1) AS na FROM conversations GROUP BY conv_id) "
    "SELECT path, CASE WHEN na = 0 THEN 'new' ELSE 'changed' END AS change FROM s WHERE a IS DISTINCT FROM b",
    graph=False,
)
def changed_between(g: Graph) -> DataFrame:
    return lineage.changed_between(_versions(g), 1, 3)


# Lookups by an index of 3-grams; the SQL is that of the lookups without one


def _index(g: Graph, *fields: str) -> grams.GramIndex:
    """Of the columns that the lookup asks."""
    return grams.GramIndex(g.spark, scratch(g.spark, "grams")).build(g.raw_nodes, fields)


@query("F2_indexed_find", ORACLES["F2_find"], graph=False)
def indexed_find(g: Graph) -> DataFrame:
    return _index(g, "id", "name").find(g.nodes, "fn_12").select("id", "kind", "name", "in_degree")


@query("F3_indexed_symbol", ORACLES["F3_find_symbol"], graph=False)
def indexed_symbol(g: Graph) -> DataFrame:
    return _index(g, "id", "name").find_symbol(g.nodes, "Customer#00000001", "class")


@query("F4_indexed_search", ORACLES["F4_search"], graph=False)
def indexed_search(g: Graph) -> DataFrame:
    return _index(g, "name", "path").search(g.raw_nodes, "Widget", None).select("id", "kind", "name", "path")


# Enrichment kept up by deltas


@query(
    "A4_by_deltas",
    ", kept AS (SELECT src, dst, kind FROM edges WHERE src NOT IN (SELECT id FROM raw_nodes WHERE path IN (SELECT path FROM files WHERE p_partkey % 3 = 0)) AND dst NOT IN (SELECT id FROM raw_nodes WHERE path IN (SELECT path FROM files WHERE p_partkey % 3 = 0))), "
    "i AS (SELECT dst AS id, count(*) AS n, count(*) FILTER (kind = 'TESTS') AS t FROM kept GROUP BY dst), o AS (SELECT src AS id, count(*) AS n FROM kept GROUP BY src), top AS (SELECT max(n) AS m FROM i WHERE starts_with(id, 'file:')) "
    "SELECT id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, coalesce(i.t, 0) AS test_count, CASE WHEN starts_with(id, 'file:') THEN round(coalesce(i.n, 0) / CAST(m AS DOUBLE), 9) ELSE 0 END AS coupling FROM raw_nodes r LEFT JOIN i USING (id) LEFT JOIN o USING (id), top WHERE r.path NOT IN (SELECT path FROM files WHERE p_partkey % 3 = 0)",
)
def degrees_by_deltas(g: Graph) -> DataFrame:
    """Degrees, test counts and coupling after edges came in two batches and every third file went, from what changed each time."""
    store = GraphStore(g.spark, scratch(g.spark, "store"))
    store.commit("nodes", {"nodes": g.raw_nodes})
    for batch, edges in (("calls", g.edges.where("kind <> 'IMPORTS'")), ("imports", g.edges.where("kind = 'IMPORTS'"))):
        store.commit(batch, {"edges": edges})
        deltas.refresh(store)
    store.commit("delete", gone=g.files.where("p_partkey % 3 = 0").select("path"))
    deltas.refresh(store)
    out = deltas.with_degrees(store.read("nodes"), store)
    return out.select("id", "in_degree", "out_degree", "test_count", F.round("coupling", 9).alias("coupling"))


# Ordered, capped listings


@query("T9_cross_cluster", f"SELECT *, CAST(row_number() OVER (ORDER BY edge_count DESC, src_community, dst_community) AS INT) AS rank FROM ({ORACLES['J5_cross_cluster']}) ORDER BY rank LIMIT 50", graph=False)
def top_cross_cluster(g: Graph) -> DataFrame:
    return rank.top_cross_cluster(g.nodes, g.edges, rank.communities(g.nodes))


@query("A1_counts_with_snapshots", "SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count, (SELECT count(DISTINCT sha) FROM commits) AS snapshot_count")
def counts_with_snapshots(g: Graph) -> DataFrame:
    """Of a graph whose commits all have a snapshot."""
    return rank.counts(g.raw_nodes, g.edges, g.commits.select("sha").distinct())
