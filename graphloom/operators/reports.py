"""Coverage of docs and tests, facts about one file or symbol, diffs, reviews and dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.paths import file_group, file_role
from graphloom.operators.traverse import impact, within

SYMBOLS = ("Function", "Class")
LINKS = ("CALLS", "IMPORTS", "INHERITS")


def _documented() -> Column:
    return F.coalesce("doc_comment", F.lit("")) != ""


def docs_coverage(nodes: DataFrame, by_community: bool = False, exported_only: bool = False) -> DataFrame:
    """([community,] total, documented, pct) over functions and classes outside paths with 'test'."""
    own = nodes.where(F.col("kind").isin(*SYMBOLS) & ~F.contains("path", F.lit("test")))
    if exported_only:
        own = own.where("exported")
    grouped = own.groupBy("community") if by_community else own.groupBy()
    out = grouped.agg(F.count("*").alias("total"), F.count_if(_documented()).alias("documented"))
    return out.withColumn("pct", F.coalesce(F.lit(100.0) * F.col("documented") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)))


def undocumented(nodes: DataFrame, limit: int = 10) -> DataFrame:
    return nodes.where((F.col("kind") == "Function") & ~_documented()).orderBy(F.desc("in_degree"), "id").limit(limit)


def test_coverage(nodes: DataFrame) -> DataFrame:
    """One row: total, tested, untested, pct of functions and classes outside test files."""
    out = nodes.where(F.col("kind").isin(*SYMBOLS) & ~F.col("is_test_file")).agg(F.count("*").alias("total"), F.count_if("is_tested").alias("tested"))
    return out.select("total", "tested", (F.col("total") - F.col("tested")).alias("untested"), F.when(F.col("total") > 0, F.lit(100.0) * F.col("tested") / F.col("total")).otherwise(0.0).alias("pct"))


def test_coverage_by_community(nodes: DataFrame, limit: int = 20) -> DataFrame:
    by = nodes.where((F.col("kind") == "Function") & ~F.col("is_test_file")).groupBy("community").agg(F.count("*").alias("total"), F.count_if("is_tested").alias("tested"))
    return by.orderBy(F.desc("total"), "community").limit(limit)


def combined_risk() -> Column:
    return F.lit(1.0) - (F.lit(1.0) - F.col("churn")) * (F.lit(1.0) - F.col("coupling"))


def test_gaps(nodes: DataFrame, limit: int = 20) -> DataFrame:
    """Untested symbols by callers and churn, with a risk and the file a test would go to."""
    gaps = nodes.where(F.col("kind").isin(*SYMBOLS) & ~F.col("is_test_file") & ~F.col("is_tested")).withColumn("weight", F.col("churn") * F.col("in_degree") + F.col("in_degree") * F.lit(0.5))
    top = gaps.orderBy(F.desc("weight"), "id").limit(limit)
    risk = F.when(combined_risk() > 0.7, "HIGH").when(combined_risk() > 0.4, "MEDIUM").otherwise("LOW")
    target = F.when(F.contains("path", F.lit("/")), F.concat(F.lit("tests/"), F.regexp_replace("path", r"(\.ts)+$|(\.tsx)+$", ""), F.lit(".test.ts"))).otherwise(F.concat(F.lit("tests/"), F.lower("name"), F.lit(".test.ts")))
    return top.select("id", "name", "path", "in_degree", "weight", risk.alias("risk"), target.alias("suggested"))


def cross_file(nodes: DataFrame, edges: DataFrame, path: str, callers: bool = True) -> DataFrame:
    """Symbols of other files that call, import or inherit from a path's nodes, or the other way round."""
    own = nodes.where(F.col("path") == path).select(F.col("id").alias("_own"))
    here, there = ("dst", "src") if callers else ("src", "dst")
    ends = edges.where(F.col("kind").isin(*LINKS)).join(own, edges[here] == F.col("_own"), "left_semi").select(F.col(there).alias("_id")).distinct()
    return nodes.where((F.col("path") != path) & ~F.col("kind").isin("File", "Author")).join(ends, nodes["id"] == F.col("_id"), "left_semi")


def tests_of(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """Nodes of test files with any edge into a path's nodes."""
    own = nodes.where(F.col("path") == path).select(F.col("id").alias("_own"))
    ends = edges.join(own, edges["dst"] == F.col("_own"), "left_semi").select(F.col("src").alias("_id")).distinct()
    return nodes.where("is_test_file").join(ends, nodes["id"] == F.col("_id"), "left_semi")


def owners_of(nodes: DataFrame, edges: DataFrame, path: str, limit: int = 10) -> DataFrame:
    """(name, weight, lines) of a file's authors; lines estimated from its length."""
    files = nodes.where((F.col("kind") == "File") & (F.col("path") == path)).select(F.col("id").alias("dst"), F.greatest(F.col("line_end") - F.col("line_start"), F.lit(1)).alias("length"))
    authors = nodes.where("kind = 'Author'").select(F.col("id").alias("src"), "name")
    found = edges.where("kind = 'OWNS'").join(files, "dst").join(authors, "src")
    return found.select("name", "weight", F.round(F.col("weight") * F.col("length")).cast("long").alias("lines")).orderBy(F.desc("weight"), "name").limit(limit)


def file_facts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, language, churn, community, complexity, exported_count, n_symbols, n_callers, n_callees, n_tests, role, file_group) of every file at once.

    Cross-file links of all files come from one join of the edges with the paths of both ends.
    """
    files = nodes.where("kind = 'File'").select("path", "language", "churn", "community")
    symbols = nodes.where(F.col("kind").isin("Function", "Class", "Variable", "Type")).groupBy("path").agg(F.count("*").alias("n_symbols"), F.max("complexity").alias("complexity"), F.count_if("exported").alias("exported_count"))
    ends = nodes.select("id", "path", "kind", "is_test_file")
    pairs = edges.select("src", "dst", "kind").join(ends.toDF("src", "src_path", "src_kind", "src_test"), "src").join(ends.select("id", "path", "kind").toDF("dst", "dst_path", "dst_kind"), "dst")
    link, other = F.col("kind").isin(*LINKS), F.col("src_path") != F.col("dst_path")
    said = F.array(
        F.when(link & other & ~F.col("src_kind").isin("File", "Author"), F.struct(F.col("dst_path").alias("path"), F.lit("caller").alias("what"), F.col("src").alias("id"))),
        F.when(link & other & ~F.col("dst_kind").isin("File", "Author"), F.struct(F.col("src_path").alias("path"), F.lit("callee").alias("what"), F.col("dst").alias("id"))),
        F.when(F.col("src_test"), F.struct(F.col("dst_path").alias("path"), F.lit("test").alias("what"), F.col("src").alias("id"))),
    )
    facts = pairs.select(F.explode(F.filter(said, lambda x: x.isNotNull())).alias("f")).select("f.*").distinct()
    by = facts.groupBy("path").agg(*(F.count_if(F.col("what") == w).alias(n) for w, n in (("caller", "n_callers"), ("callee", "n_callees"), ("test", "n_tests"))))
    out = files.join(symbols, "path", "left").join(by, "path", "left").fillna(0, ["n_symbols", "exported_count", "n_callers", "n_callees", "n_tests"]).fillna(0.0, ["complexity"])
    return out.withColumns({"role": file_role(F.col("path"), F.col("exported_count"), F.col("n_callers")), "file_group": file_group(F.col("path"))})


def symbol_context(nodes: DataFrame, edges: DataFrame, node_id: str, limit: int = 5) -> DataFrame:
    """(role, id, name, kind, path): callers and dependencies of a node, by id or by its bare name, and its peers in the community."""
    me = nodes.where(F.col("id") == node_id)
    mine = me.select(F.col("id").alias("_end")).union(me.select("name"))
    back = edges.where(F.col("kind").isin("CALLS", "INHERITS", "TESTS")).join(F.broadcast(mine), edges["dst"] == F.col("_end"), "left_semi").select(F.col("src").alias("_id")).distinct()
    callers = nodes.join(back, nodes["id"] == F.col("_id"), "left_semi").where(F.col("id") != node_id).select(F.lit("caller").alias("role"), "id", "name", "kind", "path", "in_degree")
    ahead = edges.where(F.col("kind").isin(*LINKS) & (F.col("src") == node_id)).select(F.col("dst").alias("_id")).distinct()
    by_id = nodes.join(ahead, nodes["id"] == F.col("_id"), "left_semi")
    unknown = ahead.join(nodes.select(F.col("id").alias("_id")), "_id", "left_anti")
    by_name = nodes.join(unknown, nodes["name"] == F.col("_id"), "left_semi")
    deps = by_id.unionByName(by_name).where(F.col("id") != node_id).dropDuplicates(["id"]).select(F.lit("dependency").alias("role"), "id", "name", "kind", "path", "in_degree")
    home = me.where("community > 0").select(F.col("community").alias("_c"))
    peers = nodes.join(F.broadcast(home), nodes["community"] == F.col("_c"), "left_semi").where((F.col("id") != node_id) & F.col("kind").isin(*SYMBOLS)).select(F.lit("peer").alias("role"), "id", "name", "kind", "path", "in_degree")
    both = callers.unionByName(deps).unionByName(peers.orderBy(F.desc("in_degree"), "id").limit(3))
    ranked = both.withColumn("_r", F.row_number().over(W.partitionBy("role").orderBy(F.desc("in_degree"), "id"))).where(F.col("_r") <= limit)
    return ranked.drop("_r")


def graph_diff(before_nodes: DataFrame, before_edges: DataFrame, after_nodes: DataFrame, after_edges: DataFrame) -> DataFrame:
    """(element, id, change): nodes added, removed, modified; edges added, removed."""
    fields = ("name", "path", "line_start", "line_end", "kind")
    a, b = (df.select("id", F.struct(*fields).alias(s)) for df, s in ((before_nodes, "a"), (after_nodes, "b")))
    node = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified")
    nodes = a.join(b, "id", "full_outer").select(F.lit("node").alias("element"), "id", node.alias("change")).where("change IS NOT NULL")
    key = F.concat_ws("|", "src", "kind", "dst").alias("id")
    was, now = before_edges.select(key).distinct(), after_edges.select(key).distinct()
    plus = now.join(was, "id", "left_anti").select(F.lit("edge").alias("element"), "id", F.lit("added").alias("change"))
    minus = was.join(now, "id", "left_anti").select(F.lit("edge").alias("element"), "id", F.lit("removed").alias("change"))
    return nodes.unionByName(plus).unionByName(minus)


def impact_report(nodes: DataFrame, edges: DataFrame, changed_paths: DataFrame) -> DataFrame:
    """One row: changed_files, changed_nodes, impacted_nodes, total."""
    found = impact(nodes, edges, changed_paths).agg(F.count_if(F.col("role") == "changed").alias("changed_nodes"), F.count_if(F.col("role") == "impacted").alias("impacted_nodes"))
    files = changed_paths.select("path").distinct().agg(F.count("*").alias("changed_files"))
    return files.join(F.broadcast(found)).withColumn("total", F.col("changed_nodes") + F.col("impacted_nodes"))


def review(nodes: DataFrame, edges: DataFrame, changed_paths: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """One row: changed_nodes, blast, hotspots, missing_tests, missing_docs, todos, risk, reviewers (owners of the changed files)."""
    paths = changed_paths.select("path").distinct()
    changed = nodes.where("kind <> 'Author'").join(paths, "path", "left_semi")
    reached = within(nodes, edges, changed.select(F.col("id").alias("seed")), 2, "both").select("id").distinct()
    blast = nodes.join(reached, "id", "left_semi").join(paths, "path", "left_anti").agg(F.count("*").alias("blast"))
    symbol = F.col("kind").isin(*SYMBOLS)
    counts = changed.agg(F.count("*").alias("changed_nodes"), F.count_if((F.col("churn") > 0.7) & (F.col("coupling") > 0.6)).alias("hotspots"), F.count_if(symbol & ~F.col("is_tested")).alias("missing_tests"), F.count_if(symbol & ~_documented()).alias("missing_docs"))
    todos = (tags.join(paths.toDF("file_path"), "file_path", "left_semi") if tags is not None else nodes.limit(0)).agg(F.count("*").alias("todos"))
    authors = nodes.where("kind = 'Author'").select(F.col("id").alias("src"), "name")
    mine = edges.where("kind = 'OWNS'").join(changed.where("kind = 'File'").select(F.col("id").alias("dst")), "dst", "left_semi").join(authors, "src").groupBy("name").agg(F.sum("weight").alias("w"))
    top = mine.orderBy(F.desc("w"), "name").limit(3).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("w"), "name"))), lambda x: x["name"]), ", ").alias("reviewers"))
    out = counts.join(F.broadcast(blast)).join(F.broadcast(todos)).join(F.broadcast(top))
    risk = F.when((F.col("hotspots") > 0) | (F.col("blast") > 20), "HIGH").when((F.col("blast") > 5) | (F.col("missing_tests") > 0), "MEDIUM").otherwise("LOW")
    return out.withColumn("risk", risk)


def dependency_health(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Each dependency with its advisories (name, ecosystem, version, cve_id), a risk score and a label."""
    by = advisories.groupBy("name", "ecosystem", "version").agg(F.sort_array(F.collect_set("cve_id")).alias("cve_ids"))
    out = deps.join(by, ["name", "ecosystem", "version"], "left").withColumn("cve_ids", F.coalesce("cve_ids", F.array().cast("array<string>")))
    n = F.size("cve_ids")
    return out.withColumns({"cve_count": n.cast("long"), "risk_score": F.least(n, F.lit(5)) / F.lit(5.0), "label": F.when(n >= 3, "CRITICAL").when(n >= 1, "HIGH").otherwise("OK")})


def dependency_totals(health: DataFrame) -> DataFrame:
    return health.agg(F.count("*").alias("total"), F.count_if(F.col("cve_count") > 0).alias("affected"), F.coalesce(F.sum("cve_count"), F.lit(0)).alias("cves"))


def slice_hashes(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, hash) of what a file's note shows; a note is written anew only where it differs from the saved one."""
    own = nodes.where(F.col("kind").isin("Function", "Class", "Variable", "Type")).groupBy("path").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "id", F.col("line_start").cast("string"), F.col("line_end").cast("string")))), ";").alias("own"))
    joined = facts.join(own, "path", "left")
    parts = ["path", F.col("community").cast("string"), F.coalesce("own", F.lit("")), *(F.col(c).cast("string") for c in ("n_callers", "n_callees", "n_tests")), F.floor(F.col("complexity") / 10).cast("string")]
    return joined.select("path", F.sha2(F.concat_ws("\u0001", *parts), 256).alias("hash"))


def tldr() -> Column:
    """A sentence on a row of file_facts."""
    # Display names of languages, and the phrases below.
    names = {"rust": "Rust", "typescript": "TypeScript", "javascript": "JavaScript", "python": "Python", "go": "Go", "java": "Java", "php": "PHP"}
    language = F.when(F.col("language") == "", "Source")
    for key, shown in names.items():
        language = language.when(F.col("language") == key, shown)
    exported = F.when(F.col("exported_count") > 0, F.concat(F.col("exported_count").cast("string"), F.lit(" exported symbol"), F.when(F.col("exported_count") == 1, "").otherwise("s"))).otherwise("internal-only")
    c, d = F.col("n_callers"), F.col("n_callees")
    called, into = F.concat(F.lit("called by "), c.cast("string")), F.concat(F.lit("calls into "), d.cast("string"))
    links = F.when((c == 0) & (d == 0), "no cross-file edges").when(d == 0, F.concat(called, F.lit(" other file(s)"))).when(c == 0, F.concat(into, F.lit(" other file(s)"))).otherwise(F.concat(called, F.lit(" · "), into))
    hot = F.when((F.col("churn") >= 0.5) | (F.col("complexity") >= 10), " · ⚠ hotspot").otherwise("")
    return F.concat(F.lit("> **"), language.otherwise(F.col("language")), F.lit(" · "), F.col("role"), F.lit("** — "), exported, F.lit(", "), links, F.lit("."), hot)


def group_sizes(nodes: DataFrame) -> DataFrame:
    """(file_group, files, exported): files of each group, and the exported symbols in them."""
    symbols = nodes.where(F.col("kind").isin("Function", "Class", "Variable", "Type")).groupBy("path").agg(F.count_if("exported").alias("n"))
    files = nodes.where("kind = 'File'").select("path", file_group(F.col("path")).alias("file_group"))
    return files.join(symbols, "path", "left").groupBy("file_group").agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("exported"))


def name_collisions(files: DataFrame) -> DataFrame:
    """(path, file_group, basename, collides): whether another file of the group has the same base name."""
    base = files.select("path", file_group(F.col("path")).alias("file_group"), F.regexp_extract("path", "[^/]*$", 0).alias("basename"))
    return base.withColumn("collides", F.count("*").over(W.partitionBy("file_group", "basename")) > 1)
