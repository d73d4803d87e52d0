"""Rankings and counts over enriched nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NO_SYMBOL = ("File", "Author")
DEPENDENCIES = ("CALLS", "IMPORTS", "INHERITS", "DEPENDS_ON")


def heat() -> Column:
    """churn times coupling, in_degree as a tie-break."""
    return F.col("churn") * F.col("coupling") + F.lit(0.01) * F.col("in_degree")


def hotspots(nodes: DataFrame, limit: int = 20, churned_only: bool = False) -> DataFrame:
    """Files by heat; those without churn too, unless churned_only."""
    live = F.col("churn") > 0 if churned_only else (F.col("churn") > 0) | (F.col("in_degree") > 0)
    hot = nodes.where((F.col("kind") == "File") & live).select("path", "churn", "coupling", "in_degree", heat().alias("score"))
    return hot.orderBy(F.desc("score"), "path").limit(limit)


def hotspots_with_owner(nodes: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """Hotspots with the author of the heaviest OWNS edge; ties go to the smaller name. Only the hot files' edges are joined."""
    hot = nodes.where((F.col("kind") == "File") & ((F.col("churn") > 0) | (F.col("in_degree") > 0))).select("id", "path", "churn", "coupling", heat().alias("score")).orderBy(F.desc("score"), "path").limit(limit)
    owns = edges.where("kind = 'OWNS'").select(F.col("src").alias("_author"), F.col("dst").alias("_file"), "weight")
    names = nodes.where("kind = 'Author'").select(F.col("id").alias("_id"), "name")
    mine = owns.join(F.broadcast(hot.select(F.col("id").alias("_hot"))), F.col("_file") == F.col("_hot")).join(names, F.col("_author") == F.col("_id"))
    best = mine.groupBy("_file").agg(F.min_by("name", F.struct(-F.col("weight"), "name")).alias("owner"))
    return hot.join(best, hot["id"] == F.col("_file"), "left").select("path", "churn", "coupling", "score", F.coalesce("owner", F.lit("")).alias("owner"))


def entry_points(nodes: DataFrame, limit: int = 20) -> DataFrame:
    return nodes.where((F.col("in_degree") == 0) & ~F.col("kind").isin(*NO_SYMBOL)).orderBy(F.desc("out_degree"), "id").limit(limit)


def listed_entry_points(nodes: DataFrame) -> DataFrame:
    """All symbols that nothing refers to, with a reason; exported ones first, then by what they refer to."""
    # The reasons.
    reason = F.when(F.col("exported"), "exported, no callers").when(F.col("kind").isin("Function", "Method"), "no callers in graph (CLI entry / event handler / dead candidate)").otherwise("no incoming references")
    hit = nodes.where((F.col("in_degree") == 0) & ~F.col("kind").isin("File", "Author", "Module") & ~F.col("is_test_file"))
    return hit.select("id", "kind", "name", "path", "line_start", "exported", "out_degree", reason.alias("reason")).orderBy(F.desc("exported"), F.desc("out_degree"), "path", "line_start", "id")


def god_nodes(nodes: DataFrame, limit: int = 20) -> DataFrame:
    return nodes.where((F.col("in_degree") > 0) & ~F.col("kind").isin(*NO_SYMBOL)).orderBy(F.desc("in_degree"), "id").limit(limit)


def god_names(nodes: DataFrame, limit: int = 20) -> DataFrame:
    """One node a name, the one with most references."""
    pick = nodes.where((F.col("in_degree") > 0) & ~F.col("kind").isin(*NO_SYMBOL)).groupBy("name").agg(F.min_by(F.struct("id", "kind", "in_degree"), F.struct(-F.col("in_degree"), "id")).alias("n"))
    return pick.select("name", "n.*").orderBy(F.desc("in_degree"), "name").limit(limit)


def most_referenced(nodes: DataFrame, limit: int = 5) -> DataFrame:
    """Any kind but files; nodes without references too."""
    return nodes.where("kind <> 'File'").orderBy(F.desc("in_degree"), "id").limit(limit)


def combined_complexity(nodes: DataFrame, limit: int = 20) -> DataFrame:
    """Functions by complexity times the churn of their file, out of a pool of the 5 * limit most complex."""
    pool = nodes.where("kind = 'Function'").orderBy(F.desc("complexity"), "id").limit(5 * limit).select("id", "name", "path", "complexity")
    files = nodes.where("kind = 'File'").select(F.col("path").alias("_path"), F.col("churn").alias("file_churn"))
    joined = files.join(F.broadcast(pool), F.col("path") == F.col("_path"), "right")
    scored = joined.select("id", "name", "path", "complexity", F.coalesce("file_churn", F.lit(0.0)).alias("file_churn")).withColumn("score", F.col("complexity") * F.col("file_churn"))
    return scored.orderBy(F.desc("score"), F.desc("complexity"), "id").limit(limit)


def complex_functions(nodes: DataFrame, limit: int = 40) -> DataFrame:
    return nodes.where("kind = 'Function' AND complexity > 0").orderBy(F.desc("complexity"), "id").limit(limit)


def counts_by_kind(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count("*").alias("n"))


def counts(nodes: DataFrame, edges: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """One row: node_count, edge_count and, of given snapshots, snapshot_count."""
    out = nodes.agg(F.count("*").alias("node_count")).join(F.broadcast(edges.agg(F.count("*").alias("edge_count"))))
    return out if snapshots is None else out.join(F.broadcast(snapshots.agg(F.count("*").alias("snapshot_count"))))


def language_breakdown(nodes: DataFrame) -> DataFrame:
    """Share of each language among nodes that have one."""
    by = nodes.where("language <> ''").groupBy("language").agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("_total"))
    return by.join(F.broadcast(total)).select("language", "n", (F.col("n") / F.col("_total")).alias("share"))


def communities(nodes: DataFrame, top: int = 5) -> DataFrame:
    """(id, label, node_count, top_nodes) of communities above 0; the top nodes as Kind:name, the label the first of them."""
    own = nodes.where("community > 0")
    sizes = own.groupBy("community").agg(F.count("*").alias("node_count"))
    ranked = own.select("community", "kind", "name", "in_degree", "id", F.row_number().over(W.partitionBy("community").orderBy(F.desc("in_degree"), "name", "id")).alias("r")).where(F.col("r") <= top)
    tops = ranked.groupBy("community").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", F.concat_ws(":", "kind", "name").alias("t")))), lambda x: x["t"]).alias("top_nodes"))
    return sizes.join(tops, "community").select(F.col("community").alias("id"), F.element_at("top_nodes", 1).alias("label"), "node_count", "top_nodes")


def ownership(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, files, share): files of each author, and the share of all."""
    authors = nodes.where("kind = 'Author'").select(F.col("id").alias("_id"), "name")
    by = edges.where("kind = 'OWNS'").groupBy("src").agg(F.count("*").alias("_n")).join(authors, F.col("src") == F.col("_id")).groupBy("name").agg(F.sum("_n").alias("files"))
    total = by.agg(F.sum("files").alias("_total"))
    return by.join(F.broadcast(total)).select("name", "files", (F.col("files") / F.col("_total")).alias("share"))


def cross_cluster(nodes: DataFrame, edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(src_community, src_label, dst_community, dst_label, edge_count, total_weight) of dependencies between communities.

    Labels are joined after the aggregation, when there is one row a pair of communities.
    """
    own = nodes.where("community > 0").select("id", "community")
    ends = edges.where(F.col("kind").isin(*DEPENDENCIES)).select("src", "dst", "weight")
    ends = ends.join(own.toDF("src", "src_community"), "src").join(own.toDF("dst", "dst_community"), "dst")
    by = ends.where("src_community <> dst_community").groupBy("src_community", "dst_community").agg(F.count("*").alias("edge_count"), F.sum("weight").alias("total_weight"))
    if labels is None:
        return by.select("src_community", F.lit("").alias("src_label"), "dst_community", F.lit("").alias("dst_label"), "edge_count", "total_weight")
    names = labels.select("id", "label")
    by = by.join(names.toDF("src_community", "src_label"), "src_community", "left").join(names.toDF("dst_community", "dst_label"), "dst_community", "left")
    return by.select("src_community", F.coalesce("src_label", F.lit("")).alias("src_label"), "dst_community", F.coalesce("dst_label", F.lit("")).alias("dst_label"), "edge_count", "total_weight")


def top_cross_cluster(nodes: DataFrame, edges: DataFrame, labels: DataFrame | None = None, limit: int = 50) -> DataFrame:
    """The pairs of communities with most dependencies between them, with `rank` from 1; ties by the pair."""
    order = (F.desc("edge_count"), "src_community", "dst_community")
    top = cross_cluster(nodes, edges, labels).orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order)))  # `limit` rows


def community_edges(nodes: DataFrame, edges: DataFrame, community: int) -> DataFrame:
    """Distinct edges with both ends in the community."""
    own = nodes.where(F.col("community") == community).select(F.col("id").alias("_n"))
    return edges.join(own, edges["src"] == F.col("_n"), "left_semi").join(own, edges["dst"] == F.col("_n"), "left_semi").select("src", "dst", "kind", "weight").distinct()


def community_doc(nodes: DataFrame, community: int, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """Of a community: its most frequent path, and its top nodes."""
    own = nodes.where(F.col("community") == community)
    main = own.where("path <> ''").groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(1)
    return main, own.orderBy(F.desc("in_degree"), "id").limit(top)


def glossary(nodes: DataFrame) -> DataFrame:
    """One row a kind and one a community size class: (section, name, n)."""
    kinds = nodes.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("kind").alias("section"), F.col("kind").alias("name"), "n")
    sizes = nodes.groupBy("community").agg(F.count("*").alias("n"))
    by_size = sizes.select(F.lit("community").alias("section"), F.col("community").cast("string").alias("name"), "n")
    single = sizes.agg(F.count_if(F.col("n") == 1).alias("n")).select(F.lit("singletons").alias("section"), F.lit("").alias("name"), "n")
    return kinds.unionByName(by_size).unionByName(single)
