"""Columns computed from edges and version history. Every function maps DataFrames to a DataFrame.

Each reads edges once, aggregates before the join on node id, and leaves the join strategy to the planner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHURN_DAYS, COCHANGE_DAYS, COCHANGE_LEAST, OWNERS = 90, 365, 2, 3


def with_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """in_degree and out_degree over all edge kinds; both in one pass over the edges and one join."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("i")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i")))).alias("e"))
    counts = ends.groupBy(F.col("e.id").alias("_id")).agg(F.sum("e.i").alias("_in"), F.count("*").alias("_all"))
    joined = nodes.join(counts, nodes["id"] == F.col("_id"), "left")
    return joined.withColumns({"in_degree": F.coalesce("_in", F.lit(0)).cast("long"), "out_degree": F.coalesce(F.col("_all") - F.col("_in"), F.lit(0)).cast("long")}).drop("_id", "_in", "_all")


def with_coupling(nodes: DataFrame) -> DataFrame:
    """A file's in_degree over the largest of a file; 0 for other kinds and where that is 0."""
    top = nodes.where("kind = 'File'").agg(F.max("in_degree").alias("_top"))
    share = F.when((F.col("kind") == "File") & (F.col("_top") > 0), F.col("in_degree") / F.col("_top")).otherwise(F.lit(0.0))
    return nodes.join(F.broadcast(top)).withColumn("coupling", share).drop("_top")  # one row


def _since(commits: DataFrame, now: Column | None, days: int) -> DataFrame:
    """Commits not older than this many days before now, by default the newest commit."""
    if now is not None:
        return commits.where(F.col("ts") >= now - F.expr(f"INTERVAL {days} DAYS"))
    newest = commits.agg(F.max("ts").alias("_now"))
    return commits.join(F.broadcast(newest)).where(F.col("ts") >= F.col("_now") - F.expr(f"INTERVAL {days} DAYS")).drop("_now")


def churn(commits: DataFrame, now: Column | None = None, days: int = CHURN_DAYS) -> DataFrame:
    """(path, commits, churn): distinct commits of each path in the window, and their share of the largest."""
    counts = _since(commits, now, days).select("path", "sha").distinct().groupBy("path").agg(F.count("*").alias("commits"))
    top = counts.agg(F.max("commits").alias("_top"))
    return counts.join(F.broadcast(top)).select("path", "commits", (F.col("commits") / F.col("_top")).alias("churn"))


def with_churn(nodes: DataFrame, churned: DataFrame) -> DataFrame:
    """Files take their path's churn; all else 0."""
    joined = nodes.drop("churn").join(churned.select(F.col("path").alias("_path"), "churn"), (nodes["path"] == F.col("_path")) & (nodes["kind"] == "File"), "left")
    return joined.withColumn("churn", F.coalesce("churn", F.lit(0.0))).drop("_path").select(*nodes.columns)


#: Paths of a commit that are paired in one task.
BLOCK = 512


def cochange(commits: DataFrame, now: Column | None = None, days: int = COCHANGE_DAYS, least: int = COCHANGE_LEAST) -> DataFrame:
    """(a, b, commits, weight) of paths changed together, a < b.

    Pairs come from one array per commit, so the commits are shuffled once and there is no self-join. A commit of more than BLOCK paths is
    cut into blocks, and each two of them are paired in a task of their own, so no task makes a large commit's pairs alone.
    The weight is the share of the largest count, taken before pairs below `least` go.
    """
    sets = _since(commits, now, days).groupBy("sha").agg(F.sort_array(F.collect_set("path")).alias("p")).where(F.size("p") > 1)
    small = sets.where(F.size("p") <= BLOCK).select(F.posexplode("p").alias("k", "a"), "p").select("a", F.explode(F.slice("p", F.col("k") + 2, F.size("p"))).alias("b"))
    last = F.floor((F.size("p") - 1) / BLOCK).cast("int")
    cut = lambda i: F.slice("p", F.col(i) * BLOCK + 1, BLOCK)
    blocks = sets.where(F.size("p") > BLOCK).select("sha", "p", F.explode(F.sequence(F.lit(0), last)).alias("i")).select("sha", "p", "i", F.explode(F.sequence(F.col("i"), last)).alias("j"))
    blocks = blocks.select("sha", "i", "j", cut("i").alias("pi"), cut("j").alias("pj")).repartition("sha", "i", "j")
    large = blocks.select(F.explode("pi").alias("a"), "pj").select("a", F.explode("pj").alias("b")).where("a < b")
    tails = small.unionByName(large)
    counts = tails.groupBy("a", "b").agg(F.count("*").alias("commits"))
    top = counts.agg(F.max("commits").alias("_top"))
    return counts.join(F.broadcast(top)).where(F.col("commits") >= least).select("a", "b", "commits", (F.col("commits") / F.col("_top")).alias("weight"))


def owners(blame: DataFrame, top: int | None = OWNERS) -> DataFrame:
    """(path, author_name, author_email, lines, share, rank): the authors of each path by share of lines."""
    lines = blame.groupBy("path", "author_email").agg(F.min("author_name").alias("author_name"), F.sum("lines").alias("lines"))
    by_path = W.partitionBy("path")
    ranked = lines.withColumns({"share": F.col("lines") / F.sum("lines").over(by_path), "rank": F.row_number().over(by_path.orderBy(F.desc("lines"), "author_email"))})
    out = ranked.select("path", "author_name", "author_email", "lines", "share", F.col("rank").cast("int").alias("rank"))
    return out if top is None else out.where(F.col("rank") <= top)


def ownership_edges(owned: DataFrame) -> DataFrame:
    """OWNS edges from authors to files."""
    return owned.select(F.concat(F.lit("author:"), "author_email").alias("src"), F.concat(F.lit("file:"), "path").alias("dst"), F.lit("OWNS").alias("kind"), F.col("share").alias("weight"), F.lit(1.0).alias("confidence"))


def author_nodes(owned: DataFrame) -> DataFrame:
    """One Author node for each e-mail."""
    return owned.groupBy("author_email").agg(F.min("author_name").alias("name")).select(F.concat(F.lit("author:"), "author_email").alias("id"), F.lit("Author").alias("kind"), "name", F.lit("").alias("path"))


def cochange_edges(pairs: DataFrame) -> DataFrame:
    """CO_CHANGES edges in both directions."""
    there = pairs.select(F.concat(F.lit("file:"), "a").alias("src"), F.concat(F.lit("file:"), "b").alias("dst"), "weight")
    both = there.unionByName(there.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.select("src", "dst", F.lit("CO_CHANGES").alias("kind"), "weight", F.lit(1.0).alias("confidence"))


def with_test_coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """test_count: TESTS edges into the node; is_tested: it has one and is not in a test file."""
    counts = edges.where("kind = 'TESTS'").groupBy(F.col("dst").alias("_id")).agg(F.count("*").alias("_n"))
    joined = nodes.join(counts, nodes["id"] == F.col("_id"), "left").withColumn("test_count", F.coalesce("_n", F.lit(0)).cast("long"))
    return joined.withColumn("is_tested", (F.col("test_count") > 0) & ~F.col("is_test_file")).select(*nodes.columns)


def is_test_path(path: Column) -> Column:
    """Whether a path looks like a test's, by the parts and ends listed here."""
    p = F.lower(path)
    # Directory parts and file-name ends of tests.
    inside = ("/test/", "/tests/", "/__tests__/", "/spec/")
    ends = (".test.ts", ".spec.ts", ".test.js", ".spec.js", ".test.tsx", ".spec.tsx", "_test.py", "_test.rs")
    hit = F.lit(False)
    for part in inside:
        hit = hit | F.contains(p, F.lit(part))
    for end in ends:
        hit = hit | F.endswith(p, F.lit(end))
    return hit
