"""Architecture rules and bisect predicates."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.lookup import guarded_sql
from graphloom.operators.traverse import cyclic_edges

VIOLATION = "rule string, severity string, file string, message string"


@dataclass
class Rule:
    name: str
    description: str = ""
    severity: str = "error"
    query: str | None = None
    built_in: str | None = None
    threshold: float | None = None


def load(text: str) -> list[Rule]:
    """Rules of a TOML document with [[rules]] tables."""
    import tomllib

    known = Rule.__dataclass_fields__
    return [Rule(**{k: v for k, v in r.items() if k in known}) for r in tomllib.loads(text).get("rules", [])]


def max_coupling(nodes: DataFrame, threshold: float = 30, limit: int = 20) -> DataFrame:
    hit = nodes.where((F.col("kind") != "Author") & (F.col("in_degree") > int(threshold))).orderBy(F.desc("in_degree"), "id").limit(limit)
    return hit.select(F.col("path").alias("file"), F.format_string(f"%s has %d callers (threshold: {int(threshold)})", "name", "in_degree").alias("message"))


def max_complexity(nodes: DataFrame, threshold: float = 0.3, limit: int = 20) -> DataFrame:
    hit = nodes.where((F.col("kind") == "Function") & (F.col("complexity") > threshold)).orderBy(F.desc("complexity"), "id").limit(limit)
    return hit.select(F.col("path").alias("file"), F.format_string(f"%s has complexity %.2f (threshold: {threshold:.2f})", "name", "complexity").alias("message"))


def undocumented_public(nodes: DataFrame, limit: int = 50) -> DataFrame:
    hit = nodes.where(F.col("kind").isin("Function", "Class") & F.col("exported") & (F.coalesce("doc_comment", F.lit("")) == "")).orderBy("name", "id").limit(limit)
    return hit.select(F.col("path").alias("file"), F.concat(F.lit("Public "), "name", F.lit(" has no doc comment")).alias("message"))


def no_cycles(edges: DataFrame, limit: int = 10) -> DataFrame:
    """Import edges on a cycle."""
    bad = cyclic_edges(edges.where("kind = 'IMPORTS'")).orderBy("src", "dst").limit(limit)
    return bad.select(F.col("src").alias("file"), F.concat(F.lit("Circular import detected: "), "src", F.lit(" -> "), "dst").alias("message"))


def sql_rule(spark: SparkSession, query: str, nodes: DataFrame, edges: DataFrame, **views: DataFrame) -> DataFrame:
    """Each row is a violation: its first column the file, its first ten columns the message."""
    rows = guarded_sql(spark, query, nodes=nodes, edges=edges, **views)
    cells = [F.coalesce(rows[f"`{c}`"].cast("string"), F.lit("")) for c in rows.columns[:10]]
    return rows.select(cells[0].alias("file"), F.concat_ws(", ", *cells).alias("message"))


def run(spark: SparkSession, rules: list[Rule], nodes: DataFrame, edges: DataFrame, only: str | None = None, **views: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """(violations, errors): rows of all rules that could be planned, and why the others could not."""
    parts, errors = [], {}
    for rule in rules:
        if only and rule.name != only:
            continue
        try:
            if rule.query:
                found = sql_rule(spark, rule.query, nodes, edges, **views)
            elif rule.built_in == "no_cycles":
                found = no_cycles(edges)
            elif rule.built_in == "max_coupling":
                found = max_coupling(nodes, rule.threshold if rule.threshold is not None else 30)
            elif rule.built_in == "max_complexity":
                found = max_complexity(nodes, rule.threshold if rule.threshold is not None else 0.3)
            elif rule.built_in == "require_docs_for_public":
                found = undocumented_public(nodes)
            else:
                raise ValueError(f"neither a query nor a known built-in: {rule.built_in}")
        except Exception as why:  # one broken rule is a result, not an end
            errors[rule.name] = str(why)
            continue
        parts.append(found.select(F.lit(rule.name).alias("rule"), F.lit(rule.severity).alias("severity"), "file", "message"))
    return (reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], VIOLATION)), errors


def verdict(violations: DataFrame) -> DataFrame:
    """One row: errors, warnings, failed."""
    out = violations.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") != "error").alias("warnings"))
    return out.withColumn("failed", F.col("errors") > 0)


def annotations(violations: DataFrame) -> DataFrame:
    """Lines that a build service shows beside the code."""
    level = F.when(F.col("severity") == "error", "error").otherwise("warning")
    return violations.select(F.concat(F.lit("::"), level, F.lit(" file="), "file", F.lit("::"), "message").alias("line"))


@dataclass
class Predicates:
    node_count_min: int | None = None
    node_count_max: int | None = None
    nodes_exist: list[str] = field(default_factory=list)
    nodes_missing: list[str] = field(default_factory=list)
    nodes_alive: list[str] = field(default_factory=list)
    rule_violations_max: int | None = None


def load_predicates(text: str) -> Predicates:
    import tomllib

    known = Predicates.__dataclass_fields__
    return Predicates(**{k: v for k, v in tomllib.loads(text).items() if k in known})


def bisect(predicates: Predicates, nodes: DataFrame, violations: int | None = None) -> DataFrame:
    """(predicate, passed, detail): an outcome for each stated predicate."""
    spark = nodes.sparkSession
    wanted = [("nodes_exist", i) for i in predicates.nodes_exist] + [("nodes_missing", i) for i in predicates.nodes_missing] + [("nodes_alive", i) for i in predicates.nodes_alive]
    asked = spark.createDataFrame(wanted, "what string, id string")
    state = nodes.select(F.col("id").alias("_id"), F.coalesce("is_dead_candidate", F.lit(False)).alias("dead"))
    found = state.join(F.broadcast(asked), F.col("_id") == F.col("id"), "right")  # a stated list
    there = F.col("dead").isNotNull()
    passed = F.when(F.col("what") == "nodes_exist", there).when(F.col("what") == "nodes_missing", ~there).otherwise(there & ~F.coalesce("dead", F.lit(True)))
    detail = F.when(F.col("what") == "nodes_exist", F.when(there, "found").otherwise("missing")).when(F.col("what") == "nodes_missing", F.when(there, "still present").otherwise("absent"))
    detail = detail.otherwise(F.when(~there, "missing").when(F.col("dead"), "flagged dead").otherwise("alive"))
    parts = [found.select(F.concat_ws(":", "what", "id").alias("predicate"), passed.alias("passed"), detail.alias("detail"))]
    total = nodes.agg(F.count("*").alias("n"))
    for name, bound, ok, sign in (("node_count_min", predicates.node_count_min, F.col("n") >= F.lit(predicates.node_count_min), "≥"), ("node_count_max", predicates.node_count_max, F.col("n") <= F.lit(predicates.node_count_max), "≤")):
        if bound is not None:
            parts.append(total.select(F.lit(name).alias("predicate"), ok.alias("passed"), F.format_string(f"required {sign} {bound}, got %d", "n").alias("detail")))
    if predicates.rule_violations_max is not None:
        most = predicates.rule_violations_max
        row = ("rule_violations_max", True, "skipped") if violations is None else ("rule_violations_max", violations <= most, f"required ≤ {most}, got {violations}")
        parts.append(spark.createDataFrame([row], "predicate string, passed boolean, detail string"))
    return reduce(DataFrame.unionByName, parts)


def exit_code(outcomes: DataFrame) -> int:
    """Of a bisect run: 0 good, 1 bad, 125 skip where nothing was asked."""
    row = outcomes.agg(F.count("*").alias("n"), F.count_if(~F.col("passed")).alias("bad")).first()
    return 125 if not row["n"] else int(row["bad"] > 0)
