"""Dead code: five categories, each with a confidence and the risk of a false alarm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values, in the order in which a later category overwrites an earlier reason.
REASONS = ("unreferenced_export", "unreachable", "unused_variable", "disconnected", "zombie_file")
#: Names that a framework calls, names of entry points, files that others import by convention.
HOOKS = ("getServerSideProps", "getStaticProps", "loader", "action", "beforeEach", "afterAll", "getStaticPaths")
ENTRIES = ("main", "init", "setup", "bootstrap", "start")
INDEX_FILES = ("index.ts", "index.js", "lib.rs", "mod.rs")
ROOT_FILES = ("index.ts", "index.js", "main.ts", "main.rs", "lib.rs", "mod.rs", "app.ts", "__init__.py")
#: What is said of the risk of a false finding.
RISK_HOOK = "Framework hook — called by framework not by your code"
RISK_ENTRY = "Common entry point name — verify before deleting"
RISK_TYPE = "Types erased at runtime — may be used by consuming TypeScript packages"
RISK_LIBRARY = "May be consumed externally by npm consumers"


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def judged() -> Column:
    """confidence and false_positive_risk of a row with name, kind, path and reason, as one struct."""
    as_pair = lambda confidence, risk=None: F.struct(F.lit(confidence).alias("confidence"), F.lit(risk).cast("string").alias("risk"))
    path = F.col("path")
    library = F.contains(path, F.lit("/lib/")) | F.contains(path, F.lit("/dist/")) | F.startswith(path, F.lit("lib/")) | F.startswith(path, F.lit("dist/"))
    index = (F.col("reason") == "unreferenced_export") & basename(path).isin(*INDEX_FILES)
    out = F.when(F.col("name").isin(*HOOKS), as_pair("low", RISK_HOOK)).when(F.col("name").isin(*ENTRIES), as_pair("low", RISK_ENTRY))
    out = out.when(F.col("kind").isin("Type", "Interface"), as_pair("low", RISK_TYPE)).when(library | index, as_pair("low", RISK_LIBRARY))
    return out.when(F.col("reason").isin("unused_variable", "zombie_file"), as_pair("medium")).otherwise(as_pair("high"))


def detect(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kind, name, path, community, reason, confidence, false_positive_risk): one row a node and category.

    What the categories ask of the edges is summed once per node, so one join serves all five.
    """
    called = F.struct(F.col("dst").alias("id"), F.when(F.col("kind") == "CALLS", 1).when(F.col("kind") == "IMPORTS", 2).otherwise(0).alias("what"))
    calls = F.struct(F.col("src").alias("id"), F.when(F.col("kind") == "CALLS", 3).otherwise(4).alias("what"))
    facts = edges.select(F.explode(F.array(called, calls)).alias("e")).groupBy(F.col("e.id").alias("_id"))
    facts = facts.agg(F.bool_or(F.col("e.what") == 1).alias("called"), F.bool_or(F.col("e.what") == 2).alias("imported"), F.bool_or(F.col("e.what") == 3).alias("calls"), F.bool_or(F.col("e.what") >= 3).alias("leads"))
    n = nodes.join(facts, nodes["id"] == F.col("_id"), "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    path, kind, uncalled = F.col("path"), F.col("kind"), ~flag("called")
    calm = ~F.contains(path, F.lit("test"))
    export = kind.isin("Function", "Class", "Variable", "Type") & F.col("exported") & uncalled & calm & ~F.contains(path, F.lit("spec")) & ~F.endswith(path, F.lit(".d.ts"))
    unreachable = (kind == "Function") & (F.col("name") != "constructor") & ~F.col("exported") & uncalled & calm
    variable = (kind == "Variable") & uncalled & calm
    alone = uncalled & ~flag("calls") & ~kind.isin("File", "Module", "Author") & calm & ~(export | unreachable | variable)
    zombie = (kind == "File") & ~flag("imported") & flag("leads") & ~basename(F.col("name")).isin(*ROOT_FILES) & calm
    reasons = F.filter(F.array(*(F.when(c, F.lit(r)) for c, r in zip((export, unreachable, variable, alone, zombie), REASONS, strict=True))), lambda r: r.isNotNull())
    rows = n.select("id", "kind", "name", "path", "community", F.explode(reasons).alias("reason")).withColumn("j", judged())
    return rows.select("id", "kind", "name", "path", "community", "reason", F.col("j.confidence").alias("confidence"), F.col("j.risk").alias("false_positive_risk"))


def filtered(found: DataFrame, reason: str | None = None, confidence: str | None = None, kind: str | None = None, community: int | None = None, prefix: str | None = None, safe: bool = False) -> DataFrame:
    """Rows that pass all filters; safe: high confidence without a risk."""
    for column, value in (("reason", reason), ("confidence", confidence), ("kind", kind), ("community", community)):
        if value is not None:
            found = found.where(F.col(column) == value)
    if prefix:
        found = found.where(F.startswith("path", F.lit(prefix)))
    return found.where("confidence = 'high' AND false_positive_risk IS NULL") if safe else found


def marked(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """nodes with is_dead_candidate and dead_reason; of several categories the last in REASONS."""
    order = F.array_position(F.array(*map(F.lit, REASONS)), F.col("reason"))
    last = found.groupBy("id").agg(F.max_by("reason", order).alias("_reason")).withColumnRenamed("id", "_id")
    joined = nodes.join(last, nodes["id"] == F.col("_id"), "left")
    return joined.withColumns({"is_dead_candidate": F.col("_reason").isNotNull(), "dead_reason": F.col("_reason")}).select(*nodes.columns)


def summary(found: DataFrame) -> DataFrame:
    """(reason, total, high, medium, low), and a row 'total' over all."""
    by = found.rollup("reason").agg(F.count("*").alias("total"), *(F.count_if(F.col("confidence") == c).alias(c) for c in ("high", "medium", "low")))
    return by.select(F.coalesce("reason", F.lit("total")).alias("reason"), "total", "high", "medium", "low")


def stats(marked_nodes: DataFrame) -> DataFrame:
    """One row: all candidates, and those that nothing reaches or that touch nothing."""
    dead = marked_nodes.where("is_dead_candidate")
    return dead.agg(F.count("*").alias("total"), F.count_if(F.col("dead_reason").isin("unreachable", "disconnected")).alias("severe"))
