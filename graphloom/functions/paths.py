"""Column functions on file paths: import resolution, groups, roles, labels, safe names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: File extensions by language.
EXTENSIONS = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "rs": "rust", "go": "go", "java": "java", "cs": "csharp", "php": "php",
}


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def language(path: Column) -> Column:
    """By extension; null for others."""
    table = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def joined(current: Column, imported: Column) -> Column:
    """The path an import means, seen from a file: . stays, .. goes up, anything else goes down."""
    parts = F.split(current, "/")
    start = F.slice(parts, 1, F.size(parts) - 1)
    step = lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    return F.array_join(F.aggregate(F.split(imported, "/"), start, step), "/")


def safe_filename(raw: Column) -> Column:
    """Letters, digits, _ . / stay; all else becomes single dashes, none at the ends."""
    slashed = F.regexp_replace(raw, r"\\", "/")
    dashed = F.regexp_replace(slashed, r"[^A-Za-z0-9_./]+", "-")
    return F.regexp_replace(F.regexp_replace(dashed, r"^-+|-+$", ""), r"^/+", "")


def link(target: Column, alias: Column, style: str = "wiki") -> Column:
    """A link to a note, given without its ending: [[target|alias]], or Markdown's form."""
    if style == "wiki":
        return F.concat(F.lit("[["), target, F.lit("|"), alias, F.lit("]]"))
    return F.concat(F.lit("["), alias, F.lit("]("), target, F.lit(".md)"))


def community_slug(label: Column, number: Column) -> Column:
    """A label as one segment of a path."""
    slug = F.regexp_replace(F.replace(F.lower(safe_filename(label)), F.lit("/"), F.lit("-")), "^-+|-+$", "")
    return F.when(slug == "", F.concat(F.lit("community-"), number.cast("string"))).otherwise(slug)


def file_group(path: Column) -> Column:
    """The first two directories that tell something, else root."""
    parent = F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")
    trimmed = parent
    for prefix in (r"\./", "crates/", "packages/", "apps/", "services/"):
        trimmed = F.regexp_replace(trimmed, f"^(?:{prefix})+", "")
    parts = F.filter(F.split(trimmed, "/"), lambda s: (s != "") & (s != "src"))
    return F.when(F.size(parts) == 0, "root").otherwise(safe_filename(F.array_join(F.slice(parts, 1, 2), "/")))


def file_role(path: Column, exported: Column, callers: Column) -> Column:
    """The first rule that fits decides."""
    p = F.lower(path)
    base = basename(p)

    def has(*parts: str) -> Column:
        out = F.lit(False)
        for part in parts:
            out = out | F.contains(p, F.lit(part))
        return out

    def ends(*tails: str) -> Column:
        out = F.lit(False)
        for tail in tails:
            out = out | F.endswith(p, F.lit(tail))
        return out

    # Parts, ends and names of paths, by role, in order of precedence.
    fixture = has("/fixtures/", "/fixture/")
    test = has("/tests/", ".test.", "/__tests__/") | ends("_test.go", "_test.rs", "_test.py")
    out = F.when(test & fixture, "fixture").when(test, "test").when(fixture, "fixture")
    out = out.when(base.isin("lib.rs", "mod.rs"), "library")
    out = out.when(base.isin("main.rs", "main.go", "main.py", "main.ts", "main.js", "index.ts", "index.js", "index.tsx"), "entry")
    out = out.when(has("/parsers/", "/parser/") | ends("/parser.rs"), "parser")
    out = out.when(has("/mcp/", "mcp-server") | (has("/tools.rs") & has("mcp")), "mcp")
    out = out.when(has("/cli/", "/cmd/", "/commands/"), "cli")
    out = out.when(has("/components/", "/views/", "/pages/") | ends(".tsx", ".jsx"), "view")
    out = out.when(has("/api/", "/server/", "/handlers/", "/routes/") | ends("/serve.rs", "/server.rs"), "api_server")
    out = out.when(has("/config") | ends("config.rs", "config.ts", "settings.py", "conf.py"), "config")
    out = out.when(has("/models/", "/model/", "/types/"), "model")
    out = out.when(has("/db/", "/dao/") | ends("graph.rs", ".sql", "queries.rs", "repository.rs"), "query_layer")
    out = out.when(has("/skill") | ends("skill.rs"), "skill")
    out = out.when(has("build.rs", "/scripts/", "/build/", ".github/"), "build")
    return out.when((exported >= 8) & (callers <= 3), "library").otherwise("other")


def community_labels(nodes: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """(community, label) from the paths of each community.

    One path: its last directory and its name without extension. Several: their common directories, of
    which the smallest and the largest path decide, so no paths are gathered. None in common: a
    given label that is no node's, else community-N.
    """
    paths = nodes.where("path <> ''").groupBy("community").agg(F.min("path").alias("p0"), F.max("path").alias("p1"), F.min(F.regexp_replace("path", "[^/]*$", "")).alias("d0"), F.max(F.regexp_replace("path", "[^/]*$", "")).alias("d1"))
    stem = F.regexp_replace(basename(F.col("p0")), r"\.[^.]*$", "")
    tail = F.regexp_extract("d0", "([^/]*)/$", 1)
    single = F.when(tail.isin("", "src", "."), stem).otherwise(F.concat_ws("/", tail, stem))
    a, b = F.split("d0", "/"), F.split("d1", "/")
    same = F.aggregate(F.arrays_zip(a.alias("x"), b.alias("y")), F.struct(F.lit(True).alias("on"), F.array().cast("array<string>").alias("out")), lambda acc, z: F.when(acc["on"] & (z["x"] == z["y"]), F.struct(F.lit(True).alias("on"), F.concat(acc["out"], F.array(z["x"])).alias("out"))).otherwise(F.struct(F.lit(False).alias("on"), acc["out"].alias("out"))))
    prefix = F.regexp_replace(F.array_join(same["out"], "/"), "/+$", "")
    condensed = prefix
    for root in ("crates/", "packages/", "src/", r"\./"):
        condensed = F.regexp_replace(condensed, f"^(?:{root})+", "")
    shared = F.when(condensed != "", condensed).otherwise(F.regexp_replace(prefix, "^/+", ""))
    labelled = paths.select("community", F.when(F.col("p0") == F.col("p1"), single).when(prefix != "", shared).alias("own"))
    if fallback is not None:
        names = fallback.select(F.col("id").alias("community"), F.trim("label").alias("given"))
        labelled = labelled.join(names, "community", "left")
    else:
        labelled = labelled.withColumn("given", F.lit(None).cast("string"))
    usable = (F.col("given") != "") & ~F.startswith("given", F.lit("File:")) & ~F.startswith("given", F.lit("Function:"))
    return labelled.select("community", F.coalesce("own", F.when(usable, F.col("given")), F.concat(F.lit("community-"), F.col("community").cast("string"))).alias("label"))
