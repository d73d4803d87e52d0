"""Dependency manifests: package.json, Cargo.toml, requirements.txt, pyproject.toml, go.mod; and which files use a dependency."""

from __future__ import annotations

import json
import os
import re
import tomllib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.schemas import DEPS

#: Manifest names, and directories whose members may have manifests of their own.
NAMES = ("package.json", "Cargo.toml", "requirements.txt", "pyproject.toml", "go.mod")
WORKSPACES = ("crates", "packages", "apps", "services")


def version(text: str) -> str:
    """Without the signs before it."""
    return re.sub(r"^\^*~*>*=*", "", text.strip())


def _table(deps: dict, kind: str) -> Iterator[tuple[str, str, str]]:
    for name, spec in deps.items():
        found = spec if isinstance(spec, str) else spec.get("version", "") if isinstance(spec, dict) else ""
        yield name, version(found), kind


def package_json(text: str) -> list[tuple[str, str, str]]:
    data = json.loads(text)
    kinds = (("dependencies", "normal"), ("devDependencies", "dev"), ("peerDependencies", "peer"))
    return [row for key, kind in kinds for row in _table(data.get(key) or {}, kind)]


def cargo_toml(text: str) -> list[tuple[str, str, str]]:
    data = tomllib.loads(text)
    kinds = (("dependencies", "normal"), ("dev-dependencies", "dev"), ("build-dependencies", "build"))
    return [row for key, kind in kinds for row in _table(data.get(key) or {}, kind)]


def requirement(line: str) -> tuple[str, str] | None:
    m = re.match(r"\s*([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*(?:(?:==|>=|~=|<=|>|<|!=)\s*([^\s,;#]+))?", line)
    return (m[1], m[2] or "") if m and not line.lstrip().startswith(("#", "-")) else None


def requirements_txt(text: str) -> list[tuple[str, str, str]]:
    return [(*r, "normal") for line in text.splitlines() if line.strip() and (r := requirement(line))]


def pyproject_toml(text: str) -> list[tuple[str, str, str]]:
    project = tomllib.loads(text).get("project", {})
    rows = [(*r, "normal") for line in project.get("dependencies", []) if (r := requirement(line))]
    return rows + [(*r, "dev") for lines in project.get("optional-dependencies", {}).values() for line in lines if (r := requirement(line))]


def go_mod(text: str) -> list[tuple[str, str, str]]:
    blocks = re.findall(r"^require\s*\(([^)]*)\)", text, re.M) + re.findall(r"^require\s+([^\s(].*)$", text, re.M)
    rows = [line.split("//")[0].split() for block in blocks for line in block.splitlines()]
    return [(r[0], r[1].removeprefix("v"), "normal") for r in rows if len(r) >= 2]


#: By name: reader and ecosystem.
READERS = {"package.json": (package_json, "npm"), "Cargo.toml": (cargo_toml, "crates.io"), "requirements.txt": (requirements_txt, "PyPI"), "pyproject.toml": (pyproject_toml, "PyPI"), "go.mod": (go_mod, "Go")}


def manifests(repo: str, workspaces: bool = False) -> list[str]:
    """Paths of manifests at the root and, on request, one level below the workspace directories."""
    folders = [""]
    if workspaces:
        folders += [f"{w}/{d}/" for w in WORKSPACES if os.path.isdir(os.path.join(repo, w)) for d in sorted(os.listdir(os.path.join(repo, w)))]
    return [f + n for f in folders for n in NAMES if os.path.isfile(os.path.join(repo, f + n))]


def dependencies(spark: SparkSession, repo: str, workspaces: bool = False) -> DataFrame:
    """The deps table; a manifest that can't be read has no rows."""
    rows = []
    for path in manifests(repo, workspaces):
        reader, ecosystem = READERS[os.path.basename(path)]
        try:
            with open(os.path.join(repo, path)) as f:
                rows += [(name, v, ecosystem, path, kind) for name, v, kind in reader(f.read())]
        except (OSError, ValueError):
            continue
    return spark.createDataFrame(rows, DEPS)


def merged(deps: DataFrame) -> DataFrame:
    """One row a name: the longest manifest path, as that of a member says more; the first version that is told; the rest from the first manifest."""
    by = deps.groupBy("name").agg(
        F.min_by("version", F.struct(F.col("version") == "", "manifest")).alias("version"),
        F.min_by("ecosystem", "manifest").alias("ecosystem"),
        F.min_by("manifest", F.struct(-F.length("manifest"), "manifest")).alias("manifest"),
        F.min_by("dep_kind", F.struct("manifest", "dep_kind")).alias("dep_kind"),
    )
    return by.select("name", "version", "ecosystem", "manifest", "dep_kind")


#: What a manifest says of a project's stack.
STACKS = {"Cargo.toml": "Rust workspace", "package.json": "Node project", "pyproject.toml": "Python package", "requirements.txt": "Python package", "go.mod": "Go module"}


def header(name: str, text: str) -> tuple[str | None, str | None, str | None]:
    """Name, version and description of the project that a manifest declares."""
    if name == "package.json":
        data = json.loads(text)
    elif name == "Cargo.toml":
        data = tomllib.loads(text).get("package", {})
    elif name == "pyproject.toml":
        data = tomllib.loads(text).get("project", {})
    elif name == "go.mod":
        module = re.search(r"^module\s+(\S+)", text, re.M)
        data = {"name": module[1]} if module else {}
    else:
        data = {}
    return tuple(data.get(k) if isinstance(data.get(k), str) else None for k in ("name", "version", "description"))


def headers(spark: SparkSession, repo: str, workspaces: bool = True) -> DataFrame:
    """(manifest, name, version, description, stack) of each manifest that can be read."""
    rows = []
    for path in manifests(repo, workspaces):
        try:
            with open(os.path.join(repo, path)) as f:
                rows.append((path, *header(os.path.basename(path), f.read()), STACKS[os.path.basename(path)]))
        except (OSError, ValueError):
            continue
    return spark.createDataFrame(rows, "manifest string, name string, version string, description string, stack string")


def project(found: DataFrame) -> DataFrame:
    """One row: of each field of headers() the first that is told, by manifest path, and all stacks."""
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("manifest"))).alias(c) for c in ("name", "version", "description")]
    return found.agg(*first, F.sort_array(F.collect_set("stack")).alias("stacks"))


def import_heads(files: DataFrame) -> DataFrame:
    """(path, ecosystem, name): what each file imports from outside, once a file and name.

    The heads are taken out of the text once, so that usage is an equi-join however many dependencies there are.
    """
    text = F.col("content")
    quoted = F.regexp_extract_all(text, F.lit(r"""(?:\bfrom|\brequire\s*\(|\bimport\s*\(?)\s*['"]([^'".][^'"]*)['"]"""), F.lit(1))
    js = F.transform(quoted, lambda s: F.regexp_extract(s, r"^(@[^/]+/[^/]+|[^/]+)", 1))
    py = F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:from|import)\s+([A-Za-z_]\w*)"), F.lit(1))
    plain = F.regexp_replace(text, r"(?s)//[^\n]*|/\*.*?\*/", " ")
    rs = F.regexp_extract_all(plain, F.lit(r"\b([A-Za-z_]\w*)\s*::"), F.lit(1))
    go = F.regexp_extract_all(text, F.lit(r'"([^"\s]+)"'), F.lit(1))
    heads = F.when(F.col("language").isin("typescript", "javascript"), js).when(F.col("language") == "python", py).when(F.col("language") == "rust", rs).when(F.col("language") == "go", go)
    ecosystem = F.when(F.col("language").isin("typescript", "javascript"), "npm").when(F.col("language") == "python", "PyPI").when(F.col("language") == "rust", "crates.io").when(F.col("language") == "go", "Go")
    return files.select("path", ecosystem.alias("ecosystem"), F.explode(heads).alias("name")).distinct()


def usage(deps: DataFrame, files: DataFrame) -> DataFrame:
    """deps with use_count: files that import each."""
    spelled = F.when(F.col("ecosystem").isin("PyPI", "crates.io"), F.lower(F.replace("name", F.lit("-"), F.lit("_")))).otherwise(F.col("name"))
    uses = import_heads(files).select("ecosystem", spelled.alias("_head"), "path").distinct().groupBy("ecosystem", "_head").agg(F.count("*").alias("use_count"))
    named = deps.withColumn("_head", spelled)
    return named.join(uses, ["ecosystem", "_head"], "left").select(*deps.columns, F.coalesce("use_count", F.lit(0)).alias("use_count"))
