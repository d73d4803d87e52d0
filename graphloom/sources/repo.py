"""Repositories as tables: files, commits, blame, trees and diffs, through the git command line.

Listing is done on the driver; contents and blame are read by the workers, so the
repository's path has to be one that they see too.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.paths import EXTENSIONS
from graphloom.operators.storage import ship
from graphloom.schemas import BLAME, COMMITS, FILES

#: Directories and file-name ends that a walk leaves out.
SKIPPED_DIRS = ("node_modules", "target", "dist", "__pycache__", ".git", ".next", "out", "coverage", "vendor", "venv", ".venv", ".tox", "build", "generated")
SKIPPED_SUFFIXES = ("-dist", "_dist", "-build", "_build", "-out", "_out")
SKIPPED_FILES = (".min.js", ".min.ts", ".bundle.js", ".chunk.js")
LARGEST = 2 * 1024 * 1024
#: Extensions that the timeline counts.
COUNTED = (".ts", ".tsx", ".js", ".jsx", ".py", ".rs", ".go", ".java", ".php", ".cs")


def git(repo: str, *args: str) -> str:
    """Output of a git command; an error where it fails."""
    run = subprocess.run(["git", "-c", "safe.directory=*", "-c", "core.quotepath=off", "-C", repo, *args], capture_output=True)
    if run.returncode:
        raise RuntimeError(f"git {args[0]}: {run.stderr.decode(errors='replace').strip()}")
    return run.stdout.decode(errors="replace")


def _pattern(rule: str) -> tuple[re.Pattern, bool, bool]:
    """Of an ignore rule: its regular expression over paths, whether it re-includes, whether it names directories only."""
    again, rule = rule.startswith("!"), rule.removeprefix("!")
    only_dirs, rule = rule.endswith("/"), rule.rstrip("/")
    anchored, rule = "/" in rule, rule.lstrip("/")
    out, k = "", 0
    while k < len(rule):
        if rule.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif rule.startswith("**", k):
            out, k = out + ".*", k + 2
        else:
            out, k = out + {"*": "[^/]*", "?": "[^/]"}.get(rule[k], re.escape(rule[k])), k + 1
    return re.compile(out if anchored else f"(?:.*/)?{out}"), again, only_dirs


def ignores(repo: str, extra: str = ".graphloomignore") -> list[tuple[re.Pattern, bool, bool]]:
    rules = []
    for name in (".gitignore", extra):
        path = os.path.join(repo, name)
        if os.path.exists(path):
            with open(path, errors="replace") as lines:
                rules += [_pattern(x.strip()) for x in lines if x.strip() and not x.startswith("#")]
    return rules


def ignored(rules: list[tuple[re.Pattern, bool, bool]], path: str, is_dir: bool) -> bool:
    out = False
    for pattern, again, only_dirs in rules:
        if (is_dir or not only_dirs) and pattern.fullmatch(path):
            out = not again
    return out


def listed(repo: str, largest: int = LARGEST) -> Iterator[tuple[str, str, int]]:
    """(path, language, size) of the source files below, ignored and hidden ones left out."""
    rules = ignores(repo)
    for folder, names, files in os.walk(repo):
        inside = os.path.relpath(folder, repo)
        inside = "" if inside == "." else inside + "/"
        names[:] = sorted(n for n in names if not n.startswith(".") and n not in SKIPPED_DIRS and not n.endswith(SKIPPED_SUFFIXES) and not ignored(rules, inside + n, True))
        for name in sorted(files):
            language = EXTENSIONS.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None
            if language is None or name.startswith(".") or name.endswith(SKIPPED_FILES) or ignored(rules, inside + name, False):
                continue
            size = os.path.getsize(os.path.join(folder, name))
            if size <= largest:
                yield inside + name, language, size


def repo_files(spark: SparkSession, repo: str, largest: int = LARGEST, per_task: int = 500) -> DataFrame:
    """The files table of a working tree; binary files (a zero byte in the first 8192) and such as aren't UTF-8 are left out."""
    ship(spark)
    repo = os.path.abspath(repo)
    found = list(listed(repo, largest))
    names = spark.createDataFrame(found, "path string, language string, size_bytes bigint").repartition(max(1, -(-len(found) // per_task)), "path")

    def read(batches: Iterator) -> Iterator:
        for pdf in batches:
            texts = []
            for path in pdf["path"]:
                try:
                    with open(os.path.join(repo, path), "rb") as f:
                        data = f.read()
                    texts.append(None if b"\0" in data[:8192] else data.decode())
                except (OSError, UnicodeDecodeError):
                    texts.append(None)
            yield pdf.assign(content=texts)[["path", "language", "content", "size_bytes"]]

    return names.mapInPandas(read, FILES).where("content IS NOT NULL")


def tree_files(spark: SparkSession, repo: str, ref: str = "HEAD", largest: int = LARGEST) -> DataFrame:
    """The files table of a commit."""
    ship(spark)
    found = []
    for line in git(repo, "ls-tree", "-r", "-l", "-z", ref).split("\0"):
        if "\t" in line:
            (_, kind, sha, size), path = line.split("\t")[0].split(), line.split("\t")[1]
            language = EXTENSIONS.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None
            if kind == "blob" and language and int(size) < largest:
                found.append((path, language, sha, int(size)))

    def read(batches: Iterator) -> Iterator:
        for pdf in batches:
            yield pdf.assign(content=[git(repo, "cat-file", "blob", sha) for sha in pdf["sha"]])[["path", "language", "content", "size_bytes"]]

    return spark.createDataFrame(found, "path string, language string, sha string, size_bytes bigint").mapInPandas(read, FILES)


def commits(spark: SparkSession, repo: str, since: str | None = None, parents: str = "first") -> DataFrame:
    """The commits table: a row for each commit and changed path, against the first parent or all."""
    how = ["--diff-merges=first-parent" if parents == "first" else "-m"]
    out, rows = git(repo, "log", "HEAD", "--date-order", *how, *([f"--since={since}"] if since else []), "--name-only", "-z", "--pretty=format:%x01%H%x02%ct%x02%an%x02%ae%x02"), set()
    import datetime

    for block in out.split("\x01")[1:]:
        sha, when, name, mail, names = block.split("\x02")
        ts = datetime.datetime.fromtimestamp(int(when), datetime.timezone.utc)
        rows |= {(sha, ts, name, mail, p.strip("\n")) for p in names.split("\0") if p.strip("\n")}
    return spark.createDataFrame(sorted(rows), COMMITS)


def blame(spark: SparkSession, repo: str, paths: DataFrame) -> DataFrame:
    """The blame table of the given paths (`path`)."""
    ship(spark)

    def read(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows: dict[tuple[str, str, str], int] = {}
            for path in pdf["path"]:
                try:
                    text = git(repo, "blame", "--line-porcelain", "HEAD", "--", path)
                except RuntimeError:
                    continue
                names = re.findall(r"^author (.*)$", text, re.M)
                mails = re.findall(r"^author-mail <(.*)>$", text, re.M)
                for name, mail in zip(names, mails, strict=True):
                    rows[path, name, mail] = rows.get((path, name, mail), 0) + 1
            yield pd.DataFrame([(*k, n) for k, n in rows.items()], columns=["path", "author_name", "author_email", "lines"])

    return paths.select("path").distinct().mapInPandas(read, BLAME)


def changed_paths(spark: SparkSession, repo: str, span: str) -> DataFrame:
    """(path) that differ in a..b, or from a to HEAD."""
    a, _, b = span.partition("..")
    return spark.createDataFrame([(p,) for p in git(repo, "diff", "--name-only", "-z", a, b or "HEAD").split("\0") if p], "path string")


def timeline(spark: SparkSession, repo: str, most: int = 100, since: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """Snapshot rows of commits that are not known yet: date, summary, source files in the tree, lines added and removed."""
    ship(spark)
    import datetime

    out = git(repo, "log", "HEAD", f"--max-count={most}", *([f"--since={since}"] if since else []), "--diff-merges=first-parent", "--numstat", "--pretty=format:%x01%H%x02%ct%x02%s%x02")
    rows = []
    for block in out.split("\x01")[1:]:
        sha, when, message, stats = block.split("\x02")
        changes = [line.split("\t") for line in stats.splitlines() if line.count("\t") == 2]
        date = datetime.datetime.fromtimestamp(int(when), datetime.timezone.utc).strftime("%Y-%m-%d")
        rows.append((f"snap:{sha[:8]}", sha, date, message, sum(int(a) for a, _, _ in changes if a.isdigit()), sum(int(b) for _, b, _ in changes if b.isdigit())))
    heads = spark.createDataFrame(rows, "id string, commit_sha string, commit_date string, commit_msg string, insertions bigint, deletions bigint")
    if known is not None:
        heads = heads.join(known.select("commit_sha"), "commit_sha", "left_anti").select(*heads.columns)

    def count(batches: Iterator) -> Iterator:
        for pdf in batches:
            yield pdf.assign(node_count=0, edge_count=0, file_count=[sum(p.endswith(COUNTED) for p in git(repo, "ls-tree", "-r", "--name-only", "-z", sha).split("\0")) for sha in pdf["commit_sha"]])[["id", "commit_sha", "commit_date", "commit_msg", "node_count", "edge_count", "file_count", "insertions", "deletions"]]

    return heads.mapInPandas(count, "id string, commit_sha string, commit_date string, commit_msg string, node_count bigint, edge_count bigint, file_count bigint, insertions bigint, deletions bigint")


def snapshot_json(snapshots: DataFrame) -> DataFrame:
    """With the counts of the snapshot as one JSON column."""
    return snapshots.withColumn("snapshot_data", F.to_json(F.struct("file_count", "insertions", "deletions")))


def snapshot_counts(rows: DataFrame) -> DataFrame:
    """rows with the counts out of their JSON column; what it lacks is null."""
    read = F.from_json("snapshot_data", "file_count bigint, insertions bigint, deletions bigint")
    return rows.withColumn("_read", read).select(*(c for c in rows.columns if c != "snapshot_data"), "_read.*")
