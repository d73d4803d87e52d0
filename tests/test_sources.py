"""Parsers, repositories, manifests and incremental runs."""

import datetime
import os
import subprocess
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.operators import enrich
from graphloom.sources import manifests, parse, repo
from graphloom.streaming import watch

TS = """import { query } from './db';
import x from 'outside';
const y = require("../lib/y");

/** Signs people in. */
export class Service {
  async login(user: string): Promise<boolean> {
    if (user && user.length > 1) { return query(user); }
    for (const a of [1]) { if (a) { other(a); } }
    return new Session(user) ? true : false;
  }
  private helper() { return this.login('a(b)'); }
}

// TODO: later
export const run = async (a) => { go(a); };
function idle() {} // BUG here
export { idle };
service.start();
"""


def test_typescript():
    out, error = parse.parse("src/a/auth.ts", "typescript", TS)
    assert error is None
    nodes = {n[2]: n for n in out.nodes}
    assert {k: (v[1], v[5]) for k, v in nodes.items()} == {"Service": ("Class", True), "login": ("Function", False), "helper": ("Function", False), "run": ("Function", True), "idle": ("Function", True)}
    assert nodes["Service"][7] == "Signs people in." and (nodes["login"][3], nodes["login"][4]) == (7, 11)
    kinds = lambda k: {(s.rsplit(":", 1)[1], d) for s, d, kind, _ in out.edges if kind == k}
    assert kinds("IMPORTS") == {("src/a/auth.ts", "file:src/a/db"), ("src/a/auth.ts", "file:src/lib/y")}
    assert kinds("CALLS") == {("login", "query"), ("login", "other"), ("login", "Session"), ("helper", "login"), ("run", "go"), ("src/a/auth.ts", "start"), ("src/a/auth.ts", "service")}
    assert sorted(d.rsplit(":", 1)[1] for _, d in kinds("EXPORTS")) == ["Service", "helper", "idle", "login", "run"]
    assert [(t[0], t[2]) for t in out.tags] == [("TODO", 15), ("BUG", 17)]
    assert nodes["login"][6] == pytest.approx((1 + 0.5 + 1 + 1.5 + 1) / 100)


def test_jsx_tag_and_component():
    out, _ = parse.parse("a.tsx", "typescript", "export function B() { return <div>{/* TODO: x */}<Item a={1}/></div>; }\n")
    assert [(t[0], t[3]) for t in out.tags] == [("TODO", "jsx")] and ("fn:a.tsx:B", "Item", "CALLS", 0.6) in out.edges


def test_python():
    source = 'from a.b import c\nimport d.e\nfrom . import f\nfrom ..g import h\nclass A:\n    """Doc."""\n    def __init__(self): pass\ndef _x(): pass\nasync def y(): pass\n'
    out, error = parse.parse("p/q/m.py", "python", source)
    assert error is None and {(n[2], n[1], n[5]) for n in out.nodes} == {("A", "Class", True), ("__init__", "Function", False), ("_x", "Function", False), ("y", "Function", True)}
    assert {e[1] for e in out.edges if e[2] == "IMPORTS"} == {"file:a/b.py", "file:d/e.py", "file:p/q/__init__.py", "file:p/g.py"}
    assert next(n for n in out.nodes if n[2] == "A")[7] == "Doc."
    assert "SyntaxError" in parse.parse("x.py", "python", "def (")[1]


def test_other_languages():
    rust, _ = parse.parse("src/a.rs", "rust", '/// Doc.\n#[derive(Debug)]\npub struct S<\'a> { x: &\'a str }\nimpl S { pub fn new() -> Self { S { x: "}" } }\n fn hidden(&self) {} }\nuse crate::db::pool::Pool;\nuse crate::m;\nuse util;\n')
    assert {(n[2], n[1], n[5]) for n in rust.nodes} == {("S", "Class", True), ("new", "Function", True), ("hidden", "Function", False)}
    assert {e[1] for e in rust.edges if e[2] == "IMPORTS"} == {"file:src/db/pool.rs", "file:util.rs"} and not [e for e in rust.edges if e[2] == "CALLS"]
    go, _ = parse.parse("a/m.go", "go", 'package m\nimport (\n "fmt"\n "./util"\n)\n// A holds x.\ntype A struct { x int }\nfunc (a *A) Run(x int) error { return helper(x) }\nfunc helper(x int) error { fmt.Println(x); return nil }\n')
    assert {(n[2], n[5]) for n in go.nodes} == {("A", True), ("Run", True), ("helper", False)}
    assert {(e[0], e[1]) for e in go.edges if e[2] == "CALLS"} == {("fn:a/m.go:Run", "helper"), ("fn:a/m.go:helper", "Println")}
    java, _ = parse.parse("Foo.java", "java", "import java.util.List;\n/** Doc */\npublic class Foo {\n  public Foo(int y) { compute(y); }\n  List<String> names(int a) throws Exception { if (a > 1) { return other(a); } return null; }\n}\ninterface I { void go(int x); }\n")
    assert {n[2] for n in java.nodes} >= {"Foo", "names", "I"} and not any(n[5] for n in java.nodes)
    assert {(e[0], e[1]) for e in java.edges if e[2] == "CALLS"} == {("fn:Foo.java:Foo", "compute"), ("fn:Foo.java:names", "other")}
    php, _ = parse.parse("x.php", "php", "<?php\nrequire_once './lib.php';\nclass A { public function run($x) { return go($x); } }\nfunction go($y) { return strlen($y); }\n")
    assert {e[1] for e in php.edges if e[2] == "IMPORTS"} == {"file:lib.php"} and ("fn:x.php:run", "go", "CALLS", 0.7) in php.edges
    assert parse.parse("x.txt", "text", "a") == (parse.Parsed("x.txt"), None)


@pytest.fixture(scope="module")
def history(tmp_path_factory):
    """Three files, two people, four commits."""
    root = tmp_path_factory.mktemp("repo")
    run = lambda *a, **k: subprocess.run(["git", "-C", str(root), *a], check=True, capture_output=True, **k)
    run("init", "-q")
    now = datetime.datetime.now(datetime.timezone.utc)
    steps = [("Alice", "alice@dev.io", ("auth.ts", "db.ts"), 40), ("Alice", "alice@dev.io", ("auth.ts", "db.ts"), 30), ("Bob", "bob@dev.io", ("router.ts",), 20), ("Alice", "alice@dev.io", ("auth.ts", "db.ts"), 10)]
    for k, (name, mail, files, days) in enumerate(steps):
        for f in files:
            os.makedirs(root / "src", exist_ok=True)
            with open(root / "src" / f, "a") as out:
                out.write(f"export function {f[:-3]}{k}() {{ return {k}; }}\n")
        when = (now - datetime.timedelta(days=days)).isoformat()
        env = os.environ | {"GIT_AUTHOR_NAME": name, "GIT_AUTHOR_EMAIL": mail, "GIT_COMMITTER_NAME": name, "GIT_COMMITTER_EMAIL": mail, "GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when}
        run("add", "-A")
        run("commit", "-q", "-m", f"step {k}", env=env)
    (root / "node_modules").mkdir()
    (root / "node_modules" / "x.js").write_text("function x() {}")
    (root / "app.min.js").write_text("x")
    (root / "bin.js").write_bytes(b"a\0b")
    (root / "skip.ts").write_text("export const a = 1;")
    (root / ".gitignore").write_text("skip.ts\n*.log\n")
    return str(root)


def test_registered_parsers_reach_the_workers(spark):
    def lines(path, content):
        out = parse.Parsed(path)
        for k, name in enumerate(content.split()):
            out.symbol("Function", name, k + 1, k + 1, True)
        return out

    parse.register("plain", lines)
    try:
        found = parse.nodes_of(parse.extract(spark.createDataFrame([("a.txt", "plain", "x y"), ("b.txt", "none", "z")], "path string, language string, content string"))).collect()
        assert sorted(r["id"] for r in found) == ["fn:a.txt:x", "fn:a.txt:y"]
    finally:
        del parse.PARSERS["plain"]


def test_repository(spark, history):
    files = {r["path"]: r for r in repo.repo_files(spark, history).collect()}
    assert sorted(files) == ["src/auth.ts", "src/db.ts", "src/router.ts"] and files["src/db.ts"]["language"] == "typescript"
    assert sorted(r["path"] for r in repo.tree_files(spark, history, "HEAD~3").collect()) == ["src/auth.ts", "src/db.ts"]
    commits = repo.commits(spark, history)
    assert commits.count() == 7
    assert {r["path"]: round(r["churn"], 3) for r in enrich.churn(commits).collect()} == {"src/auth.ts": 1.0, "src/db.ts": 1.0, "src/router.ts": 0.333}
    assert [(r["a"], r["b"], r["weight"]) for r in enrich.cochange(commits).collect()] == [("src/auth.ts", "src/db.ts", 1.0)]
    owners = {(r["path"], r["author_name"]): r["share"] for r in enrich.owners(repo.blame(spark, history, commits)).collect()}
    assert owners == {("src/auth.ts", "Alice"): 1.0, ("src/db.ts", "Alice"): 1.0, ("src/router.ts", "Bob"): 1.0}
    assert sorted(r["path"] for r in repo.changed_paths(spark, history, "HEAD~1..HEAD").collect()) == ["src/auth.ts", "src/db.ts"]
    shots = repo.timeline(spark, history)
    assert [(r["commit_msg"], r["file_count"], r["insertions"]) for r in shots.orderBy("commit_msg").collect()] == [("step 0", 2, 2), ("step 1", 2, 2), ("step 2", 3, 1), ("step 3", 3, 2)]
    assert repo.timeline(spark, history, known=shots.where("commit_msg <> 'step 3'")).count() == 1
    assert "file_count" in repo.snapshot_json(shots).first()["snapshot_data"]
    with pytest.raises(RuntimeError):
        repo.commits(spark, os.path.dirname(history))


def test_ignore_rules():
    rules = [repo._pattern(x) for x in ("*.log", "/top.ts", "docs/", "!keep.log", "a/**/z.ts")]
    said = lambda p, d=False: repo.ignored(rules, p, d)
    assert [said("x/y.log"), said("keep.log"), said("top.ts"), said("x/top.ts"), said("docs", True), said("docs"), said("a/b/c/z.ts"), said("a/z.ts")] == [True, False, True, False, True, False, True, True]


def test_manifests(spark, tmp_path):
    (tmp_path / "package.json").write_text('{"dependencies": {"left-pad": "^1.2.3"}, "devDependencies": {"@types/node": "~20.1"}}')
    (tmp_path / "Cargo.toml").write_text('[dependencies]\nserde = "1.0"\ntokio = { version = "=1.2", features = ["x"] }\n')
    (tmp_path / "requirements.txt").write_text("# c\nrequests==2.31.0\nflask>=2 ; python_version > '3'\n-r other.txt\nplain\n")
    (tmp_path / "pyproject.toml").write_text('[project]\ndependencies = ["numpy>=1.26", "rich"]\n')
    (tmp_path / "go.mod").write_text("module m\nrequire (\n\tgithub.com/a/b v1.2.3 // indirect\n)\nrequire github.com/c/d v0.1.0\n")
    (tmp_path / "packages" / "one").mkdir(parents=True)
    (tmp_path / "packages" / "one" / "package.json").write_text("{broken")
    deps = manifests.dependencies(spark, str(tmp_path), workspaces=True)
    assert {(r["name"], r["version"], r["ecosystem"]) for r in deps.collect()} == {
        ("left-pad", "1.2.3", "npm"), ("@types/node", "20.1", "npm"), ("serde", "1.0", "crates.io"), ("tokio", "1.2", "crates.io"), ("requests", "2.31.0", "PyPI"), ("flask", "2", "PyPI"),
        ("plain", "", "PyPI"), ("numpy", "1.26", "PyPI"), ("rich", "", "PyPI"), ("github.com/a/b", "1.2.3", "Go"), ("github.com/c/d", "0.1.0", "Go"),
    }
    files = spark.createDataFrame([("a.ts", "typescript", "import p from 'left-pad/x';\nconst q = require('./left-pad');"), ("b.py", "python", "import numpy as np\nfrom requests import get\n"), ("c.rs", "rust", "// tokio::x\nuse serde::De;"), ("d.go", "go", 'import "github.com/c/d"')], "path string, language string, content string")
    assert {r["name"] for r in manifests.usage(deps, files).where("use_count > 0").collect()} == {"left-pad", "numpy", "requests", "serde", "github.com/c/d"}


def test_project_header(spark, tmp_path):
    (tmp_path / "Cargo.toml").write_text('[package]\nname = "root"\nversion.workspace = true\n')
    (tmp_path / "crates" / "a").mkdir(parents=True)
    (tmp_path / "crates" / "a" / "package.json").write_text('{"name": "a", "version": "2.0", "description": "A."}')
    (tmp_path / "go.mod").write_text("module m\n")
    row = manifests.project(manifests.headers(spark, str(tmp_path))).first()
    assert (row["name"], row["version"], row["description"], row["stacks"]) == ("root", "2.0", "A.", ["Go module", "Node project", "Rust workspace"])


def test_incremental_graph(spark):
    files = spark.createDataFrame([("a.ts", "typescript", "export function f() { g(); }"), ("b.ts", "typescript", "export function g() {}"), ("t/__tests__/c.ts", "typescript", "g();"), ("bad.py", "python", "def (")], "path string, language string, content string")
    parsed, hashes = watch.incremental(files, spark.createDataFrame([], "path string, hash string"), parse.extract(files.limit(0)))
    nodes, edges = watch.graph(parsed)
    assert Counter(r["kind"] for r in nodes.collect()) == {"File": 4, "Function": 2}
    assert {(r["src"], r["dst"], r["kind"]) for r in edges.where("kind <> 'EXPORTS'").collect()} == {("fn:a.ts:f", "fn:b.ts:g", "CALLS"), ("file:t/__tests__/c.ts", "fn:b.ts:g", "TESTS")}
    assert parsed.where("error IS NOT NULL").select("path").first()[0] == "bad.py"
    later = files.where("path <> 'a.ts'").withColumn("content", F.when(F.col("path") == "b.ts", "export function h() {}").otherwise(F.col("content")))
    again, _ = watch.incremental(later, hashes, parsed)
    assert sorted(r["id"] for r in parse.nodes_of(again).collect()) == ["fn:b.ts:h"]


def test_texts_of_a_small_table_are_parsed_by_many_tasks(spark):
    """A table of one file is one task's; parsing it must not be."""
    from graphloom.plans import parser_queries
    from graphloom.plans.projection import Graph

    tasks = 4 * spark.sparkContext.defaultParallelism
    one = spark.createDataFrame([(f"m{k}.py", "python", f"def f{k}(): pass\n") for k in range(200)], "path string, language string, content string").coalesce(1)
    parsed = parse.extract(one)
    assert parsed.rdd.getNumPartitions() >= tasks and parsed.count() == 200
    data = "/root/testdata/sf0.001"
    if os.path.isdir(data):
        assert parser_queries._composed(Graph(spark, data)).rdd.getNumPartitions() >= tasks


def test_a_parser_query_parses_each_text_once(spark, monkeypatch):
    """Nodes, edges and tags are read from what was parsed, not parsed again for each."""
    from graphloom.plans import parser_queries
    from graphloom.plans.projection import Graph

    monkeypatch.setattr(Graph, "table", lambda self, name: spark.range(1, 30).toDF("p_partkey"))
    found = parser_queries._found(Graph(spark, "nowhere"), parser_queries.TEMPLATES["P4_go"])
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 29 * 9
