"""The front door: a repository indexed, asked, exported and documented."""

import json
import os
import subprocess

import pytest

from graphloom import api
from graphloom.export import notes


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    (root / "src").mkdir()
    (root / "src" / "a.ts").write_text("import { g } from './b';\n/** Runs. */\nexport function f(x) {\n  const n = x + 1;\n  return g(n * 2);\n}\n// TODO: more\n")
    (root / "src" / "b.ts").write_text("export function g(x) {\n  const n = x + 1;\n  return h(n * 2);\n}\nfunction h(x) { return x; }\n")
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=Ann", "-c", "user.email=ann@dev.io", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "-A")
    run("commit", "-q", "-m", "first")
    folder = str(tmp_path_factory.mktemp("graph"))
    api.save(api.analyze(spark, str(root)), folder)
    return api.Graph(spark, folder)


def test_tools(graph):
    summary = api.call(graph, "get_repo_summary")[0]
    assert (summary["node_count"], summary["edge_count"]) == (6, 8) and summary["languages"][0]["language"] == "typescript"
    assert api.call(graph, "get_call_chain", {"source": "f", "target": "h"})[0]["hops"] == 2
    assert api.call(graph, "get_blast_radius", {"node": "h"})[0]["total"] >= 2
    assert [r["id"] for r in api.call(graph, "find_symbol", {"name": "src/a.ts:f"})] == ["fn:src/a.ts:f"]
    assert api.call(graph, "get_file_owners", {"path": "src/a.ts"})[0]["name"] == "Ann"
    assert api.call(graph, "run_query", {"sql": "SELECT count(*) AS n FROM nodes"}) == [{"n": 6}]
    assert {r["id"] for r in api.call(graph, "search_graph", {"text": "B.TS"})} >= {"file:src/b.ts"}
    assert api.call(graph, "get_hotspots")[0]["owner"] == "Ann" and api.call(graph, "get_dead_code")
    assert graph.todos("todo").first()["line"] == 7 and graph.file_context("src/a.ts").first()["n_symbols"] == 1
    assert graph.context("g").where("role = 'caller'").first()["name"] == "f"
    with pytest.raises(LookupError):
        api.call(graph, "drop_everything")


def test_settings_and_registry(spark):
    assert api.settings("churn_days = 7")["churn_days"] == 7 and api.settings()["churn_days"] == 90
    with pytest.raises(ValueError):
        api.settings("nothing = 1")
    rows = api.repos(spark, json.dumps([{"id": "x", "name": "n", "path": "/p", "node_count": 3, "language_breakdown": {"rust": 1.0}}])).collect()
    assert (rows[0]["id"], rows[0]["node_count"], rows[0]["language_breakdown"]) == ("x", 3, {"rust": 1.0})


def test_notes(spark, graph, tmp_path):
    n, hashes = notes.generate(graph.nodes, graph.edges, str(tmp_path / "vault"))
    assert n == 2 + 12 and os.path.exists(tmp_path / "vault" / "index" / "hotspots.md")
    assert sorted(r["path"] for r in notes.unfilled(spark, str(tmp_path / "vault" / "files")).collect()) == ["src/a.ts", "src/b.ts"]
    again, _ = notes.generate(graph.nodes, graph.edges, str(tmp_path / "vault"), hashes)
    assert again == 12
    assert notes.readme_excerpt("# T\n\n<img src=x>\n\nA *tool* for\nthings.\n") == "A tool for things."


def test_exports(graph, tmp_path):
    from graphloom.export import formats

    formats.write(graph.export("mermaid"), str(tmp_path / "m"))
    text = "".join(p.read_text() for p in (tmp_path / "m").glob("*.txt"))
    assert text.startswith("graph TD\n") and "-.->" in text
