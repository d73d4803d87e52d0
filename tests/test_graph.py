"""Graph operators on seed graphs."""

import os
import random

import pytest
from pyspark.sql import functions as F

from graphloom.export import formats
from graphloom.functions import paths, text
from graphloom.operators import clones, community, dead, enrich, lookup, rank, reports, resolve, rules, storage, traverse
from graphloom.schemas import as_edges, as_nodes
from graphloom.streaming import watch


def graph(spark, names, links, **columns):
    nodes = as_nodes(spark.createDataFrame([(n, "Function", n, f"{n}.ts", *(columns[c].get(n) for c in columns)) for n in names], "id string, kind string, name string, path string" + "".join(f", {c} {t}" for c, t in zip(columns, ("string",) * len(columns), strict=True))))
    return nodes, as_edges(spark.createDataFrame([(a, b, k, float(w)) for a, b, k, w in links], "src string, dst string, kind string, weight double"))


def test_neighbours_and_dependents(spark):
    nodes, edges = graph(spark, ["foo", "bar", "baz"], [("foo", "bar", "CALLS", 1), ("bar", "baz", "CALLS", 1), ("baz", "gone", "CALLS", 1)])
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(traverse.neighbours(nodes, edges, "foo", 1)) == ["bar"]
    assert ids(traverse.neighbours(nodes, edges, "foo", 2)) == ["bar", "baz"]
    assert ids(traverse.dependents(nodes, edges, "baz", 3)) == ["bar", "foo"]
    seeds = spark.createDataFrame([("baz",), ("foo",)], "seed string")
    found = {r["seed"]: (r["total"], r["by_kind"], r["risk"]) for r in traverse.blast_radius(nodes, edges, seeds).collect()}
    assert found == {"baz": (2, "Function=2", "LOW"), "foo": (0, "", "LOW")}


def test_a_hub_is_not_cut_and_a_cap_is_a_choice(spark):
    names = ["hub", *(f"c{i:03d}" for i in range(120))]
    nodes, edges = graph(spark, names, [(n, "hub", "CALLS", 1) for n in names[1:]] + [("hub", "hub", "CALLS", 1)])
    seed = spark.createDataFrame([("hub",)], "seed string")
    assert traverse.within(nodes, edges, seed, 1, "in").count() == 120
    assert traverse.within(nodes, edges, seed, 1, "in", cap=100).count() == 100


def test_degrees_coupling_and_hotspots(spark):
    nodes, edges = graph(spark, ["a", "b", "c"], [("a", "b", "IMPORTS", 1), ("c", "b", "IMPORTS", 1), ("b", "c", "IMPORTS", 1), ("a", "nowhere", "IMPORTS", 1)])
    files = enrich.with_coupling(enrich.with_degrees(nodes.withColumn("kind", F.lit("File")), edges))
    assert {r["id"]: (r["in_degree"], r["out_degree"], r["coupling"]) for r in files.collect()} == {"a": (0, 2, 0.0), "b": (2, 1, 1.0), "c": (1, 1, 0.5)}
    assert [r["path"] for r in rank.hotspots(files).collect()] == ["b.ts", "c.ts"]


def test_history(spark):
    rows = [("1", "2024-05-01", p) for p in "ab"] + [("2", "2024-05-02", p) for p in "ab"] + [("3", "2024-05-03", "r")] + [("4", "2024-05-30", p) for p in "ab"] + [("old", "2023-01-01", p) for p in "ar"]
    commits = spark.createDataFrame(rows, "sha string, ts string, path string").withColumn("ts", F.to_timestamp("ts"))
    assert {r["path"]: round(r["churn"], 6) for r in enrich.churn(commits).collect()} == {"a": 1.0, "b": 1.0, "r": 0.333333}
    assert [(r["a"], r["b"], r["commits"], r["weight"]) for r in enrich.cochange(commits).collect()] == [("a", "b", 3, 1.0)]
    edge = spark.createDataFrame([("1", "2024-01-01", "x"), ("2", "2024-03-31", "y"), ("3", "2023-12-31", "z")], "sha string, ts string, path string").withColumn("ts", F.to_timestamp("ts"))
    now = F.to_timestamp(F.lit("2024-03-31"))
    assert sorted(r["path"] for r in enrich.churn(edge, now).collect()) == ["x", "y"]  # 90 days back counts, 91 does not


def test_chain_and_impact(spark):
    nodes, edges = graph(spark, list("abcdex"), [("a", "b", "CALLS", 1), ("b", "c", "CALLS", 1), ("a", "d", "CALLS", 1), ("d", "e", "CALLS", 1), ("e", "c", "CALLS", 1), ("c", "a", "CALLS", 1)])
    chain = lambda a, b: [tuple(r) for r in traverse.shortest_chain(edges, a, b).collect()]
    assert chain("a", "c") == [(2, ["a", "b", "c"])] and chain("a", "a") == [(0, ["a"])] and chain("a", "x") == []
    found = {r["id"]: r["role"] for r in traverse.impact(nodes, edges, spark.createDataFrame([("e.ts",)], "path string")).collect()}
    assert found == {"e": "changed", "d": "impacted", "a": "impacted", "c": "impacted", "b": "impacted"}


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    links = sorted({(f"n{rng.randrange(25):02d}", f"n{rng.randrange(25):02d}") for _ in range(38)})
    reach = {a: {a} for link in links for a in link}
    for _ in range(30):
        for a, b in links:
            for seen in reach.values():
                if a in seen:
                    seen.add(b)
    want = sorted((a, b) for a, b in links if a != b and a in reach[b])
    found = traverse.cyclic_edges(spark.createDataFrame(links, "src string, dst string"))
    assert sorted((r["src"], r["dst"]) for r in found.collect()) == want


def parts(spark, names, links):
    nodes, edges = graph(spark, names, links)
    found = {r["id"]: r["community"] for r in community.detect(nodes, edges).collect()}
    assert set(found) == set(names) and min(found.values(), default=1) == 1
    return found


def test_communities(spark):
    assert parts(spark, ["a"], []) == {"a": 1}
    assert len(set(parts(spark, ["a", "b", "c"], []).values())) == 3
    pair = parts(spark, ["a", "b"], [("a", "b", "CALLS", 1)])
    assert pair["a"] == pair["b"]
    triangles = [(a, b, "CALLS", 1) for t in (("foo", "bar", "baz"), ("alpha", "beta", "gamma")) for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))]
    names = ["foo", "bar", "baz", "alpha", "beta", "gamma"]
    found = parts(spark, names, [*triangles, ("foo", "alpha", "CALLS", 0.1)])
    assert len({found[n] for n in names[:3]}) == 1 and len({found[n] for n in names[3:]}) == 1 and found["foo"] != found["alpha"]
    weights = parts(spark, ["center", "strong", "weak"], [("center", "strong", "CALLS", 10), ("center", "weak", "CALLS", 0.1)])
    assert weights["center"] == weights["strong"]


def test_communities_by_shuffles_and_with_decimal_weights_are_the_same(spark, monkeypatch):
    rng = random.Random(3)
    names = [f"n{i}" for i in range(24)]
    links = [(a, b, "CALLS", rng.choice((0.1, 0.3, 1, 2.5))) for a, b in (rng.sample(names[:12], 2) if rng.random() < 0.5 else rng.sample(names[10:], 2) for _ in range(50))]
    few, most = community.BROADCAST_NODES, community.MOST_IN_UNITS
    found = parts(spark, names, links)
    monkeypatch.setattr(community, "BROADCAST_NODES", 0)
    monkeypatch.setattr(community, "MOST_IN_UNITS", 0)
    assert few > 0 and most > 0 and parts(spark, names, links) == found and 1 < len(set(found.values())) < 24


def test_communities_of_the_whole_graph(spark):
    import __spark_entry__
    from graphloom.plans.projection import Graph

    g = Graph(spark, "/root/testdata/sf0.001")
    nodes, edges = storage.stored(g.raw_nodes, "n"), storage.stored(g.edges, "e")
    found = storage.stored(__spark_entry__.queries()["G8_communities"](spark, g.sf_dir), "found")
    given = {r["id"]: r["community"] for r in found.collect()}
    ids = {r["id"] for r in nodes.select("id").collect()}
    assert len(given) == found.count() and set(given) == ids and {i.split(":")[0] for i in given} == {"file", "fn", "cls", "mod", "type", "author"}
    firsts = {}
    for i in sorted(given):
        firsts.setdefault(given[i], i)
    assert list(firsts) == list(range(1, len(firsts) + 1))
    up = {i: i for i in ids}
    root = lambda x: x if up[x] == x else root(up[x])
    for r in edges.collect():
        if r["src"] in ids and r["dst"] in ids:
            up[root(r["src"])] = root(r["dst"])
    whole = {i: root(i) for i in ids}
    assert all(whole[i] == whole[firsts[c]] for i, c in given.items())  # none reaches over what no edge joins
    few = community.detect(nodes, edges, sweeps=6)
    quality = lambda parts: community.modularity(nodes, edges, parts).first()[0]
    assert quality(found) > quality(few) - 1e-9 and quality(found) > 0


def test_dead_code(spark):
    rows = [
        ("exp", "Function", "exp", "src/a.ts", True), ("idx", "Function", "idx", "src/index.ts", True), ("priv", "Function", "priv", "src/a.ts", False), ("main", "Function", "main", "src/a.ts", False),
        ("used", "Function", "used", "src/a.ts", False), ("ctor", "Function", "constructor", "src/a.ts", False), ("v", "Variable", "v", "src/a.ts", True), ("t", "Type", "t", "src/a.ts", True),
        ("lib", "Function", "lib", "lib/a.ts", True), ("tst", "Function", "tst", "src/a.test.ts", False), ("f", "File", "src/a.ts", "src/a.ts", False), ("g", "File", "src/index.ts", "src/index.ts", False),
        ("hook", "Function", "loader", "src/b.ts", True), ("tested", "Function", "tested", "src/b.ts", False), ("c", "Class", "c", "src/b.ts", False),
    ]
    nodes = as_nodes(spark.createDataFrame(rows, "id string, kind string, name string, path string, exported boolean"))
    links = [("exp", "used", "CALLS"), ("f", "exp", "EXPORTS"), ("g", "idx", "EXPORTS"), ("tst", "tested", "TESTS")]
    edges = as_edges(spark.createDataFrame(links, "src string, dst string, kind string"))
    found = {(r["id"], r["reason"]): r["confidence"] for r in dead.detect(nodes, edges).collect()}
    assert found == {
        ("exp", "unreferenced_export"): "high", ("idx", "unreferenced_export"): "low", ("v", "unreferenced_export"): "high", ("t", "unreferenced_export"): "low", ("lib", "unreferenced_export"): "low",
        ("hook", "unreferenced_export"): "low", ("priv", "unreachable"): "high", ("main", "unreachable"): "low", ("tested", "unreachable"): "high", ("v", "unused_variable"): "medium",
        ("ctor", "disconnected"): "high", ("c", "disconnected"): "high", ("f", "zombie_file"): "medium",
    }
    marked = {r["id"]: r["dead_reason"] for r in dead.marked(nodes, dead.detect(nodes, edges)).where("is_dead_candidate").collect()}
    assert marked["v"] == "unused_variable" and "used" not in marked


def test_resolution(spark):
    rows = [("file:src/a.ts", "File", "src/a.ts"), ("file:src/b/index.ts", "File", "src/b/index.ts"), ("fn:src/a.ts:login", "Function", "src/a.ts"), ("fn:src/c.ts:login", "Function", "src/c.ts"), ("fn:src/x/tests/t.ts:check", "Function", "src/x/tests/t.ts")]
    nodes = as_nodes(spark.createDataFrame([(i, k, i.rsplit(":", 1)[1], p) for i, k, p in rows], "id string, kind string, name string, path string"))
    links = [("file:src/c.ts", "file:src/a", "IMPORTS", 0.5), ("file:src/c.ts", "file:src/b", "IMPORTS", 0.5), ("file:src/c.ts", "file:nope", "IMPORTS", 0.5), ("fn:src/x/tests/t.ts:check", "login", "CALLS", 0.7), ("fn:src/a.ts:login", "unknown", "CALLS", 0.7), ("fn:src/a.ts:login", "fn:src/c.ts:login", "CALLS", 0.7)]
    found = {(r["src"], r["dst"], r["kind"], r["confidence"]) for r in resolve.resolve(spark.createDataFrame(links, "src string, dst string, kind string, confidence double"), nodes).collect()}
    assert found == {
        ("file:src/c.ts", "file:src/a.ts", "IMPORTS", 1.0), ("file:src/c.ts", "file:src/b/index.ts", "IMPORTS", 1.0), ("file:src/c.ts", "file:nope", "IMPORTS", 0.5),
        ("fn:src/x/tests/t.ts:check", "fn:src/a.ts:login", "TESTS", 0.8), ("fn:src/x/tests/t.ts:check", "fn:src/c.ts:login", "TESTS", 0.8),
        ("fn:src/a.ts:login", "unknown", "CALLS", 0.7), ("fn:src/a.ts:login", "fn:src/c.ts:login", "CALLS", 0.7),
    }


def test_rules_and_bisect(spark):
    nodes, edges = graph(spark, ["a", "b", "c"], [("a", "b", "IMPORTS", 1), ("b", "a", "IMPORTS", 1), ("b", "c", "IMPORTS", 1)])
    nodes = nodes.withColumns({"exported": F.col("id") == "a", "complexity": F.when(F.col("id") == "b", 0.9).otherwise(0.0), "is_dead_candidate": F.col("id") == "c"})
    stated = rules.load('[[rules]]\nname="cycles"\nbuilt_in="no_cycles"\n[[rules]]\nname="cx"\nseverity="warning"\nbuilt_in="max_complexity"\nthreshold=0.5\n[[rules]]\nname="sql"\nquery="SELECT path, id FROM nodes WHERE exported"\n[[rules]]\nname="bad"\nquery="DROP TABLE nodes"\n[[rules]]\nname="odd"\nbuilt_in="nothing"')
    found, errors = rules.run(spark, stated, nodes, edges)
    assert sorted((r["rule"], r["message"]) for r in found.collect()) == [("cx", "b has complexity 0.90 (threshold: 0.50)"), ("cycles", "Circular import detected: a -> b"), ("cycles", "Circular import detected: b -> a"), ("sql", "a.ts, a")]
    assert set(errors) == {"bad", "odd"} and tuple(rules.verdict(found).first()) == (3, 1, True)
    outcomes = rules.bisect(rules.load_predicates('node_count_min = 2\nnodes_exist = ["a", "zz"]\nnodes_alive = ["b", "c"]\nnodes_missing = ["q"]'), nodes)
    assert {r["predicate"]: r["passed"] for r in outcomes.collect()} == {"node_count_min": True, "nodes_exist:a": True, "nodes_exist:zz": False, "nodes_alive:b": True, "nodes_alive:c": False, "nodes_missing:q": True}
    assert rules.exit_code(outcomes) == 1 and rules.exit_code(rules.bisect(rules.Predicates(), nodes)) == 125
    for sql in ("DELETE FROM nodes", "SELECT 1; SELECT 2", "WITH x AS (SELECT 1) SELECT * FROM x", ""):
        with pytest.raises(ValueError):
            lookup.guarded_sql(spark, sql, nodes=nodes)


def test_guarded_sql_leaves_no_views(spark):
    nodes, _ = graph(spark, ["a"], [])
    spark.range(3).createOrReplaceTempView("nodes")
    try:
        assert lookup.guarded_sql(spark, "SELECT count(*) AS n FROM nodes JOIN edges", nodes=nodes, edges=nodes).first()["n"] == 1
        assert spark.table("nodes").count() == 3 and not spark.catalog.tableExists("edges")
        with pytest.raises(ValueError):
            lookup.guarded_sql(spark, "DROP TABLE nodes", nodes=nodes)
    finally:
        spark.catalog.dropTempView("nodes")


def test_normalized_bodies(spark):
    bodies = ['x1 = "a\\"b" + 12.5; // c', "/* a\nb */ y\t\n z/2 .5e", "`t", "'", "", None, "a/b//c\nd"]
    found = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "k int, b string").select("k", text.normalized_body(F.col("b")).alias("n")).orderBy("k").collect()
    assert [r["n"] for r in found] == ["xN = S + N;", "y z/N Ne", "S", "S", "", None, "a/b d"]


def test_text_functions(spark):
    cases = [('a = "x//y" + 12; // c', "a = S + N;"), ("foo1", "fooN"), ("x /* y", "x"), ("  a\n\t b  ", "a b"), ("'it\\'s' `t`", "S S"), ("", "")]
    rows = spark.createDataFrame(cases, "t string, want string").select("want", text.normalized_body(F.col("t")).alias("got")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
    pairs = [("", "", 1.0), ("", "abcd", 0.0), ("abc", "abc", 0.0), ("abcd", "abcd", 1.0), ("abcdef", "abcdeg", 0.5)]
    rows = spark.createDataFrame(pairs, "a string, b string, want double").select("want", text.text_similarity(F.col("a"), F.col("b")).alias("got")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
    tags = [("Note: this is fine", None), ("programming bugs", None), (" BUGS in this", None), ("DEBUGGER attached", None), ("// TODO: fix", "TODO"), ("* HACK: x", "HACK"), ("BUG!", "BUG"), ("// FIXME TODO", "TODO")]
    assert [r["got"] for r in spark.createDataFrame(tags, "t string, w string").select(text.tag_of(F.col("t")).alias("got")).collect()] == [w for _, w in tags]


def test_path_functions(spark):
    row = spark.range(1).select(
        paths.joined(F.lit("src/a/b.ts"), F.lit("../c")).alias("up"), paths.joined(F.lit("src/a.ts"), F.lit("./b")).alias("same"),
        *(paths.file_group(F.lit(p)).alias(f"g{k}") for k, p in enumerate(["crates/x-engine/src/graph.rs", "crates/x-engine/src/parsers/rust.rs", "tests/integration/a.test.ts", "README.md"])),
        *(paths.file_role(F.lit(p), F.lit(0), F.lit(9)).alias(f"r{k}") for k, p in enumerate(["a/tests/x.ts", "src/main.rs", "src/lib.rs", "a/components/B.ts", "x/db/q.ts", "x/y.ts"])),
        paths.safe_filename(F.lit("--a b//c: d-")).alias("safe"),
    ).first()
    assert tuple(row) == ("src/c", "src/b", "x-engine", "x-engine/parsers", "tests/integration", "root", "test", "entry", "library", "view", "query_layer", "other", "a-b//c-d")
    nodes = spark.createDataFrame([(1, "src/auth/a.ts"), (1, "src/auth/b.ts"), (2, "src/x/only.ts"), (3, "a/b.ts"), (3, "c/d.ts"), (4, "ab/x.ts"), (4, "ab-c/x.ts")], "community long, path string")
    given = spark.createDataFrame([(3, "Payments")], "id long, label string")
    assert {r["community"]: r["label"] for r in paths.community_labels(nodes, given).collect()} == {1: "auth", 2: "x/only", 3: "Payments", 4: "community-4"}


def test_clones(spark):
    body = "function a(x) { const total = x + 1; return total * 2; } // note"
    rows = [(1, body), (2, body.replace("// note", "/* other */")), (3, body.replace("* 2", "* 3 + x")), (4, "something else entirely, with nothing shared"), (5, "abc"), (6, "")]
    found = {(r["node_a"], r["node_b"]): r["kind"] for r in clones.clones(spark.createDataFrame(rows, "id long, body string"), 0.8).collect()}
    assert found == {(1, 2): "exact", (1, 3): "near"}


def test_near_clones_of_whole_documents_equal_brute_force(spark, tmp_path):
    import __spark_entry__

    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("stone", "river", "cloud", "amber", "quiet") for b in ("fall", "mark", "wise", "less", "gate", "ward")]
    base = [" ".join(rng.choice(words) for _ in range(n)) for n in (6, 60, 600, 4000)]
    texts = [*base, *(t + " and one more end" for t in base), base[1].replace("stone", "brick"), "abc", "", None, base[2]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    grams = {}
    for i, t in reversed(list(enumerate(texts))):
        grams = {k: v for k, v in grams.items() if texts[k] != t} | {i: {t[k : k + 4] for k in range(len(t) - 3)}} if t and len(t) >= 4 else grams
    want = {(a, b): len(x & y) / len(x | y) for a, x in grams.items() for b, y in grams.items() if a < b and len(x & y) / len(x | y) >= 0.8}
    found = __spark_entry__.queries()["J23_near_clones_bodies"](spark, str(tmp_path)).collect()
    assert {(r["node_a"], r["node_b"]): r["similarity"] for r in found} == {k: pytest.approx(v, abs=2e-5) for k, v in want.items()}
    assert (2, 6) in want and len(found) == len(want)


@pytest.mark.parametrize("long", [0, 1 << 40])
def test_near_clones_by_sketches_and_by_rare_grams_equal_brute_force(spark, monkeypatch, long):
    rng = random.Random(7)
    words = [f"{a}{b}" for a in ("stone", "river", "cloud") for b in ("fall", "mark", "wise", "less")]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice((1, 3, 8, 9, 10, 40)))) for _ in range(60)]
    texts += [texts[3], "abcd", "abcde", "äöü", "", "abc"]
    for name, n in (("LONG", long), ("LEAST_BLOCK", 7), ("MOST_BLOCK", 7), ("SKETCH_WORDS", 2)):
        monkeypatch.setattr(clones, name, n)
    found = clones.near_clones(spark.createDataFrame([*enumerate(texts), (70, None)], "id long, body string"), 0.8).collect()
    sets = {}
    for i, t in enumerate(texts):
        raw = t.encode()
        if len(raw) >= 4 and texts.index(t) == i:
            sets[i] = {raw[k : k + 4] for k in range(len(raw) - 3)}
    want = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) / len(x | y) >= 0.8}
    assert len(found) == len(want) > 3 and {(r["node_a"], r["node_b"]): r["similarity"] for r in found} == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def test_sketches_leave_few_pairs_of_long_bodies():
    import numpy as np

    rng = np.random.default_rng(5)
    common = rng.integers(0, 1 << 32, 1500)
    grams = [np.unique(rng.choice(common, 1000, replace=False)).astype(np.uint32) for _ in range(60)]
    grams[9] = np.unique(np.append(grams[4][:-40], 7)).astype(np.uint32)
    grams.sort(key=len)
    sizes = np.array([len(g) for g in grams])
    everyone = np.arange(len(grams))
    found = [(x, y) for x, ys in clones.near_pairs(sizes, [clones.sketch(g) for g in grams], everyone, everyone, 0.8) for y in ys.tolist()]
    alike = [(x, y) for x in everyone for y in everyone[x + 1 :] if 10 * len(np.intersect1d(grams[x], grams[y])) >= 8 * len(np.union1d(grams[x], grams[y]))]
    assert len(alike) == 1 and set(alike) <= set(found) and len(found) < 5


def test_storage(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "id string, v int, seq int")
    assert sorted(tuple(r) for r in storage.upsert(table, new, order="seq").collect()) == [("a", 1), ("b", 4), ("c", 5)]
    assert sorted(tuple(r) for r in storage.update_by_id(table, spark.createDataFrame([("a", 9)], "id string, v int")).collect()) == [("a", 9), ("b", 2)]
    now, then = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "path string, hash string"), spark.createDataFrame([("y", "2"), ("z", "0"), ("w", "1")], "path string, hash string")
    assert {r["path"]: r["change"] for r in storage.changed_files(now, then).collect()} == {"x": "new", "z": "changed", "w": "deleted"}


def test_exports(spark):
    nodes, edges = graph(spark, ['a<"&', "b"], [('a<"&', "b", "IMPORTS", 2), ("b", "gone", "CALLS", 1)])
    lines = lambda df: [r["line"] for r in df.orderBy("section", "k").collect()]
    assert lines(formats.mermaid(nodes, edges, 10)) == ["graph TD", '  a_"&["a<\'&"]', '  b["b"]', '  a_"& -.-> b']
    xml = lines(formats.graphml(nodes, edges))
    import xml.etree.ElementTree as ET

    root = ET.fromstring("\n".join(xml).split("\n", 1)[1])
    assert [n.get("id") for n in root.iter("{http://graphml.graphdrawing.org/xmlns}node")] == ['a<"&', "b"]
    ET.fromstring("\n".join(lines(formats.svg(nodes, edges))))
    assert len(lines(formats.dot(nodes, edges))) == 6
    assert lines(formats.mermaid(nodes.limit(0), edges.limit(0))) == ["graph TD"]


def test_exports_hold_the_whole_graph(spark):
    import json

    import __spark_entry__
    from graphloom.plans.projection import Graph

    g = Graph(spark, "/root/testdata/sf0.001")
    nodes = {r["id"]: r for r in storage.stored(g.nodes, "n").collect()}
    edges = g.edges.collect()
    rows = {name: __spark_entry__.queries()[name](spark, g.sf_dir).collect() for name in ("K10_json", "K12_dot", "K13_svg", "K14_graphml")}
    found = {part: [json.loads(r["json"]) for r in rows["K10_json"] if r["part"] == part] for part in ("nodes", "edges", "meta")}
    assert sorted(n["id"] for n in found["nodes"]) == sorted(nodes) and all(n["churn"] == nodes[n["id"]]["churn"] for n in found["nodes"])
    ends = lambda each: sorted((e["src"], e["kind"], e["dst"]) for e in each)
    assert ends(found["edges"]) == ends(edges) and found["meta"] == [{"node_count": len(nodes), "edge_count": len(edges)}]
    for name, head, foot in (("K12_dot", 2, 1), ("K14_graphml", 11, 2)):
        by = {k: [r["line"] for r in rows[name] if r["section"] == k] for k in range(4)}
        assert [len(by[k]) for k in range(4)] == [head, len(nodes), len(edges), foot]
        assert all(any(i in line for line in by[1]) for i in ("author:1", "file:1", "fn:1", "mod:3", "type:2"))
    assert [sum(r["section"] == k for r in rows["K13_svg"]) for k in (0, 2, 3)] == [1, 200, 1] and len(rows["K13_svg"]) <= 602


def test_blast_radius_of_every_node(spark):
    import __spark_entry__
    from graphloom.plans.projection import Graph

    g = Graph(spark, "/root/testdata/sf0.001")
    kinds = {r["id"]: r["kind"] for r in g.raw_nodes.select("id", "kind").collect()}
    back = {}
    for r in g.edges.collect():
        back.setdefault(r["dst"], set()).add(r["src"])
    want = {}
    for seed in kinds:
        seen, frontier = {seed}, {seed}
        for _ in range(3):
            frontier = {b for a in frontier for b in back.get(a, ()) if b in kinds} - seen
            seen |= frontier
        n = {}
        for i in seen - {seed}:
            n[kinds[i]] = n.get(kinds[i], 0) + 1
        total = sum(n.values())
        want[seed] = (total, ",".join(sorted(f"{k}={v}" for k, v in n.items())), "CRITICAL" if total > 50 else "HIGH" if total > 20 else "MEDIUM" if total > 5 else "LOW")
    found = __spark_entry__.queries()["G3_blast_radius"](spark, g.sf_dir).collect()
    assert len(found) == len(want) and {r["seed"]: (r["total"], r["by_kind"], r["risk"]) for r in found} == want


def test_blast_radius_has_few_rows_for_many_seeds(spark):
    names = ["hub", *(f"u{i}" for i in range(20)), *(f"f{i}" for i in range(1000))]
    links = [*((f"u{i}", "hub", "IMPORTS", 1) for i in range(20)), *(("hub", f"f{i}", "EXPORTS", 1) for i in range(1000)), ("hub", "gone", "CALLS", 1)]
    nodes, edges = graph(spark, names, links)
    seeds = nodes.select(F.col("id").alias("seed")).unionByName(spark.createDataFrame([("gone",), ("hub",), (None,)], "seed string"))
    _, masks, _, _ = traverse.reached_masks(nodes, edges, seeds)
    assert masks.groupBy("n").count().agg({"count": "max"}).first()[0] <= 3  # a row for a block of 512 seeds; with 64 seeds, 16
    found = {r["seed"]: r["total"] for r in traverse.blast_radius(nodes, edges, seeds).collect()}
    assert found == {n: 20 if n == "hub" else 0 if n.startswith("u") else 21 for n in [*names, "gone"]}


def test_chain_over_kinds_equals_brute_force(spark):
    import __spark_entry__
    from graphloom.plans.projection import Graph

    g = Graph(spark, "/root/testdata/sf0.001")
    kinds, out = {}, {}
    for r in g.edges.collect():
        out.setdefault(r["src"], set()).add(r["dst"])
        kinds.setdefault((r["src"], r["dst"]), r["kind"])
    first = min(a for (a, _), kind in kinds.items() if kind == "OWNS")
    parent, frontier = {first: None}, [first]
    while frontier:
        new = {}
        for a in sorted(frontier):
            for b in out.get(a, ()):
                if b not in parent:
                    new.setdefault(b, a)
        parent |= new
        frontier = list(new)
    (row,) = __spark_entry__.queries()["G4_chain_over_kinds"](spark, g.sf_dir).collect()
    path = row["path"].split(">")
    want = [path[-1]]
    while parent[want[-1]]:
        want.append(parent[want[-1]])
    assert path == want[::-1] and row["hops"] == len(path) - 1 and path[0] == first
    assert {"OWNS", "EXPORTS"} <= {kinds[link] for link in zip(path, path[1:])}


def test_bursts_and_watch(spark, tmp_path):
    rows = [("u", "2024-01-01 00:00:00.0"), ("u", "2024-01-01 00:00:00.4"), ("u", "2024-01-01 00:00:02.0"), ("v", "2024-01-01 00:00:00.0")]
    events = spark.createDataFrame(rows, "path string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r["path"], r["n"]) for r in watch.bursts(events, "path").collect()) == [("u", 1), ("u", 2), ("v", 1)]
    events.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    watch.watch(stream, lambda paths_, n: seen.append(sorted(r["path"] for r in paths_.collect())), str(tmp_path / "cp")).awaitTermination(60)
    assert seen == [["u", "v"]]


def test_reports(spark):
    nodes, edges = graph(spark, ["a", "b", "c"], [("a", "b", "CALLS", 1), ("c", "b", "TESTS", 1)])
    after = nodes.where("id <> 'a'").withColumn("line_end", F.when(F.col("id") == "b", 9).otherwise(F.col("line_end")))
    diff = {(r["element"], r["id"]): r["change"] for r in reports.graph_diff(nodes, edges, after, edges.where("kind = 'CALLS'")).collect()}
    assert diff == {("node", "a"): "removed", ("node", "b"): "modified", ("edge", "c|TESTS|b"): "removed"}
    context = {(r["role"], r["id"]) for r in reports.symbol_context(nodes, edges, "b").collect()}
    assert context == {("caller", "a"), ("caller", "c")}
    deps = spark.createDataFrame([("x", "1", "npm"), ("y", "1", "npm")], "name string, version string, ecosystem string")
    bad = spark.createDataFrame([("x", "npm", "1", f"CVE-{k}") for k in range(4)], "name string, ecosystem string, version string, cve_id string")
    health = reports.dependency_health(deps, bad)
    assert {r["name"]: (r["cve_count"], r["risk_score"], r["label"]) for r in health.collect()} == {"x": (4, 0.8, "CRITICAL"), "y": (0, 0.0, "OK")}
    assert tuple(reports.dependency_totals(health).first()) == (2, 1, 4)


def test_long_loops_leave_few_folders(spark):
    n = 40
    rows = [(f"n{k:02d}", f"n{k + 1:02d}") for k in range(n)]
    edges = spark.createDataFrame(rows, "src string, dst string")
    seeds = spark.createDataFrame([("n00",)], "id string")
    before = len(storage._MADE)
    found = traverse.reachable(edges, seeds)
    assert found.count() == n + 1 and len(storage._MADE) - before <= 12
    chain = traverse.shortest_chain(edges, "n03", "n31").first()
    assert chain["hops"] == 28 and chain["path"] == [f"n{k:02d}" for k in range(3, 32)]
    ring = edges.unionByName(spark.createDataFrame([("n09", "n05"), ("n30", "n20"), ("n20", "n19")], "src string, dst string"))
    before = len(storage._MADE)
    cyclic = {tuple(r) for r in traverse.cyclic_edges(ring).collect()}
    assert cyclic == {(f"n{k:02d}", f"n{k + 1:02d}") for k in [*range(5, 9), *range(19, 30)]} | {("n09", "n05"), ("n30", "n20"), ("n20", "n19")}
    assert len(storage._MADE) - before <= 8


def test_a_replaced_table_makes_a_new_index(spark, tmp_path):
    import shutil

    from graphloom.plans.projection import Graph

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    for name in os.listdir("/root/testdata/sf0.001"):
        shutil.copy(f"/root/testdata/sf0.001/{name}", tmp_path / name)
    modules = lambda: Graph(spark, str(tmp_path)).raw_nodes.where("kind = 'Module'").count()
    assert modules() == 25
    kept = spark.read.parquet(f"{tmp_path}/nation.parquet").where("n_nationkey < 5").toPandas()
    kept.to_parquet(f"{tmp_path}/nation.parquet")
    assert modules() == 5


def test_large_commits_are_paired_in_blocks(spark, monkeypatch):
    import datetime

    day = datetime.datetime(2024, 1, 1)
    rows = [("big", day, f"p{k:02d}") for k in range(23)] + [("two", day, "p03"), ("two", day, "p20"), ("one", day, "p05")]
    commits = spark.createDataFrame(rows, "sha string, ts timestamp, path string")
    want = sorted(map(tuple, enrich.cochange(commits, least=1).collect()))
    assert len(want) == 23 * 22 // 2 and want[0][:2] == ("p00", "p01")
    monkeypatch.setattr(enrich, "BLOCK", 5)
    assert sorted(map(tuple, enrich.cochange(commits, least=1).collect())) == want


def shuffle_files(spark) -> set[str]:
    """Names of the shuffle files that there are."""
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.length()) if (name := files.apply(k).getName()).startswith("shuffle_")}


def test_what_is_stored_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(storage.TIDY_SETTING)
    found = storage.stored(spark.range(100).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "t-tidy")
    assert shuffle_files(spark) <= before and found.count() == 7
    assert spark.conf.get(storage.TIDY_SETTING) == setting


def test_walk_from_few_looks_at_their_edges_only(spark, monkeypatch):
    rng = random.Random(12)
    names = [f"n{k}" for k in range(40)]
    nodes, edges = graph(spark, names, [(rng.choice(names), rng.choice([*names, "gone"]), "CALLS", 1) for _ in range(70)])
    nodes, edges = storage.stored(nodes, "t-n"), storage.stored(edges, "t-e")
    seeds = spark.createDataFrame([(n,) for n in names[:4]] + [("nowhere",), (None,)], "seed string")
    for direction, cap in (("both", None), ("in", None), ("out", 1)):
        monkeypatch.setattr(traverse, "NEAR_ROWS", 1_000_000)
        since = storage.mark()
        few = sorted(map(tuple, traverse.within(nodes, edges, seeds, 3, direction, cap).collect()))
        assert not any("/ends-" in path for path in storage._MADE[since:])
        monkeypatch.setattr(traverse, "NEAR_ROWS", 0)
        assert few == sorted(map(tuple, traverse.within(nodes, edges, seeds, 3, direction, cap).collect())) and few


def test_blast_radius_blocks_are_of_seeds_that_reach_the_same(spark, monkeypatch):
    names = ["a-hub", "b-hub", *(f"{c}-u{i}" for c in "ab" for i in range(20)), *(f"f{i:04}" for i in range(2048))]  # every other function is of the other hub
    links = [*((f"{c}-u{i}", f"{c}-hub", "IMPORTS", 1) for c in "ab" for i in range(20)), *((f"{'ab'[i % 2]}-hub", f"f{i:04}", "EXPORTS", 1) for i in range(2048))]
    nodes, edges = graph(spark, names, links)
    nodes, edges = storage.stored(nodes, "t-n"), storage.stored(edges, "t-e")
    seeds = nodes.select(F.col("id").alias("seed"))
    _, masks, _, _ = traverse.reached_masks(nodes, edges, seeds)
    assert masks.count() - nodes.count() <= 3 * 42  # with all blocks at both hubs, 5 * 42
    few = sorted(map(tuple, traverse.blast_radius(nodes, edges, seeds).collect()))
    monkeypatch.setattr(traverse, "BROADCAST_EDGES", 0)
    monkeypatch.setattr(traverse, "TOGETHER", 2)
    assert few == sorted(map(tuple, traverse.blast_radius(nodes, edges, seeds).collect()))
    assert spark.conf.get(traverse.DEALT_SETTING) == "true"
