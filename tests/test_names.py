"""Calls by name: every node of that name, without a shuffle of the pairs."""

from graphloom.operators import resolve, traverse


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_call_both_by_id_and_by_name_is_one_pair(spark):
    nodes = spark.createDataFrame([("f1", "f"), ("f2", "f"), ("g1", "g"), ("h1", None)], "id string, name string")
    edges = spark.createDataFrame([("a", "f1"), ("a", "f"), ("a", "f"), ("b", "g1"), ("b", "h1"), ("c", "nobody"), ("d", "f2"), ("d", "g")], "src string, dst string")
    found = traverse.with_name_fallback(nodes, edges)
    assert sorted(map(tuple, found.collect())) == [("a", "f1"), ("a", "f2"), ("b", "g1"), ("b", "h1"), ("d", "f2"), ("d", "g1")]


def test_chunks_of_a_name_meet_in_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(resolve, "CHUNK", 3)
    calls = spark.createDataFrame([(f"s{k}", "f") for k in range(10)] + [("s1", "g"), ("s2", "none")], "src string, name string")
    names = spark.createDataFrame([("f", f"f{k}") for k in range(8)] + [("g", "g0")], "name string, dst string")
    found = sorted(map(tuple, resolve.of_that_name(calls, names).collect()))
    assert found == sorted([(f"s{k}", f"f{j}") for k in range(10) for j in range(8)] + [("s1", "g0")])


def test_pairs_by_name_are_not_shuffled(spark):
    """What is made of names is not compared or dealt again: no aggregate or exchange stands over the join that makes it."""
    nodes = spark.range(50).selectExpr("concat('n', id) AS id", "'f' AS name")
    edges = spark.range(50).selectExpr("concat('s', id) AS src", "'f' AS dst")
    plan = _plan(traverse.with_name_fallback(nodes, edges))
    lines = plan.split("\n")
    above = lines[: next(k for k, x in enumerate(lines) if "Union" in x)]
    assert not any("Exchange" in x or "Aggregate" in x for x in above)


def test_commits_and_nodes_are_dealt_by_few_bytes(spark):
    """Commits are made distinct by keys, without another shuffle of names and paths; nodes are dealt by id once."""
    import os

    import pytest

    from graphloom.plans.projection import COMMITS, Graph

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables here")
    g = Graph(spark, data)
    made = g._committed()
    assert made.schema.simpleString() == g._sql(COMMITS).schema.simpleString()
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, g._sql(COMMITS).collect()))
    assert not any("Exchange" in x and "author_name" in x for x in _plan(made).split("\n"))
    assert sum("hashpartitioning(path" in x for x in _plan(g._enriched()).split("\n")) <= sum("hashpartitioning(path" in x for x in _plan(g.churn).split("\n")) + 1
