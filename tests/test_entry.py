"""The driver contract: registered queries agree with their SQL, and the rest works without the corpus operators."""

import datetime
import decimal
import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__
from tests.conftest import ROOT

SF = "/root/testdata/sf0.001"
SOME = ("T1_hotspots", "A4_degrees", "A6_communities", "A20_cochange", "G3_blast_radius", "G5_impact", "G7_cycles", "R9_dead_code", "J21_graph_diff", "J5_cross_cluster", "P1_parse_nodes", "M1_bursts", "Q15_file_facts", "W9_collisions", "G4_chain_over_kinds", "J24_exact_clones", "X3_normalized_bodies", "K12_dot", "K13_svg", "K14_graphml", "P1_typescript", "P2_python", "P3_rust", "P4_go", "P5_java", "P6_php", "F20_retrieve", "G10_grid", "X14_purposes", "X17_durations", "X19_sizes", "X19_versions", "D6_registry", "A25_group_exports", "K1_store_nodes", "M1_closed_bursts", "R8_first_bad", "S5_line_balance", "P1d_composed_calls")

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int | float | decimal.Decimal):
        return f"{float(v):.9g}"
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


@needs_data
@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = __spark_entry__.queries()[name](spark, SF)
    theirs = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(map(plain, r)) for r in df.select(*columns).collect()) == sorted(tuple(map(plain, r)) for r in theirs.fetchall())


@needs_data
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    for name in ("graphloom", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "graphloom" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'T1_hotspots' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
