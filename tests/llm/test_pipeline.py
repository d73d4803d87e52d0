"""The pipeline's stages, and the queries of the corpus operators over a driver table."""

import os

import pytest

import __spark_entry__
import corpus_pipeline
from graphloom.llm import jaccard, language, pii
from tests.llm.test_kernels import brute_sets
from tests.llm.test_operators import DOCS, brute_components, corpus

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A table folder with a benchmark item that one document holds."""
    root = str(tmp_path_factory.mktemp("sf"))
    rows = corpus()
    leak = " ".join((rows[3][1] + " " + rows[4][1]).split()[:45])
    rows.append((900, f"{leak} and more words of its own", "en", "s1", 10))
    spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", id int").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, rows


def test_stages_take_effect(spark, small):
    root, rows = small
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, root)
        path = f"{root}/{name}.parquet"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs.collect()
        if name != "pack":
            assert docs.columns == columns
    ids = {name: {r["doc_id"] for r in kept[name]} for name in kept}
    texts = {i: t for i, t, *_ in rows}
    assert ids["language_id"] == {i for i, t in texts.items() if t and any(map(str.isalpha, t))}
    left = sorted(ids["language_id"])
    roots = brute_components([texts[i] for i in left], 5, 80)
    assert ids["near_duplicates"] == {left[k] for _, k in roots}
    assert 900 in ids["near_duplicates"] and 900 not in ids["decontaminate"]
    clean = {r["doc_id"]: r for r in kept["personal_data"]}
    assert set(clean) == ids["decontaminate"]
    assert all(r["text"] == pii.redact(texts[i]) and r["n_chars"] == len(r["text"]) for i, r in clean.items())
    assert ids["pack"] == set(clean)
    assert sorted(map(tuple, corpus_pipeline.run(spark, root).collect()))[0] is not None


def test_names_of_queries():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()


@needs_data
def test_language_on_held_out_rows(spark):
    found = language.op6_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = found.where("held_out AND lang_pred <> 'und'").collect()
    assert held and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


@needs_data
def test_jaccard_on_a_driver_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    want = brute_components([r["text"] for r in docs], 3, 90)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.op8_jaccard(spark, SF).collect()}
    assert found == {docs[k]["doc_id"]: (n, docs[c]["doc_id"]) for k, (n, c) in enumerate(want)}
    assert len(brute_sets([docs[0]["text"]], 3)[0]) == found[docs[0]["doc_id"]][0]


@needs_data
@pytest.mark.parametrize("name", ["op7_url_filter", "op10_decontamination"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = __spark_entry__.queries()[name](spark, SF)
    theirs = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, theirs.fetchall()))
