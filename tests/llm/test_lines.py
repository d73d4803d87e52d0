"""Reversible line dedup: the filter, the index against brute force through insertions and deletions, odd rows."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import lines
from graphloom.llm.common import scratch

DOCS = "doc_id long, text string"


def brute(rows):
    """(n_lines, n_dropped, text) of each row (id, text), by the definition alone; rows of one id are one document, null ids the greatest."""
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    order = lambda i: (i is None, i or 0)
    holders = defaultdict(set)
    for i, text in rows:
        for k in {key(line) for line in (text or "").split("\n")}:
            if len(k) >= 10:
                holders[k].add(i)
    out = []
    for i, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)], key=order) == i]
        out.append((i, len(own), len(own) - len(kept), None if text is None else "\n".join(kept)))
    return sorted(out, key=str)


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    pool = [f"Line number {k} of the pool" for k in range(25)] + ["short", "", "  Ünïcode LINE é of text \t", "exactly 10"]
    texts = ["\n".join(rng.choice(pool) + rng.choice(["", " ", "\t"]) if rng.random() < 0.6 else f"own line {rng.random()}" for _ in range(rng.randrange(1, 12))) for _ in range(n)]
    texts += ["LINE NUMBER 3 OF THE POOL", "", None, "\n\n\n", "everyone has this line\n" * 3, "a line of its own\r\neveryone has this line", "x" * 50_000 + "\n" + "y" * 50_000, "x" * 50_000]
    return list(enumerate(texts))


def cleaned(index, docs):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in index.cleaned(docs).collect()), key=str)


def test_filter_adds_and_removes():
    rng = np.random.default_rng(0)
    for n in (0, 1, 9, 3000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        held = lines.Cuckoo.sized(len(keys))
        assert held.add(keys) and held.has(keys).all() and held.held() == len(keys) <= held.room()
        held.remove(keys[::2])
        assert held.has(keys[1::2]).all() and held.held() == len(keys[1::2])
        assert held.add(keys[::2]) and held.has(keys).all()
        assert held.has(rng.integers(0, 1 << 63, 5000, dtype=np.uint64)).mean() < 0.01
        held.remove(keys)
        assert held.held() == 0
    small = lines.Cuckoo.sized(4)
    assert not small.add(rng.integers(0, 1 << 63, 40, dtype=np.uint64))
    with pytest.raises(ValueError):
        lines.Cuckoo.sized(10).remove(np.array([5], np.uint64))


def test_batches_deletions_and_replays(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    index = lines.Index(spark, scratch(spark, "t-lines"))
    index.insert(docs.where("doc_id % 3 = 0"), "a")
    index.insert(docs.where("doc_id % 3 <> 0"), "b")
    assert cleaned(index, docs) == brute(rows)
    before = sorted(map(tuple, index.counts().collect()))
    for kind in range(2):  # ids that come first, and others
        gone = docs.where(F.col("doc_id") % 2 == kind)
        assert index.delete(gone.select(F.col("doc_id").alias("doc")), f"d{kind}")
        left = [r for r in rows if r[0] % 2 != kind]
        assert cleaned(index, docs.where(F.col("doc_id") % 2 != kind)) == brute(left)
        assert not index.delete(gone.select(F.col("doc_id").alias("doc")), f"d{kind}")
        assert index.insert(gone, f"r{kind}") and not index.insert(gone, f"r{kind}")
        assert sorted(map(tuple, index.counts().collect())) == before
    # the filters hold every key, and are not larger than they need be
    tables = {r["shard"]: lines.Cuckoo(np.frombuffer(r["table"], np.uint16).reshape(-1, lines.SLOTS)) for r in index._filters().collect()}
    for shard in tables:
        own = np.array([r[2] for r in before if r[0] == shard], np.int64).view(np.uint64)
        assert tables[shard].has(own).all() and tables[shard].held() == len(own)
    index.delete(docs.select(F.col("doc_id").alias("doc")), "all")
    assert index.counts().isEmpty() and index.postings().isEmpty() and index.documents().isEmpty()


def test_a_batch_that_was_cut_off_does_not_count(spark):
    docs = spark.createDataFrame(corpus(), DOCS)
    path = scratch(spark, "t-lines-cut")
    index = lines.Index(spark, path)
    index.insert(docs.where("doc_id < 20"), "a")
    docs.selectExpr("1L h1", "2L h2", "doc_id doc", "1 sign").write.parquet(f"{path}/v000001-b/postings")  # no mark
    assert [n for n, _ in index.versions()] == ["a"]
    again = lines.Index(spark, path)
    assert again.insert(docs.where("doc_id >= 20"), "b")
    assert cleaned(again, docs) == brute(corpus())
    with pytest.raises(ValueError):
        again.insert(docs.where("doc_id = 5"), "c")


def test_filters_grow(spark, monkeypatch):
    index = lines.Index(spark, scratch(spark, "t-lines-grow"), shards=2)
    few, many = (spark.range(a, b).select(F.col("id").alias("doc_id"), F.concat(F.lit("line of document "), (F.col("id") % 900).cast("string")).alias("text")) for a, b in ((0, 5), (5, 2000)))
    index.insert(few, "a")
    sizes = {r["shard"]: len(r["table"]) for r in index._filters().collect()}
    index.insert(many, "b")
    assert all(len(r["table"]) > sizes.get(r["shard"], 0) for r in index._filters().collect())
    assert index.counts().count() == 900 and index.repeated().count() == 1100


def test_odd_rows(spark):
    rows = [(1, "same line in all"), (1, "same line in all\nother text here"), (None, "same line in all"), (None, "only with null ids"), (None, "only with null ids"), (7, None), (8, ""), (2, "Other Text Here")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("doc", "h1", "h2", "n", "d", "t", "first", "_doc", "shard", "cut")})
    index = lines.Index(spark, scratch(spark, "t-lines-odd"))
    index.insert(docs, "a")
    assert cleaned(index, docs) == brute(rows)
    out = index.cleaned(docs)
    assert {*docs.columns, "n_lines", "n_dropped"} == {*out.columns} and {r["h1"] for r in out.collect()} == {"x"}
    empty = spark.createDataFrame([], DOCS)
    index = lines.Index(spark, scratch(spark, "t-lines-none"))
    index.insert(empty, "a")
    assert index.cleaned(empty).collect() == [] and index.repeated().isEmpty()
    assert cleaned(index, spark.createDataFrame(rows[:2], DOCS))[0][2] == 0
    with pytest.raises(ValueError):
        index.insert(empty, "no/name")


def test_query(spark, tmp_path):
    rows = corpus(5)
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in lines.op11_line_dedup(spark, str(tmp_path)).collect()}
    import hashlib

    assert found == {i: (n, d, hashlib.sha256((t or "").encode()).hexdigest()) for i, n, d, t in brute(rows)}
