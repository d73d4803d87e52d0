"""Periodic runs: the suffix-array kernel against all periods of all stretches, and the query against the definition."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import periodic
from tests.llm.test_operators import sentence

DOCS = "doc_id long, text string"


def brute_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def brute(key, text, rewrite=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), None if key is None else zlib.crc32(str(key).encode())
    if rewrite and h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (key, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest("".join(f"{a},{m},{q}\n" for a, m, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def check(texts):
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    found = [[] for _ in texts]
    for t, a, m, q in np.stack(periodic.runs_of(np.array([x for t in texts for x in t], np.int64), bounds), 1).tolist():
        found[t].append((a, m, q))
    assert found == [brute_runs(t) for t in texts]


def test_kernel_on_random_and_periodic_words(monkeypatch):
    rng = random.Random(7)
    for _ in range(400):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            n, k = rng.randrange(0, 70), rng.choice([1, 2, 2, 3, 6])
            text = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randrange(3, 9)
                text = [text[i] if i < a else text[a + (i - a) % p] for i in range(n)]
            texts.append(text)
        check(texts)
    monkeypatch.setattr(periodic, "ASKED", 3)  # many rounds of few suffixes
    check([[0, 1] * 9 + [2] + [0, 1, 0] * 5, [4] * 30, []])


def test_kernel_on_structured_words():
    check([fibonacci(400), [0] * 500, [0, 1] * 200, fibonacci(90) * 5, list(range(100)) * 4, [0, 0, 1] * 60 + [0, 0]])


def test_words_are_cut_as_the_pattern_does():
    import pyarrow as pa

    from graphloom.llm.common import text_bytes

    texts = ["a b", "", None, " \t\x0b\x0c\r\n", "é x  y\x1fz", "end ", " start", "x"]
    words, bounds = periodic.words_of(*text_bytes(pa.array(texts)))
    cut = [w.decode() for w in words.to_pylist()]
    assert [cut[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def corpus():
    rng = random.Random(9)
    texts = [sentence(rng, rng.randrange(0, 150)) for _ in range(60)]
    texts += [None, "", "   ", "zeta " * 400, "a b " * 30 + sentence(rng, 20), "one two three\n" * 5, sentence(rng, 9000), "Ü é " * 9 + "x y", "w w w w w", "w w w w w w"]
    return [*enumerate(texts), (None, "null id " * 8), (3, "again and again " * 6)]


def test_query_equals_the_definition(spark, tmp_path):
    rows = corpus()
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("id", "n", "start", "length", "period", "collapsed")})
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(map(tuple, periodic.op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert found == sorted((brute(*r) for r in rows), key=str)


def test_collapsed_texts_and_empty_tables(spark):
    rows = [(0, "keep this. so so so so so so so many words"), (1, None), (2, "a b a b a b a b")]
    out = {r["id"]: r["collapsed"] for r in periodic.periodic_runs(spark.createDataFrame(rows, DOCS), with_text=True).collect()}
    assert out == {0: "keep this. so many words", 1: "", 2: "a b"}
    assert periodic.periodic_runs(spark.createDataFrame([], DOCS)).collect() == []
