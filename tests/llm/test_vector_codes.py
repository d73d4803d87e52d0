"""Vector codes: the pruned search against all distances, and codebooks against plain Lloyd rounds."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4):
    """{id: (code, error, label error, digest)}, from the definition."""
    rows = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not rows:
        return []
    x = np.floor(1024 * np.array([r[1] for r in rows], np.float32).astype(np.float64)).astype(np.int64)
    m = x.shape[1] // parts
    books = [x[:entries, p * m : p * m + m].copy() for p in range(parts)]

    def assign():
        apart = [((x[:, None, p * m : p * m + m] - books[p][None]) ** 2).sum(2) for p in range(parts)]
        return [a.argmin(1) for a in apart], sum(a.min(1) for a in apart)

    for _ in range(rounds):
        codes, _ = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = x[codes[p] == e, p * m : p * m + m]
                if len(own):
                    books[p][e] = own.sum(0) // len(own)
    codes, error = assign()
    labels = defaultdict(int)
    for r, e in zip(rows, error.tolist(), strict=True):
        labels[r[2]] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{int(codes[p][k]):02x}" for p in range(parts)), int(error[k]), labels[r[2]], digest) for k, r in enumerate(rows)), key=str)


def coded(spark, rows, tmp_path, extra=False):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:
        df = df.withColumns({c: F.lit("x") for c in ("id", "x", "v", "far", "code", "error", "n", "lab")})
    path = f"{tmp_path}/{len(rows)}-{extra}"
    df.write.parquet(f"{path}/embeddings.parquet")
    return sorted(map(tuple, vc.op12_vector_codes(spark, path).collect()), key=str)


def vectors(n, d=8, seed=1, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, spread, (12, d))
    return [(i, (centres[i % 12] + rng.normal(0, 0.1, d)).astype(np.float32).tolist(), i % 5 if i % 7 else None) for i in range(n)]


@pytest.mark.parametrize("most", [1, 30, 100_000])
def test_pruned_search_equals_all_distances(most):
    rng = np.random.default_rng(most)
    for _ in range(20):
        d, k = rng.integers(1, 9), rng.integers(1, 70)
        x, entries = rng.integers(-most, most + 1, (rng.integers(0, 200), d)), rng.integers(-most, most + 1, (k, d))
        pivots = vc.pivots_of(entries)
        code, best, asked = vc.nearest_entry(x, np.sqrt(vc.squared(x, pivots).astype(np.float64)), entries, pivots)
        apart = vc.squared(x, entries)
        assert (code == apart.argmin(1)).all() and (best == apart.min(1)).all() and asked <= apart.size + 8 * len(x)


def test_bounds_rule_entries_out():
    rng = np.random.default_rng(2)
    entries = rng.integers(-50_000, 50_000, (256, 4))
    x = entries[rng.integers(0, 256, 500)] + rng.integers(-5, 6, (500, 4))
    pivots = vc.pivots_of(entries)
    _, _, asked = vc.nearest_entry(x, np.sqrt(vc.squared(x, pivots).astype(np.float64)), entries, pivots)
    assert asked < 0.2 * 500 * 256


def test_codes_equal_plain_rounds(spark, tmp_path):
    rows = vectors(700)
    assert coded(spark, rows, tmp_path) == brute(rows)
    assert coded(spark, rows, tmp_path, extra=True) == brute(rows)


def test_odd_rows(spark, tmp_path):
    good = vectors(30)
    bad = [(100, None, 1), (101, [1.0] * 7 + [None], 1), (102, [float("nan")] * 8, 1), (103, [float("inf")] + [0.0] * 7, 2)]
    more = [(5, good[5][1], 3), (5, [0.5] * 8, 3), (None, [0.25] * 8, None), (104, [0.0] * 8, None)]  # repeated, null and zero
    assert coded(spark, good + bad + more, tmp_path) == brute(good + bad + more)
    assert coded(spark, bad, tmp_path) == [] and coded(spark, [], tmp_path) == []
    assert len(coded(spark, [(1, [1.0, 2.0], 0)], tmp_path)) == 1


def test_lengths_and_sizes_that_do_not_fit(spark, tmp_path):
    rows = [(1, [1.0, 2.0, 3.0], 0), (2, [1.0], 0), (3, [], 0), (4, [3e38, -3e38, 1.0, 0.0, 5.0], 1)]
    filled = [(i, [min(max(x, -32768.0), 32768.0) for x in v] + [0.0] * (8 - len(v)), label) for i, v, label in rows]
    assert coded(spark, rows, tmp_path) == brute(filled)
