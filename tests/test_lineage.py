"""Differences against the plain table of a longest common subsequence; chains folded over batches."""

import random

from graphloom.operators import lineage

VERSIONS = "path string, version long, author string, content string"


def length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    return row[-1]


def test_differences_are_smallest():
    rng = random.Random(1)
    for _ in range(400):
        k = rng.choice([1, 2, 4, 20])
        a = [rng.randrange(k) for _ in range(rng.randrange(0, 25))]
        b = [x for x in a if rng.random() < 0.7] if rng.random() < 0.5 else [rng.randrange(k) for _ in range(rng.randrange(0, 25))]
        for _ in range(rng.randrange(3)):
            b.insert(rng.randrange(len(b) + 1), rng.randrange(k))
        kept = lineage.common(a, b)
        assert all(a[x] == b[y] for x, y in kept) and len(kept) == length(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(kept, kept[1:], strict=False))
    assert lineage.common([], []) == [] and len(lineage.common(list(range(3000)), list(range(1, 3001)))) == 2999


def corpus():
    rng = random.Random(3)
    rows = []
    for p in range(6):
        lines = [f"line {rng.randrange(12)}" for _ in range(rng.randrange(0, 30))]
        for v in range(1, 7):
            rows.append((f"p{p}", v, rng.choice("abc"), "\n".join(lines)))
            for _ in range(rng.randrange(5)):
                if lines and rng.random() < 0.5:
                    lines.pop(rng.randrange(len(lines)))
                else:
                    lines.insert(rng.randrange(len(lines) + 1), f"line {rng.randrange(20)}")
    return [*rows, ("nulls", 1, "a", None), ("nulls", 2, None, "x\ny\n"), ("nulls", 3, "a", ""), ("one", 5, "z", "\n\n"), (None, 1, "a", "x"), ("late", None, "a", "x")]


def test_chains(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, VERSIONS).repartition(3)
    found = {(r["path"], r["version"]): (r["author"], r["added"], r["removed"], r["n_lines"]) for r in lineage.line_changes(df).collect()}
    before, want = {}, {}
    for p, v, who, text in sorted((r for r in rows if r[0] and r[1]), key=lambda r: r[:2]):
        now = lineage.lines_of(text)
        n = length(before.get(p, []), now)
        want[p, v] = (who, len(now) - n, len(before.get(p, [])) - n, len(now))
        before[p] = now
    assert found == want
    left = lineage.lines_left(df).collect()
    sizes = {}
    for r in left:
        sizes[r["path"]] = sizes.get(r["path"], 0) + r["lines"]
    assert sizes == {p: len(now) for p, now in before.items() if now}
    sure = spark.createDataFrame([("f", 1, "ann", "a\nb\nc\n"), ("f", 2, "bob", "a\nB\nc\nd\n"), ("f", 3, "ann", "d\na\nB\n"), ("f", 3, "aaa", "not the greatest")], VERSIONS)
    assert sorted((r["author"], r["lines"]) for r in lineage.lines_left(sure).collect()) == [("ann", 2), ("bob", 1)]
    none = spark.createDataFrame([], VERSIONS)
    assert lineage.line_changes(none).collect() == [] and lineage.lines_left(none).collect() == []


def test_changed_between(spark):
    df = spark.createDataFrame([("a", 1, "x", "1"), ("a", 3, "x", "2"), ("b", 1, "x", "1"), ("c", 3, "x", "1"), ("d", 1, "x", "1"), ("d", 2, "x", None), ("e", 1, "x", "1"), ("e", 2, "x", "2"), ("e", 3, "x", "1"), ("f", 9, "x", "1")], VERSIONS)
    assert {r["path"]: r["change"] for r in lineage.changed_between(df, 1, 3).collect()} == {"a": "changed", "c": "new", "d": "deleted"}
