"""Whose lines are left: differences along each file's chain of versions, without a version-control tool.

Versions of a file are compared one after the other. A difference is the smallest there is: it keeps a longest common subsequence
of lines, found by rows of bits (a bit a line, one addition of long integers a line of the other side) and by halving, so the time is
lines times lines / 64 and the memory linear. Common beginnings and ends are taken off first. Lines that are kept keep their author,
the others get that of the version that brings them.

Rows come sorted by file and version and are folded as they pass: a task holds the last version of one file, however long its chain is.
A file's versions are one sequence, so they are worked through in one task; different files are spread over all.

A null text is an empty file without lines, so is an empty text; the last newline of a text begins no line. A null author is one of its own. Of
several rows of one version of a file the greatest (author, text) counts. Rows without a path or version are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.storage import ship

CHANGES = "path string, version long, author string, added long, removed long, n_lines long"
LEFT = "path string, author string, lines long"


def _ends(a: list[int], b: list[int]) -> list[int]:
    """At k: how long a common subsequence of a[:k] and b is at most, for k from 0 to len(a)."""
    full = (1 << len(a)) - 1
    where: dict[int, int] = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    row = full
    for x in b:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    out, n = [0], 0
    for bit in format(row, f"0{len(a)}b")[::-1] if a else "":
        n += bit == "0"
        out.append(n)
    return out


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (in a, in b) of a longest common subsequence, in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        if b1 - b0 == 1:
            if b[b0] in a[a0:a1]:
                out.append((a.index(b[b0], a0, a1), b0))
            continue
        mid = (b0 + b1) // 2
        head = _ends(a[a0:a1], b[b0:mid])
        tail = _ends(a[a0:a1][::-1], b[mid:b1][::-1])[::-1]
        cut = a0 + max(range(len(head)), key=lambda k: (head[k] + tail[k], -k))
        todo += [(a0, cut, b0, mid), (cut, a1, mid, b1)]
    return sorted(out)


def lines_of(text: str | None) -> list[str]:
    """The lines of a text, without an empty one after the last newline."""
    lines = (text or "").split("\n")
    return lines[:-1] if not lines[-1] else lines


def numbered(lines: list[str], numbers: dict[str, int]) -> list[int]:
    return [numbers.setdefault(line, len(numbers)) for line in lines]


def _chains(versions: DataFrame) -> DataFrame:
    one = versions.select(F.col("path").cast("string"), F.col("version").cast("long"), F.col("author").cast("string"), F.col("content").cast("string")).where("path IS NOT NULL AND version IS NOT NULL")
    one = one.groupBy("path", "version").agg(F.max(F.struct("author", "content")).alias("s")).select("path", "version", "s.author", "s.content")
    return one.repartition("path").sortWithinPartitions("path", "version")


def _folded(versions: DataFrame, schema: str, final: bool) -> DataFrame:
    """Rows of CHANGES a version, or (final) of LEFT a file and author of its last version."""
    ship(versions.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in schema.split(", ")]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names)
        path, lines, owners = None, [], []
        for batch in batches:
            rows = []
            for p, version, author, text in zip(*(batch.column(k) for k in range(4)), strict=True):
                p, author = p.as_py(), author.as_py()
                if p != path:
                    if final and path is not None:
                        rows += [(path, who, n) for who, n in Counter(owners).items()]
                    path, lines, owners = p, [], []
                fresh, numbers = lines_of(text.as_py()), {}
                kept = common(numbered(lines, numbers), numbered(fresh, numbers))
                mine = [author] * len(fresh)
                for a, b in kept:
                    mine[b] = owners[a]
                if not final:
                    rows.append((p, version.as_py(), author, len(fresh) - len(kept), len(lines) - len(kept), len(fresh)))
                lines, owners = fresh, mine
            yield made(rows)
        if final and path is not None:
            yield made([(path, who, n) for who, n in Counter(owners).items()])

    return _chains(versions).mapInArrow(run, schema)


def line_changes(versions: DataFrame) -> DataFrame:
    """(path, version, author, added, removed, n_lines) of each version (path, version, author, content) of each file."""
    return _folded(versions, CHANGES, final=False)


def lines_left(versions: DataFrame) -> DataFrame:
    """(path, author, lines): how many lines of each file's last version each author has brought."""
    return _folded(versions, LEFT, final=True)


def as_blame(left: DataFrame) -> DataFrame:
    """lines_left() as what ownership is made from."""
    return left.select("path", F.col("author").alias("author_name"), F.col("author").alias("author_email"), "lines")


def changed_between(versions: DataFrame, old: int, new: int) -> DataFrame:
    """(path, change): files that differ between two versions of the whole; a file is in a state until its next version, a null content means that it is gone."""
    state = lambda until: F.max_by(F.struct(F.sha2(F.col("content").cast("binary"), 256).alias("hash")), F.when(F.col("version") <= until, F.col("version")))
    both = versions.groupBy("path").agg(state(old)["hash"].alias("a"), state(new)["hash"].alias("b")).where("NOT a <=> b")
    return both.select("path", F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "deleted").otherwise("changed").alias("change"))
