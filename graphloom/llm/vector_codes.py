"""Compression of vectors to short codes: integer product quantisation with pivots that save distance evaluations.

Components become floor(SCALE * x). A vector is cut into PARTS equal parts; each part position has a codebook of at most ENTRIES
integer entries, at first that part of the vectors of smallest id. A round assigns every part to its nearest entry (squared
distance, ties to the lower index) and replaces each entry that has parts by the floor of their mean.

The search is LAESA's: PIVOTS fixed points a position are picked once among the first entries, each farthest from those before. The distances
from every part to them are computed once and stored beside it. A round computes those from pivots to entries; as |x - y| is at
least | |x - p| - |y - p| | for each pivot p, the greatest of these bounds orders the entries and rules out those whose bound is
beyond the best exact distance so far. Only the others are evaluated, in integers, the most promising first. Bounds are lowered
by what floating point may have got wrong, and an entry whose bound equals the best is evaluated too, so results are exact.

A round is one pass over the stored table: tasks emit sums and counts by entry, at most PARTS * ENTRIES rows for each HELD rows
or a task, which are summed before and after a shuffle. The driver holds codebooks only: ENTRIES times the length of a vector.

Nulls: rows whose vector is null or holds null or non-finite components are dropped; a null id comes after all others, a null
label is a label. Lengths: shorter vectors, and lengths that PARTS doesn't divide, are filled up with zeros; an empty vector is all
zeros. Components beyond LIMIT in size (in integers) count as LIMIT, so sums of squares fit. Repeated rows: each counts and has its
row; of equal ids the smaller vector comes first. Fewer rows than ENTRIES: as many entries. Empty table: no rows. Other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import lean, met, ship, stored

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
PIVOTS = 8
LIMIT = 1 << 25
#: Rows that a task works on at a time, and for which it holds sums before it sends them.
TILE, HELD = 4096, 1 << 20
#: Entries evaluated at a time for the rows that still have candidates.
STEP = 8


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to each of y, in integers."""
    return np.stack([((x - row) ** 2).sum(1) for row in y], 1) if len(y) else np.zeros((len(x), 0), np.int64)


def pivots_of(entries: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Rows of entries, each the farthest from those before (ties to the lower index); the first is the one farthest from entry 0."""
    chosen: list[int] = []
    near = ((entries - entries[0]) ** 2).sum(1)
    for _ in range(min(count, len(entries))):
        chosen.append(int(near.argmax()))
        apart = ((entries - entries[chosen[-1]]) ** 2).sum(1)
        near = np.minimum(near, apart) if len(chosen) > 1 else apart
    return entries[chosen]


def nearest_entry(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row of x (n, d), whose distances to the pivots are known (n, p): the nearest entry, its squared distance, and how many were evaluated in all."""
    from_pivots = np.sqrt(squared(entries, pivots).astype(np.float64))
    bound = np.zeros((len(x), len(entries)))
    for p in range(len(pivots)):
        gap = np.abs(to_pivots[:, p, None] - from_pivots[None, :, p])
        gap -= 1e-12 * (to_pivots[:, p, None] + from_pivots[None, :, p])
        np.maximum(bound, gap, out=bound)
    bound *= bound
    bound *= 1 - 1e-12
    order = np.argsort(bound, axis=1)
    bound = np.take_along_axis(bound, order, 1)
    best = np.full(len(x), np.iinfo(np.int64).max)
    code = np.full(len(x), len(entries))
    live, asked = np.arange(len(x)), 0
    for at in range(0, len(entries), STEP):
        live = live[bound[live, at] <= best[live]]
        if not len(live):
            break
        tried = order[live, at : at + STEP]
        asked += tried.size
        apart = ((entries[tried] - x[live, None, :]) ** 2).sum(2)
        least = apart.min(1)
        low = np.where(apart == least[:, None], tried, len(entries)).min(1)
        better = (least < best[live]) | ((least == best[live]) & (low < code[live]))
        best[live[better]], code[live[better]] = least[better], low[better]
    return code, best, asked


def assigned(x: np.ndarray, to_pivots: np.ndarray, books: list[np.ndarray], pivots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(n, parts) codes and squared distances of vectors (n, d) with distances to pivots (n, all of them by part)."""
    width, at, codes, errors = x.shape[1] // len(books), 0, [], []
    for part, (book, own) in enumerate(zip(books, pivots, strict=True)):
        code, error, _ = nearest_entry(x[:, part * width : (part + 1) * width], to_pivots[:, at : at + len(own)], book, own)
        at += len(own)
        codes.append(code)
        errors.append(error)
    return np.stack(codes, 1), np.stack(errors, 1)


def _matrix(column, kind) -> np.ndarray:
    """An Arrow list column whose lists are all of one length."""
    return np.asarray(column.flatten()).astype(kind).reshape(len(column), -1)


def integers(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """vectors' rows with usable vectors, and `x`: their integer components. No row is moved."""
    v = F.col(vector_col).cast("array<double>")
    fit = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))
    whole = F.transform(v, lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int"))
    return vectors.where(fit).withColumn("x", whole)


class Codes:
    """Codebooks learned from a table of vectors, and the table's codes under them."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS):
        ship(vectors.sparkSession)
        self.parts = parts
        plain = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("string").alias("label"), vectors[vector_col].alias("v"))
        rows = integers(plain, "v").select("id", "label", "x")
        longest = rows.agg(F.max(F.size("x"))).first()[0]
        self.width = 0 if longest is None else max(1, -(-longest // parts))  # components of a part
        size = self.width * parts
        rows = rows.withColumn("x", F.when(F.size("x") < size, F.concat("x", F.array_repeat(F.lit(0), F.lit(size) - F.size("x")))).otherwise(F.col("x")))
        first = rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()  # a codebook's size, not the data's
        start = np.array([r["x"] for r in first], np.int64).reshape(len(first), size)
        self.books = [start[:, p * self.width : (p + 1) * self.width].copy() for p in range(parts)]
        self.pivots = [pivots_of(b) if len(b) else b for b in self.books]
        self.rows = stored(self._measured(rows), "vector-parts") if len(first) else None
        self.empty = rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).where("false")
        for _ in range(rounds if len(first) else 0):
            self._round()

    def _measured(self, rows: DataFrame) -> DataFrame:
        """With distances to all pivots, in the order of parts."""
        pivots, width = self.pivots, self.width

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                for at in range(0, batch.num_rows, TILE):
                    part = batch.slice(at, TILE)
                    x = _matrix(part.column(2), np.int64)
                    far = np.concatenate([np.sqrt(squared(x[:, p * width : (p + 1) * width], own).astype(np.float64)) for p, own in enumerate(pivots)], 1)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, far.size + 1, far.shape[1]), pa.int32()), pa.array(far.ravel()))
                    yield pa.RecordBatch.from_arrays([*part.columns, lists], ["id", "label", "x", "far"])

        return rows.mapInArrow(lean(run), "id long, label string, x array<int>, far array<double>")

    def _round(self) -> None:
        """One assignment and new entries."""
        books, pivots, width = self.books, self.pivots, self.width

        def sums(held: list[np.ndarray], counts: list[np.ndarray]):
            import pyarrow as pa

            parts, entries = zip(*((p, e) for p, n in enumerate(counts) for e in np.flatnonzero(n).tolist()), strict=True)
            values = np.concatenate([held[p][n > 0] for p, n in enumerate(counts)])
            many = np.concatenate([n[n > 0] for n in counts])
            at = np.tile(np.arange(width), len(parts))
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(c, np.int32), width)) for c in (parts, entries)] + [pa.array(at.astype(np.int32)), pa.array(values.ravel()), pa.array(np.repeat(many, width))], ["part", "entry", "at", "s", "n"])

        def run(batches: Iterator) -> Iterator:
            fresh = lambda: ([np.zeros(b.shape, np.int64) for b in books], [np.zeros(len(b), np.int64) for b in books])
            (held, counts), rows = fresh(), 0
            for batch in batches:
                for tile in range(0, batch.num_rows, TILE):
                    x, far = _matrix(batch.column(0).slice(tile, TILE), np.int64), _matrix(batch.column(1).slice(tile, TILE), np.float64)
                    codes, _ = assigned(x, far, books, pivots)
                    for p in range(len(books)):
                        np.add.at(held[p], codes[:, p], x[:, p * width : (p + 1) * width])
                        counts[p] += np.bincount(codes[:, p], minlength=len(books[p]))
                    rows += len(x)
                    if rows >= HELD:
                        yield sums(held, counts)
                        (held, counts), rows = fresh(), 0
            if rows:
                yield sums(held, counts)

        told = self.rows.select("x", "far").mapInArrow(lean(run), "part int, entry int, at int, s long, n long")
        found = told.groupBy("part", "entry", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).toPandas()  # a codebook's size
        books = [b.copy() for b in books]
        for p, book in enumerate(books):
            own = found[found["part"] == p]
            book[own["entry"].to_numpy(), own["at"].to_numpy()] = own["s"].to_numpy() // own["n"].to_numpy()
        self.books = books

    def digest(self) -> str:
        """SHA-256 of all entries' components in decimal, by part, entry and position."""
        return hashlib.sha256(",".join(str(c) for b in self.books for c in b.ravel().tolist()).encode()).hexdigest()

    def coded(self) -> DataFrame:
        """(id, label, code, error) of every kept row: two hex digits a part, and the squared distance to what the code stands for."""
        if self.rows is None:
            return self.empty
        books, pivots = self.books, self.pivots

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                for at in range(0, batch.num_rows, TILE):
                    part = batch.slice(at, TILE)
                    codes, errors = assigned(_matrix(part.column(2), np.int64), _matrix(part.column(3), np.float64), books, pivots)
                    texts = [row.tobytes().hex() for row in codes.astype(np.uint8)]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(errors.sum(1))], ["id", "label", "code", "error"])

        return self.rows.mapInArrow(lean(run), "id long, label string, code string, error long")


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with `label_error`, the errors' sum over equal labels (null if beyond a long); rows of a label that many have stay where they are."""
    rows = stored(coded.withColumn("lab", F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))), "vector-codes")
    sums = stored(rows.groupBy("lab").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    return met(rows, sums, ["lab"], "n", rows.count()).drop("lab")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all embeddings."""
    codes = Codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    out = with_label_errors(codes.coded()).withColumn("codebooks_sha256", F.lit(codes.digest()))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")
