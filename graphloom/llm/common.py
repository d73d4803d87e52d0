"""What the corpus operators share: the shared work folder, hashes of byte spans, connected components."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.storage import mark, release, remove, scratch, ship, stored, tidy

__all__ = ["batches", "components", "lean", "mark", "met", "mix64", "offsets_of", "release", "remove", "runs", "scratch", "ship", "slices", "stored", "text_bytes", "tidy", "trim"]

#: Bytes of text that a worker turns into Python objects at a time. Spark itself ends an Arrow batch at 64 MB or the session's number of rows.
SLICE_BYTES = 2_000_000


def slices(texts, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, end) of slices of an Arrow array of texts, each of at most so many bytes, or one text."""
    offsets = offsets_of(texts)
    at, n = 0, len(texts)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to


#: Rows of an Arrow batch of whole texts, inside batches().
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


@contextlib.contextmanager
def batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """What is run to its end inside, in jobs that pass whole texts to Python, has batches of at most so many rows; then the session is as before."""
    before = spark.conf.get(BATCH_SETTING)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(BATCH_SETTING, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def offsets_of(column) -> np.ndarray:
    """The n + 1 offsets of an Arrow string or binary array into its bytes."""
    import pyarrow as pa

    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4))


def trim() -> None:
    """Gives memory that this worker no longer uses back to the system; workers live on from stage to stage."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run):
    """A function of Arrow batches that trims at its end, and between batches once a second."""

    def fed(batches):
        last = time.monotonic()
        for batch in batches:
            yield batch
            if time.monotonic() - last > 1:
                trim()
                last = time.monotonic()

    def out(batches):
        yield from run(fed(batches))
        trim()

    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit words; wraps."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Of an Arrow string or binary array: its bytes without a copy, and the n + 1 offsets into them. Nulls are empty."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8).copy()
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    if column.null_count:
        valid = np.asarray(column.is_valid())
        if (np.diff(offsets)[~valid] > 0).any():  # bytes under a null are no text
            parts = [raw[a:b] if ok else raw[:0] for a, b, ok in zip(offsets[:-1], offsets[1:], valid, strict=True)]
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            raw = np.concatenate(parts)
    return raw, offsets


#: A key is hot if it has more rows than HUB, and more than one in HUB_SHARE of all.
HUB, HUB_SHARE = 1000, 1_000_000


def met(rows: DataFrame, sums: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """rows joined with sums, which has a row a key and in `count` (then dropped) how many of the `total` rows have it at most.

    Rows of a hot key stay where they are and get its row by broadcast: with total rows there are at most total / HUB and HUB_SHARE
    hot keys. The others meet by shuffle, where no key has more rows than that. Both frames are read more than once, so they should be stored.
    """
    most = max(HUB, total // HUB_SHARE)
    if total <= most or sums.where(F.col(count) > most).isEmpty():
        return rows.join(sums.drop(count), keys)
    hot = sums.where(F.col(count) > most).drop(count)
    cold = sums.where(F.col(count) <= most).drop(count)
    near = rows.join(F.broadcast(hot), keys)
    far = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return near.unionByName(far)


def components(links: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """Connected components of links (a, b of one orderable type; any order, repeats allowed): rows (id, component), component the smallest id.

    Alternating large-star and small-star steps; each is one aggregation and one join, so no node's
    neighbours are ever gathered in a row, nor the links of a hub in a task. Stops when a round changes
    nothing; each round's file is deleted once the next is written.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    spark, print_of = links.sparkSession, (F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    edges = stored(edges, name)
    seen = edges.agg(*print_of).first()
    for _ in range(rounds):
        since = mark()
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), f"{name}-low")
        large = met(both.where("v > u"), low, ["u"], "n", 2 * seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, f"{name}-large")
        lowest = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), f"{name}-lowest")
        small = met(large, lowest, ["u"], "n", seen[0]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = stored(small, name)
        now = new.agg(*print_of).first()
        release(spark, since - 1, keep=1)  # the last round's links, and this one's sums
        edges = new
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components: no fixpoint after {rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())


def runs(batches, columns: int):
    """Tables of the rows with equal values in the first `columns` columns; batches come sorted by these. Nothing but one such run is held."""
    import pyarrow as pa

    held: list = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = [np.asarray(batch.column(c)) if pa.types.is_integer(batch.schema.field(c).type) else np.array(batch.column(c).to_pylist(), object) for c in range(columns)]
        cut = np.zeros(n - 1, bool)
        for k in keys:
            cut |= k[1:] != k[:-1]
        edges = [0, *(np.flatnonzero(cut) + 1).tolist(), n]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(k[a] for k in keys)
            if key != last and held:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
