"""Bursts of change events over all paths of a root, closed by a quiet gap, and committed to a versioned store.

A root's burst goes on while its next event, on whatever path, comes within the gap. The stream keeps the open bursts of each root as
state: their spans in one value, their paths in a map with an entry a (burst, path). Late events within the watermark extend
bursts and may join two. A timer at a burst's end closes it once the watermark is there, so that no event that is still to come
could extend it; then it is given out, a row a path, and forgotten.

Rows without a root, path or time are left out. Events that are later than the watermark are dropped, as in any windowed stream.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from graphloom.operators.storage import ship
from graphloom.operators.store import GraphStore

BURSTS = "root string, start timestamp, end timestamp, n bigint, path string, n_path bigint"
_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def spans_of(times: list[int], gap: int) -> list[tuple[int, int]]:
    """(first, last) of the bursts of sorted times."""
    out: list[tuple[int, int]] = []
    for t in times:
        if out and t < out[-1][1] + gap:
            out[-1] = (out[-1][0], t)
        else:
            out.append((t, t))
    return out


def merged(spans: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """(first, last, n) of bursts that don't touch, of such that may."""
    out: list[tuple[int, int, int]] = []
    for a, b, n in sorted(spans):
        if out and a < out[-1][1] + gap:
            out[-1] = (out[-1][0], max(out[-1][1], b), out[-1][2] + n)
        else:
            out.append((a, b, n))
    return out


class BurstCloser(StatefulProcessor):
    """Times in microseconds; a burst is known by its first."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "spans array<struct<first: bigint, last: bigint, n: bigint>>")
        self.paths = handle.getMapState("paths", "first bigint, path string", "n bigint")

    def _spans(self) -> list[tuple[int, int, int]]:
        return [(s["first"], s["last"], s["n"]) for s in self.open.get()[0]] if self.open.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        fresh: list[tuple[int, int, int]] = []
        counted: Counter = Counter()
        for pdf in rows:
            times = pdf["ts"].astype("int64").to_numpy() // (1000 if str(pdf["ts"].dtype).startswith("datetime64[ns") else 1)
            spans = spans_of(sorted(times.tolist()), self.gap)
            firsts, sizes = [a for a, _ in spans], Counter()
            for t, path in zip(times.tolist(), pdf["path"], strict=True):
                first = firsts[bisect_right(firsts, t) - 1]
                sizes[first] += 1
                counted[first, path] += 1
            fresh += [(a, b, sizes[a]) for a, b in spans]
        before = self._spans()
        after = merged(before + fresh, self.gap)
        home = lambda t: next(a for a, b, _ in after if a <= t <= b)
        moved = {a for a, _, _ in before} - {a for a, _, _ in after}
        if moved:  # bursts that an earlier event has opened, or joined to another
            for k, n in [(k, n) for k, n in self.paths.iterator() if k[0] in moved]:
                counted[k[0], k[1]] += n[0]
                self.paths.removeKey(k)
        sums: Counter = Counter()
        for (first, path), n in counted.items():
            sums[home(first), path] += n
        for k, n in sums.items():
            self.paths.updateValue(k, ((self.paths.getValue(k)[0] if self.paths.containsKey(k) else 0) + n,))
        self.open.update(([{"first": a, "last": b, "n": n} for a, b, n in after],))
        for _, b, _ in after:
            self.handle.registerTimer(self._end(b))
        return iter(())

    def _end(self, last: int) -> int:
        """Milliseconds, rounded up."""
        return -(-(last + self.gap) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        now = timerValues.getCurrentWatermarkInMs()
        spans = self._spans()
        closing = {a: (b, n) for a, b, n in spans if self._end(b) <= now}
        if not closing:
            return
        rows = []
        for k, n in [(k, n) for k, n in self.paths.iterator() if k[0] in closing]:
            last, total = closing[k[0]]
            rows.append((key[0], k[0], last + self.gap, total, k[1], n[0]))
            self.paths.removeKey(k)
        rest = [{"first": a, "last": b, "n": n} for a, b, n in spans if a not in closing]
        if rest:
            self.open.update((rest,))
        else:
            self.open.clear()
        out = pd.DataFrame(rows, columns=["root", "start", "end", "n", "path", "n_path"])
        for c in ("start", "end"):
            out[c] = pd.to_datetime(out[c], unit="us", utc=True)
        yield out

    def close(self) -> None:
        pass


def closed_bursts(events: DataFrame, gap_ms: int = 500, watermark: str = "10 minutes") -> DataFrame:
    """(root, start, end, n, path, n_path) of each closed burst and path of a stream of events (root, path, ts)."""
    ship(events.sparkSession)
    told = events.select(F.col("root").cast("string"), F.col("path").cast("string"), F.col("ts").cast("timestamp")).where("root IS NOT NULL AND path IS NOT NULL AND ts IS NOT NULL")
    by = told.withWatermark("ts", watermark).groupBy("root")
    return by.transformWithStateInPandas(statefulProcessor=BurstCloser(gap_ms * 1000), outputStructType=BURSTS, outputMode="append", timeMode="EventTime")


def start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query with the state store that map states need; the session's own choice is put back at once, as a query keeps the settings it started with."""
    conf = stream.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKS)
    try:
        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    finally:
        if before is None:
            conf.unset(_PROVIDER)
        else:
            conf.set(_PROVIDER, before)


def commits(store: GraphStore, reindex: Callable[[DataFrame], dict[str, DataFrame]], name: str = "watch") -> Callable[[DataFrame, int], None]:
    """What to do with each micro-batch of closed bursts: one transaction with reindex() of their distinct paths.

    The batch's number is in the transaction's name, so a micro-batch that is given again after a failure changes nothing.
    """

    def each(batch: DataFrame, number: int) -> None:
        paths = batch.select("path").distinct()
        if not paths.isEmpty():
            store.commit(f"{name}-{number}", reindex(paths))

    return each


def watch_into(store: GraphStore, events: DataFrame, reindex: Callable[[DataFrame], dict[str, DataFrame]], checkpoint: str, gap_ms: int = 500, watermark: str = "10 minutes", name: str = "watch", trigger: dict | None = None) -> StreamingQuery:
    """Re-indexes the paths of each closed burst into the store."""
    return start(closed_bursts(events, gap_ms, watermark), commits(store, reindex, name), checkpoint, trigger)
