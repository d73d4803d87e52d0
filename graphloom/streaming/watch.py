"""Watching a source of change events: a quiet gap closes a batch, and each batch is one incremental run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators import resolve, storage
from graphloom.sources import parse

QUIET = "500 milliseconds"


def bursts(events: DataFrame, key: str, quiet: str = QUIET, watermark: str = "10 minutes", time_col: str = "ts") -> DataFrame:
    """(key, start, end, n) of runs of events with no gap of `quiet`; batch and streaming frames alike."""
    timed = events.withWatermark(time_col, watermark) if events.isStreaming else events
    by = timed.groupBy(F.session_window(time_col, quiet).alias("w"), F.col(key))
    return by.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame, key: str, watermark: str = "10 minutes", time_col: str = "ts") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(time_col, watermark).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def watch(events: DataFrame, reindex: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Runs reindex(paths, batch) on the distinct paths of each micro-batch of change events (`path`).

    A batch that is given again has the same number, so a reindex that records it is idempotent.
    """

    def each(batch: DataFrame, number: int) -> None:
        reindex(batch.select("path").distinct(), number)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def incremental(files: DataFrame, hashes: DataFrame, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parsed, hashes) after a run: only files that are new or whose content changed are parsed, deleted ones go, the rest is kept.

    parsed and the result have the columns of parse.extract; hashes (path, hash).
    """
    now = files.withColumn("hash", storage.content_hash(F.col("content")))
    changes = storage.changed_files(now, hashes)
    todo = now.join(changes.where("change <> 'deleted'").select("path"), "path", "left_semi")
    kept = parsed.join(changes.select("path"), "path", "left_anti").select(*parsed.columns)
    return kept.unionByName(parse.extract(todo)), now.select("path", "hash")


def graph(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of parsed files, resolved."""
    symbols = parse.nodes_of(parsed)
    nodes = resolve.as_nodes(symbols.withColumn("is_test_file", resolve.is_test_path(F.col("path")))).unionByName(resolve.file_nodes(parsed.select("path", "language")))
    return nodes, resolve.resolve(parse.edges_of(parsed), nodes)


def changed_notes(facts_hashes: DataFrame, saved: DataFrame) -> DataFrame:
    """(path, state): new, changed or unchanged against saved (path, hash)."""
    joined = facts_hashes.select("path", F.col("hash").alias("_now")).join(saved.select("path", F.col("hash").alias("_then")), "path", "left")
    return joined.select("path", F.when(F.col("_then").isNull(), "new").when(F.col("_then") != F.col("_now"), "changed").otherwise("unchanged").alias("state"))
