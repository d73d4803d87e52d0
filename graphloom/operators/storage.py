"""Storage maintenance on immutable tables: upserts, deletions by path, updates by id, file hashes."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Only a local master may go without: it gets a new one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Paths of intermediates in the order they were made, for release().
_MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"


#: Spark deletes the shuffle files of what is run once it has ended; otherwise they stay until the driver collects garbage.
TIDY_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """What is run to its end inside has this setting; then the session is as before."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def tidy(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Writes inside leave no shuffle files behind."""
    return setting(spark, TIDY_SETTING, "true")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage, survives lost executors. release() deletes it."""
    path = scratch(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    _MADE.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt over tasks by keys, for rows that cost far more to work on than to send.

    A table of one file is read by a task or two, and a small shuffle is put together again by adaptive execution; a number given is kept.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def mark() -> int:
    """The place up to which intermediates exist, to be given to release()."""
    return len(_MADE)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes the intermediates stored since a mark, but for the last `keep`; for callers that read them no more."""
    upto = max(since, len(_MADE) - keep)
    for path in _MADE[since:upto]:
        remove(spark, path)
    del _MADE[since:upto]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder by Hadoop's file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives Python workers this package, once an application: a zip of its sources, a few hundred kB."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="graphloom-")), "graphloom_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet folder was written to its end."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def upsert(current: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("id",), order: str | None = None) -> DataFrame:
    """current with new rows replacing those of the same keys; among new rows of one key the greatest `order` wins."""
    if order is not None:
        new = new.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
    else:
        new = new.dropDuplicates(list(keys))
    kept = current.join(new.select(*keys), list(keys), "left_anti")
    return kept.select(*current.columns).unionByName(new.select(*current.columns))


def delete_paths(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes of these paths (`path`) and all edges that touch them."""
    gone = nodes.join(paths.select("path").distinct(), "path", "left_semi").select(F.col("id").alias("_gone"))
    kept = nodes.join(paths.select("path").distinct(), "path", "left_anti").select(*nodes.columns)
    left = edges.join(gone, edges["src"] == F.col("_gone"), "left_anti").join(gone, edges["dst"] == F.col("_gone"), "left_anti")
    return kept, left


def upsert_tags(current: DataFrame, new: DataFrame) -> DataFrame:
    """Tags by id; new ones replace."""
    return upsert(current, new)


def delete_tags(tags: DataFrame, paths: DataFrame) -> DataFrame:
    return tags.join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_anti").select(*tags.columns)


def update_by_id(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """table with the other columns of changes where these hold a value for the row's key."""
    renamed = changes.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_new_{c}") for c in changes.columns if c != key))
    joined = table.join(renamed, table[key] == F.col("_key"), "left")
    return joined.select(*(F.coalesce(F.col(f"_new_{c}"), table[c]).alias(c) if c != key and c in changes.columns else table[c] for c in table.columns))


def clear_communities(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("community", F.lit(0).cast("long"))


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def changed_files(current: DataFrame, hashes: DataFrame) -> DataFrame:
    """(path, change): new, changed or deleted, of files (path, hash) against stored hashes."""
    joined = current.select("path", F.col("hash").alias("_now")).join(hashes.select("path", F.col("hash").alias("_then")), "path", "full_outer")
    change = F.when(F.col("_then").isNull(), "new").when(F.col("_now").isNull(), "deleted").when(F.col("_now") != F.col("_then"), "changed")
    return joined.select("path", change.alias("change")).where("change IS NOT NULL")


def kept_edges(edges: DataFrame, nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """Edges of which both ends are known and in unchanged files (`path` of changed)."""
    good = nodes.join(changed.select("path").distinct(), "path", "left_anti").select(F.col("id").alias("_good"))
    return edges.join(good, edges["src"] == F.col("_good"), "left_semi").join(good, edges["dst"] == F.col("_good"), "left_semi")


def evicted(repos: DataFrame, budget: int) -> DataFrame:
    """(id, size, evict): least recently used first, until the rest fits the budget."""
    order = W.orderBy("last_used_at", "id").rowsBetween(W.unboundedPreceding, -1)
    total = repos.agg(F.sum("size").alias("_total"))
    before = F.coalesce(F.sum("size").over(order), F.lit(0))
    return repos.join(F.broadcast(total)).select("id", "size", (F.col("_total") - before > budget).alias("evict"))


def touched(repos: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """repos with last_used_at set to now where their id is among ids (`id`)."""
    used = ids.select(F.col("id").alias("_used")).distinct()
    kind = repos.schema["last_used_at"].dataType
    return repos.join(used, repos["id"] == F.col("_used"), "left").withColumn("last_used_at", F.when(F.col("_used").isNotNull(), now.cast(kind)).otherwise(F.col("last_used_at"))).select(*repos.columns)


def registry(entries: DataFrame, present: DataFrame) -> DataFrame:
    """entries (path, db_path) with state: kept if their path is among those present (`path`), else orphaned."""
    there = present.select(F.col("path").alias("_there")).distinct()
    return entries.join(there, entries["path"] == F.col("_there"), "left").select(*entries.columns, F.when(F.col("_there").isNotNull(), "kept").otherwise("orphaned").alias("state"))


def untracked(stored_files: DataFrame, kept: DataFrame) -> DataFrame:
    """Files (`path`) that no kept entry names as its db_path."""
    return stored_files.join(kept.select(F.col("db_path").alias("path")), "path", "left_anti")


def positions(df: DataFrame, key: str) -> DataFrame:
    """df with `position`, its place from 0 in the order of a unique key.

    Ranks are taken per range of keys and shifted by what comes before, so no task sees all rows.
    """
    parts = stored(df.repartitionByRange(key).withColumn("_p", F.spark_partition_id()), "ranges")
    before = parts.groupBy("_p").agg(F.count("*").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    ranks = parts.withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy(key))).join(F.broadcast(before), "_p")  # a row a range
    return ranks.select(*df.columns, (F.col("_before") + F.col("_r") - 1).cast("long").alias("position"))


def snapshots_missing(commits: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Commits without a stored snapshot yet."""
    return commits.join(snapshots.select(F.col("commit_sha").alias("sha")), "sha", "left_anti")
