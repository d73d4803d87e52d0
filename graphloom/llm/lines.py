"""Reversible line dedup: sharded cuckoo filters in front of exact reference-count tables.

A text is split at newlines. A line's key is the line without blanks at both ends, A-Z in lower case; keys of LEAST code points
or more are known by their 128-bit BLAKE2b digest (two longs). A key that at least two documents hold loses all its lines
but those in the smallest id that holds it.

An Index lives in a folder of the shared store as a chain of versions, each written by one insertion or deletion of documents:
  postings   signed rows (key, doc): +1 where a document came, -1 where it went
  counts     the reference counts: of each key that the version touched, its shard, how many documents hold it from
             now on, and the smallest of them; the newest row of a key counts
  filters    one cuckoo filter a shard and version that changed it, over the keys that any document holds
A key's shard is a remainder of its digest. Insertion sums the batch by key before anything else, so a line that a third of all
documents share is a row a task. Keys that their shard's filter does not know are new, and need no look at the counts; only the
others are joined with them (the filter's false positives turn out to be new there). Deletion takes the document's postings, joins
their keys with the counts, and looks for a new smallest id among the postings of those keys that lost theirs; keys that no
document holds any more leave the filter. So a deletion, and inserting the documents again, gives what was before.

A filter has buckets of four 16-bit fingerprints; a key's second bucket is its first, XORed with a hash of its fingerprint. It is
made anew, larger, from the counts when it fills. There are as many shards as keep a filter at about SHARD_KEYS keys when the
first version is written; later they only grow in size, so choose `shards` for what is to come. A version counts once its mark is written, last; a batch whose name is committed is skipped,
and a batch cut off half-way is written anew. Two writers at once are not kept apart.

Nulls: a null text is one empty line; documents of null ids count as one document, greater than any other. Repeated rows: rows
of one id are one document that holds all their lines; inserting an id again adds to it, deleting it takes all. Empty table: no
rows. Ties cannot occur: equal smallest ids are one document. Long texts: digests of a text's own distinct lines are held, no
more. Other columns are left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import lean, met, mix64, runs, scratch, ship, stored, trim

LEAST = 10
SHARD_KEYS, MOST_SHARDS = 250_000, 1 << 16
SLOTS, LOAD, KICKS = 4, 0.85, 200
BROADCAST_ROWS = 1_000_000
BLANK = " \t\n\x0b\x0c\r"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KEY = ["h1", "h2"]

_U = np.uint64


def key_of(line: str) -> tuple[int, int] | None:
    """The digest of a line's key as two longs; none for short ones."""
    key = line.strip(BLANK)
    if len(key) < LEAST:
        return None
    digest = hashlib.blake2b(key.translate(_LOWER).encode(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


class Cuckoo:
    """A cuckoo filter over distinct 64-bit hashes; adds and removes many at a time."""

    def __init__(self, table: np.ndarray):
        self.table = table  # buckets x SLOTS fingerprints, 0 is free

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        """With room for so many keys."""
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / (SLOTS * LOAD)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    def room(self) -> int:
        """How many keys it takes in all."""
        return int(self.table.size * LOAD)

    def held(self) -> int:
        return int(np.count_nonzero(self.table))

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint, first and second bucket."""
        mask = _U(len(self.table) - 1)
        h = mix64(hashes)
        mark = (h >> _U(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = h & mask
        return mark, first.astype(np.int64), (first ^ self._turn(mark)).astype(np.int64)

    def _turn(self, mark: np.ndarray) -> np.ndarray:
        return mix64(mark.astype(np.uint64)) & _U(len(self.table) - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """False: surely not in it."""
        mark, first, second = self._places(hashes)
        return (self.table[first] == mark[:, None]).any(1) | (self.table[second] == mark[:, None]).any(1)

    def _settle(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Puts fingerprints in their buckets' free slots; which of them found one."""
        order = np.argsort(bucket, kind="stable")
        sorted_bucket = bucket[order]
        nth = np.arange(len(order)) - np.searchsorted(sorted_bucket, sorted_bucket)
        free = self.table[sorted_bucket] == 0
        slot = (np.cumsum(free, 1) == nth[:, None] + 1) & free
        fits = slot.any(1)
        at = slot.argmax(1)
        self.table[sorted_bucket[fits], at[fits]] = mark[order[fits]]
        out = np.zeros(len(mark), bool)
        out[order[fits]] = True
        return out

    def add(self, hashes: np.ndarray) -> bool:
        """False if some found no place; then the filter is to be made anew."""
        mark, first, second = self._places(hashes)
        done = self._settle(mark, first)
        mark, second = mark[~done], second[~done]
        done = self._settle(mark, second)
        mark, bucket = mark[~done], second[~done]
        for kick in range(KICKS):
            if not len(mark):
                return True
            # one of those that wait at a bucket throws out a fingerprint, which then waits at its other bucket
            at = np.unique(bucket, return_index=True)[1]
            here, slot = bucket[at], (mix64(bucket[at].astype(np.uint64) + _U(kick)) % _U(SLOTS)).astype(np.int64)
            out = self.table[here, slot]
            self.table[here, slot] = mark[at]
            rest = np.ones(len(mark), bool)
            rest[at] = False
            mark = np.concatenate([mark[rest], out])
            bucket = np.concatenate([bucket[rest], (here.astype(np.uint64) ^ self._turn(out)).astype(np.int64)])
            done = self._settle(mark, bucket)
            mark, bucket = mark[~done], bucket[~done]
        return not len(mark)

    def remove(self, hashes: np.ndarray) -> None:
        """Takes out hashes that were added."""
        mark, first, second = self._places(hashes)
        for bucket in (first, None):
            bucket = second if bucket is None else bucket
            order = np.lexsort((mark, bucket))
            b, m = bucket[order], mark[order]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (b[1:] != b[:-1]) | (m[1:] != m[:-1])
            nth = np.arange(len(order)) - np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
            same = self.table[b] == m[:, None]
            slot = same & (np.cumsum(same, 1) == nth[:, None] + 1)
            hit = slot.any(1)
            self.table[b[hit], slot.argmax(1)[hit]] = 0
            left = np.ones(len(mark), bool)
            left[order[hit]] = False
            mark, second = mark[left], second[left]
        if len(mark):
            raise ValueError("a key is removed that the filter does not hold")


def _line_rows(docs: DataFrame) -> DataFrame:
    """(doc, h1, h2) of docs (doc, text): a row for each distinct long key of a text."""

    def run(batches: Iterator) -> Iterator:
        def out(ids, keys):
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in (zip(*keys, strict=True) if keys else ([], [])))], ["doc", *KEY])

        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = {key_of(line) for line in (text.as_py() or "").split("\n")} - {None}
                ids += [doc] * len(own)
                keys += own
                if len(ids) >= 50_000:
                    yield out(ids, keys)
                    ids, keys = [], []
            yield out(ids, keys)

    return docs.mapInArrow(lean(run), "doc long, h1 long, h2 long")


def _filtered(rows: DataFrame) -> DataFrame:
    """rows (shard, kind, h1, h2, table), the shard's filter first if it has one (kind 0): its keys (kind 1) with `known`, false if it surely has not seen them."""

    def run(batches: Iterator) -> Iterator:
        shard, held = None, None
        for batch in batches:
            shards, kinds = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            known = np.zeros(len(shards), bool)
            hashes = np.asarray(batch.column(3).fill_null(0)).view(np.uint64)
            cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)] if len(shards) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if shards[a] != shard:
                    shard, held = shards[a], None
                if kinds[a] == 0:
                    held = Cuckoo(np.frombuffer(batch.column(4)[a].as_py(), np.uint16).reshape(-1, SLOTS))
                if held is not None:
                    known[a:b] = held.has(hashes[a:b])
            keys = pa.array(kinds == 1)
            yield pa.RecordBatch.from_arrays([batch.column(2).filter(keys), batch.column(3).filter(keys), pa.array(known).filter(keys)], ["h1", "h2", "known"])

    return rows.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(lean(run), "h1 long, h2 long, known boolean")


def _changed(rows: DataFrame) -> DataFrame:
    """(shard, table): filters after rows (shard, kind, h1, h2, table), of kind 0 the old filter, 1 keys that come, 2 keys that go. A null table: it is to be made anew, larger."""

    def run(batches: Iterator) -> Iterator:
        for table in runs(batches, 1):
            kind, hashes = np.asarray(table["kind"]), np.asarray(table["h2"].fill_null(0)).view(np.uint64)
            come, go = hashes[kind == 1], hashes[kind == 2]
            if (kind == 0).any():
                held = Cuckoo(np.frombuffer(table["table"][int(np.argmax(kind == 0))].as_py(), np.uint16).reshape(-1, SLOTS).copy())
                held.remove(go)
                fits = held.held() + len(come) <= held.room() and held.add(come)
            else:
                size, fits = 2 * len(come), False
                while not fits:
                    held = Cuckoo.sized(size)
                    size, fits = 2 * size, held.add(come)
            yield pa.RecordBatch.from_arrays([table["shard"].combine_chunks()[:1], pa.array([held.table.tobytes() if fits else None], pa.binary())], ["shard", "table"])

    return rows.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(lean(run), "shard int, table binary")


class Index:
    """Line keys of the documents inserted and not deleted, kept in a folder of the shared store."""

    def __init__(self, spark: SparkSession, path: str, shards: int | None = None):
        ship(spark)
        self.spark, self.path, self.shards = spark, path.rstrip("/"), shards
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[tuple[str, str]]:
        """(name, folder) of what is committed, oldest first."""
        found = sorted(str(f.getPath()) for f in self._fs.globStatus(self._path(f"{self.path}/v*/_DONE-*")) or [])
        for mark in found[:1]:
            self.shards = int(mark.rsplit("-", 1)[1])
        return [(f.rsplit("/", 2)[1].split("-", 1)[1], f.rsplit("/", 1)[0]) for f in found]

    def _read(self, part: str, schema: str) -> DataFrame:
        """A part of all versions, with the version's number."""
        out = [self.spark.read.schema(schema).parquet(f"{folder}/{part}").withColumn("version", F.lit(number)) for number, (_, folder) in enumerate(self.versions())]
        return reduce(DataFrame.unionByName, out) if out else self.spark.createDataFrame([], f"{schema}, version int")

    def counts(self, keys: DataFrame | None = None) -> DataFrame:
        """(shard, h1, h2, docs, first) of each key that a document holds; of these keys only, if given."""
        rows = self._read("counts", "shard int, h1 long, h2 long, docs long, first long")
        if keys is not None:
            rows = rows.join(keys, KEY, "left_semi")
        newest = rows.groupBy("shard", *KEY).agg(F.max_by(F.struct("docs", "first"), "version").alias("s"))
        return newest.where("s.docs > 0").select("shard", *KEY, "s.docs", "s.first")

    def postings(self) -> DataFrame:
        """(h1, h2, doc): who holds what now."""
        rows = self._read("postings", "h1 long, h2 long, doc long, sign int")
        if rows.where("sign < 0").isEmpty():
            return rows.select(*KEY, "doc")
        return rows.groupBy(*KEY, "doc").agg(F.sum("sign").alias("net")).where("net > 0").drop("net")

    def documents(self) -> DataFrame:
        """(doc): ids in the index."""
        return self._read("documents", "doc long, sign int").groupBy("doc").agg(F.sum("sign").alias("net")).where("net > 0").drop("net")

    def _filters(self) -> DataFrame:
        rows = self._read("filters", "shard int, table binary")
        return rows.groupBy("shard").agg(F.max_by("table", "version").alias("table"))

    def _folder(self, name: str) -> str | None:
        """Where the batch goes; None if it is committed."""
        if not re.fullmatch(r"[A-Za-z0-9._]+", name):
            raise ValueError(f"not a batch name: {name!r}")
        done = self.versions()
        return None if name in {n for n, _ in done} else f"{self.path}/v{len(done):06d}-{name}"

    def _commit(self, folder: str, changed: DataFrame) -> None:
        """Brings the filters up to date with changed (shard, h1, h2, kind as in _changed()) and counts the version."""
        none = F.lit(None)
        keys = changed.select("shard", "kind", *KEY, none.cast("binary").alias("table"))
        olds = self._filters().select("shard", F.lit(0).alias("kind"), none.cast("long").alias("h1"), none.cast("long").alias("h2"), "table")
        made = stored(_changed(keys.unionByName(olds)), "line-filters")
        full = [r["shard"] for r in made.where("table IS NULL").select("shard").collect()]  # at most a number a shard
        if full:
            every = self.counts().where(F.col("shard").isin(full)).select("shard", *KEY)
            gone = changed.where("kind = 2").select(*KEY)
            every = every.join(gone, KEY, "left_anti").unionByName(changed.where(F.col("kind") == 1).where(F.col("shard").isin(full)).select("shard", *KEY))
            anew = _changed(every.select("shard", F.lit(1).alias("kind"), *KEY, none.cast("binary").alias("table")))
            made = made.where("table IS NOT NULL").unionByName(anew)
        made.write.mode("overwrite").parquet(f"{folder}/filters")
        self._fs.create(self._path(f"{folder}/_DONE-{self.shards}")).close()

    def insert(self, docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text") -> bool:
        """Adds documents, once; False if this batch was committed before. Ids must not be in the index."""
        folder = self._folder(name)
        if folder is None:
            return False
        rows = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].cast("string").alias("text"))
        ids = stored(rows.groupBy("doc").agg(F.count("*").alias("n")), "line-ids")
        if not ids.join(self.documents().select(F.col("doc").alias("_doc")), F.col("doc").eqNullSafe(F.col("_doc")), "left_semi").isEmpty():
            raise ValueError(f"batch {name}: some documents are in the index; delete them first")
        ids.select("doc", F.lit(1).alias("sign")).write.mode("overwrite").parquet(f"{folder}/documents")
        lines = _line_rows(rows)
        if not ids.where("n > 1").isEmpty():
            lines = lines.distinct()
        lines.select(*KEY, "doc", F.lit(1).alias("sign")).write.mode("overwrite").parquet(f"{folder}/postings")
        posted = self.spark.read.schema("h1 long, h2 long, doc long, sign int").parquet(f"{folder}/postings")
        batch = stored(posted.groupBy(*KEY).agg(F.count("*").alias("docs"), F.min("doc").alias("first")), "line-keys")
        if self.shards is None:
            self.shards = min(MOST_SHARDS, max(8, 1 << (batch.count() // SHARD_KEYS).bit_length()))
        batch = batch.withColumn("shard", F.pmod("h1", F.lit(self.shards)).cast("int"))
        if self.versions():
            none = F.lit(None)
            filters = self._filters().select("shard", F.lit(0).alias("kind"), none.cast("long").alias("h1"), none.cast("long").alias("h2"), "table")
            asked = batch.select("shard", F.lit(1).alias("kind"), *KEY, none.cast("binary").alias("table"))
            maybe = stored(_filtered(filters.unionByName(asked)).where("known").select(*KEY), "known-keys")
            few = maybe.count() <= BROADCAST_ROWS
            old = stored(self.counts(F.broadcast(maybe) if few else maybe).select(*KEY, F.col("docs").alias("_docs"), F.col("first").alias("_first")), "known-counts")
            batch = batch.join(F.broadcast(old) if few else old, KEY, "left")
            batch = batch.select("shard", *KEY, (F.col("docs") + F.coalesce("_docs", F.lit(0))).alias("docs"), F.least("first", "_first").alias("first"), F.col("_docs").isNull().alias("fresh"))
        else:
            batch = batch.withColumn("fresh", F.lit(True))
        batch.write.mode("overwrite").parquet(f"{folder}/counts")
        written = self.spark.read.schema(batch.schema).parquet(f"{folder}/counts")
        self._commit(folder, written.where("fresh").select("shard", *KEY, F.lit(1).alias("kind")))
        return True

    def delete(self, ids: DataFrame, name: str) -> bool:
        """Takes documents (`doc`) out, once; False if this batch was committed before. Ids that are not in the index do nothing."""
        folder = self._folder(name)
        if folder is None:
            return False
        if not self.versions():
            raise ValueError("nothing was inserted yet")
        ids = ids.select(F.col("doc").cast("long").alias("doc")).distinct()
        known = self.documents().withColumnRenamed("doc", "_doc")
        ids = stored(ids.join(known, F.col("doc").eqNullSafe(F.col("_doc")), "left_semi"), "line-ids")
        ids.select("doc", F.lit(-1).alias("sign")).write.mode("overwrite").parquet(f"{folder}/documents")
        few = ids.count() <= BROADCAST_ROWS
        named = ids.withColumnRenamed("doc", "_doc")
        gone = self.postings().join(F.broadcast(named) if few else named, F.col("doc").eqNullSafe(F.col("_doc")), "left_semi")
        gone.select(*KEY, "doc", F.lit(-1).alias("sign")).write.mode("overwrite").parquet(f"{folder}/postings")
        gone = self.spark.read.schema("h1 long, h2 long, doc long, sign int").parquet(f"{folder}/postings")
        lost = stored(gone.groupBy(*KEY).agg(F.count("*").alias("lost"), F.min("doc").alias("least")), "lost-keys")
        state = self.counts(lost.select(*KEY)).join(lost, KEY)
        state = stored(state.select("shard", *KEY, (F.col("docs") - F.col("lost")).alias("docs"), "first", F.col("least").eqNullSafe(F.col("first")).alias("headless")), "lost-counts")
        orphans = stored(state.where("headless AND docs > 0").select(*KEY), "headless-keys")
        if not orphans.isEmpty():
            few_keys = orphans.count() <= BROADCAST_ROWS
            left = self.postings().join(F.broadcast(orphans) if few_keys else orphans, KEY, "left_semi")
            left = left.join(F.broadcast(named) if few else named, F.col("doc").eqNullSafe(F.col("_doc")), "left_anti")
            heads = left.groupBy(*KEY).agg(F.min("doc").alias("_first"))
            state = state.join(heads, KEY, "left").withColumn("first", F.when(F.col("headless"), F.col("_first")).otherwise(F.col("first")))
        state.select("shard", *KEY, "docs", "first").write.mode("overwrite").parquet(f"{folder}/counts")
        written = self.spark.read.schema("shard int, h1 long, h2 long, docs long, first long").parquet(f"{folder}/counts")
        self._commit(folder, written.where("docs = 0").select("shard", *KEY, F.lit(2).alias("kind")))
        return True

    def repeated(self) -> DataFrame:
        """(h1, h2, doc): keys that a document loses, as a smaller id holds them too."""
        keys = stored(self.counts().where("docs > 1").select(*KEY, "first", F.col("docs").alias("n")), "repeated-keys")
        posted = stored(self.postings(), "line-postings")
        return met(posted, keys, KEY, "n", posted.count()).where(~F.col("doc").eqNullSafe(F.col("first"))).select(*KEY, "doc")

    def cleaned(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines_col: str = "n_lines", dropped_col: str = "n_dropped") -> DataFrame:
        """docs without the lines that they lose; and how many lines a text had, and lost. A null text stays null."""
        gone = stored(self.repeated(), "lost-lines")
        small = gone.count() <= BROADCAST_ROWS
        marks = gone.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct(*KEY)).alias("_keys")).select("_doc", F.transform("_keys", lambda x: x["h1"]).alias("_h1"), F.transform("_keys", lambda x: x["h2"]).alias("_h2"))
        fresh = lambda name: name + "_" * (1 + max(map(len, docs.columns)))
        marks = marks.toDF(*map(fresh, ("doc", "h1", "h2")))
        joined = docs.join(F.broadcast(marks) if small else marks, docs[id_col].cast("long").eqNullSafe(F.col(fresh("doc"))), "left")

        @F.arrow_udf("struct<n: bigint, d: bigint, t: string>")
        def cut(texts: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
            n_lines, n_dropped, kept_texts = [], [], []
            for text, a, b in zip(texts, h1, h2, strict=True):
                lines = (text.as_py() or "").split("\n")
                kept = lines
                if a.is_valid:
                    dropped = set(zip(a.as_py(), b.as_py(), strict=True))
                    kept = [line for line in lines if key_of(line) not in dropped]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
                kept_texts.append("\n".join(kept) if text.is_valid else None)
            trim()
            return pa.StructArray.from_arrays([pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept_texts, pa.string())], ["n", "d", "t"])

        joined = joined.withColumn(fresh("cut"), cut(docs[text_col].cast("string"), fresh("h1"), fresh("h2")))
        others = [c for c in docs.columns if c not in (text_col, lines_col, dropped_col)]
        out = {text_col: "t", lines_col: "n", dropped_col: "d"}
        return joined.select(*(docs[c] for c in others), *(F.col(f"{fresh('cut')}.{v}").alias(c) for c, v in out.items()))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that every document loses: documents come in two batches, some are deleted and come back, then all are cleaned."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    deal = F.coalesce(F.crc32(docs["doc_id"].cast("string")), F.lit(0))
    index = Index(spark, scratch(spark, "line-index"))
    index.insert(docs.where(deal % 2 == 0), "even")
    index.insert(docs.where(deal % 2 == 1), "odd")
    index.delete(docs.where(deal % 32 == 3).select(F.col("doc_id").alias("doc")), "some")
    index.insert(docs.where(deal % 32 == 3), "back")
    out = index.cleaned(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
