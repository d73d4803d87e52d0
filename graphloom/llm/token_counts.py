"""Token counts as rollups that deltas maintain.

A delta is a signed row of a document: +1 for one that came, -1 for one that went; a revised count
is the old row's -1 and the new row's +1. Deltas are summed per batch by source, language and
tokenizer version, and the batch's sums are written once, under the batch's name. The totals are the sums over
all committed batches. A batch is committed when its folder carries Spark's _SUCCESS mark; giving
the same batch again changes nothing, whether it was cut off half-way (its folder is written over) or
done (it is skipped). compact() folds committed batches into one folder that lists their names.

Nulls: a null text has no tokens and no bytes but counts as a document; null source, language and
version are groups of their own. Repeated rows: each counts. Empty batch: committed, no rows. Groups
whose totals are all zero are left out of the totals. Long texts: counted whole; a worker holds one text's ids. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import tokens
from graphloom.llm.common import lean, scratch, ship, stored

KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens", "n_bytes")
VERSION = "byte_bpe_50k/1"


def counted(docs: DataFrame, version: str = VERSION, vocabulary: str | None = None, source_col: str = "source", lang_col: str = "lang", text_col: str = "text", **carried: Column) -> DataFrame:
    """A row (source, lang, tokenizer, n_docs = 1, n_tokens, n_bytes) for each document, with the columns `carried`."""
    ship(docs.sparkSession)
    path = vocabulary or tokens.default_path()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        tok = tokens.tokenizer(path)
        for batch in batches:
            n_tokens = [len(tok.encode(t.as_py())) for t in batch.column(0)]
            n_bytes = pc.fill_null(pc.binary_length(batch.column(0)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(n_tokens, pa.int64()), n_bytes, *batch.columns[1:]], ["n_tokens", "n_bytes", *batch.schema.names[1:]])

    kept = docs.select(docs[text_col].cast("string").alias("text"), docs[source_col].cast("string").alias("source"), docs[lang_col].cast("string").alias("lang"), *(c.alias(f"carried_{n}") for n, c in carried.items()))
    schema = "n_tokens long, n_bytes long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[1:])
    return kept.mapInArrow(lean(run), schema).select("source", "lang", F.lit(version).alias("tokenizer"), F.lit(1).cast("long").alias("n_docs"), "n_tokens", "n_bytes", *(F.col(f"carried_{n}").alias(n) for n in carried))


def deltas(docs: DataFrame, sign: Column | int = 1, version: str = VERSION, vocabulary: str | None = None, source_col: str = "source", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """A signed row (source, lang, tokenizer, n_docs, n_tokens, n_bytes) for each document and sign.

    sign is a constant or a column of docs holding +1 and -1.
    """
    sign = sign if isinstance(sign, Column) else F.lit(sign)
    rows = counted(docs, version, vocabulary, source_col, lang_col, text_col, sign=sign.cast("long"))
    return rows.select(*KEYS, *((F.col(c) * F.col("sign")).alias(c) for c in SUMS))


def negated(rows: DataFrame) -> DataFrame:
    """The deltas that undo these."""
    return rows.select(*KEYS, *((-F.col(c)).alias(c) for c in SUMS))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Deltas that replace old rows by new ones; both as deltas() gives them with sign +1."""
    return negated(old).unionByName(new.select(*KEYS, *SUMS))


def copies_gone(rows: DataFrame, digest: str = "digest", order: str = "id") -> DataFrame:
    """Deltas that delete all rows of a digest but the first by order: every row's -1, and one first row's +1 a digest.

    Only sums and a minimum are taken by digest, so a digest that a third of all rows have is combined before the shuffle.
    """
    first = rows.groupBy(digest).agg(F.min(F.struct(order, *KEYS, *SUMS)).alias("f")).select("f.*")
    return revised(rows, first)


class Rollup:
    """Totals kept in a folder of the shared store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _done(self) -> dict[str, str]:
        """Folder by name of what is committed."""
        found = self._fs.globStatus(self._path(f"{self.path}/*/_SUCCESS")) or []
        folders = [str(f.getPath().getParent()) for f in found]
        return {name: f for f in folders if re.fullmatch(r"batch-.*|base-[0-9]+", name := f.rsplit("/", 1)[1])}

    def _live(self) -> tuple[list[str], set[str]]:
        """Folders to sum, and all batch names that they cover."""
        done = self._done()
        bases = sorted(n for n in done if n.startswith("base-"))
        covered: set[str] = set()
        folders = []
        if bases:
            folders.append(done[bases[-1]])
            covered = {r[0] for r in self.spark.read.parquet(f"{done[bases[-1]]}/names").collect()}  # one short name a batch
        for name, folder in done.items():
            if name.startswith("batch-") and name[6:] not in covered:
                folders.append(folder)
                covered.add(name[6:])
        return folders, covered

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Adds the batch's deltas, once; False if it was committed before."""
        if not re.fullmatch(r"[A-Za-z0-9._-]+", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        if batch in self._live()[1]:
            return False
        summed = rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))
        summed.write.mode("overwrite").parquet(f"{self.path}/batch-{batch}")
        return True

    def compact(self) -> None:
        """Folds all that is committed into a new base; its mark is written last, and with it it counts. Then what it covers is deleted, so not beside a reader."""
        folders, covered = self._live()
        if not folders:
            return
        last = max((int(n[5:]) for n in self._done() if n.startswith("base-")), default=-1)
        name = f"base-{last + 1:08d}"
        self._fs.delete(self._path(f"{self.path}/{name}.tmp"), True)  # of a compaction that was cut off
        totals = self._sum(folders)
        self.spark.createDataFrame([(n,) for n in sorted(covered)], "name string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/names-{name}")
        totals.write.mode("overwrite").parquet(f"{self.path}/{name}.tmp/data")
        self._fs.rename(self._path(f"{self.path}/names-{name}"), self._path(f"{self.path}/{name}.tmp/names"))
        self._fs.create(self._path(f"{self.path}/{name}.tmp/_SUCCESS")).close()
        self._fs.rename(self._path(f"{self.path}/{name}.tmp"), self._path(f"{self.path}/{name}"))
        for old, folder in self._done().items():
            if old != name and (old.startswith("base-") or old[6:] in covered):
                self._fs.delete(self._path(folder), True)

    def _sum(self, folders: list[str]) -> DataFrame:
        schema = ", ".join([*(f"{k} string" for k in KEYS), *(f"{s} long" for s in SUMS)])
        paths = [f"{f}/data" if f.rsplit("/", 1)[1].startswith("base-") else f for f in folders]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        summed = rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))
        return summed.where(" OR ".join(f"{s} <> 0" for s in SUMS))

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens, n_bytes) over all committed batches."""
        return self._sum(self._live()[0])


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents after batches of every kind, each given twice.

    The documents come in without a language; exact copies are deleted and come back; then every document's
    count is revised to be under its language; at last all batches are folded into one base. What is left is each
    document once.
    """
    rollup = Rollup(spark, scratch(spark, "token-counts"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = stored(counted(docs, id=docs["doc_id"], digest=F.unhex(F.sha2(docs["text"], 256))), "document-counts")
    unlabelled = known.withColumn("lang", F.lit(None).cast("string"))
    copies = copies_gone(unlabelled)
    for batch, rows in (("load", unlabelled), ("delete-copies", copies), ("restore-copies", negated(copies)), ("languages", revised(unlabelled, known))):
        rollup.commit(batch, rows)
        rollup.commit(batch, rows)  # skipped
    rollup.compact()
    return rollup.totals()
