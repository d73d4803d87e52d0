"""Cost-balanced packing of documents into fixed-length token sequences.

A document costs LINEAR tokens + QUADRATIC tokens squared (its own attention). Whole runs of
`capacity` tokens become sequences of their own. What is left of each document is gathered into
windows of a bounded number of documents and, in descending cost, goes to the sequence of lowest
cost so far that has room for it; one that fits nowhere is cut over the roomiest sequences. A
window opens exactly as many tokens of sequences as it holds: full ones, and for the last few tokens
sequences of power-of-two lengths, so that every sequence ends full and nothing is padded.

Each task packs the rows it reads, window by window: no shuffle, bounded memory, and a retried task
gives the same rows, since its input rows and their order are the same.

Nulls: a null text is empty; every document ends with the end token, so it has one piece at least. A
null id stays null. Repeated rows: packed each. Long texts: cut over as many sequences as they need. Ties: of equal costs the
sequence opened first. Empty table: no rows. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import tokens
from graphloom.llm.common import lean, ship

CAPACITY, END, LINEAR, QUADRATIC = 2048, 1, 1.0, 1.0 / 2048
#: Documents, and tokens, that a window holds at most (the last document may pass the second).
WINDOW_DOCS, WINDOW_TOKENS = 8192, 4_000_000


def cost(length, linear: float = LINEAR, quadratic: float = QUADRATIC):
    """Estimated cost of a document, or piece, of this many tokens."""
    return linear * length + quadratic * length * length


def assign(lengths: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) pieces of documents of these lengths, all at most capacity; all sequences end full."""
    total = int(lengths.sum())
    rooms = [capacity] * (total // capacity)
    rest = total % capacity
    rooms += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    room, load, size = np.array(rooms, np.int64), np.zeros(len(rooms)), np.array(rooms, np.int64)
    out = []
    for d in np.argsort(-lengths, kind="stable"):
        left, start = int(lengths[d]), 0
        while left:
            k = int(np.where(room >= left, load, np.inf).argmin())
            if room[k] < left:
                k = int(room.argmax())
            n = min(left, int(room[k]))
            out.append((int(d), start, n, k, int(size[k] - room[k])))
            room[k] -= n
            load[k] += cost(n, linear, quadratic)
            start, left = start + n, left - n
    return out


class _Packer:
    """Pieces of one task's documents, in columns."""

    NAMES = ("id", "start", "length", "crc", "doc_tokens", "sequence", "offset", "ids")

    def __init__(self, first: int, capacity: int, with_ids: bool):
        self.next, self.capacity, self.with_ids = first, capacity, with_ids
        self.window: list[tuple[object, int, np.ndarray, int]] = []
        self.held = 0
        self.rows: list[tuple] = []

    def piece(self, key, start: int, ids: np.ndarray, n_doc: int, sequence: int, offset: int) -> None:
        self.rows.append((key, start, len(ids), zlib.crc32(ids.tobytes()), n_doc, sequence, offset, ids.tobytes() if self.with_ids else None))

    def add(self, key, ids: np.ndarray) -> None:
        whole = len(ids) // self.capacity * self.capacity
        for a in range(0, whole, self.capacity):
            self.piece(key, a, ids[a : a + self.capacity], len(ids), self.next, 0)
            self.next += 1
        if whole < len(ids):
            self.window.append((key, whole, ids[whole:].copy(), len(ids)))
            self.held += len(ids) - whole
        if len(self.window) >= WINDOW_DOCS or self.held >= WINDOW_TOKENS:
            self.close()

    def close(self) -> None:
        if self.window:
            pieces = assign(np.array([len(w[2]) for w in self.window]), self.capacity)
            for d, start, n, k, offset in pieces:
                key, before, ids, n_doc = self.window[d]
                self.piece(key, before + start, ids[start : start + n], n_doc, self.next + k, offset)
            self.next += 1 + max(p[3] for p in pieces)
        self.window, self.held = [], 0

    def drain(self):
        import pyarrow as pa

        kinds = [pa.int64()] * 7 + [pa.binary()]
        columns = list(zip(*self.rows, strict=True)) or [()] * 8
        self.rows = []
        last = len(kinds) if self.with_ids else 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:last], kinds, strict=False)], list(self.NAMES[:last]))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces (id, start, length, crc, doc_tokens, sequence, offset[, ids: little-endian unsigned 32-bit]) of all documents.

    sequence numbers are unique over all tasks; the pieces of a sequence lie gapless from offset 0.
    """
    ship(docs.sparkSession)
    path = vocabulary or tokens.default_path()

    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        tok = tokens.tokenizer(path)
        packer = _Packer(TaskContext.get().partitionId() << 36, capacity, with_ids)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(key, np.append(tok.encode(text.as_py()), np.uint32(end)).astype("<u4"))
                if len(packer.rows) >= 20_000:
                    yield packer.drain()
        packer.close()
        yield packer.drain()

    schema = "id long, start long, length long, crc long, doc_tokens long, sequence long, offset long" + ", ids binary" * with_ids
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(lean(run), schema)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    out = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.toDF("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
