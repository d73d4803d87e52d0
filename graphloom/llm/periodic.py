"""Periodic runs of words: maximal repetitions found by an enhanced suffix array, and the text with them collapsed.

A run is a stretch of consecutive words whose smallest period q repeats at least four times in it (words q apart are
identical; at least LEAST words in all) and that no neighbouring word extends with the same period.

The texts of a slice share one suffix array over (text, word) codes, made by prefix doubling: each round sorts only the
suffixes that are still tied. The classes of all rounds are kept, so the words of two places can be compared
for any length by looking up one or two numbers. Common prefixes of neighbours in the array come from these classes. Of each place j in the
array with a common prefix d > 0, the suffixes that share d words lie between the nearest smaller prefixes to both
sides, and j halves them. Every suffix i of the smaller half is asked whether i + d or i - d is in the other half (by
its place in the array): then d words repeat at once there and the word after them differs, a branching tandem. As a
stretch of period d ends in exactly one of these, rotating it leftwards, while the words d apart agree, gives the whole stretch; of
several periods of one stretch the smallest counts. No tree is built; halves add up to n log n at most.

Work is done slice by slice (SLICE_BYTES, or one text), so memory follows the slice and the longest text: some 4 bytes a
word for each doubling round.

Nulls: a null text has no words and no runs; a null id stays null, and its words are never rewritten. Empty texts: the same as
null ones. Ties: of runs equal in length / period the smallest start, then period, is the greatest. Repeated rows: each has its row. Empty
table: no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import lean, ship, text_bytes

#: A run has so many words at least, and so many periods.
LEAST, TIMES = 6, 4
SLICE_BYTES = 2_000_000
#: Suffixes of smaller halves asked at a time.
ASKED = 1_000_000


def words_of(raw: np.ndarray, offsets: np.ndarray):
    """Of texts in UTF-8 (bytes and n + 1 offsets): all words as an Arrow array, and n + 1 bounds into it."""
    import pyarrow as pa

    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    letters = ~blank
    before = np.concatenate([[True], blank[:-1]]) if len(raw) else blank
    if len(raw):
        inner = offsets[(offsets > 0) & (offsets < len(raw))]
        before[inner] = True
    starts = np.flatnonzero(letters & before)
    kept = np.concatenate([[0], np.cumsum(letters)])
    ends = np.append(starts[1:], len(raw))
    at = np.append(kept[starts], kept[ends[-1]] if len(starts) else 0).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(raw[letters]))])
    return words, np.searchsorted(starts, offsets)


class Suffixes:
    """The suffix array of texts of numbered words; no suffix reaches into the next text, and no two texts share a class."""

    def __init__(self, codes: np.ndarray, bounds: np.ndarray):
        n = len(codes)
        self.bounds, self.n = bounds, n
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self.end = bounds[1:][owner] if n else bounds[:0]
        self.start = bounds[:-1][owner] if n else bounds[:0]
        key = owner.astype(np.int64) << 32 | codes
        sa = np.argsort(key, kind="stable").astype(np.int32)
        rank = np.empty(n + 1, np.int32)
        rank[n] = -1
        key = key[sa]
        fresh = np.ones(n, bool)
        fresh[1:] = key[1:] != key[:-1]
        heads = np.flatnonzero(fresh).astype(np.int32)
        sizes = np.diff(np.append(heads, n))
        rank[sa] = np.repeat(heads, sizes)
        #: The round in which a place of the array was first parted from the one before it.
        self.parted = np.where(fresh, 0, 255).astype(np.uint8)
        self.classes = [rank]
        places = np.flatnonzero(np.repeat(sizes > 1, sizes))
        h = 1
        while len(places):
            idx = sa[places]
            to = idx.astype(np.int64) + h
            after = np.where(to < self.end[idx], rank[np.minimum(to, n)], -1)
            key = rank[idx].astype(np.int64) << 32 | (after + 1).astype(np.int64)
            order = np.argsort(key, kind="stable")
            key, idx = key[order], idx[order]
            sa[places] = idx
            fresh = np.ones(len(places), bool)
            fresh[1:] = key[1:] != key[:-1]
            heads = np.flatnonzero(fresh)
            sizes = np.diff(np.append(heads, len(places)))
            rank = rank.copy()
            rank[idx] = np.repeat(places[heads], sizes)
            self.classes.append(rank)
            now = places[fresh]
            self.parted[now[self.parted[now] == 255]] = len(self.classes) - 1
            places = places[np.repeat(sizes > 1, sizes)]
            h *= 2
        self.sa = sa

    def common(self) -> np.ndarray:
        """At each place of the array, how many words its suffix shares with the one before; 0 at both ends (n + 1 values)."""
        out = np.zeros(self.n + 1, np.int32)
        here = np.flatnonzero(self.parted)
        a, b, level = self.sa[here - 1].astype(np.int64), self.sa[here].astype(np.int64), self.parted[here]
        length = np.zeros(len(here), np.int32)
        for k in range(len(self.classes) - 1, -1, -1):
            todo = np.flatnonzero(level > k)
            x, y = a[todo], b[todo]
            same = todo[self.classes[k][x] == self.classes[k][y]]
            a[same] += 1 << k
            b[same] += 1 << k
            length[same] += 1 << k
        out[here] = length
        return out

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether `length` >= 1 words from a and from b are the same; all of them must lie in the text."""
        level = np.log2(length).astype(np.int64)
        level += (2 << level) <= length  # what floating point got wrong
        level -= (1 << level) > length
        out = np.zeros(len(a), bool)
        for k in np.unique(level).tolist():
            if k < len(self.classes):
                at, c = np.flatnonzero(level == k), self.classes[k]
                shift = length[at] - (1 << k)
                out[at] = (c[a[at]] == c[b[at]]) & (c[a[at] + shift] == c[b[at] + shift])
        return out


def halves(common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(j, low, high) of each place j with a common prefix: the suffixes that share it are low <= place < high, of which those before j are one half.

    low is the nearest place before j with a smaller value, high the nearest after it that is not greater; found
    by stepping over blocks of minima.
    """
    j = np.flatnonzero(common[:-1] > 0)
    if not len(j):
        return j, j, j
    gaps = np.diff(np.flatnonzero(common == 0))
    minima = [common]
    while 1 << len(minima) <= gaps.max():
        last, half = minima[-1], 1 << (len(minima) - 1)
        nxt = last.copy()
        np.minimum(last[:-half], last[half:], out=nxt[:-half])
        minima.append(nxt)
    value = common[j]
    low, high = j.copy(), j + 1
    for k in range(len(minima) - 1, -1, -1):
        step = 1 << k
        back = low - step
        low = np.where((back >= 0) & (minima[k][np.maximum(back, 0)] >= value), back, low)
        fits = high + step <= len(common)
        high = np.where(fits & (minima[k][np.minimum(high, len(common) - 1)] > value), high + step, high)
    return j, low - 1, high


def tandems(s: Suffixes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, d) of every branching tandem: d words that repeat at once, where the word after them differs from their first."""
    common = s.common()
    j, low, high = halves(common)
    place = np.empty(s.n, np.int32)
    place[s.sa] = np.arange(s.n, dtype=np.int32)
    left = j - low <= high - j
    first, size = np.where(left, low, j), np.where(left, j - low, high - j)
    other, until = np.where(left, j, low), np.where(left, high, j)
    ends = np.cumsum(size)
    at = 0
    while at < len(j):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ASKED)))
        part = slice(at, to)
        n = size[part]
        which = np.repeat(np.arange(at, to), n)
        base = np.cumsum(n) - n
        i = s.sa[np.arange(len(which)) - np.repeat(base - first[part], n)].astype(np.int64)
        d = common[j[which]].astype(np.int64)
        for start, partner in ((i, i + d), (i - d, i - d)):
            there = (partner >= 0) & (partner < s.n)
            p = place[np.where(there, partner, 0)]
            hit = there & (p >= other[which]) & (p < until[which])
            yield start[hit], d[hit]
        at = to


def runs_of(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs of texts (word numbers and n + 1 bounds), by text, start and period; start within the text."""
    none = np.zeros(0, np.int64)
    if not len(codes):
        return none, none, none, none
    s = Suffixes(codes, bounds)
    found = [np.zeros((3, 0), np.int64)]
    for start, d in tandems(s):
        end = start + 2 * d
        length = np.maximum(LEAST, TIMES * d)
        origin = end - length
        ok = origin >= s.start[start]
        start, d, end, length, origin = start[ok], d[ok], end[ok], length[ok], origin[ok]
        ok = s.equal(origin, origin + d, length - d)
        found.append(np.stack([origin[ok], end[ok], d[ok]]))
    at, end, d = np.concatenate(found, 1)
    edge = s.start[at]
    for k in range(len(s.classes) - 1, -1, -1):
        back = at - (1 << k)
        fits = back >= edge
        c, back = s.classes[k], np.maximum(back, 0)
        at = np.where(fits & (c[back] == c[back + d]), back, at)
    order = np.lexsort((d, end, at))
    at, end, d = at[order], end[order], d[order]
    keep = np.ones(len(at), bool)
    keep[1:] = (at[1:] != at[:-1]) | (end[1:] != end[:-1])
    at, end, d = at[keep], end[keep], d[keep]
    order = np.lexsort((d, at))
    at, end, d = at[order], end[order], d[order]
    text = np.searchsorted(bounds, at, "right") - 1
    return text, at - bounds[text], end - at, d


def rewritten(key: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) where the words from a on become those of a, a + 1 .. in turn, p of them; one text in ten, by its id."""
    if key is None or not n:
        return None
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


SCHEMA = "id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _judged(keys: list[int | None], raw: np.ndarray, offsets: np.ndarray, periodic: bool, with_text: bool):
    """Rows of SCHEMA (and the collapsed text) of a slice of texts, as columns."""
    import pyarrow as pa
    import pyarrow.compute as pc

    words, bounds = words_of(raw, offsets)
    source = np.arange(len(words))
    if periodic:
        for key, b, n in zip(keys, bounds[:-1].tolist(), np.diff(bounds).tolist(), strict=True):
            if made := rewritten(key, n):
                a, p = made
                source[b + a : b + n] = b + a + np.arange(n - a) % p
    codes = np.asarray(words.dictionary_encode().indices).astype(np.int64)[source]
    text, start, length, period = runs_of(codes, bounds)
    cover = np.zeros(len(words) + 1, np.int32)
    begin = bounds[text] + start if len(text) else start
    np.add.at(cover, begin + period, 1)
    np.add.at(cover, begin + length, -1)
    kept = np.cumsum(cover[:-1]) == 0
    lengths = np.concatenate([[0], np.cumsum(kept)])[bounds]
    left = words if kept.all() and not periodic else words.take(pa.array(source[kept]))
    collapsed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(lengths, pa.int64()), left), pa.scalar(b" ", pa.large_binary()))
    cuts = np.searchsorted(text, np.arange(len(keys) + 1)).tolist()
    spans = list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
    out = []
    for r, key in enumerate(keys):
        own = spans[cuts[r] : cuts[r + 1]]
        best = max(own, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if own else None
        digest = hashlib.sha256("".join(f"{a},{m},{q}\n" for a, m, q in own).encode()).hexdigest()
        kept_text = memoryview(collapsed[r].as_buffer())
        row = (key, len(own), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, digest, hashlib.sha256(kept_text).hexdigest())
        out.append((*row, bytes(kept_text).decode()) if with_text else row)
    return list(zip(*out, strict=True))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", periodic: bool = False, with_text: bool = False) -> DataFrame:
    """A row a document: how many runs, the one with the most periods, digests of all runs and of the text without their repeats.

    with_text adds `collapsed`, the words that stay, joined by a space. periodic rewrites one text in ten to be periodic first, by its id.
    """
    ship(docs.sparkSession)
    schema = SCHEMA + ", collapsed string" * with_text

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in schema.split(", ")]
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            keys = batch.column(0).to_pylist()
            raw, offsets = text_bytes(batch.column(1))
            at = 0
            while at < len(keys):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
                columns = _judged(keys[at:to], raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], periodic, with_text)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
                at = to

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(lean(run), schema)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, of which one in ten is made periodic first."""
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), periodic=True).withColumnRenamed("id", "doc_id")
