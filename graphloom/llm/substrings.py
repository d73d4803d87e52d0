"""Exact removal of byte strings that repeat: every byte that a repeated string of LENGTH bytes covers goes.

Every window of LENGTH bytes has an anchor: the leftmost of its GRAM-byte strings with the smallest
hash. Equal windows have equal anchors at equal places, so only windows of equal anchors need
comparing, aligned at them. Each anchor has a segment, the bytes of all windows that it anchors.
 1. Anchors whose hash occurs once are done. Identical segments of an anchor (by 128-bit BLAKE2b digests of
    their bytes) collapse into one; what was there more than once repeats as a whole.
 2. The distinct segments, group by group of equal anchors, go through a column-wise construction in the
    manner of Bauer, Cox and Rosone: from the right, one symbol of every segment is inserted a round;
    the symbols in the order of the suffixes inserted so far are the round's column of the
    Burrows-Wheeler transform, a stable sort of it places the new suffixes, and the common prefixes of
    neighbours follow from range minima over the previous round's. Segments of a group are aligned, so
    a round's suffixes need comparing among themselves only. A window repeats where a neighbour has
    LENGTH bytes in common.
 3. A group of more than GROUP_ROWS segments, such as that of a passage that a third of all documents hold,
    would not fit a task. It is split, as often as needed: the windows of a segment are halved by where they
    start before the anchor, and each half goes with those that agree in the bytes which all its windows
    share. Equal windows stay together; after eight halvings a half is one window, and equal ones collapse.
    All parts end in step 2.

The whole collection is not built as one transform: with one symbol a round it takes as many passes
over everything as the longest document has bytes. Segments lie in sequential files of the shared folder, sorted by
group; a task reads them in order, and holds the columns of BATCH_ROWS segments and one group at most.

A text is known by a hash of 64 bits, of which a pass over all documents has made sure that different texts
have different ones (else another seed is taken); so nulls and repeats among the ids play no part.

Nulls: a null text is empty; a null id has its row. Texts of fewer than LENGTH bytes lose nothing. Repeated rows:
each has its row, and they repeat one another. Empty table: no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import lean, met, mix64, ship, stored, text_bytes

LENGTH, GRAM = 200, 64
#: Bytes hashed at a time; segments of a batch; segments of a group that are compared by columns.
PIECE, BATCH_ROWS, GROUP_ROWS = 900_000, 16_384, 2_048
BROADCAST_ROWS = 1_000_000

_U = np.uint64
_BITS = 20
_BASE = _U(0xD1342543DE82EF95)
_VALUE = mix64(np.arange(1001, 1257, dtype=np.uint64))
_POWERS: dict[str, np.ndarray] = {}


def _power(n: int, inverse: bool) -> np.ndarray:
    """Powers of the base, or of its inverse, modulo 2^64."""
    name = f"{inverse}"
    if name not in _POWERS or len(_POWERS[name]) < n:
        p = np.full(1 << n.bit_length(), _U(pow(int(_BASE), -1, 1 << 64)) if inverse else _BASE, np.uint64)
        p[0] = 1
        _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS[name]


def _sums(raw: np.ndarray) -> np.ndarray:
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * _power(len(raw) + 1, False)[: len(raw)], out=out[1:])
    return out


def _span_hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [a, b), which only say what may be equal."""
    return mix64((sums[b] - sums[a]) * _power(len(sums), True)[a] + (b - a).astype(np.uint64))


def pieces(offsets: np.ndarray, length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (text, first byte, end byte) of about PIECE bytes; long texts are cut into pieces that overlap by length - 1."""
    out, held = [], 0
    for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if b - a < length:
            continue
        for at in range(a, b - length + 1, PIECE):
            end = min(b, at + PIECE + length - 1)
            if held + end - at > PIECE + length and out:
                yield out
                out, held = [], 0
            out.append((d, at, end))
            held += end - at
    if out:
        yield out


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, lo, hi, at, anchor hash, segment digest as two words a row), byte positions within the text: windows starting at lo to hi have their anchor at `at`."""
    width = length - gram + 1
    for part in pieces(offsets, length):
        data = np.concatenate([raw[a:b] for _, a, b in part])
        sizes = np.array([b - a for _, a, b in part])
        begins = np.concatenate([[0], np.cumsum(sizes)])
        sums = _sums(data)
        n = len(data) - gram + 1
        places = np.arange(n)
        hashes = _span_hash(sums, places, places + gram)
        low = (hashes >> _U(_BITS) << _U(_BITS)) | places.astype(np.uint64)
        reach = 1
        while reach < width:
            step = min(reach, width - reach)
            low = np.minimum(low[: len(low) - step], low[step:])
            reach += step
        own = np.repeat(np.arange(len(part)), np.maximum(sizes - length + 1, 0))
        starts = np.arange(len(own)) - np.repeat(np.cumsum(sizes - length + 1) - (sizes - length + 1), sizes - length + 1) + begins[:-1][own]
        at = (low[starts] & _U((1 << _BITS) - 1)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (own[1:] != own[:-1])]))
        lo, hi, at, own = starts[cut], starts[np.concatenate([cut[1:], [len(starts)]]) - 1], at[cut], own[cut]
        text = np.array([d for d, _, _ in part])[own]
        shift = np.array([a for _, a, _ in part])[own] - begins[:-1][own] - offsets[:-1][text]
        held = data.tobytes()
        digests = b"".join(hashlib.blake2b(held[a:b], digest_size=16).digest() for a, b in zip(lo.tolist(), (hi + length).tolist(), strict=True))
        yield text, lo + shift, hi + shift, at + shift, hashes[at], np.frombuffer(digests, np.int64).reshape(-1, 2)


def repeated(group: np.ndarray, segments: list[bytes], lo: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Which windows repeat: flags by segment and by how far before the anchor the window starts.

    Rows come sorted by group. Column c of the symbols lies c bytes after the anchor; 0: no symbol.
    """
    m, reach = len(segments), length - gram
    sizes = np.fromiter(map(len, segments), np.int64, m)
    columns = np.zeros((reach + length, m), np.uint16)
    place = np.repeat(lo - at + reach, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    columns[place, np.repeat(np.arange(m), sizes)] = np.frombuffer(b"".join(segments), np.uint8).astype(np.uint16) + 1
    rank = np.concatenate([[0], np.cumsum(group[1:] != group[:-1])])
    order, common = np.arange(m), np.zeros(m + 1, np.int16)
    flags = np.zeros((m, reach + 1), bool)
    for c in range(reach + length - 1, -1, -1):
        symbols = columns[c][order]  # this round's column of the transform
        key = rank[order] * 257 + symbols
        perm = np.argsort(key, kind="stable")
        key = key[perm]
        same = np.concatenate([[False], (key[1:] == key[:-1]) & (symbols[perm][1:] > 0)])
        before, here = perm[np.flatnonzero(same) - 1], perm[same]
        fresh = common[here].copy()
        far = here != before + 1
        if far.any():
            fresh[far] = np.minimum.reduceat(common, np.stack([before[far] + 1, here[far] + 1], 1).ravel())[::2]
        order, common = order[perm], np.zeros(m + 1, np.int16)
        common[:m][same] = np.minimum(fresh + 1, length)
        if c <= reach:
            k = np.flatnonzero(common[:m] >= length)
            flags[order[k], reach - c] = flags[order[k - 1], reach - c] = True
    return flags


def _union(flags: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the maximal runs of flagged windows of each row, as byte spans."""
    wide = np.zeros((len(flags), flags.shape[1] + 2), np.int8)
    wide[:, 1:-1] = flags[:, ::-1]  # by ascending start
    turn = np.diff(wide, axis=1)
    row, first = np.nonzero(turn == 1)
    _, end = np.nonzero(turn == -1)
    base = at[row] - (flags.shape[1] - 1)
    return row, base + first, base + end - 1 + length


def _arrow_rows(names: list[str], *columns):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c)) for c in columns], names)


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, text, doc) of all rows, and (doc, id, c) of all distinct texts: the smallest id, and how many rows."""
    for seed in range(8):
        text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
        rows = docs.select(docs[id_col].cast("long").alias("id"), text.alias("text"), F.xxhash64(text, F.lit(seed)).alias("doc"))
        sha = rows.select("doc", "id", F.unhex(F.sha2("text", 256)).alias("sha"))
        known = stored(sha.groupBy("doc").agg(F.min("id").alias("id"), F.count("*").alias("c"), (F.min("sha") != F.max("sha")).alias("clash")), "texts")
        if known.where("clash").isEmpty():
            return rows, known.drop("clash")
    raise RuntimeError("different texts had equal hashes under every seed")


def _columnwise(segments: DataFrame, keys: list[str], length: int, gram: int) -> DataFrame:
    """(doc, a, b) of the windows that repeat within a group of segments (keys, doc, lo, at, seg)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list = []
        count = 0

        def done(upto) -> Iterator:
            table = pa.Table.from_batches(held).slice(0, upto).combine_chunks()
            at = np.asarray(table["at"].combine_chunks()).astype(np.int64)
            flags = repeated(np.asarray(table["g"].combine_chunks()), table["seg"].to_pylist(), np.asarray(table["lo"].combine_chunks()).astype(np.int64), at, length, gram)
            row, a, b = _union(flags, at, length)
            yield _arrow_rows(["doc", "a", "b"], np.asarray(table["doc"].combine_chunks())[row], a.astype(np.int32), b.astype(np.int32))

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= BATCH_ROWS:
                g = np.concatenate([np.asarray(b.column(0)) for b in held])
                edge = int(np.flatnonzero(g != g[-1])[-1]) + 1 if g[0] != g[-1] else 0
                if edge:
                    yield from done(edge)
                    held = pa.Table.from_batches(held).slice(edge).combine_chunks().to_batches()
                    count -= edge
        if count:
            yield from done(count)

    one = segments.select(F.col(keys[0]).alias("g") if len(keys) == 1 else F.xxhash64(*keys).alias("g"), "doc", "lo", "at", "seg")
    return one.repartition("g").sortWithinPartitions("g").mapInArrow(lean(run), "doc long, a int, b int")


def _halved(large: DataFrame, length: int, gram: int) -> DataFrame:
    """(g, d1, d2, r0, r1, doc, lo, at, seg): the segments (g, r0, r1, doc, lo, at, seg) of windows that start r0 to r1 bytes before the anchor, in halves by that.

    g names the group of a half: the group before, the half, and the bytes that all its windows share; d1 and d2 digest its own bytes.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["g", "r0", "r1", "doc", "lo", "at", "seg"]
        kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] + [pa.int32()] * 2 + [pa.binary()]
        for batch in batches:
            out = []
            for g, r0, r1, doc, lo, at, seg in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                hi, middle = lo + len(seg) - length, (r0 + r1) // 2
                for first, last in ((r0, middle), (middle + 1, r1)):
                    a, b = max(lo, at - last), min(hi, at - first)
                    if first <= last and a <= b:
                        part = seg[a - lo : b - lo + length]
                        shared = part[at - first - a : at - last - a + length]
                        group = hashlib.blake2b(g.to_bytes(8, "little", signed=True) + first.to_bytes(4, "little") + shared, digest_size=8).digest()
                        own = hashlib.blake2b((at - a).to_bytes(4, "little") + part, digest_size=16).digest()
                        out.append((*np.frombuffer(group + own, np.int64).tolist(), first, last, doc, a, at, part))
            yield _arrow_rows(["g", "d1", "d2", "r0", "r1", "doc", "lo", "at", "seg"], *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))) if out else _arrow_rows(["g", "d1", "d2", "r0", "r1", "doc", "lo", "at", "seg"], *(pa.array([], t) for t in kinds))

    return large.mapInArrow(lean(run), "g long, d1 long, d2 long, r0 int, r1 int, doc long, lo int, at int, seg binary")


def _compared(segments: DataFrame, length: int, gram: int, group_rows: int) -> DataFrame:
    """(doc, a, b) of the windows that repeat among the distinct segments (ha, n, doc, lo, at, seg), n of which have the anchor ha."""
    found = _columnwise(segments.where(F.col("n") <= group_rows), ["ha"], length, gram)
    large = segments.where(F.col("n") > group_rows).select(F.col("ha").alias("g"), F.lit(0).alias("r0"), F.lit(length - gram).alias("r1"), "doc", "lo", "at", "seg")
    while (total := large.count()) > 0:
        halves = stored(_halved(large, length, gram), "halves")
        kinds = halves.groupBy("g", "d1", "d2").agg(F.count("*").alias("c"), F.min(F.struct("doc", "lo", "at", "r0", "r1")).alias("f"), F.first("seg").alias("seg"))
        kinds = stored(kinds.select("g", "d1", "d2", "c", "f.*", "seg"), "half-kinds")
        copies = met(halves.select("g", "d1", "d2", "doc", "lo", F.octet_length("seg").alias("size")), kinds.where("c > 1").select("g", "d1", "d2", "c"), ["g", "d1", "d2"], "c", 2 * total)
        sizes = stored(kinds.groupBy("g").agg(F.count("*").alias("n")), "half-sizes")
        sized = stored(met(kinds, sizes.withColumn("times", F.col("n")), ["g"], "times", 2 * total), "sized-halves")
        found = found.unionByName(copies.select("doc", F.col("lo").alias("a"), (F.col("lo") + F.col("size")).alias("b")))
        found = found.unionByName(_columnwise(sized.where(F.col("n") <= group_rows), ["g"], length, gram))
        large = sized.where(F.col("n") > group_rows).select("g", "r0", "r1", "doc", "lo", "at", "seg")
    return found


def repeats(rows: DataFrame, known: DataFrame, length: int = LENGTH, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc, a, b): byte spans of texts, as texts_of() gives them, whose bytes are covered by repeated strings; they may overlap."""
    ship(rows.sparkSession)

    def find(batches: Iterator) -> Iterator:
        for batch in batches:
            docs = np.asarray(batch.column(0))
            raw, offsets = text_bytes(batch.column(1))
            for text, lo, hi, at, ha, hu in anchors(raw, offsets, length, gram):
                yield _arrow_rows(["ha", "u1", "u2", "doc", "lo", "hi", "at"], ha.view(np.int64), hu[:, 0], hu[:, 1], docs[text], *(x.astype(np.int32) for x in (lo, hi, at)))

    found = stored(rows.select("doc", "text").mapInArrow(lean(find), "ha long, u1 long, u2 long, doc long, lo int, hi int, at int"), "anchors")
    total = found.count()
    segment = F.struct("u1", "u2")
    many = found.groupBy("ha").agg(F.count("*").alias("c"), (F.min(segment) != F.max(segment)).alias("mixed")).where("c > 1")
    shared = stored(met(found, stored(many, "repeated-anchors"), ["ha"], "c", total), "shared-anchors")
    whole = shared.where("NOT mixed").select("doc", F.col("lo").alias("a"), (F.col("hi") + length).alias("b"))

    mixed = shared.where("mixed").drop("mixed")
    kinds = stored(mixed.groupBy("ha", "u1", "u2").agg(F.count("*").alias("c"), F.min(F.struct("doc", "lo", "hi", "at")).alias("f")).select("ha", "u1", "u2", "c", "f.*"), "segment-kinds")
    copies = met(mixed, kinds.where("c > 1").select("ha", "u1", "u2", "c"), ["ha", "u1", "u2"], "c", total).select("doc", F.col("lo").alias("a"), (F.col("hi") + length).alias("b"))
    sizes = stored(kinds.groupBy("ha").agg(F.count("*").alias("n")), "group-sizes")
    compared = met(kinds.select("ha", "doc", "lo", "hi", "at"), sizes.where("n > 1").withColumn("times", F.col("n")), ["ha"], "times", total)
    by_doc = stored(compared.groupBy("doc").agg(F.collect_list(F.struct("ha", "lo", "hi", "at", "n")).alias("own")), "compared-anchors")  # of one text
    wanted = stored(by_doc.join(known, "doc").select(F.col("doc").alias("_doc"), F.col("id").alias("_id"), "own"), "compared-texts")
    few = wanted.count() <= BROADCAST_ROWS
    ids = wanted.select("_doc", "_id")
    texts = rows.join(F.broadcast(ids) if few else ids, (F.col("doc") == F.col("_doc")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    with_own = texts.join(wanted, F.col("doc") == F.col("_doc")).select("doc", "text", "own")

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            out, seen = [], set()
            for doc, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if doc in seen:  # a row given twice
                    continue
                seen.add(doc)
                data = text.as_py().encode()
                out += [(x["ha"], x["n"], doc, x["lo"], x["at"], data[x["lo"] : x["hi"] + length]) for x in own]
                if len(out) > 20_000:
                    yield _arrow_rows(["ha", "n", "doc", "lo", "at", "seg"], *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)))
                    out = []
            if out:
                yield _arrow_rows(["ha", "n", "doc", "lo", "at", "seg"], *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)))

    segments = stored(with_own.mapInArrow(lean(cut), "ha long, n long, doc long, lo int, at int, seg binary"), "segments")
    return whole.unionByName(copies).unionByName(_compared(segments, length, gram, group_rows))


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, group_rows: int = GROUP_ROWS, with_bytes: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of each row: what is left of its bytes."""
    rows, known = texts_of(docs, id_col, text_col)
    spans = repeats(rows, known, length, gram, group_rows)
    spans = spans.groupBy("doc").agg(F.collect_set(F.struct("a", "b")).alias("spans"))  # of one text
    spans = stored(spans.join(known.select("doc", "c"), "doc"), "repeated-spans")
    n_rows = known.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    names = spans.select("doc")
    touched = met(rows, spans, ["doc"], "c", n_rows).select("id", "text", "spans")
    rest = rows.join(F.broadcast(names) if names.count() <= BROADCAST_ROWS else names, "doc", "left_anti").select("id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    joined = touched.unionByName(rest)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        for batch in batches:
            rows = []
            for key, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data, parts, at, gone, runs = text.as_py().encode(), [], 0, 0, 0
                for a, b in sorted((x["a"], x["b"]) for x in own.as_py() or ()):
                    if b <= at and runs:
                        continue
                    if a > at or not runs:
                        parts.append(data[at:a])
                        runs += 1
                        gone += b - a
                    else:
                        gone += b - at
                    at = b
                parts.append(data[at:])
                left = b"".join(parts)
                rows.append((key, len(data), gone, runs, hashlib.sha256(left).hexdigest(), left if with_bytes else None))
            columns = list(zip(*rows, strict=True))[: 5 + with_bytes] if rows else [()] * (5 + with_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_bytes])

    return joined.mapInArrow(lean(run), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 200-byte strings."""
    return kept(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
