"""Exact n-gram Jaccard join by parity sketches.

A text's node is the 128-bit BLAKE2b digest of its words, so texts of equal words are one node, whatever their
ids. A node's set holds the distinct word shingles, hashed to 64 bits from keyed SipHashes of the words.

Sketch: every token of a set is hashed to one of P parts and toggled there, in a bit sketch (one bit
a token) and in a XOR of token hashes. The bit sketches' Hamming distance is at most the symmetric
difference of the sets. Two sets of which the smaller has s tokens reach similarity p/q only if at
most s (q - p) / p tokens differ. Sets are banded by size; in the band of the smaller set at most t
tokens differ, so of more than t parts that are not empty one agrees in full: the parts' XORs, as keys, are
joined (a set also joins the lower band from which a smaller partner may come). Where a set leaves
too many parts empty to have more than t others, it adds the keys of a second dealing, and so on.

Of each key the smallest node is the head. First every node is tested with the heads of its keys (stars, cut
into buckets of BLOCK_DOCS). Most groups of copies end there: all of a group were found linked with one head. In the
groups that were not (connected by keys, but of several labels), all pairs of different labels are tested by size and
Hamming distance, nearest first. Groups are cut into blocks, and each pair of blocks is a task group of its
own, so neither a group nor its pairs are ever gathered or emitted. A link counts only when the pair's word shingles,
compared as words, reach the threshold; what is emitted are spanning links, and their components are taken once more.

Hot keys are combined before they are shuffled: of HELD_KEYS keys at a time, a task sends each once. They travel packed, KEY_BYTES
of the key and IDENT_BYTES of the node (its ident), many in a row. Two keys or nodes that agree in these bytes only add candidates: an ident
stands for all of its nodes, and these are candidates of each other, so no link is lost.

Nulls: a null text has no words, an empty set, and links with nothing; a null id is a document like others, but
never names a component unless all its ids are null. Texts with fewer words than a shingle have the whole
sequence as their one shingle. Repeated rows: each has its row, in the same component; an id with several texts
stands for several documents, each linked for itself. Empty table: no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import batches, components, lean, mix64, runs, ship, stored

#: A band's largest size over its smallest; how many more parts than t + 1; words hashed at a time.
RATIO, SLACK, SLICE = 1.5, 0.15, 200_000
#: A block of a candidate group: documents, and shingles. Groups of up to BLOCKS blocks are cut finer, down to LEAST_DOCS, to be spread over more tasks.
BLOCK_DOCS, BLOCK_SHINGLES, BLOCKS, LEAST_DOCS = 256, 400_000, 32, 64
#: So few sets are compared as words at once, without sketches.
DIRECT = 3
#: Keys that a task holds to combine them; tokens that it holds to count them.
HELD_KEYS, HELD_TOKENS = 500_000, 2_000_000
#: What travels of a key, beside its bucket, and of a node; keys in a row; tokens of all sets for a bucket, which has fewer keys than these.
KEY_BYTES, IDENT_BYTES, PACKED, BUCKET_TOKENS = 6, 5, 512, 1_000_000
#: Key of the words' hash.
HASH_KEY = "parity sketches."
#: Tokens that tell nothing alone: those in at least so many of the texts that a task holds at a time; at most so many of them.
COMMON_LEAST, COMMON_MOST = 5, 200_000
BROADCAST_ROWS = 1_000_000

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """A-Z in lower case, cut at space and \\x09 to \\x0D; the methods of bytes know ASCII only."""
    return (text or "").encode().lower().split()


def node_of(words: list[bytes]) -> bytes | None:
    """The words' digest; none without words."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def shingle_sets(words: list[list[bytes]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text's words, and their n + 1 bounds."""
    from pandas.util import hash_array

    counts = np.fromiter(map(len, words), np.int64, len(words))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    hashes = hash_array(np.array([*chain.from_iterable(words)], object), hash_key=HASH_KEY, categorize=False)
    text = np.repeat(np.arange(len(counts)), counts)
    n = np.maximum(counts - k + 1, np.minimum(counts, 1))  # shingles of each text
    starts = np.arange(len(hashes)) - bounds[:-1][text] < n[text]
    at, of = np.flatnonzero(starts), text[starts]
    size = np.minimum(counts[of], k)
    out = size.astype(np.uint64)
    for j in range(k):
        there = size > j
        out[there] = mix64(out[there] * _BASE + hashes[at[there] + j])
    ends = np.cumsum(n)
    for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
        out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (of[1:] != of[:-1])
    out, of = out[fresh], of[fresh]
    return out, np.searchsorted(of, np.arange(len(counts) + 1), "left")


def chunks(texts, k: int) -> Iterator[tuple[int, int, list[bytes | None], np.ndarray, np.ndarray]]:
    """(first row, end row, nodes, shingles, bounds) of an Arrow array of texts; chunks of about SLICE words or one text."""
    words, held, begin = [], 0, 0
    for at, text in enumerate(texts):
        words.append(words_of(text.as_py()))
        held += len(words[-1])
        if held >= SLICE:
            yield begin, at + 1, list(map(node_of, words)), *shingle_sets(words, k)
            words, held, begin = [], 0, at + 1
    if words:
        yield begin, begin + len(words), list(map(node_of, words)), *shingle_sets(words, k)


@lru_cache(maxsize=4)
def bands(p: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest size of the smaller set, tokens that may differ, and parts, of each band."""
    tops, low = [], 1
    while low < 1 << 40:
        top = max(low, int(low * RATIO))
        tops.append(top)
        low = top + 1
    top = np.array(tops, np.int64)
    most = top * (q - p) // p
    return top, most, np.where(most > 0, most + 1 + np.ceil(SLACK * (most + 1)), 1).astype(np.int64)


def part_keys(values: np.ndarray, bounds: np.ndarray, p: int, q: int, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) of all keys of all sets.

    A part that holds tokens of `common` (sorted) only would join all sets of a common passage. A set in
    which more than t parts hold other tokens leaves such parts out: one of those parts agrees with
    any partner, which has it too. Sets with fewer keep all parts; so the choice of common tokens changes
    no result.
    """
    top, most, parts = bands(p, q)
    rare = np.ones(len(values), np.uint8) if common is None or not len(common) else (common[np.minimum(np.searchsorted(common, values), len(common) - 1)] != values).astype(np.uint8)
    n = np.diff(bounds)
    own = np.searchsorted(top, n, "left")
    sets, keys = [], []
    for down in range(64):
        band = own - down
        # the lower bands from which a smaller partner may come: p n <= q top
        here = np.flatnonzero((n > 0) & (band >= 0) & ((down == 0) | (p * n <= q * top[np.maximum(band, 0)])))
        if down and not len(here):
            break
        for dealing in range(256):
            if not len(here):
                break
            size = n[here]
            begin = np.concatenate([[0], np.cumsum(size)])
            which = np.repeat(np.arange(len(here)), size)
            at = np.arange(begin[-1]) - np.repeat(begin[:-1] - bounds[:-1][here], size)
            tokens, b = values[at], band[here]
            salt = mix64(b.astype(np.uint64) * _U(1000) + _U(dealing))[which]
            part = (mix64(tokens ^ salt) % parts[b][which].astype(np.uint64)).astype(np.int64)
            base = np.concatenate([[0], np.cumsum(parts[b])])
            slot = base[:-1][which] + part
            order = np.argsort(slot, kind="stable")
            slot = slot[order]
            heads = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
            xors = np.bitwise_xor.reduceat(mix64(tokens + _BASE)[order], heads)
            telling = np.bitwise_or.reduceat(rare[at][order], heads) > 0
            owner = which[order][heads]
            enough = np.bincount(owner[telling], minlength=len(here)) > most[b]
            sent = telling | ~enough[owner]
            sets.append(here[owner[sent]])
            place = slot[heads].astype(np.uint64) - base[:-1][owner].astype(np.uint64)
            keys.append(mix64(xors ^ mix64(place + (salt[order][heads] << _U(1))))[sent])
            here = here[~enough & (np.bincount(owner, minlength=len(here)) <= most[b])]
        else:
            raise RuntimeError("a set filled too few parts in every dealing")
    return (np.concatenate(sets), np.concatenate(keys)) if sets else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def sketch(values: np.ndarray, words: int) -> np.ndarray:
    """Parity bits of a set in 64-bit words, a power of two of them."""
    bit = mix64(values ^ _U(0x5EED))
    counts = np.bincount((bit % _U(64 * words)).astype(np.int64), minlength=64 * words)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.uint64)


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def shingles_of(words: list[bytes], k: int) -> set[tuple[bytes, ...]]:
    """The set itself, for a last comparison."""
    return set(zip(*(words[j:] for j in range(k)), strict=False)) if len(words) >= k else {tuple(words)} if words else set()


def linked(words: list[list[bytes]], left: np.ndarray, right: np.ndarray, k: int, p: int, q: int, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links of the pairs of left and right members that reach p/q; members of one label count as linked."""
    if len(words) <= DIRECT:
        return _compared(words, left, right, k, p, q, labels)
    values, bounds = shingle_sets(words, k)
    sets = [values[bounds[r] : bounds[r + 1]] for r in range(len(words))]
    n = np.diff(bounds)
    labels = np.arange(len(words)) if labels is None else labels
    size = min(1 << max(2, int(np.median(n) / 16).bit_length()), 256)
    bits = np.stack([sketch(s, size) for s in sets])
    forest, out = Forest(len(sets)), []
    _, first = np.unique(labels, return_index=True)
    head = {labels[i]: i for i in first.tolist()}
    for x, label in enumerate(labels.tolist()):
        forest.join(head[label], x)
    same = len(left) == len(right) and (left == right).all()
    pairs = []
    for at, x in enumerate(left.tolist()):
        others = right[at + 1 :] if same else right
        fits = others[(q * np.minimum(n[x], n[others]) >= p * np.maximum(n[x], n[others])) & (labels[others] != labels[x])]
        if not len(fits):
            continue
        apart = np.bitwise_count(bits[fits] ^ bits[x]).sum(1, dtype=np.int64)
        near = apart * (q + p) <= (n[x] + n[fits]) * (q - p)
        pairs.append(np.stack([apart[near], np.full(near.sum(), x), fits[near]]))
    if not pairs:
        return out
    pairs = np.concatenate(pairs, 1)
    for _, x, y in pairs[:, np.argsort(pairs[0], kind="stable")].T.tolist():
        if forest.root(x) == forest.root(y):
            continue
        common = len(sets[x]) + len(sets[y]) - len(np.union1d(sets[x], sets[y]))
        if q * common >= p * (len(sets[x]) + len(sets[y]) - common):
            a, b = shingles_of(words[x], k), shingles_of(words[y], k)
            if q * len(a & b) >= p * len(a | b):
                forest.join(x, y)
                out.append((x, y))
    return out


def _compared(words: list[list[bytes]], left: np.ndarray, right: np.ndarray, k: int, p: int, q: int, labels: np.ndarray | None) -> list[tuple[int, int]]:
    """linked() of a few members."""
    sets, forest, out = [shingles_of(w, k) for w in words], Forest(len(words)), []
    for x in left.tolist():
        for y in right.tolist():
            if x != y and (labels is None or labels[x] != labels[y]) and forest.root(x) != forest.root(y) and q * len(sets[x] & sets[y]) >= p * len(sets[x] | sets[y]):
                forest.join(x, y)
                out.append((x, y))
    return out


def _digested(rows: DataFrame, k: int) -> DataFrame:
    """(id, n, node, digest) of rows (id, text, digest); and, with `times`, tokens (as id) that so many of the texts that a task held at a time have."""
    names = ["id", "n", "node", "digest", "times"]

    def often(tokens: list[np.ndarray]):
        sorted_tokens = np.sort(np.concatenate(tokens))
        heads = np.flatnonzero(np.concatenate([[True], sorted_tokens[1:] != sorted_tokens[:-1]]))
        times = np.diff(np.append(heads, len(sorted_tokens)))
        kept = times >= COMMON_LEAST
        m = int(kept.sum())
        return pa.RecordBatch.from_arrays([pa.array(sorted_tokens[heads[kept]].view(np.int64)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.array(times[kept])], names)

    def run(batches: Iterator) -> Iterator:
        tokens, held = [], 0
        for batch in batches:
            for a, b, nodes, values, bounds in chunks(batch.column(1), k):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(bounds)), pa.array(nodes, pa.binary()), batch.column(2).slice(a, b - a), pa.nulls(b - a, pa.int64())], names)
                tokens.append(values)
                held += len(values)
                if held >= HELD_TOKENS:
                    yield often(tokens)
                    tokens, held = [], 0
        if held:
            yield often(tokens)

    return rows.mapInArrow(lean(run), "id long, n long, node binary, digest binary, times long")


def _common(digested: DataFrame) -> np.ndarray:
    """At most COMMON_MOST tokens of those that many texts have, sorted. Which ones are taken changes no result."""
    often = digested.where("times IS NOT NULL").groupBy(F.col("id").alias("token")).agg(F.sum("times").alias("n")).orderBy(F.desc("n"), "token").limit(COMMON_MOST)
    return np.sort(often.select("token").toPandas()["token"].to_numpy(np.int64).view(np.uint64))


def _headed(keys: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted keys and who has them: the first place of each key, and distinct (head, other) positions of nodes with a common key."""
    first = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
    head = own[np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))] if len(keys) else own
    pairs = np.unique(np.stack([head[~first], own[~first]], 1), axis=0)
    return first, head, pairs[pairs[:, 0] != pairs[:, 1]]


def ident_of(node: bytes, width: int) -> int:
    """The first bytes of a node as a number, so that idents are in the order of nodes."""
    return int.from_bytes(node[:width], "big")


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """The low bytes of unsigned numbers, a row each."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def _unpacked(raw: bytes, width: int, per_row: int = 1) -> np.ndarray:
    """Numbers of so many bytes, so many in a row."""
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").astype(np.int64).reshape(-1, per_row)


def _rows_of(bucket: np.ndarray, columns: list[np.ndarray | None]) -> Iterator:
    """Batches (bucket, binary columns) of items sorted by bucket: a row holds up to PACKED items of a bucket."""
    if not len(bucket):
        return
    heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = np.append(heads[1:], len(bucket))
    pieces = (ends - heads + PACKED - 1) // PACKED
    which = np.repeat(np.arange(len(heads)), pieces)
    starts = heads[which] + PACKED * (np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    cuts = np.append(starts, len(bucket))
    for at in range(0, len(starts), 200):
        here = cuts[at : at + 201]
        arrays = [pa.array(bucket[here[:-1]], pa.int32())]
        for c in columns:
            if c is None:
                arrays.append(pa.nulls(len(here) - 1, pa.binary()))
            else:
                raw = np.ascontiguousarray(c[here[0] : here[-1]])
                offsets = ((here - here[0]) * c.shape[1]).astype(np.int32)
                arrays.append(pa.Array.from_buffers(pa.binary(), len(here) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)]))
        yield pa.RecordBatch.from_arrays(arrays, ["bucket", "keys", "nodes"])


def _candidates(rows: DataFrame, k: int, p: int, q: int, common: np.ndarray | None = None, buckets: int = 1) -> DataFrame:
    """(a, b): idents of nodes of rows (text) that connect all sets with a common key; a is the head of such a key, in a batch or overall."""
    width = IDENT_BYTES

    def combined(names: dict[bytes, int], own: list[np.ndarray], keys: list[np.ndarray]) -> Iterator:
        """The keys of some nodes, each key once with its smallest node, and the pairs of that node and the others."""
        nodes = sorted(names)
        rank = {node: r for r, node in enumerate(nodes)}
        idents = np.array([ident_of(node, width) for node in nodes], np.int64)
        place, key = np.array([rank[node] for node in names], np.int64)[np.concatenate(own)], np.concatenate(keys)
        order = np.lexsort((place, key))
        place, key = place[order], key[order]
        first, _, pairs = _headed(key, place)
        key, place = key[first], place[first]
        bucket = key % _U(buckets)
        order = np.argsort(bucket, kind="stable")
        yield from _rows_of(bucket[order].astype(np.int32), [_packed(key[order] // _U(buckets), KEY_BYTES), _packed(idents[place[order]], width)])
        bucket = mix64(pairs[:, 0].astype(np.uint64) * _BASE + pairs[:, 1].astype(np.uint64)) % _U(buckets)
        order = np.argsort(bucket, kind="stable")
        yield from _rows_of(bucket[order].astype(np.int32), [None, np.concatenate([_packed(idents[pairs[order, 0]], width), _packed(idents[pairs[order, 1]], width)], 1)])

    def emit(batches: Iterator) -> Iterator:
        names: dict[bytes, int] = {}
        own, keys, held = [], [], 0
        for batch in batches:
            for _, _, nodes, values, bounds in chunks(batch.column(0), k):
                fresh, place = np.zeros(len(nodes), bool), np.zeros(len(nodes), np.int64)
                for r, node in enumerate(nodes):
                    if node is not None:
                        fresh[r] = node not in names
                        place[r] = names.setdefault(node, len(names))
                sets, part = part_keys(values, bounds, p, q, common)
                told = fresh[sets]
                own.append(place[sets[told]])
                keys.append(part[told])
                held += len(keys[-1])
                if held >= HELD_KEYS:
                    yield from combined(names, own, keys)
                    names, own, keys, held = {}, [], [], 0
        if own:
            yield from combined(names, own, keys)

    def meet(batches: Iterator) -> Iterator:
        import pyarrow.compute as pc

        for table in runs(batches, 1):
            told = pc.is_null(table["keys"])
            found = [_unpacked(b"".join(table["nodes"].filter(told).to_pylist()), width, 2)]
            rest = table.filter(pc.invert(told))
            keys, own = _unpacked(b"".join(rest["keys"].to_pylist()), KEY_BYTES)[:, 0], _unpacked(b"".join(rest["nodes"].to_pylist()), width)[:, 0]
            order = np.lexsort((own, keys))
            found.append(_headed(keys[order], own[order])[2])
            pairs = np.concatenate(found)
            for at in range(0, len(pairs), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[at : at + 50_000, 0]), pa.array(pairs[at : at + 50_000, 1])], ["a", "b"])

    packed = rows.mapInArrow(lean(emit), "bucket int, keys binary, nodes binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(meet), "a long, b long").where("a <> b").distinct()


def _texts_of(rows: DataFrame, wanted: DataFrame, few: bool) -> DataFrame:
    """(node, text), stored: one text of each wanted node; wanted has (node, id), the smallest id that has it, once a node."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([node_of(words_of(t.as_py())) for t in batch.column(0)], pa.binary()), batch.column(0)], ["node", "text"])

    ids, nodes = wanted.select(F.col("id").alias("_id")).distinct(), wanted.select("node")
    held = rows.join(F.broadcast(ids) if few else ids, F.col("id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    texts = stored(held.mapInArrow(lean(run), "node binary, text string").join(F.broadcast(nodes) if few else nodes, "node", "left_semi"), "candidate-texts")
    # each node is there; unless an id or a row is repeated, once, and then no text travels for it
    return texts if texts.count() == wanted.count() else stored(texts.dropDuplicates(["node"]), "candidate-texts")


def _starred(members: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """(a, b): of members (head, bucket, node, text) the links of each head with the others of its bucket."""

    def run(batches: Iterator) -> Iterator:
        for table in runs(batches, 2):
            head, nodes = table["head"][0].as_py(), table["node"].to_pylist()
            at = nodes.index(head)
            words = [words_of(t) for t in table["text"].to_pylist()]
            own = np.array([at])
            links = [nodes[y] for _, y in linked(words, own, np.delete(np.arange(len(nodes)), at), k, p, q)]
            yield pa.RecordBatch.from_arrays([pa.array([head] * len(links), pa.binary()), pa.array(links, pa.binary())], ["a", "b"])

    return members.select("head", "bucket", "node", "text").repartition("head", "bucket").sortWithinPartitions("head", "bucket").mapInArrow(lean(run), "a binary, b binary")


def _tiled(members: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """(a, b): of members (component, i, j, block, label, node, text) spanning links between blocks i and j of each component."""

    def run(batches: Iterator) -> Iterator:
        for table in runs(batches, 3):
            i, j = table["i"][0].as_py(), table["j"][0].as_py()
            block, nodes = np.asarray(table["block"]), table["node"].to_pylist()
            labels = np.asarray(table["label"].combine_chunks().dictionary_encode().indices).astype(np.int64)
            links = linked([words_of(t) for t in table["text"].to_pylist()], np.flatnonzero(block == i), np.flatnonzero(block == j), k, p, q, labels)
            yield pa.RecordBatch.from_arrays([pa.array([nodes[x] for x, _ in links], pa.binary()), pa.array([nodes[y] for _, y in links], pa.binary())], ["a", "b"])

    return members.select("component", "i", "j", "block", "label", "node", "text").repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(lean(run), "a binary, b binary")


def _links(rows: DataFrame, known: DataFrame, k: int, p: int, q: int, common: np.ndarray) -> DataFrame:
    """(a, b): links of nodes that connect all that are to be connected; known has (node, id, n) once a node."""
    known = known.withColumn("ident", F.conv(F.hex(F.substring("node", 1, IDENT_BYTES)), 16, 10).cast("long"))
    tokens = known.agg(F.sum("n")).first()[0] or 0
    stars = stored(_candidates(rows.select("text"), k, p, q, common, 1 + tokens // BUCKET_TOKENS), "candidate-links")
    groups = stored(components(stars, "candidate-groups").withColumnRenamed("id", "ident"), "candidate-nodes")
    twins = stored(known.groupBy("ident").agg(F.min("node").alias("first"), F.count("*").alias("m")).where("m > 1").select("ident", "first"), "twins")
    groups = groups.unionByName(twins.join(groups, "ident", "left_anti").select("ident", F.col("ident").alias("component")))
    few = groups.count() <= BROADCAST_ROWS
    wanted = stored(known.join(F.broadcast(groups) if few else groups, "ident"), "candidate-sizes")
    texts = _texts_of(rows, wanted, few)

    # a head and another of too different sizes cannot link with each other, so their texts need not meet
    sizes = wanted.select("ident", "node", "n")
    sizes = F.broadcast(sizes) if few else sizes
    same = wanted.join(F.broadcast(twins), "ident").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    met = stars.toDF("ident_a", "ident_b").join(sizes.toDF("ident_a", "a", "n_a"), "ident_a").join(sizes.toDF("ident_b", "b", "n_b"), "ident_b")
    fit = met.where(p * F.greatest("n_a", "n_b") <= q * F.least("n_a", "n_b")).select("a", "b").unionByName(same)
    stars = stored(fit.select("a", "b"), "fitting-links")
    buckets = stars.groupBy(F.col("a").alias("head")).agg(F.ceil(F.count("*") / BLOCK_DOCS).cast("int").alias("nb")).where("nb > 1")
    buckets = stored(buckets, "large-stars")  # at most a row for BLOCK_DOCS pairs
    large = F.broadcast(buckets) if buckets.count() <= BROADCAST_ROWS else buckets
    dealt = stars.select(F.col("a").alias("head"), F.col("b").alias("node")).join(large, "head", "left").select("head", F.pmod(F.xxhash64("node"), F.coalesce("nb", F.lit(1))).cast("int").alias("bucket"), "node")
    heads = dealt.select("head", "bucket").distinct().select("head", "bucket", F.col("head").alias("node"))
    near = stored(_starred(dealt.unionByName(heads).join(texts, "node"), k, p, q), "star-links")

    labels = stored(near.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("head")), "star-labels")
    # the heads of batches have heads of their own
    labels = labels.join(labels.select(F.col("node").alias("head"), F.col("head").alias("top")), "head", "left").select("node", F.coalesce("top", "head").alias("head"))
    named = stored(wanted.join(labels, "node", "left").select("node", "component", "n", F.coalesce("head", "node").alias("label")), "candidate-labels")
    mixed = named.groupBy("component").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.least(F.ceil(F.count("*") / LEAST_DOCS), F.greatest(F.lit(BLOCKS), F.ceil(F.count("*") / BLOCK_DOCS))).alias("nb"), F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("ns")).where("l0 <> l1")
    mixed = stored(mixed.select("component", F.greatest("nb", "ns").cast("int").alias("nb")), "mixed-groups")
    left = F.broadcast(mixed) if mixed.count() <= BROADCAST_ROWS else mixed
    members = named.join(left, "component").select("node", "component", "label", "nb", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int").alias("block"))
    tiles = members.join(texts, "node").select("node", "text", "component", "label", "block", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    tiles = tiles.select("node", "text", "component", "label", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return near.unionByName(_tiled(tiles, k, p, q))


def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, p: int = 90, q: int = 100, with_digest: bool = False) -> DataFrame:
    """(id, n, component, node, digest) of each row: size of its set, and the smallest id that it is linked with, through others too, at p/q or more.

    node stands for the text's words, digest, if it is asked for, for the text itself.
    """
    spark = docs.sparkSession
    ship(spark)
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].cast("long").alias("id"), text.alias("text"), (_digest(text) if with_digest else F.lit(None).cast("binary")).alias("digest"))
    with batches(spark):
        digested = stored(_digested(rows, k), "nodes")
        common = _common(digested)
        digested = digested.where("times IS NULL").drop("times")
        known = stored(digested.where("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.count("*").alias("c")), "distinct-nodes")
        joined = stored(components(_links(rows.drop("digest"), known.drop("c"), k, p, q, common), "verified-links"), "linked-nodes").withColumnRenamed("id", "node")
    few = joined.count() <= BROADCAST_ROWS
    named = known.join(F.broadcast(joined) if few else joined, "node", "left").where("c > 1 OR component IS NOT NULL").select("node", "id", F.coalesce("component", "node").alias("component"))
    named = stored(named, "named-nodes")
    least = named.groupBy("component").agg(F.min("id").alias("least"))
    named = stored(named.join(least, "component").select(F.col("node").alias("_node"), "least"), "named-nodes")
    out = digested.join(F.broadcast(named) if named.count() <= BROADCAST_ROWS else named, F.col("node") == F.col("_node"), "left")
    return out.select("id", "n", F.coalesce("least", "id").alias("component"), "node", "digest")


def _digest(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(text.cast("binary")))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """docs with one row of each component, that of the smallest id (of several texts of that id the one of the smallest digest). Rows with an empty set stay, and so do those of components without an id."""
    found = clusters(docs, id_col, text_col, k, p, q, with_digest=True).where("n > 0").groupBy("id", "digest").agg(F.first("component").alias("component"), F.count("*").alias("c"))
    found = stored(found, "nodes-by-id")
    stays = found.where("id = component")
    several = stays.groupBy("id").agg(F.min("digest").alias("first"), F.count("*").alias("m")).where("m > 1").select("id", "first")
    second = stays.join(several, "id").where("digest <> first").select("id", "digest", F.lit(False).alias("one"))
    others = found.where(~F.col("id").eqNullSafe(F.col("component"))).select("id", "digest", F.lit(False).alias("one"))
    repeated = stays.where("c > 1").join(second, ["id", "digest"], "left_anti").select("id", "digest", F.lit(True).alias("one"))
    found = stored(others.unionByName(second).unionByName(repeated), "copies")
    fresh = lambda name: name + "_" * (1 + max(map(len, docs.columns)))
    marked = docs.withColumns({fresh("d"): _digest(docs[text_col].cast("string")), fresh("i"): docs[id_col].cast("long")})
    gone = found.toDF(fresh("id"), fresh("digest"), fresh("one"))
    same = F.col(fresh("i")).eqNullSafe(F.col(fresh("id"))) & (F.col(fresh("d")) == F.col(fresh("digest")))
    small = found.count() <= BROADCAST_ROWS
    kept = marked.join(F.broadcast(gone) if small else gone, same, "left_anti").select(*docs.columns)
    again = gone.where(F.col(fresh("one")))
    if again.isEmpty():
        return kept
    one = marked.join(F.broadcast(again) if small else again, same, "left_semi").dropDuplicates([fresh("i"), fresh("d")])
    return kept.unionByName(one.select(*docs.columns))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets reach a Jaccard similarity of 0.9."""
    return clusters(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("node", "digest").toDF("doc_id", "n_shingles", "component_id")
