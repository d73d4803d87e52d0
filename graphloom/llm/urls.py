"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

Glob rules are compiled into one automaton of state bits packed over as many 64-bit words as they
need. A step takes one byte of each URL of a batch and moves all patterns of all these URLs at once:
shift the states, mask them by what the byte may match, and keep the states that a wildcard lets
stand (Shift-And with self-loops). In a glob, ** matches any bytes, * any bytes but '/', ? one byte.

The canonical form is host + path: the host is what follows the first '://' up to '/', '?', '#' or
the end, with A-Z lower-cased; the path goes on up to '?', '#' or the end. A host holds no '/', so
'*' cannot leave it. A host rule (host, path) is two globs: the host itself, and any subdomain.

Nulls and URLs without '://': host and path are empty; no rule fits them, and they are allowed. A
null id stays null. Repeated rows: each has its row. Empty table: no rows. Other columns are not
looked at. An empty rule list allows everything.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import ship, text_bytes

#: The rules of the contract: verdict, host and path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: What decides where no rule fits: a URL that one of these globs matches is blocked.
BLOCKED_GLOBS = ("*spam*/**", "*spam*", "*cheap-*/**", "*cheap-*", "*casino*/**", "*casino*", "**/ads/**", "**.exe", "**viagra**")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: URLs of a batch that are stepped together at most, and bytes that their states take at most (a few such arrays live at once).
LANES, STATE_BYTES = 16_384, 16 << 20


@dataclass
class Automaton:
    """Masks by byte and word; bits of starts and of ends; ends[k] is the bit of pattern k."""

    step: np.ndarray
    stay: np.ndarray
    start: np.ndarray
    ends: list[int]

    @property
    def words(self) -> int:
        return len(self.start)


def compiled(globs: Sequence[str]) -> Automaton:
    """One automaton for all globs. A pattern of n literal bytes takes n + 1 bits, of which the first is its start."""
    parsed: list[list[tuple[int | None, str]]] = []  # of each bit: the byte that enters it (None: any), and what lets it stand
    for glob in globs:
        raw, bits, k = glob.encode(), [(-1, "")], 0
        while k < len(raw):
            if raw[k] == 42:
                deep = raw[k : k + 2] == b"**"
                bits[-1] = (bits[-1][0], "any" if deep or bits[-1][1] == "any" else "part")
                k += 1 + deep
            else:
                bits.append((None if raw[k] == 63 else raw[k], ""))
                k += 1
        parsed.append(bits)
    total = sum(map(len, parsed))
    words = max(1, -(-total // 64))
    step, stay, start, ends, at = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64), np.zeros(words, np.uint64), [], 0
    for bits in parsed:
        for k, (byte, standing) in enumerate(bits):
            word, bit = at // 64, np.uint64(1) << np.uint64(at % 64)
            if k == 0:
                start[word] |= bit
            elif byte is None:
                step[:, word] |= bit
            else:
                step[byte, word] |= bit
            if standing:
                stay[:, word] |= bit
                if standing == "part":
                    stay[47, word] &= ~bit
            at += 1
        ends.append(at - 1)
    return Automaton(step, stay, start, ends)


def matches(auto: Automaton, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Final states (n, words) of the texts in raw; the lanes that have ended drop out, longest first."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    states = np.repeat(auto.start[None, :], len(lengths), 0)
    begins, sizes, live = offsets[:-1][order], lengths[order], states[order]
    one, top = np.uint64(1), np.uint64(63)
    for k in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -k, "left"))  # those longer than k
        now = live[:n]
        byte = raw[begins[:n] + k]
        moved = now << one
        moved[:, 1:] |= now[:, :-1] >> top
        live[:n] = (moved & auto.step[byte]) | (now & auto.stay[byte])
    states[order] = live
    return states


def hit(auto: Automaton, states: np.ndarray, pattern: int) -> np.ndarray:
    """Whether the pattern matched, for each text."""
    end = auto.ends[pattern]
    return (states[:, end // 64] >> np.uint64(end % 64) & np.uint64(1)).astype(bool)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path, both empty for null or without '://'."""
    there = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + F.lit(3), F.lit(2147483647))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.when(there, F.translate(host, UPPER, LOWER)).otherwise(""), F.when(there, path).otherwise("")


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, blocked: Sequence[str] = BLOCKED_GLOBS) -> DataFrame:
    """(id, host, path, rule, verdict): the longest rule that fits decides; without one, the globs do."""
    ship(pages.sparkSession)
    globs = [g for _, rule in rules for g in (f"{rule}**", f"*.{rule}**")] + list(blocked)
    by_length = sorted(range(len(rules)), key=lambda k: (len(rules[k][1].encode()), -k))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        auto = compiled(globs)
        lanes = max(64, min(LANES, STATE_BYTES // (8 * auto.words)))
        for whole in batches:
            for at in range(0, whole.num_rows, lanes):
                batch = whole.slice(at, lanes)
                raw, offsets = text_bytes(batch.column(3))
                states = matches(auto, raw, offsets)
                rule, block = np.full(batch.num_rows, None, object), np.zeros(batch.num_rows, bool)
                for k in range(len(blocked)):
                    block |= hit(auto, states, 2 * len(rules) + k)
                for k in by_length:
                    fits = hit(auto, states, 2 * k) | hit(auto, states, 2 * k + 1)
                    rule[fits], block[fits] = rules[k][1], rules[k][0] == "block"
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(2), pa.array(rule, pa.string()), pa.array(np.where(block, "block", "allow").tolist(), pa.string())],
                    ["id", "host", "path", "rule", "verdict"],
                )

    host, path = parts(pages[url_col])
    canonical = pages.select(pages[id_col].cast("long").alias("id"), host.alias("host"), path.alias("path")).withColumn("canonical", F.concat("host", "path"))
    return canonical.mapInArrow(run, "id long, host string, path string, rule string, verdict string")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page."""
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("id", "page_id")


OP7_SQL = """
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
     q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
     r AS (SELECT *, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM q)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
    WHEN contains(host, 'spam') OR contains(host, 'cheap-') OR contains(host, 'casino')
      OR contains(path, '/ads/') OR ends_with(path, '.exe') OR (path = '' AND ends_with(host, '.exe'))
      OR contains(host || path, 'viagra') THEN 'block'
    ELSE 'allow' END AS verdict FROM r
"""
