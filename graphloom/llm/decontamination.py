"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Texts are lower-cased and cut into words at ASCII characters other than letters and digits. A mask
selects some of the words under it and ignores the others, so that a hit survives substitutions at
the ignored places. The hashes under every mask at every position of benchmark and training texts
are joined; a hit names a document, an item and a diagonal (how far the item is shifted along the
document). On each diagonal the item is compared with the document word by word: it counts when in
some stretch of WINDOW words (or the whole item, if shorter) SHARE of the words agree.

First each document is only asked whether it has any seed of the benchmark: one probe a position, however many items share the
seed. Those that do are read again, equal texts once, and their seeds are joined with the items. What travels from there is the window of
the document that lies on the item. The benchmark's hashes, the ids of documents with seeds and the items that are hit are
broadcast while there are at most BROADCAST_ROWS of them (and BROADCAST_WORDS words of items), and joined by shuffle beyond, where a
seed that more than HOT_ITEMS items share is dealt over several keys. A seed that m items and n different texts share still
makes a comparison for each pair, spread over all tasks; and the result has a row for each document and item that overlap.

What the masks miss: of all ways to substitute as many words as SHARE allows, 2 of 15,504 in a stretch of 20
words, 17 of 1820 in an item of 16, 15 of 220 in one of 12, 15 of 28 in one of 8. Items of EXACT to 5 words have
a mask of their own length that ignores nothing, so they match exact copies; shorter ones cannot be told from
ordinary text and match nothing.

Nulls: a null text, on either side, matches nothing; a null id does, on either side, as an id of its own. Repeated
rows: a (document, item) pair is returned once; an id with several texts has the best match of them. Empty
tables: no rows. Long texts: a row's seeds are an array of its words' size. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import stored

#: 1: the word counts, 0: it is ignored.
MASKS = ("1101011", "111001011", "111011")
#: Items of at least so many words, but fewer than the shortest mask has, are matched as they are.
EXACT = 4
WINDOW, SHARE = 20, 0.75
#: Of what is broadcast: rows, and words of items.
BROADCAST_ROWS, BROADCAST_WORDS = 1_000_000, 5_000_000
#: Items that share a seed and are joined with the texts that have it as one key.
HOT_ITEMS = 1000
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.coalesce(F.array_remove(F.split(F.lower(text), SEPARATORS), ""), F.array().cast("array<string>"))


def _seed(w: Column, k: int, taken: list[int], places: bool):
    """Of a position: its hash under mask k, in a struct with the position where places are asked for."""
    h = lambda i: F.xxhash64(F.lit(k), *(F.get(w, i + F.lit(j)) for j in taken))
    return (lambda i: F.struct(i.alias("i"), h(i).alias("h"))) if places else h


def _seeds(w: Column, masks: tuple[str, ...], numbers: range, places: bool) -> Column:
    """Hashes under the masks of these numbers at all positions of an array of word hashes; as structs i, h, or alone."""
    out = []
    for k in numbers:
        taken = [j for j, c in enumerate(masks[k]) if c == "1"]
        last = F.size(w) - F.lit(len(masks[k]))
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        out.append(F.transform(at, _seed(w, k, taken, places)))
    return F.concat(*out)


def seeds(rows: DataFrame, masks: tuple[str, ...] = MASKS, numbers: range | None = None, places: bool = True) -> DataFrame:
    """(id, i, h) of rows (id, text): one row for each mask, or each of these numbers, and position; without places (id, h)."""
    hashed = rows.select("id", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("w"))
    found = hashed.select("id", F.explode(_seeds(F.col("w"), masks, range(len(masks)) if numbers is None else numbers, places)).alias("s"))
    return found.select("id", "s.i", "s.h") if places else found.select("id", F.col("s").alias("h"))


def _probed(rows: DataFrame, hashes: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """(id) of rows (id, text) at each position that has one of the hashes (distinct, small) under any mask.

    A row a position with a hash a mask, looked up in generated code: no arrays of hashes are made. Past the text's end a hash covers
    fewer words, which no item's does.
    """
    hashed = rows.select("id", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("w")).where(F.size("w") > 0)
    at = hashed.select("id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("i"))
    under = [F.xxhash64(F.lit(k), *(F.get("w", F.col("i") + F.lit(j)) for j, c in enumerate(mask) if c == "1")).alias(f"h{k}") for k, mask in enumerate(masks)]
    out = at.select("id", *under)
    for k in range(len(masks)):
        out = out.join(F.broadcast(hashes.select(F.col("h").alias(f"h{k}"), F.lit(True).alias(f"y{k}"))), f"h{k}", "left")
    return out.where(F.coalesce(*(F.col(f"y{k}") for k in range(len(masks)))).isNotNull()).select("id")


def with_short(items: DataFrame, masks: tuple[str, ...] = MASKS) -> tuple[str, ...]:
    """masks, and one of ones only for each number of words that items too short for them have: a few at most."""
    n = F.size(words(F.col("text"))).alias("n")
    lengths = items.select(n).where(F.col("n").between(EXACT, min(map(len, masks)) - 1)).distinct().collect()
    return (*masks, *("1" * r["n"] for r in sorted(lengths)))


def item_seeds(items: DataFrame, masks: tuple[str, ...], spaced: int) -> DataFrame:
    """seeds() of the items: under the first `spaced` masks, and of an item that is exactly as long as one of the others, under that."""
    n = F.size(words(F.col("text")))
    out = seeds(items.where(n >= min(map(len, masks[:spaced]))), masks, range(spaced))
    for k in range(spaced, len(masks)):
        out = out.unionByName(seeds(items.where(n == len(masks[k])), masks, range(k, k + 1)))
    return out


def _digest(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(text.cast("binary")))


def _salted(known: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """known (h, ..) and found (h, ..) with `salt`: a hash that more than HOT_ITEMS rows of known have is dealt over several salts, to each of which found's rows go."""
    hot = known.groupBy("h").agg(F.ceil(F.count("*") / HOT_ITEMS).cast("int").alias("_salts")).where("_salts > 1")  # at most a row for HOT_ITEMS of known
    if hot.isEmpty():
        return known.withColumn("salt", F.lit(0)), found.withColumn("salt", F.lit(0))
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    dealt = known.join(hot, "h", "left").withColumn("salt", F.pmod(F.xxhash64("item"), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    every = found.join(hot, "h", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt, every


def _matches(rows: DataFrame, items: DataFrame, masks: tuple[str, ...], window: int, share: float) -> tuple[DataFrame, DataFrame]:
    """(held, scored): held has (id, k) of each row (id, text) that has a seed of an item, k its text's digest; scored has (k, item, start, n_words, n_equal, best) of each of these texts and items that overlap.

    Equal texts are compared once. Of a row nothing but its id is kept at first, however many items have its seeds.
    """
    all_masks = with_short(items, masks)
    known = stored(item_seeds(items, all_masks, len(masks)).select(F.col("id").alias("item"), F.col("i").alias("at"), "h").distinct(), "item-seeds")
    hashes = stored(known.select("h").distinct(), "seed-hashes")
    few = hashes.count() <= BROADCAST_ROWS
    hit = _probed(rows, hashes, all_masks) if few else seeds(rows, all_masks, places=False).join(hashes, "h", "left_semi")
    wanted = stored(hit.select(F.col("id").alias("_id")).distinct(), "rows-with-seeds")
    few_rows = wanted.count() <= BROADCAST_ROWS
    with_hits = rows.join(F.broadcast(wanted) if few_rows else wanted, F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    with_hits = with_hits.where("text IS NOT NULL").withColumn("k", _digest(F.col("text")))
    texts = stored(with_hits.groupBy("k").agg(F.first("text").alias("text")).select("k", words(F.col("text")).alias("w"), "text"), "texts-with-seeds")
    own = seeds(texts.select(F.col("k").alias("id"), "text"), all_masks).withColumnRenamed("id", "k")
    if few and known.count() <= BROADCAST_ROWS:
        hits = own.join(F.broadcast(known), "h")
    else:
        dealt, every = _salted(known, own)
        hits = every.join(dealt, ["h", "salt"])
    hits = stored(hits.select("k", "item", (F.col("i") - F.col("at")).alias("start")).distinct(), "seed-hits")
    hit_items = stored(hits.select("item").distinct(), "hit-items")
    cut = items.select(F.col("id").alias("_item"), words(F.col("text")).alias("b"))
    cut = stored(cut.join(hit_items, F.col("_item").eqNullSafe(F.col("item")), "left_semi").withColumn("n_words", F.size("b")), "items-hit")
    size = cut.agg(F.count("*").alias("n"), F.sum("n_words").alias("words")).first()
    small = size["n"] <= BROADCAST_ROWS and (size["words"] or 0) <= BROADCAST_WORDS
    lengths = cut.select("_item", "n_words")
    same = F.col("item").eqNullSafe(F.col("_item"))
    placed = hits.join(F.broadcast(lengths) if size["n"] <= BROADCAST_ROWS else lengths, same).select("k", "item", "start", "n_words")
    begin = F.greatest("start", F.lit(0))
    windows = placed.join(texts, "k").select("k", "item", "start", (begin - F.col("start")).alias("skip"), F.slice("w", begin + 1, F.greatest(F.col("start") + F.col("n_words") - begin, F.lit(0))).alias("w"))
    pairs = windows.join(F.broadcast(cut) if small else cut, same)
    equal = F.transform("b", lambda x, j: F.when(F.get("w", j - F.col("skip")) == x, 1).otherwise(0))
    pairs = pairs.select("k", "item", "start", "n_words", equal.alias("m"))
    span = F.least(F.lit(window), F.col("n_words"))
    add = lambda a, x: a + x
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.col("n_words") - span + 1), lambda j: F.aggregate(F.slice("m", j, span), F.lit(0), add)))
    scored = pairs.select("k", "item", "start", "n_words", F.aggregate("m", F.lit(0), add).alias("n_equal"), best.alias("best"), span.alias("span"))
    return with_hits.select("id", "k").distinct(), scored.where(F.col("best") >= F.ceil(F.col("span") * F.lit(share))).drop("span")


def _items(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    return benchmark.select(benchmark[item_col].cast("long").alias("id"), benchmark[text_col].cast("string").alias("text")).distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(id, item, start, n_words, n_equal, best): one row for each document and item that overlap.

    start is the word of the document that the item's first word lies on (negative if before it),
    n_equal how many of the item's n_words agree, best the most that agree in a stretch; of
    several diagonals, the one with the greatest best, then n_equal, then the smallest start.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    held, scored = _matches(rows, _items(benchmark, item_col, item_text_col), masks, window, share)
    best = F.max(F.struct("best", "n_equal", (-F.col("start")).alias("s"), "n_words")).alias("t")
    by_text = stored(scored.groupBy("k", "item").agg(best), "matches")
    some = by_text.select("k").distinct()
    owners = stored(held.join(F.broadcast(some) if some.count() <= BROADCAST_ROWS else some, "k", "left_semi"), "owners")
    top = by_text.join(owners, "k").groupBy("id", "item").agg(F.max("t").alias("t"))
    return top.select("id", "item", (-F.col("t.s")).cast("long").alias("start"), F.col("t.n_words").cast("long").alias("n_words"), F.col("t.n_equal").cast("long").alias("n_equal"), F.col("t.best").cast("long").alias("best"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text overlaps with an item. Texts are known by a 128-bit digest, so equal ones go together and ids play no part."""
    text = docs[text_col].cast("string")
    _, scored = _matches(docs.select(_digest(text).alias("id"), text.alias("text")), _items(benchmark), MASKS, WINDOW, SHARE)
    found = stored(scored.select(F.col("k").alias("_k")).distinct(), "texts-found")
    return docs.join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, _digest(text) == found["_k"], "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that overlap."""
    out = overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


def _sql_seeds(table: str) -> str:
    """Short items have the key of their whole length; of documents such keys are only taken where an item has that length."""
    least, parts = min(map(len, MASKS)), []
    for k, mask in enumerate((*MASKS, *("1" * n for n in range(EXACT, least)))):
        key = " || ' ' || ".join(f"w[i + {j}]" for j, c in enumerate(mask) if c == "1")
        where = "" if k < len(MASKS) and table == "d" else f" WHERE len(w) >= {least}" if k < len(MASKS) else f" WHERE EXISTS (SELECT 1 FROM b WHERE len(b.w) = {len(mask)})" if table == "d" else f" WHERE len(w) = {len(mask)}"
        parts.append(f"SELECT id, i - 1 AS i, '{k} ' || {key} AS h FROM (SELECT id, w, unnest(range(1, len(w) - {len(mask)} + 2)) AS i FROM {table}{where})")
    return " UNION ALL ".join(parts)


OP10_SQL = f"""
WITH d AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '{SEPARATORS}'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
     b AS (SELECT DISTINCT item_id AS id, list_filter(string_split_regex(lower(text), '{SEPARATORS}'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
     ds AS ({_sql_seeds("d")}), bs AS ({_sql_seeds("b")}),
     hits AS (SELECT DISTINCT ds.id, bs.id AS item, ds.i - bs.i AS start FROM ds JOIN bs USING (h)),
     m AS (SELECT hits.id, item, start, len(b.w) AS n_words,
                  list_transform(range(0, len(b.w)), lambda k: CASE WHEN start + k >= 0 AND start + k < len(d.w) AND d.w[start + k + 1] = b.w[k + 1] THEN 1 ELSE 0 END) AS m
           FROM hits JOIN d ON d.id IS NOT DISTINCT FROM hits.id JOIN b ON b.id IS NOT DISTINCT FROM hits.item),
     s AS (SELECT *, list_sum(m) AS n_equal, least({WINDOW}, n_words) AS span,
                  list_max(list_transform(range(1, n_words - least({WINDOW}, n_words) + 2), lambda j: list_sum(m[j:j + least({WINDOW}, n_words) - 1]))) AS best FROM m)
SELECT id AS doc_id, item AS item_id, CAST(start AS BIGINT) AS start, CAST(n_words AS BIGINT) AS n_words, CAST(n_equal AS BIGINT) AS n_equal, CAST(best AS BIGINT) AS best
FROM s WHERE best >= ceil(span * {SHARE})
QUALIFY row_number() OVER (PARTITION BY id, item ORDER BY best DESC, n_equal DESC, start) = 1
"""
