"""Language identification of whole, possibly mixed texts.

Words are runs of letters. A word's script, from fixed code-point ranges, narrows the languages it
may be; among these, sums of smoothed log-probabilities of its character n-grams (1 to 3, with word
ends) score it. Viterbi over the words, with a penalty for each switch, labels spans of one language
each. The text's language is the one with most letters, its score the share of letters under it.

The model is learned from a bounded sample of labelled rows: of each language about SAMPLE / languages rows, LEAST at
least, those of smallest hash among the ones that may be learned from. Each language keeps its most frequent
n-grams, FEATURES / languages of them, LEAST_FEATURES at least. The labels are looked at for nothing else.

Nulls: a null text, or one without a letter, is 'und' with score 0; so is every text if nothing could be learned. A
null id is not held out and not learned from. Ties go to the alphabetically first language. Repeated
rows: each has its row. Empty table: no rows. Other columns are left alone.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import batches, lean, ship, slices, stored, trim

SAMPLE, LEAST, FEATURES, LEAST_FEATURES, GRAMS, SMOOTHING = 6000, 20, 60_000, 400, (1, 2, 3), 0.5
#: Of Viterbi: log-probability lost by a switch, and the most that one word can count against a language.
SWITCH, CLIP = 12.0, 15.0
UNDETERMINED = "und"
BROADCAST_ROWS = 1_000_000
#: A language uses a script in which at least this share of its letters is.
SCRIPT_SHARE = 0.005
#: First code points of ranges of letters, by script; a range ends where the next begins.
SCRIPTS = (
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Burmese"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x3040, "Kana"), (0x3100, "Han"), (0xA000, "other"),
    (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"),
    (0xFE00, "other"), (0x20000, "Han"),
)
_STARTS = [s for s, _ in SCRIPTS]
WORD = re.compile(r"[^\W\d_]+")
CACHE, GROUP = 100_000, 512


def script(letter: str) -> str:
    """The script of a letter."""
    return SCRIPTS[max(0, bisect_right(_STARTS, ord(letter)) - 1)][1]


def grams(word: str) -> list[str]:
    """The word's letters, and its n-grams with its ends marked by spaces."""
    marked = f" {word} "
    return [*word, *(marked[i : i + n] for n in GRAMS[1:] for i in range(len(marked) - n + 1))]


def lowered(text: str | None) -> str:
    """In lower case, letter for letter: the one letter whose lower case is longer, dotted capital I, becomes i."""
    return (text or "").replace("\u0130", "i").lower()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def gram_keys(points: np.ndarray) -> list[np.ndarray]:
    """Of code points: a key for each 1-, 2- and 3-gram by its start; the ends of the text count as spaces."""
    after = np.concatenate([points[1:], [32]]).astype(np.uint64)
    third = np.concatenate([points[2:], [32, 32]])[: len(points)].astype(np.uint64)
    pair = (points << np.uint64(21)) | after | np.uint64(1 << 63)
    return [points, pair, (points << np.uint64(42)) | (after << np.uint64(21)) | third]


@dataclass
class Model:
    """Learned languages, the scripts each uses, and log-probabilities by n-gram (keys sorted; the last row: of any other)."""

    languages: list[str]
    scripts: dict[str, list[bool]]
    keys: np.ndarray
    table: np.ndarray
    known: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray | None = None
    _next: int = 1

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in ("languages", "scripts", "keys", "table")} | {"known": {}, "scores": None, "_next": 1}

    def score(self, words: list[str]) -> np.ndarray:
        """Log-scores of words by language, 0 for the best; languages that don't use a word's script lose CLIP."""
        points = codes(f" {' '.join(words)} ")
        space = points == 32
        inner = np.append(space[1:], True)
        total = np.zeros((len(points), len(self.languages)), np.float32)
        for keys, unless in zip(gram_keys(points), (space, np.zeros(len(points), bool), inner), strict=True):
            at = np.searchsorted(self.keys, keys)
            at[self.keys[np.minimum(at, len(self.keys) - 1)] != keys] = len(self.table) - 1
            found = self.table[at]
            found[unless] = 0
            total += found
        starts = np.flatnonzero(space)[:-1]
        sums = np.add.reduceat(total[:-1], starts)
        kinds = np.array([s for _, s in SCRIPTS])[np.maximum(np.searchsorted(_STARTS, points[starts + 1], "right") - 1, 0)]
        uses = np.array([self.scripts.get(s, [True] * len(self.languages)) for s in kinds.tolist()])
        sums = np.where(uses, sums, -np.inf)
        sums = np.maximum(sums - sums.max(1, keepdims=True), -CLIP)
        sums[[s not in self.scripts for s in kinds.tolist()]] = 0
        return sums.astype(np.float32)

    def learn_words(self, words: list[str]) -> None:
        """Gives rows of scores to words that have none; row 0 is for words without a letter."""
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if self.scores is None:
            self.scores = np.zeros((4096, len(self.languages)), np.float32)
        self.known.update((w, 0) for w in new if not any(map(str.isalpha, w)))
        new = [w for w in new if w not in self.known]
        at = self._next
        while at + len(new) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        if new:
            self.scores[at : at + len(new)] = self.score(new)
            self.known.update(zip(new, range(at, at + len(new)), strict=True))
        self._next = at + len(new)

    def forget(self) -> None:
        self.known, self.scores, self._next = {}, None, 1

    def indices(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


def learn(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """The model of a bounded sample of the rows with a language for which may_learn holds."""
    ship(docs.sparkSession)
    usable = docs.where(may_learn & docs[lang_col].isNotNull() & docs[id_col].isNotNull()).select(docs[id_col].alias("key"), docs[lang_col].alias("lang"), docs[text_col].alias("text"))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    wanted = max(LEAST, sample // max(1, len(sizes)))
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, wanted / n)) for lang, n in sizes.items()], "_lang string, share double")
    place = F.pmod(F.xxhash64("key"), F.lit(1 << 40)) / float(1 << 40)
    rows = usable.join(F.broadcast(shares), (F.col("lang") == F.col("_lang")) & (place < F.col("share"))).select("text", "lang")

    def count(batches: Iterator) -> Iterator:
        import pandas as pd

        sums: dict[str, Counter] = {}
        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
                mine = sums.setdefault(lang, Counter())
                for word, n in Counter(WORD.findall(lowered(text))).items():
                    for g in grams(word):
                        mine[g] += n
        yield pd.DataFrame([(lang, g, n) for lang, c in sums.items() for g, n in c.items()], columns=["lang", "gram", "n"])

    counted = rows.mapInPandas(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    each = max(LEAST_FEATURES, features // max(1, len(sizes)))
    ranked = counted.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram")))  # of the sample: a bounded vocabulary a language
    by_gram = ranked.groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("by"), F.min("r").alias("r"))
    kept = sorted(by_gram.where(F.col("r") <= each).select("gram", "by").collect(), key=lambda r: r["gram"])
    languages = sorted({x["lang"] for r in kept for x in r["by"]})
    place = {lang: k for k, lang in enumerate(languages)}
    counts = np.zeros((len(kept) + 1, len(languages)))
    letters: dict[str, np.ndarray] = {}
    for k, r in enumerate(kept):
        for x in r["by"]:
            counts[k, place[x["lang"]]] = x["n"]
        if len(r["gram"]) == 1 and r["gram"].isalpha():
            letters.setdefault(script(r["gram"]), np.zeros(len(languages)))
            letters[script(r["gram"])] += counts[k]
    table = np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * len(counts))).astype(np.float32) if languages else np.zeros((1, 0), np.float32)
    total = sum(letters.values()) if letters else 1
    scripts = {s: (n >= SCRIPT_SHARE * total).tolist() for s, n in letters.items()}
    keys = np.array([int(gram_keys(codes(r["gram"]))[len(r["gram"]) - 1][0]) for r in kept], np.uint64)
    order = np.argsort(keys)
    return Model(languages, {s: u for s, u in scripts.items() if any(u)}, keys[order], table[[*order.tolist(), len(kept)]])


def viterbi(words: list[np.ndarray], scores: np.ndarray, switch: float = SWITCH) -> list[np.ndarray]:
    """The best language of each word of each text; texts of like length take each step together."""
    out: list[np.ndarray] = [np.zeros(0, np.int16)] * len(words)
    order = sorted(range(len(words)), key=lambda d: -len(words[d]))
    for a in range(0, len(order), GROUP):
        group = [d for d in order[a : a + GROUP] if len(words[d])]
        if not group:
            break
        lengths = np.array([len(words[d]) for d in group])
        begins = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.concatenate([words[d] for d in group])
        n_at = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
        values = np.zeros((len(group), scores.shape[1]), np.float32)
        best_from, stays = np.empty(len(flat), np.int16), np.empty((len(flat), scores.shape[1]), bool)
        for t, n in enumerate(n_at.tolist()):
            at, now = begins[:n] + t, values[:n]
            best = now.argmax(1)
            moved = now[np.arange(n), best][:, None] - np.float32(switch if t else 0)
            stay = now >= moved
            best_from[at], stays[at] = best, stay
            values[:n] = np.where(stay, now, moved) + scores[flat[at]]
        labels, state = np.empty(len(flat), np.int16), values.argmax(1)
        for t in range(len(n_at) - 1, -1, -1):
            n = n_at[t]
            at, here = begins[:n] + t, state[:n]
            labels[at] = here
            state[:n] = np.where(stays[at, here], here, best_from[at])
        for k, d in enumerate(group):
            out[d] = labels[begins[k] : begins[k + 1]]
    return out


def labels_of(model: Model, texts: list[str | None]) -> Iterator[tuple[str, list[str], np.ndarray, np.ndarray]]:
    """Of each text: it in lower case, its words, which of them count, and the language of each of these."""
    for begin in range(0, len(texts), 2 * GROUP):
        lower = [lowered(text) if model.languages else "" for text in texts[begin : begin + 2 * GROUP]]
        if len(model.known) > CACHE:
            model.forget()
        cut = [WORD.findall(text) for text in lower]
        model.learn_words([w for words in cut for w in words])
        indices = [model.indices(words) for words in cut]
        found = viterbi([index[index > 0] for index in indices], model.scores) if model.languages else [np.zeros(0, np.int16)] * len(lower)
        yield from zip(lower, cut, (index > 0 for index in indices), found, strict=True)


def verdict(model: Model, words: list[str], counts: np.ndarray, labels: np.ndarray) -> tuple[str, float]:
    """The language with most letters, and their share."""
    if not len(labels):
        return UNDETERMINED, 0.0
    letters = np.bincount(labels, np.fromiter(map(len, words), np.int64, len(words))[counts], len(model.languages))
    top = int(letters.argmax())
    return model.languages[top], float(letters[top] / letters.sum())


def judged(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and score of each text."""
    return [verdict(model, words, counts, labels) for _, words, counts, labels in labels_of(model, texts)]


def accepted(docs: DataFrame, model: Model, least: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs in a language that holds at least this share of the letters.

    Texts go to Python once, in bounded batches, to tell which are rejected; these are stored by id and digest, and docs go without them, so
    no text is shuffled or written while rejected rows are few.
    """
    spark = docs.sparkSession
    ship(spark)

    @F.arrow_udf("boolean")
    def fits(texts: pa.Array) -> pa.Array:
        out: list[bool] = []
        for a, b in slices(texts):
            out += [lang != UNDETERMINED and score >= least for lang, score in judged(model, texts.slice(a, b - a).to_pylist())]
        trim()
        return pa.array(out, pa.bool_())

    text, fresh = docs[text_col].cast("string"), lambda name: name + "_" * (1 + max(map(len, docs.columns)))
    key = {"id": docs[id_col].cast("string"), "digest": F.unhex(F.md5(text.cast("binary")))}
    with batches(spark):
        rejected = stored(docs.where(~fits(text)).select(*(c.alias(fresh(n)) for n, c in key.items())).distinct(), "rejected")
    same = [c.eqNullSafe(F.col(fresh(n))) for n, c in key.items()]
    return docs.join(F.broadcast(rejected) if rejected.count() <= BROADCAST_ROWS else rejected, same, "left_anti")


SCHEMA = "id long, lang_pred string, score double, n_spans long, spans array<struct<lang:string,start:int,end:int>>"


def labelled(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """(id, lang_pred, score, n_spans, spans) of each row; spans, in code points, only where asked for."""
    ship(docs.sparkSession)

    def spans(text: str, counts: np.ndarray, labels: np.ndarray, edges: list[int]) -> list[dict]:
        places = [m.span() for m, counted in zip(WORD.finditer(text), counts, strict=True) if counted]
        return [{"lang": model.languages[labels[a]], "start": places[a][0], "end": places[b - 1][1]} for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def run(batches: Iterator) -> Iterator:
        kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))]
        for whole in batches:
            for begin, end in slices(whole.column(1)):
                batch, rows = whole.slice(begin, end - begin), []
                for key, (text, words, counts, labels) in zip(batch.column(0).to_pylist(), labels_of(model, batch.column(1).to_pylist()), strict=True):
                    edges = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)] if len(labels) else [0]
                    rows.append((key, *verdict(model, words, counts, labels), len(edges) - 1, spans(text, counts, labels, edges) if with_spans else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], ["id", "lang_pred", "score", "n_spans", "spans"])

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(lean(run), SCHEMA)


def fold(key: Column) -> Column:
    """crc32 of the id as text, mod 5; null for a null id."""
    return F.crc32(key.cast("string").cast("binary")) % 5


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, fold(docs["doc_id"]) != 0)
    out = labelled(docs, model)
    held_out = F.coalesce(fold(F.col("id")) == 0, F.lit(False))
    return out.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "lang_pred", "score", "n_spans")
