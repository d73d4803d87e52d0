"""The operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import common, decontamination, jaccard, language, neighbours, packing, pii, sharding, substrings, token_counts, tokens, urls
from tests.llm.test_kernels import brute_cover, brute_sets, brute_spans, thue_morse

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is that it for was on with as be by at from this have are not or an they which you one had".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "ing", "ed", "s", "ly"]) for _ in range(n))


def corpus():
    """Exact and near copies, a shared passage, benchmark leaks, personal data, empty, null and long texts."""
    rng = random.Random(5)
    base, passage = sentence(rng, 120), sentence(rng, 70)
    texts = [sentence(rng, rng.randrange(1, 200)) for _ in range(30)]
    texts += [base] * 4
    for k in range(12):
        words = base.split()
        for _ in range(k):
            words[rng.randrange(len(words))] = f"new{rng.randrange(100)}"
        texts.append(" ".join(words))
    texts += [f"{sentence(rng, 20)} {passage} {sentence(rng, 15)}" for _ in range(5)]
    texts += ["", None, "123 ... !!", "x", "A B", "a b", sentence(rng, 6000), "mail me@example.com or +1 (555) 010-9999", "zeta " * 400]
    return [(i, t, "en", None if i % 9 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(corpus(), DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """With more columns of the names that the operators use inside."""
    return df.withColumns({c: F.lit("x") for c in ("id", "n", "rep", "component", "h", "spans", "score", "size", "item", "key", "ha", "doc", "node", "_chosen", "_copy", "_overlapping", "_id", "_doc", "_node")})


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, 101), (101, 102), (103, 102), (7, 7)]
    up = {}
    root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    found = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(links, "a long, b long"), "t").collect()}
    assert found == {x: root(x) for a, b in links if a != b for x in (a, b)}
    assert common.components(spark.createDataFrame([], "a long, b long"), "t").collect() == []


def test_packing_round_trip(docs, empty):
    rows = packing.pack(clashing(docs), with_ids=True).collect()
    tok, whole, ends = tokens.tokenizer(tokens.default_path()), defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(bytes(r["ids"])) == r["crc"]
        whole[r["id"]].append((r["start"], ids.tolist()))
        ends[r["sequence"]].append((r["offset"], r["length"]))
    for i, text, *_ in corpus():
        joined = [x for start, ids in sorted(whole[i]) for x in ids]
        assert joined == [*tok.encode(text).tolist(), 1]
    for pieces in ends.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0  # full, or a power of two: nothing is padded
    assert packing.pack(empty).collect() == []


def test_personal_data(docs, empty):
    rows = {r["id"]: r for r in pii.scan(clashing(docs)).collect()}
    for i, text, *_ in corpus():
        spans = brute_spans(text or "")
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in spans) for k in pii.BASE]
    assert pii.scan(empty).collect() == []
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(docs).collect()}
    assert all(clean[i] == t for i, t, *_ in corpus() if not pii.find(t)) and "[EMAIL]" in "".join(t or "" for t in clean.values())


def test_sharding(docs, empty, spark):
    path = common.scratch(spark, "maps")
    rows = sharding.shard_by_bytes(clashing(docs), 4, map_path=path).collect()
    assert sorted(r["id"] for r in rows) == [i for i, *_ in corpus()]
    for i, text, *_ in corpus():
        r = next(r for r in rows if r["id"] == i)
        assert r["size"] == len((text or "").encode()) + 1 and r["crc"] == zlib.crc32((text or "").encode())
    loads = defaultdict(int)
    for s in range(4):
        own = sorted(r["place"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
        loads[s] = sum(r["size"] for r in rows if r["shard"] == s)
    assert max(loads.values()) <= sum(loads.values()) / 4 + max(r["size"] for r in rows)
    first = sharding.load_map(spark, path)
    grown = sharding.edited_map(first, 5)
    sharding.save_map(grown, path)
    before, after = ({r["vslot"]: r["shard"] for r in m.collect()} for m in (first, sharding.load_map(spark, path)))
    assert sharding.load_map(spark, path, 1).count() == len(before) == len(after)
    assert all(after[v] in (before[v], 4) for v in before)
    assert sharding.shard_by_bytes(empty, 4).collect() == []


def test_sharding_recomputed(docs, spark, tmp_path):
    """Slots, the greedy map, its edit for one more shard and all places, in plain Python."""
    import xxhash

    def slot(i, text):
        h = xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42)
        h = xxhash.xxh64_intdigest((text or "").encode(), h)
        return (h - (1 << 64) if h >> 63 else h) % 16

    rows = [(slot(i, t), i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t, *_ in corpus()]
    sizes = Counter()
    for v, _, _, n in rows:
        sizes[v] += n
    loads, shard = [0] * 3, {}
    for n, v in sorted(((n, v) for v, n in sizes.items()), reverse=True):
        shard[v] = loads.index(min(loads))
        loads[shard[v]] += n
    fair, later = sum(loads) / 4, dict(shard)
    for s in range(3):
        tail = 0
        for n, v in sorted((n, v) for v, n in sizes.items() if shard[v] == s):
            tail += n
            if tail <= loads[s] - fair:
                later[v] = 3
    places = Counter()
    want = set()
    for v, i, crc, n in sorted(rows):
        want.add((i, n, crc, v, shard[v], places[shard[v]]))
        places[shard[v]] += 1
    path = f"file://{tmp_path}/maps"
    found = sharding.shard_by_bytes(docs, 3, slots=16, map_path=path)
    assert {(r["id"], r["size"], r["crc"], r["vslot"], r["shard"], r["place"]) for r in found.collect()} == want
    assert {r["vslot"]: r["shard"] for r in sharding.grown(spark, path, 4).collect()} == later
    assert {r["vslot"]: r["shard"] for r in sharding.load_map(spark, path, 1).collect()} == shard


def test_sharding_query(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = sharding.op9_sharding(spark, str(tmp_path)).collect()
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None} and len(rows) == len(corpus())
    assert all(r["next_shard"] in (r["shard"], 8) for r in rows)


def test_token_counts(docs, empty, spark):
    tok = tokens.tokenizer(tokens.default_path())
    want = defaultdict(lambda: [0, 0, 0])
    for _, text, lang, source, _ in corpus():
        for k, v in enumerate((1, len(tok.encode(text)), len((text or "").encode()))):
            want[source, lang][k] += v
    rollup = token_counts.Rollup(spark, common.scratch(spark, "rollup"))
    totals = lambda: {(r["source"], r["lang"]): [r["n_docs"], r["n_tokens"], r["n_bytes"]] for r in rollup.totals().collect()}
    assert totals() == {}
    rows = token_counts.deltas(clashing(docs))
    assert rollup.commit("load", rows) and not rollup.commit("load", rows)
    assert totals() == dict(want)
    some = docs.where("source = 's1'")
    assert rollup.commit("delete", token_counts.deltas(some, -1))
    assert ("s1", "en") not in totals()
    rollup.compact()
    assert not rollup.commit("load", rows) and not rollup.commit("delete", rows)
    assert rollup.commit("back", token_counts.deltas(some, F.lit(1)))
    assert totals() == dict(want)
    old = token_counts.deltas(docs.where("doc_id = 1"))
    assert rollup.commit("revise", token_counts.revised(old, token_counts.deltas(docs.where("doc_id = 1").withColumn("text", F.lit("two words")))))
    key = next((s, g) for i, _, g, s, _ in corpus() if i == 1)
    assert totals()[key][0] == want[key][0] and totals()[key][1] == want[key][1] - len(tok.encode(corpus()[1][1])) + 2
    assert rollup.commit("none", token_counts.deltas(empty))
    with pytest.raises(ValueError):
        rollup.commit("../x", rows)


def test_token_count_query(docs, spark, tmp_path):
    """Inserts, deletes, restores and revisions leave the plain counts, here by the tokenizers library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs.unionByName(docs.where("doc_id < 3")).write.parquet(f"{tmp_path}/documents.parquet")
    want = defaultdict(lambda: [0, 0, 0])
    for _, text, lang, source, _ in corpus() + corpus()[:3]:
        for k, v in enumerate((1, len(theirs.encode(text or "", add_special_tokens=False).ids), len((text or "").encode()))):
            want[source, lang][k] += v
    found = token_counts.op1_token_counts(spark, str(tmp_path)).collect()
    assert {(r["source"], r["lang"]): [r["n_docs"], r["n_tokens"], r["n_bytes"]] for r in found} == dict(want)
    copies = token_counts.copies_gone(token_counts.counted(docs, id=F.col("doc_id"), digest=F.md5("text"))).groupBy().agg(F.sum("n_docs")).first()[0]
    assert copies == len({t for _, t, *_ in corpus()}) - len(corpus())


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(300, 8)).astype(np.float32)
    vectors[50:90] = vectors[3]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    rows += [(300, None, 0), (301, [0.0] * 8, 0), (302, [float("nan")] * 8, 0), (303, [1.0, None] + [0.0] * 6, 0), (304, [float("inf")] + [0.0] * 7, 0), (305, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit("x"))
    found = neighbours.nearest(df, F.col("vec_id") % 10 == 0, query_block=8, candidate_block=64).collect()
    mine = defaultdict(dict)
    for r in found:
        mine[r["query"]][r["rank"]] = (r["id"], r["score"])
    wide = vectors.astype(np.float64)
    assert sorted(mine) == list(range(0, 300, 10))
    for q in mine:
        cosines = neighbours.exact(np.repeat(wide[q : q + 1], 300, 0), wide)
        best = sorted((-c, i) for i, c in enumerate(cosines) if i != q)[:5]
        assert [mine[q][k + 1][0] for k in range(5)] == [i for _, i in best]
    tiny = spark.createDataFrame([(i, (vectors[i].astype(float) * scale).tolist()) for i, scale in enumerate([1e-200, 1e200, 1.0, 1e-300, 3.0])], "vec_id long, embedding array<double>")
    for r in neighbours.nearest(tiny, F.col("vec_id") >= 0).collect():
        a, b = wide[r["query"]], wide[r["id"]]
        assert abs(r["score"] - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12
    few = spark.createDataFrame(rows[:3], df.select("vec_id", "embedding", "label").schema)
    assert [(r["id"]) for r in neighbours.nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()] != []
    assert neighbours.nearest(few.limit(0), F.col("vec_id") == 0).collect() == []


def test_language(spark, empty):
    rng = random.Random(2)
    inventory = {"aa": ["ka", "ki", "ru"], "bb": ["étr", "eau", "oux"], "cc": ["при", "вет", "ско"]}
    word = lambda g: "".join(rng.choice(inventory[g]) for _ in range(rng.randrange(1, 4)))
    rows = [(i, " ".join(word(g) for _ in range(rng.randrange(3, 60))), g, "s", 0) for i, g in enumerate(["aa", "bb", "cc"] * 40)]
    rows += [(1000, None, "aa", "s", 0), (1001, "12 ²", "aa", "s", 0), (1002, "kakiru " * 20 + "eauoux " * 30, None, "s", 0), (None, "kaki", "bb", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language.learn(docs, language.fold(docs["doc_id"]) != 0)
    assert model.languages == ["aa", "bb", "cc"] and model.scripts["Cyrillic"] == [False, False, True]
    found = {r["id"]: r for r in language.labelled(clashing(docs), model, with_spans=True).collect()}
    held = [i for i, _, g, _, _ in rows[:120] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(found[i]["lang_pred"] == rows[i][2] for i in range(120))
    assert (found[1000]["lang_pred"], found[1001]["lang_pred"]) == ("und", "und")
    mixed = found[1002]
    assert mixed["lang_pred"] == "bb" and 0.5 < mixed["score"] < 0.7 and [s["lang"] for s in mixed["spans"]] == ["aa", "bb"]
    assert (mixed["spans"][0]["start"], mixed["spans"][0]["end"]) == (0, 139)
    texts = [(i, text) for i, text, *_ in rows]
    assert dict(zip([i for i, _ in texts], language.judged(model, [text for _, text in texts]), strict=True)) == {i: (r["lang_pred"], r["score"]) for i, r in found.items()}
    assert {r["doc_id"] for r in language.accepted(clashing(docs), model, 0.8).collect()} == {i for i, r in found.items() if r["lang_pred"] != "und" and r["score"] >= 0.8}
    nothing = language.learn(empty, F.lit(True))
    assert language.accepted(docs, nothing, 0.0).collect() == []
    assert {r["lang_pred"] for r in language.labelled(docs, nothing).collect()} == {"und"}
    assert language.labelled(empty, model).collect() == []


def test_languages_beyond_a_byte(spark):
    """Two hundred languages, each of letters of its own; a rare one keeps its features."""
    letters = [chr(0x4E00 + 3 * k) + chr(0x4E01 + 3 * k) + chr(0x4E02 + 3 * k) for k in range(200)]
    rows = [(5 * k + j, " ".join([letters[k], letters[k][::-1]] * 5), f"l{k:03d}") for k in range(200) for j in range(2 if k else 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language.learn(clashing(docs), F.lit(True))
    assert len(model.languages) == 200
    assert all(r["lang_pred"] == f"l{r['id'] // 5:03d}" for r in language.labelled(docs.where("doc_id >= 1000 OR doc_id < 2"), model).collect() if r["id"] < 2)
    found = {r["id"]: r["lang_pred"] for r in language.labelled(docs, model).collect()}
    assert all(found[5 * k] == f"l{k:03d}" for k in range(41, 200))


def test_spans_after_letters_with_a_longer_lower_case(spark, docs):
    model = language.learn(docs, F.lit(True))
    text = "\u0130stanbul the of and"
    spans = language.labelled(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, with_spans=True).first()["spans"]
    assert (spans[0]["start"], spans[-1]["end"]) == (0, len(text))


def brute_components(texts, k, p):
    sets = brute_sets([t or "" for t in texts], k)
    up = list(range(len(sets)))
    root = lambda x: x if up[x] == x else root(up[x])
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= p * len(a | sets[j]):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("k, p", [(3, 90), (5, 80)])
def test_jaccard(docs, k, p, monkeypatch):
    for name, n in (("BLOCK_DOCS", 4), ("LEAST_DOCS", 4), ("DIRECT", 0)):
        monkeypatch.setattr(jaccard, name, n)  # candidate groups in several blocks
    texts = [t for _, t, *_ in corpus()]
    found = {r["id"]: (r["n"], r["component"]) for r in jaccard.clusters(clashing(docs), k=k, p=p).collect()}
    assert [found[i] for i in range(len(texts))] == brute_components(texts, k, p)


def test_jaccard_edges(empty, docs, spark):
    assert jaccard.clusters(empty).collect() == []
    odd = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None), (None, "x y z"), (None, None)], "doc_id long, text string")
    assert Counter((r["id"], r["n"], r["component"]) for r in jaccard.clusters(odd).collect()) == Counter([(None, 1, 1), (1, 1, 1), (1, 1, 1), (2, 0, 2), (None, 1, None), (None, 0, None)])
    kept = jaccard.deduplicated(clashing(docs))
    want = {c for n, c in brute_components([t for _, t, *_ in corpus()], 5, 80)}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == clashing(docs).columns
    assert Counter(map(tuple, jaccard.deduplicated(odd).collect())) == Counter([(1, "a b c"), (2, None), (None, "x y z"), (None, None)])


def test_jaccard_of_ids_with_several_texts(spark):
    """Each row is a document of its own, whatever its id."""
    rng = random.Random(3)
    a, b = sentence(rng, 80), sentence(rng, 80)
    one, two = thue_morse(2048)
    rows = [(1, a), (5, a), (5, b), (9, f"{b} tail"), (7, one), (8, two), (3, f"{a} tail"), (3, f"{a} end")]
    found = Counter((r["id"], r["component"]) for r in jaccard.clusters(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == Counter([(1, 1), (5, 1), (5, 5), (9, 5), (7, 7), (8, 8), (3, 1), (3, 1)])
    kept = jaccard.deduplicated(spark.createDataFrame(rows[2:], "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == [3, 5, 7, 8]


@pytest.mark.parametrize("group_rows", [16384, 3])
def test_substrings(docs, empty, group_rows):
    texts = [t or "" for _, t, *_ in corpus()]
    found = {r["id"]: r for r in substrings.kept(clashing(docs), group_rows=group_rows, with_bytes=True).collect()}
    for i, (text, cover) in enumerate(zip(texts, brute_cover(texts, 200), strict=True)):
        left = bytes(b for b, c in zip(text.encode(), cover, strict=True) if not c)
        runs = len([x for x in cover.split(b"\0") if x])
        assert (found[i]["n_bytes"], found[i]["n_removed"], found[i]["n_spans"]) == (len(text.encode()), sum(cover), runs)
        assert bytes(found[i]["kept"]) == left and found[i]["kept_sha256"] == hashlib.sha256(left).hexdigest()
    assert sum(r["n_removed"] for r in found.values()) > 0
    assert substrings.kept(empty).collect() == []


def test_substrings_of_ids_with_several_texts(spark):
    rng = random.Random(4)
    passage, other = sentence(rng, 60), "".join(thue_morse(512))
    rows = [(1, f"{passage} one"), (2, f"{passage} two"), (1, sentence(rng, 120)), (None, f"{passage} three"), (None, None), (3, "short"), (4, other[:512]), (5, other[512:])]
    found = [tuple(r) for r in substrings.kept(spark.createDataFrame(rows, "doc_id long, text string"), with_bytes=True).collect()]
    want = []
    for (i, text), cover in zip(rows, brute_cover([t or "" for _, t in rows], 200), strict=True):
        left = bytes(b for b, c in zip((text or "").encode(), cover, strict=True) if not c)
        want.append((i, len(cover), sum(cover), len([x for x in cover.split(b"\0") if x]), hashlib.sha256(left).hexdigest(), left))
    assert Counter((*r[:5], bytes(r[5])) for r in found) == Counter(want)


def test_substrings_of_a_passage_that_all_hold(spark):
    """Groups larger than a task takes are split by content; several halvings."""
    rng = random.Random(6)
    passage = sentence(rng, 60)
    texts = [f"{sentence(rng, rng.randrange(2, 40))} {passage} {sentence(rng, rng.randrange(2, 40))}" for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["id"]: bytes(r["kept"]) for r in substrings.kept(rows, group_rows=2, with_bytes=True).collect()}
    for i, (text, cover) in enumerate(zip(texts, brute_cover(texts, 200), strict=True)):
        assert found[i] == bytes(b for b, c in zip(text.encode(), cover, strict=True) if not c)


def test_decontamination(spark, docs, empty):
    rng = random.Random(9)
    item, short = sentence(rng, 40), "too short"
    words = item.split()
    some = [w if k % 8 else "changed" for k, w in enumerate(words)]
    rows = [(1, f"{sentence(rng, 50)} {item.upper()}, {sentence(rng, 9)}"), (2, " ".join(some)), (3, " ".join(words[5:30])), (4, sentence(rng, 500)), (5, None), (6, ""), (None, item), (7, item), (7, item), (8, " ".join(words[:9]))]
    train = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "h": F.lit(2), "w": F.lit("x")})
    bench = spark.createDataFrame([(10, item), (11, short), (12, None), (None, item), (10, item)], "item_id long, text string")
    found = {(r["id"], r["item"]): r for r in decontamination.overlaps(train, bench).collect()}
    assert set(found) == {(i, k) for i in (1, 2, 3, 7, None) for k in (10, None)}
    assert (found[1, 10]["start"], found[1, 10]["n_equal"], found[3, 10]["start"], found[3, 10]["n_equal"]) == (50, 40, -5, 25)
    assert found[2, 10]["n_equal"] == 35
    assert sorted(r["doc_id"] or 0 for r in decontamination.clean(train, bench).collect()) == [4, 5, 6, 8]
    mixed = spark.createDataFrame([(None, item), (None, "clean words"), (1, f"x {item}"), (1, "other words")], "doc_id long, text string")
    assert sorted(r["text"] for r in decontamination.clean(mixed, bench).collect()) == ["clean words", "other words"]
    assert decontamination.clean(clashing(train), bench).columns == clashing(train).columns
    assert decontamination.overlaps(empty, bench).collect() == [] and decontamination.overlaps(train, bench.limit(0)).collect() == []


def test_short_benchmark_items(spark):
    """Of four and five words they match as they are; shorter ones don't."""
    train = spark.createDataFrame([(1, "so Alpha beta, gamma delta!"), (2, "alpha beta gamma other delta"), (3, "one two three four five"), (4, "one two")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "one two three four five"), (3, "one two three"), (4, "one two")], "item_id long, text string")
    assert {(r["id"], r["item"], r["n_equal"]) for r in decontamination.overlaps(train, bench).collect()} == {(1, 1, 4), (3, 2, 5)}


def test_url_filter(spark):
    cases = [
        ("http://Example.NET/en/x?q#f", "example.net", "/en/x", "example.net/en/", "allow"), ("http://a.b.net/", "a.b.net", "/", "net/", "block"), ("http://x.net", "x.net", "", None, "allow"),
        ("ftp://example.com/de/", "example.com", "/de/", "example.com/de/", "block"), ("//example.com/de/", "", "", None, "allow"), ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("http://q.org/fr/y", "q.org", "/fr/y", "org/fr/", "allow"), ("http://my-spam.org/fr", "my-spam.org", "/fr", None, "block"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
        ("http://h.org/a://x.net/", "h.org", "/a://x.net/", None, "allow"), ("http://h.org/" + "é" * 5000 + "/ads/x", "h.org", "/" + "é" * 5000 + "/ads/x", None, "block"), ("http://x.net?/en/", "x.net", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], "h") for i, c in enumerate(cases)] * 2, "page_id long, url string, host string")
    rows = urls.judged(pages).collect()
    assert len(rows) == 2 * len(cases)
    for r in rows:
        assert tuple(r)[1:] == cases[r["id"]][1:]
    assert urls.judged(pages.limit(0)).collect() == []
    assert {r["verdict"] for r in urls.judged(pages, rules=(), blocked=()).collect()} == {"allow"}


def test_many_url_rules(spark):
    """Thousands of rules: lanes shrink so that states stay within their bytes."""
    rules = tuple(("block" if k % 2 else "allow", f"host{k:05d}.example/part{k % 7}/") for k in range(2000))
    pages = spark.createDataFrame([(k, f"http://a.HOST{k:05d}.example/part{k % 7}/x") for k in range(0, 2000, 97)] + [(9999, "http://host00001.example/part2/")], "page_id long, url string")
    found = {r["id"]: (r["rule"], r["verdict"]) for r in urls.judged(pages, rules=rules).collect()}
    assert found == {k: (rules[k][1], rules[k][0]) for k in range(0, 2000, 97)} | {9999: (None, "allow")}


def test_counts_follow_the_tables(docs):
    """Repeated rows are kept as rows by every operator that returns one a document."""
    twice = docs.where("doc_id < 6").union(docs.where("doc_id < 6"))
    for rows in (pii.scan(twice), substrings.kept(twice), jaccard.clusters(twice), sharding.shard_by_bytes(twice)):
        assert Counter(r["id"] for r in rows.collect()) == Counter(list(range(6)) * 2)


def test_hot_seeds_of_a_benchmark(spark, monkeypatch):
    """Equal and different documents that share an opening with every item."""
    rng = random.Random(8)
    opening = " ".join(f"open{k}" for k in range(12))
    items = [(k, f"{opening} item{k} " + " ".join(f"w{k}x{j}" for j in range(rng.randrange(2, 12)))) for k in range(40)]
    docs = [(k, f"{opening} item{k % 5} " + " ".join(f"w{k % 5}x{j}" for j in range(12)), "en", "s", 1) for k in range(40)]
    docs += [(100 + k, f"{opening} other{k} words{k}", "en", "s", 1) for k in range(10)] + [(200, " ".join(f"long{k}" for k in range(30_000)) + " " + items[7][1], "en", "s", 1), (201, None, "en", "s", 1)]
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")

    def brute():
        out = set()
        for i, text, *_ in docs:
            w = decontamination_words(text)
            for item, b_text in items:
                b = decontamination_words(b_text)
                span = min(decontamination.WINDOW, len(b))
                for start in {a - c for a, x in enumerate(w) for c, y in enumerate(b) if x == y}:
                    m = [1 if 0 <= start + j < len(w) and w[start + j] == b[j] else 0 for j in range(len(b))]
                    if max(sum(m[j : j + span]) for j in range(len(b) - span + 1)) >= -(-span * 3 // 4):
                        out.add((i, item))
        return out

    want = brute()
    found = {(r["id"], r["item"]) for r in decontamination.overlaps(df, bench).collect()}
    assert found == want and (200, 7) in want
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontamination, "HOT_ITEMS", 6)
    assert {(r["id"], r["item"]) for r in decontamination.overlaps(df, bench).collect()} == want
    assert {r["doc_id"] for r in decontamination.clean(df, bench).collect()} == {d[0] for d in docs} - {i for i, _ in want}


def decontamination_words(text):
    return [w for w in re.split(decontamination.SEPARATORS, (text or "").lower()) if w]


def test_prose_is_no_secret():
    prose = ["The secret: information about the garden", "Password: required before Monday", "Your token = whatever you like", "Secret: Everything was well-known", "the api key: documentation follows", "a token: INFORMATION", "password : 'sentence' ends"]
    for text in prose:
        assert pii.find(text) == [] and pii.redact(text) == text
    real = ["password=hunterhunter", "token: a1b2c3d4e5", 'secret = "swordfish"', "api_key: qWeRtYuIoP", "passwd: some_long_value", "password: correct-horse-battery", "Token = abc/def+ghi"]
    for text in real:
        assert [s[0] for s in pii.find(text)] == ["secret"]
    for text in [*prose, *real, "mail a@b.example", "to\u212aen = a_secret_value", "nothing", "AKIA" + "Q" * 16, "call +1 555 010 9999"]:
        assert re.search(pii._MAY.replace("(?iu)", "(?i:") + ")", text) or pii.find(text) == []
    for number in ("000-12-3456", "666-12-3456", "912-12-3456", "123-00-4567", "123-45-0000"):
        assert pii.find(f"ssn {number}") == []


def test_rollup_in_a_folder_called_like_a_base(spark):
    rollup = token_counts.Rollup(spark, common.scratch(spark, "t/base-corpus/roll"))
    rows = spark.createDataFrame([("s", "en", "t", 1, 10, 100)], ", ".join([*(f"{k} string" for k in token_counts.KEYS), *(f"{s} long" for s in token_counts.SUMS)]))
    for batch in ("a", "b", "a"):
        rollup.commit(batch, rows)
    assert [tuple(r)[3:] for r in rollup.totals().collect()] == [(2, 20, 200)]
    for _ in range(2):  # cleans up, and counts on
        rollup.compact()
        assert [tuple(r)[3:] for r in rollup.totals().collect()] == [(2, 20, 200)] and len(rollup._done()) == 1
    assert not rollup.commit("b", rows) and rollup.commit("c", rows)
    rollup._fs.create(rollup._path(f"{rollup.path}/base-00000002.tmp/_SUCCESS")).close()  # a compaction that was cut off
    assert [tuple(r)[3:] for r in rollup.totals().collect()] == [(3, 30, 300)]
    rollup.compact()
    assert [tuple(r)[3:] for r in rollup.totals().collect()] == [(3, 30, 300)] and [*rollup._done()] == ["base-00000002"]


def test_the_session_is_left_alone(spark, docs):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    pii.redacted(docs).collect()
    pii.scan(docs).collect()
    jaccard.deduplicated(docs).collect()
    assert spark.conf.get(name) == before
    with common.batches(spark, 7):
        assert spark.conf.get(name) == "7"
        with common.batches(spark):
            assert spark.conf.get(name) == "7"
    assert spark.conf.get(name) == before


def test_slices_by_bytes():
    import pyarrow as pa

    for kind in (pa.string(), pa.large_string()):
        texts = pa.array(["x" * n for n in (5, 0, 5, 30, 1, 1)] + [None, "é" * 6], kind)
        assert list(common.slices(texts, 10)) == [(0, 3), (3, 4), (4, 7), (7, 8)]
        assert list(common.slices(texts.slice(2, 3), 10)) == [(0, 1), (1, 2), (2, 3)] and list(common.slices(texts[:0], 10)) == []


@pytest.mark.parametrize(("key_bytes", "ident_bytes"), [(6, 5), (1, 1)])
def test_jaccard_keys_travel_packed_and_lose_no_link(docs, monkeypatch, key_bytes, ident_bytes):
    want = {r["id"]: r["component"] for r in jaccard.clusters(docs).collect()}
    for name, n in (("KEY_BYTES", key_bytes), ("IDENT_BYTES", ident_bytes), ("PACKED", 3), ("BUCKET_TOKENS", 500)):
        monkeypatch.setattr(jaccard, name, n)  # one byte: many nodes share an ident
    assert {r["id"]: r["component"] for r in jaccard.clusters(docs).collect()} == want


def test_a_row_of_packed_keys_takes_few_bytes_a_key():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64))
    bucket = np.repeat(np.arange(4, dtype=np.int32), 5000)
    rows = [r for b in jaccard._rows_of(bucket, [jaccard._packed(values, 6), jaccard._packed(values, 5)]) for r in b.to_pylist()]
    assert sum(len(r["keys"]) + len(r["nodes"]) for r in rows) == 11 * len(values) and len(rows) == 40
    assert np.concatenate([jaccard._unpacked(r["keys"], 6)[:, 0] for r in rows]).tolist() == (values & np.uint64((1 << 48) - 1)).tolist()
