"""The operators' inner functions against brute force; no session."""

import random
import re

import numpy as np
import pytest

from graphloom.llm import jaccard, language, neighbours, packing, pii, substrings, tokens, urls

RNG = random.Random(7)


def as_bytes(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


TEXTS = ["", "a", "The  quick\tbrown\n\nfox's 12,345 ½ naïve façade ²x", "  leading", "trailing   ", "日本語 and emoji 🙂 mixed", "don't I'll we've", "a" * 3000, " x\u0085y\x1cz", "x\r\n\r\n  y", "<|endoftext|> as text", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "é <|endoftext|>\n\n<|endoftex"]


def test_ids_equal_the_tokenizers_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ours = tokens.tokenizer(tokens.default_path())
    fuzz = ["".join(RNG.choice("ab Z9é½²_.,'\n\t  ß日") for _ in range(RNG.randrange(60))) for _ in range(400)]
    for text in TEXTS + fuzz:
        assert ours.encode(text).tolist() == theirs.encode(text, add_special_tokens=False).ids, repr(text)
    assert ours.encode(None).tolist() == []


@pytest.mark.parametrize("lengths", [[1], [2048], [5, 5, 5], [2047, 2, 2047, 3, 700, 700, 700], list(range(1, 300))])
def test_packing_fills_every_sequence(lengths):
    lengths = np.array(lengths)
    pieces = packing.assign(lengths, 2048)
    ends, covered = {}, {}
    for d, start, n, k, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert offset == ends.get(k, 0)
        ends[k] = offset + n
        covered.setdefault(d, []).append((start, n))
    assert all(e == 2048 or e & (e - 1) == 0 for e in ends.values())
    for d, spans in covered.items():
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert at == lengths[d]
    assert len(covered) == len(lengths)


def test_packing_balances_cost():
    lengths = np.array([RNG.randrange(1, 900) for _ in range(2000)])
    load: dict[int, float] = {}
    for _, _, n, k, _ in packing.assign(lengths, 2048):
        load[k] = load.get(k, 0) + packing.cost(n)
    full = sorted(load.values())[20:]
    assert max(full) < 1.6 * np.mean(full)


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute_luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(digits) <= 19 and brute_luhn(digits or "0"), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_personal_data_equals_the_plain_patterns():
    pieces = ["a@b.co", "x.y@", "@@", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+12", " ", "é", ".", "00000001.02.3.004", "9" * 22, "-", "%+", "a@b-c.d.e@f.gh"]
    for _ in range(3000):
        text = "".join(RNG.choice(pieces) for _ in range(RNG.randrange(8)))
        assert [s[:3] for s in pii.find(text) if s[0] in pii.BASE] == brute_spans(text), text
    assert pii.find(None) == pii.find("") == []


def test_personal_data_method_adds_spans():
    text = 'Pay to iban GB82 WEST 1234 5698 7654 32, ssn 078-05-1120; token = "24be64439e3e49cf46b2d7"'
    assert [s[0] for s in pii.find(text)] == ["iban", "ssn", "secret"]
    assert [s[0] for s in pii.find("GB82 WEST 1234 5698 7654 33 and 078-05-1120")] == []
    assert pii.redact("mail a@b.co now") == "mail [EMAIL] now"
    assert pii.redact(None) is None and pii.redact("clean") == "clean"
    near, far = pii.find("card 4111 1111 1111 1111")[0][3], pii.find("x 4111 1111 1111 1111")[0][3]
    assert near > far


def test_secrets_without_a_digit():
    assert pii.find("password: correct-horse-battery")[0][:3] == ("secret", 10, 31)
    assert pii.redact("my token=abcdefgh, bye") == "my token=[SECRET], bye"
    for word in ("token", "password", "passwd", "secret", "apikey", "api_key", "api-key"):
        assert [s[0] for s in pii.find(f"{word} = correct-horse")] == ["secret"]
    assert [s[0] for s in pii.find("AKIA" + "Q" * 16)] == ["secret"] and pii.find("secretly said; a token of love") == []


def test_ibans_have_their_countrys_length():
    number, other = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"
    for text, want in (
        (f"{number} BIC COBADEFF", [number]),
        (f"{other} REF 2024", [other]),
        ("IBAN GB82 WEST 1234 5698 7654 32 IS MINE", ["GB82 WEST 1234 5698 7654 32"]),
        (f"{number} {other} {number} X", [number, other, number]),
        (f"REF AB12 3456789012345 {number}", [number]),
        (f"{number[:-1]}1 BIC COBADEFF", []),
        (f"{other}9", []),
        (f"x{other}", []),
    ):
        assert [text[a:b] for k, a, b, _ in pii.find(text) if k == "iban"] == want, text
    pii.find("AB12 " * 60_000)
    pii.find("GB12 " * 60_000)
    pii.find("GB12CDEFGHIJKLMNOPQ" * 20_000)


def test_secrets_in_any_case():
    assert [s[0] for s in pii.find("Password: hunter2hunter2")] == ["secret"] and [s[0] for s in pii.find("password=hunterhunter")] == ["secret"]


def test_context_is_whole_words():
    plain = pii.find("x +1 (555) 010-9999")[0][3]
    assert pii.find("hotel +1 (555) 010-9999")[0][3] == plain < pii.find("tel +1 (555) 010-9999")[0][3] == pii.find("Phones: +1 (555) 010-9999")[0][3]
    assert pii.find("ship 1.2.3.4")[0][3] < pii.find("IP 1.2.3.4")[0][3]
    assert pii.find("classnotes 078-05-1120") == [] and [s[0] for s in pii.find("SSN 078-05-1120")] == ["ssn"]


def test_personal_data_is_linear_in_long_runs():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" * 150_000, "a@" * 150_000):
        pii.find(text)


def glob_regex(glob):
    out = glob.encode()
    parts = re.split(rb"(\*\*|\*|\?)", out)
    return re.compile(b"".join({b"**": b".*", b"*": b"[^/]*", b"?": b"."}.get(p, re.escape(p)) for p in parts), re.S)


def test_automaton_equals_regular_expressions():
    globs = ["**", "*", "", "a*b", "*.net/**", "net/**", "?x**y?", "**ab**ba**", "a/b/*", "*spam*/**"] + ["".join(RNG.choice(["a", "b", "/", "*", "**", "?"]) for _ in range(RNG.randrange(1, 14))) for _ in range(60)]
    globs = [re.sub(r"\*{3,}", "**", g) for g in globs]
    texts = ["", "a", "ab", "net/", "x.net/", "a.net/x/y", "abba", "a/b/c", "my-spam.org/x"] + ["".join(RNG.choice("ab/x.é") for _ in range(RNG.randrange(12))) for _ in range(300)]
    auto = urls.compiled(globs)
    assert auto.words > 1
    states = urls.matches(auto, *as_bytes(texts))
    for k, glob in enumerate(globs):
        assert urls.hit(auto, states, k).tolist() == [glob_regex(glob).fullmatch(t.encode()) is not None for t in texts], glob


def test_cells_equal_brute_force_with_ties():
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(700, 16)).astype(np.float32).astype(np.float64)
    vectors[100:400] = vectors[5]  # a large group of equal vectors
    ids = rng.permutation(5000)[:700].astype(np.int64)
    queries = np.r_[0:40, 100:140]
    found = neighbours.cell(ids[queries], vectors[queries], ids, vectors, 5)
    for q in queries:
        cosines = neighbours.exact(np.repeat(vectors[q : q + 1], 700, 0), vectors)
        best = sorted((-c, i) for c, i in zip(cosines, ids, strict=True) if i != ids[q])[:5]
        mine = sorted((-s, i) for a, i, s in found if a == ids[q])
        assert [i for _, i in mine] == [i for _, i in best]
        assert np.allclose([s for s, _ in mine], [s for s, _ in best], rtol=0, atol=1e-15)
    assert neighbours.cell(ids[:0], vectors[:0], ids, vectors, 5) == []


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(1)
    scores = rng.normal(size=(30, 3)).astype(np.float32) * 4
    texts = [rng.integers(0, 30, n) for n in (0, 1, 2, 5, 6, 6, 3)]
    found = language.viterbi(texts, scores, 3.0)
    import itertools

    for words, labels in zip(texts, found, strict=True):
        value = lambda path, words=words: sum(scores[w, p] for w, p in zip(words, path, strict=True)) - 3.0 * sum(a != b for a, b in itertools.pairwise(path))
        best = max((value(p) for p in itertools.product(range(3), repeat=len(words))), default=0)
        assert len(labels) == len(words) and abs(value(labels) - best) < 1e-3


def test_scripts():
    assert [language.script(c) for c in "aéαж漢한あא"] == ["Latin", "Latin", "Greek", "Cyrillic", "Han", "Hangul", "Kana", "Hebrew"]


def brute_sets(texts, k):
    out = []
    for t in texts:
        w = t.encode().lower().split()
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def test_shingle_sets_equal_brute_force():
    texts = ["", " ", "A", "a b", "A B C", "a b c", "a b c a b c", "x\x0by\x0cz w", "é É é É", "w " * 50] + [" ".join(RNG.choice("abc") for _ in range(RNG.randrange(30))) for _ in range(100)]
    words = [jaccard.words_of(t) for t in texts]
    for k in (3, 5):
        values, bounds = jaccard.shingle_sets(words, k)
        sets = brute_sets(texts, k)
        assert np.diff(bounds).tolist() == [len(s) for s in sets]
        assert [jaccard.shingles_of(w, k) for w in words] == sets
        mine = [frozenset(values[bounds[i] : bounds[i + 1]].tolist()) for i in range(len(texts))]
        for i in range(len(texts)):
            for j in range(i):
                assert len(mine[i] & mine[j]) == len(sets[i] & sets[j])


def thue_morse(n):
    """A word over {a, b} and its complement, which polynomial hashes modulo 2^64 cannot tell apart."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_hashes_tell_structured_words_apart():
    for n in (1024, 2048, 4096):
        one, two = thue_morse(n)
        values, _ = jaccard.shingle_sets([[one.encode()], [two.encode()]], 3)
        assert len(set(values.tolist())) == 2 and jaccard.node_of([one.encode()]) != jaccard.node_of([two.encode()])


@pytest.mark.parametrize("p", [90, 80])
def test_similar_sets_always_share_a_key(p):
    rng = np.random.default_rng(p)
    for _ in range(400):
        n = int(rng.integers(1, 60))
        a = rng.integers(0, 1 << 62, n).astype(np.uint64)
        b = np.concatenate([a[int(rng.integers(0, max(1, n // 5 + 1))) :], rng.integers(0, 1 << 62, int(rng.integers(0, n // 6 + 2))).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        common = len(np.intersect1d(a, b))
        if 100 * common >= p * (len(a) + len(b) - common) and len(b) and (len(a) != len(b) or (a != b).any()):
            both = np.union1d(a, b)
            for left_out in (None, both[rng.random(len(both)) < rng.random()], both):
                sets, keys = jaccard.part_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), p, 100, left_out)
                assert set(keys[sets == 0].tolist()) & set(keys[sets == 1].tolist())


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 300, 200).astype(np.uint64)) for _ in range(2))
        apart = int(np.bitwise_count(jaccard.sketch(a, 16) ^ jaccard.sketch(b, 16)).sum())
        assert apart <= len(np.setxor1d(a, b))


def brute_cover(texts, length):
    from collections import Counter

    raw = [t.encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        cover = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        out.append(bytes(cover))
    return out


def test_columnwise_construction_equals_brute_force():
    length, gram = 12, 5
    base = "".join(RNG.choice("ab") for _ in range(60))
    texts = [base, base[10:40] + "c" + base[3:30], "a" * 50, "", "ab" * 20, base[:11], base[:12]] + ["".join(RNG.choice("ab") for _ in range(40)) for _ in range(20)]
    raw, offsets = as_bytes(texts)
    rows = []
    for text, lo, hi, at, ha, _ in substrings.anchors(raw, offsets, length, gram):
        rows += list(zip(ha.tolist(), text.tolist(), lo.tolist(), hi.tolist(), at.tolist(), strict=True))
    rows.sort()
    covered = [set() for _ in texts]
    for _, d, lo, hi, at in rows:
        assert lo <= at <= hi + length - gram
        assert not covered[d] & set(range(lo, hi + 1))
        covered[d] |= set(range(lo, hi + 1))
    assert [len(c) for c in covered] == [max(0, len(t.encode()) - length + 1) for t in texts]
    at = np.array([r[4] for r in rows])
    segments = [texts[d].encode()[lo : hi + length] for _, d, lo, hi, _ in rows]
    flags = substrings.repeated(np.array([r[0] for r in rows]), segments, np.array([r[2] for r in rows]), at, length, gram)
    mine = [bytearray(len(t.encode())) for t in texts]
    for row, a, b in zip(*substrings._union(flags, at, length), strict=True):
        mine[rows[row][1]][a:b] = b"\1" * (b - a)
    assert [bytes(m) for m in mine] == brute_cover(texts, length)


def test_anchors_of_long_texts_are_those_of_whole_texts(monkeypatch):
    text = "".join(RNG.choice("abcdefgh ") for _ in range(5000))
    whole = {(h, a) for _, _, _, at, ha, _ in substrings.anchors(*as_bytes([text])) for h, a in zip(ha.tolist(), at.tolist(), strict=True)}
    monkeypatch.setattr(substrings, "PIECE", 700)
    cut = {(h, a) for _, _, _, at, ha, _ in substrings.anchors(*as_bytes([text])) for h, a in zip(ha.tolist(), at.tolist(), strict=True)}
    assert whole == cut
