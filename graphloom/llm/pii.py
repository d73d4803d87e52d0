"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Kinds and what proposes them:
  email, ip, card, phone   the base kinds; a match that fails its check is dropped, without a retry
  iban                     a country's letters, two digits and as many letters or digits as the country's numbers
                           have, single spaces between them; confirmed by mod 97
  ssn                      ddd-dd-dddd in the ranges that are given out; counts only with a context word nearby
  secret                   a value after token, password, secret or api key, in any case, confirmed where it is unlike a word of prose
                           (see unlike_prose()); key ids of the form AKIA...
Base kinds are leftmost and do not overlap within a kind. A span's score is the kind's prior, raised
for a checksum and for a context word (a whole word, or its plural) within CONTEXT code points; base spans
stay whatever their score, the others need THRESHOLD.

Every scan is linear in the text: no pattern is tried again inside a run it has already failed on, but
for iban, which looks at no more than 34 letters or digits from each word.

Nulls: a null text has no spans; a null id stays null. Repeated rows: each has its row. Empty table:
no rows. Other columns are left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import lean, ship, slices, trim

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "secret")
CONTEXT, THRESHOLD = 48, 0.6
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.4, "phone": 0.5, "iban": 0.4, "ssn": 0.3, "secret": 0.2}
CONFIRMED, NEARBY = 0.4, 0.35
WORDS = {
    "email": ("mail", "email", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "telephone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank"),
    "ssn": ("ssn", "social security", "security number"),
    "secret": ("token", "password", "passwd", "secret", "key", "apikey", "api_key", "api-key", "credential", "login"),
}
_NEAR = {kind: re.compile(rf"(?<![^\W\d_])(?:{'|'.join(words)})s?(?![^\W\d_])", re.I) for kind, words in WORDS.items()}
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18,
    "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31,
    "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29,
    "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN_START = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}")
_IBAN_REST = {n: re.compile(rf"(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in sorted(set(IBAN_LENGTHS.values()))}
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?i:token|password|passwd|secret|api[_-]?key)(?P<sign>\x20?[=:]\x20?)(?P<quote>[\"']?)(?P<value>[A-Za-z0-9+/_-]{8,})|(?<![A-Z0-9])(?P<id>AKIA[A-Z0-9]{16})(?![A-Z0-9])")
#: One of these is in every text with a secret, in lower case.
_SECRET_STARTS = ("token", "passw", "secret", "api", "akia")


def luhn(digits: str) -> bool:
    """The check of card numbers: from the right every second digit doubled, the sum of digits a multiple of 10."""
    values = [ord(c) - 48 for c in reversed(digits)]
    return (sum(values[::2]) + sum((2 * v) // 10 + (2 * v) % 10 for v in values[1::2])) % 10 == 0


def mod97(code: str) -> bool:
    """The check of account numbers: the first four characters last, letters as 10 to 35, remainder 1."""
    plain = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """From each @ outward: the local part reaches back to the last match at most."""
    out, at, floor = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        floor = end
        at = text.find("@", end)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(p) <= 3 or not p.lstrip("0")[3:] for p in m[0].split(".")) and all(int(p.lstrip("0")[:4] or "0") <= 255 for p in m[0].split("."))]


def cards(text: str) -> list[tuple[int, int]]:
    found = ((m.span(), m[0].replace(" ", "").replace("-", "")) for m in _CARD.finditer(text))
    return [span for span, digits in found if 13 <= len(digits) <= 19 and luhn(digits)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]


def ibans(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    while m := _IBAN_START.search(text, at):
        at = m.start() + 1
        length = IBAN_LENGTHS.get(m[1])
        if length and (rest := _IBAN_REST[length].match(text, m.end())) and mod97(text[m.start() : rest.end()]):
            at = rest.end()
            out.append((m.start(), at))
    return out


def unlike_prose(m: re.Match) -> bool:
    """Whether a value after `password:` and the like is hardly an ordinary word.

    It holds a digit, or mixes cases other than by a first capital; or it has an underscore or two other marks inside (one after an
    equals sign); or it is assigned without a space, or quoted after an equals sign.
    """
    value = m["value"]
    if any("0" <= c <= "9" for c in value) or not (value.islower() or value.isupper() or value[1:].islower()):
        return True
    inner = value.strip("+/_-")
    if "_" in inner or sum(c in "+/-" for c in inner) > ("=" not in m["sign"]):
        return True
    quoted = m["quote"] and m.string[m.end() : m.end() + 1] == m["quote"]
    return m["sign"] in ("=", ":") or bool(quoted and "=" in m["sign"])


def secrets(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, end, start of the word that proposes it, confirmed)."""
    return [(*m.span("id"), m.start(), True) if m["id"] else (*m.span("value"), m.start(), unlike_prose(m)) for m in _SECRET.finditer(text)]


def score(text: str, kind: str, start: int, end: int, confirmed: bool, proposed: int | None = None) -> float:
    """Between 0 and 1; what proposed the span, from there on, is no context of it."""
    before = start if proposed is None else proposed
    near = _NEAR[kind].search(text[max(0, before - CONTEXT) : before]) or _NEAR[kind].search(text[end : end + CONTEXT])
    return min(1.0, PRIOR[kind] + CONFIRMED * confirmed + NEARBY * bool(near))


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as in KINDS, then start; code points, end exclusive."""
    if not text:
        return []
    digit = _DIGIT.search(text) is not None
    found = {"email": emails(text) if "@" in text else []}
    found["ip"] = ips(text) if digit else []
    found["card"] = cards(text) if digit else []
    found["phone"] = phones(text) if digit and "+" in text else []
    out = [(k, a, b, score(text, k, a, b, k == "card")) for k in BASE for a, b in found[k]]
    more = []
    if digit:
        more += [("iban", a, b, score(text, "iban", a, b, True)) for a, b in ibans(text)]
        more += [("ssn", *m.span(), score(text, "ssn", *m.span(), False)) for m in _SSN.finditer(text)]
    lower = text.lower()
    if any(w in lower for w in _SECRET_STARTS):
        more += [("secret", a, b, score(text, "secret", a, b, sure, proposed)) for a, b, proposed, sure in secrets(text)]
    return out + [x for x in more if x[3] >= THRESHOLD]


def joined(spans: list[tuple]) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def redact(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans, one label for their union, named by the first."""
    spans = sorted(find(text), key=lambda s: (s[1], -s[2]))
    if not spans:
        return text
    parts, at, k = [], 0, 0
    while k < len(spans):
        kind, start, end, _ = spans[k]
        k += 1
        while k < len(spans) and spans[k][1] < end:
            end = max(end, spans[k][2])
            k += 1
        parts += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(parts) + text[at:]


#: Every text with a span matches it; the others need not go to Python.
_MAY = r"[@0-9]|(?iu)token|passw|secret|api|akia"


def _suspect(text: Column) -> Column:
    """The text if it may hold a span, else null."""
    return F.when(text.rlike(_MAY), text)


SCHEMA = "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_more long, top_score double"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts of the base kinds, a digest of their spans, all spans, how many the method added, the highest score."""
    ship(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                spans = find(text.as_py())
                base = [s for s in spans if s[0] in BASE]
                rows.append((key, *(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base), max((s[3] for s in spans), default=0.0)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names)

    return docs.select(docs[id_col].cast("long").alias("id"), _suspect(docs[text_col].cast("string")).alias("text")).mapInArrow(lean(run), SCHEMA)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the texts redacted; all else as it was."""
    ship(docs.sparkSession)

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        parts = [pa.array([redact(t) for t in texts.slice(a, b - a).to_pylist()], texts.type) for a, b in slices(texts)]
        trim()
        return pa.concat_arrays(parts) if parts else texts

    text = docs[text_col].cast("string")
    return docs.withColumn(text_col, F.coalesce(clean(_suspect(text)), text))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
