"""Byte-level BPE ids of whole texts, with a cache of ids by pre-token.

Texts are split by the vocabulary's own pre-token pattern; each distinct piece is encoded once per
worker (up to a bound) and looked up afterwards. Added tokens of the vocabulary, such as an end-of-text mark,
are cut out of a text first and give their own id. The ids equal those of the tokenizers library for
byte_bpe_50k.json with add_special_tokens=False and its other settings as they come.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: The pattern's classes within Latin-1, where re does the splitting; other texts take the Unicode pattern.
_LETTER, _NUMBER, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\\t-\\r\\x20\\x85\\xa0"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Pieces kept per worker; when full, the cache starts anew. A piece longer than PIECE is never kept.
CACHE, PIECE = 150_000, 64


def default_path() -> str:
    """The public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_of_letters() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a letter: itself where it can be printed, else the next free code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Ids(dict):
    """Piece -> its ids as little-endian unsigned 32-bit bytes, filled on demand."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = np.asarray(self.encode(piece), "<u4").tobytes()
        if len(piece) <= PIECE:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids


class Tokenizer:
    """Ids of texts under a byte-level BPE vocabulary in a tokenizers JSON file."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added = spec["added_tokens"]
        if spec["model"]["type"] != "BPE" or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
        letters, special = _bytes_of_letters(), {t["content"]: t["id"] for t in added}
        ranks = {bytes(letters[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in special}
        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.unicode = regex.compile(public_tokenizers.PATTERN)
        self.ids = _Ids(encoding._encode_single_piece)
        self.special = {text: np.asarray([k], "<u4").tobytes() for text, k in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.unicode.findall(text)
        return _LATIN.findall(text)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as unsigned 32-bit; none for a null or empty text."""
        if not text:
            return np.zeros(0, "<u4")
        parts = self.cut.split(text) if self.cut and any(t in text for t in self.special) else [text]
        raw = b"".join(self.special.get(part) or b"".join(map(self.ids.__getitem__, self.pieces(part))) for part in parts)
        return np.frombuffer(raw, "<u4")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One per worker process and vocabulary."""
    return Tokenizer(path)
