"""Token ids of a public byte-level vocabulary, fast enough for whole corpora.

A text is parted by the vocabulary's own pattern and each part is looked up in a bounded cache of encoded parts; only
parts not seen lately are merged, by a second library that reads the same vocabulary as ranks. Texts with characters for which Python's classes may differ from the pattern's
are encoded whole by the library, and so are texts that hold the string of an added token, which the library gives its
own id.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

#: Parts kept encoded in a worker; the cache starts anew when it is full.
CACHE_PARTS = 600_000
# The vocabulary's pattern, for texts whose letters and digits are those of the ranges below.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
UNUSUAL = re.compile("[^\\t\\n\\r -~¡-±´-¸º»¿-ɏ]")


class _Parts(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, part: str) -> bytes:
        if len(self) >= CACHE_PARTS:
            self.clear()
        ids = self.encode(part)
        packed = self[part] = struct.pack(f"<{len(ids)}I", *ids)
        return packed


def byte_ranks(path: str) -> tuple[dict[bytes, int], list[str]]:
    """The vocabulary with its parts as bytes, and the strings of the added tokens. The file writes bytes that do not print
    as letters from 256 on."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    vocabulary, added = file["model"]["vocab"], [t["content"] for t in file.get("added_tokens", [])]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in plain]
    back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}
    return {bytes(back[c] for c in word): i for word, i in vocabulary.items() if all(c in back for c in word) and word not in added}, added


class Encoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit numbers: those of the library's own encode without
    special tokens added, so the string of an added token in a text is that token."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        known, added = byte_ranks(path)
        self.whole = re.compile("|".join([UNUSUAL.pattern, *map(re.escape, added)]))
        ranks = tiktoken.Encoding("parts", pat_str=r"(?s:.+)", mergeable_ranks=known, special_tokens={})
        self.parts = _Parts(ranks.encode_ordinary)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.whole.search(text):
            ids = self.library.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.parts.__getitem__, PARTS.findall(text)))


# The pattern of the vocabulary with word ends, for lower-case texts of the same letters and digits.
WORD_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


class WordEncoder:
    """``encode(text)`` as :class:`Encoder`, for a vocabulary with word ends that lower-cases and drops white space.

    No part of its pattern holds white space, so a text is parted there first and each piece between is kept encoded. A piece
    not seen lately is parted by the pattern, and the library's own model merges the parts. A letter whose lower case is
    more than one character is left to the library with its whole text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size, self.merge = self.library.get_vocab_size(), self.library.model.tokenize
        with open(path, encoding="utf-8") as f:
            added = [t["content"] for t in json.load(f).get("added_tokens", [])]
        self.whole = re.compile("|".join([UNUSUAL.pattern, "\u0130", *map(re.escape, added)]))
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in plain]
        self.shown = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(hidden)}
        self.words, self.pieces = _Parts(self._merged), _Parts(self._parted)

    def _merged(self, word: str) -> list[int]:
        return [t.id for t in self.merge(word if word.isascii() else word.encode().decode("latin-1").translate(self.shown))]

    def _parted(self, piece: str) -> list[int]:
        found = WORD_PARTS.findall(piece)
        return self._merged(found[0]) if len(found) == 1 else [i for w in found for i in struct.unpack(f"<{len(self.words[w]) // 4}I", self.words[w])]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.whole.search(text):
            ids = self.library.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.pieces.__getitem__, text.lower().split()))


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def word_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
