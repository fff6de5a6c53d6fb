"""Splitting text as the public BPE tokenizers do, and encoding it piece by piece through a bounded cache.

BPE never merges across the pieces that the pre-tokenizer cuts, so the ids of a text are those of its pieces. Texts with characters
outside Latin, or with an added token's string, go to the library as a whole: their classes differ between regex engines.
"""

from __future__ import annotations

import json
import re
import unicodedata
from struct import pack

from tokenizers import Tokenizer

#: Below this code point the classes of both regex engines agree (test_encoder_equals_library compares them).
LATIN = 0x180
#: Pieces in each of the cache's two generations.
CACHE = 250_000


def _chars(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(LATIN) if unicodedata.category(chr(c))[0] == kind)


_L, _N = _chars("L"), _chars("N")
_S = "\\t-\\r \\x85\\xa0"
_APOS = "'s|'t|'re|'ve|'m|'ll|'d"
WORDS = re.compile(f"{_APOS}|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
BYTES = re.compile(f"{_APOS}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND = re.compile(f"[^\\x00-{chr(LATIN - 1)}]")


class Encoder:
    """ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)`` of the given file's content."""

    def __init__(self, content: str):
        spec = json.loads(content)
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.word_ends = spec["model"].get("end_of_word_suffix") is not None
        self.split = (WORDS if self.word_ends else BYTES).findall
        self.cache = _Cache(self)

    def pieces(self, text: str) -> list[str] | None:
        """The pre-tokenizer's pieces; None where only the library can tell."""
        if not text.isascii() and _BEYOND.search(text) or any(a in text for a in self.added):
            return None
        if self.word_ends:
            if not text.isascii():
                text = unicodedata.normalize("NFC", text)
                if _BEYOND.search(text):
                    return None
            text = text.lower()
        return self.split(text)

    def piece_ids(self, piece: str) -> list[int]:
        """ids of one piece, by the library's BPE model without its normaliser and pre-tokeniser."""
        if piece.isascii() and piece.isprintable():  # of these bytes the alphabet changes the space alone
            return [t.id for t in self.model.tokenize(piece.replace(" ", _ALPHABET[32]))]
        return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(_ALPHABET))]

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def packed(self, text: str | None) -> bytes:
        """ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        pieces = self.pieces(text)
        if pieces is None:
            found = self.ids(text)
            return pack(f"<{len(found)}I", *found)
        return b"".join(map(self.cache.__getitem__, pieces))


class _Cache(dict):
    """Packed ids by piece. When it is full it becomes the old generation, from which pieces still in use come back."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.old = encoder, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            found = self.encoder.piece_ids(piece)
            out = pack(f"<{len(found)}I", *found)
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[piece] = out
        return out


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


_ALPHABET = dict(enumerate(byte_alphabet()))


def tokenizer_content(path: str) -> str:
    """A tokenizer file's text, read on the driver; of fixed size (under 2 MB), so tasks get it as a broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(content: str) -> Encoder:
    """One encoder for each worker process, kept over tasks."""
    key = hash(content)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(content)
    return _ENCODERS[key]
