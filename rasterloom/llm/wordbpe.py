"""How a word-level BPE tokenizer file parts a text, and ids of whole texts from remembered words."""

from __future__ import annotations

import re
import unicodedata
from array import array


class Parts:
    """The parts of a text that the tokenizer encodes independently: matches of its own pattern in the normalized text.

    Texts of characters under U+0250 (each already in NFC) take Python's re with character classes made from Unicode's
    categories; other texts take the library's own normalizer and pre-tokenizer, so both give the library's parts.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        letters, numbers, spaces = [], [], []
        for i in range(0x250):
            kind = unicodedata.category(chr(i))
            (letters if kind[0] == "L" else numbers if kind[0] == "N" else spaces if chr(i) in "\t\n\x0b\f\r \x85\xa0" else []).append(chr(i))
        cls = lambda chars: "".join(re.escape(c) for c in chars)
        self.pattern = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{cls(letters)}]+|[{cls(numbers)}]|[^{cls(letters + numbers + spaces)}]+")
        self.far = re.compile("[^\x00-\u024f]")
        self.odd = re.compile("[\x1c-\x1f]|[^\x00-\u024f]")  # str.split parts at the first, the tokenizer doesn't
        self.specials = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.special = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.specials, key=len, reverse=True)) + ")")

    def of(self, text: str) -> list[str]:
        """Parts in order; a special token's string is a part of its own."""
        if "<|" in text:
            pieces = self.special.split(text)
            return [w for k, p in enumerate(pieces) for w in ([p] if k % 2 else self._plain(p))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if self.far.search(text):
            t = self.tokenizer
            parts = t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text))
            return [RAW(w) for w, _ in parts]
        return self.pattern.findall(text.lower())


#: The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_TO_CHAR = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}
CHAR_TO_BYTE = {c: b for b, c in BYTE_TO_CHAR.items()}
_TABLE = {b: BYTE_TO_CHAR[b] for b in range(256)}


def RAW(mapped: str) -> str:  # noqa: N802
    """The text that a byte-level string stands for."""
    return bytes(CHAR_TO_BYTE[c] for c in mapped).decode("utf-8", "surrogateescape")


def mapped(word: str) -> str:
    """The byte-level string of a word."""
    return word.encode("utf-8", "surrogateescape").decode("latin-1").translate(_TABLE)


class Memory(dict):
    """Chunk of text between white space -> ids of its parts as little-endian 32-bit integers.

    encode(part) gives a part's ids. Both the chunks and the parts that are remembered are bounded by limit.
    """

    def __init__(self, parts: Parts, encode, limit: int = 900_000):
        super().__init__()
        self.parts, self.encode, self.limit = parts, encode, limit
        self.known: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        out = self[chunk] = b"".join(map(self.part, self.parts.pattern.findall(chunk)))
        return out

    def part(self, word: str) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            if len(self.known) >= self.limit:
                self.known.clear()
            ids = self.known[word] = array("I", self.encode(word)).tobytes()
        return ids

    def text(self, text: str) -> bytes:
        """Ids of a whole text."""
        if self.parts.odd.search(text) or "<|" in text:
            return b"".join(map(self.part, self.parts.of(text)))
        return b"".join(map(self.__getitem__, text.lower().split()))


def library_encode(tokenizer, parts: Parts):
    """encode() of a Memory by the library's model, on a part as its normalizer and pre-tokenizer leave it; a special token's
    string has the id of the token."""
    model, specials = tokenizer.model, parts.specials

    def encode(word: str) -> list[int]:
        if word in specials:
            return [specials[word]]
        return [t.id for t in model.tokenize(mapped(word))]

    return encode
