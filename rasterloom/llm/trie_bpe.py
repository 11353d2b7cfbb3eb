"""Operator 7: BPE by a trie of distinct words.

In a byte-pair encoding each prefix of a word has one possible last token: the token t that ends it, is its own encoding,
and may follow the last token of the prefix without t. The distinct words of some megabytes of text that aren't remembered go into a
trie, which is traversed depth first by sorting them: each node gets its prefix's last token once, from the states above it, and only the
states above the current node are held. A word's ids are read off by walking back up. Ids of words are remembered in two generations of bounded size.

Two tokens may stand side by side if no merge across their border would have come before the merges that made them. The
tokens' spines along the border are walked in the order in which merges happen; that needs each merge to come after those
that made its parts, which holds for trained vocabularies and is checked on loading.

Null text is empty and gives no ids. Repeated rows give repeated rows; other columns are ignored; no table, no rows.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import chunks, map_batches
from rasterloom.llm.wordbpe import Parts, mapped

#: Chunks and words that one generation of the memory holds before it becomes the old one.
REMEMBERED = 200_000
#: Bytes of text whose distinct words make one trie.
TEXT_BYTES = 1 << 21


class TrieBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.tail = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ids = self.vocab
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        made: dict[int, int] = {}
        for r, (a, b) in enumerate(merges):
            left, right, whole = ids[a], ids[b], ids[a + b]
            self.rank[left, right] = r
            if whole not in self.halves:
                self.halves[whole], made[whole] = (left, right), r
            if max(made.get(left, -1), made.get(right, -1)) >= r:
                raise ValueError("a merge precedes the merges that make its parts")
        self.made = made
        self.pairs: dict[int, bool] = {}
        self.sound: dict[int, bool] = {}
        for t in sorted(ids.values(), key=lambda t: made.get(t, -1)):
            half = self.halves.get(t)
            self.sound[t] = half is None or self.sound[half[0]] and self.sound[half[1]] and self.meets(*half, made[t])
        self.usable = {s: i for s, i in ids.items() if self.sound[i]}
        self.longest = max(len(s) for s in self.usable)
        # token and character -> the token of both: most prefixes end in the last token of the prefix before, made longer
        self.longer = {(self.usable[s[:-1]], s[-1]): i for s, i in self.usable.items() if s[:-1] in self.usable}
        self.chars = {i: len(s) - (len(self.tail) if self.tail and s.endswith(self.tail) else 0) for s, i in ids.items()}
        t = Tokenizer.from_file(path)
        self.parts = Parts(t)
        self.strings = [b""] * (max([*ids.values(), *self.parts.specials.values()]) + 1)
        for s, i in [*ids.items(), *self.parts.specials.items()]:
            self.strings[i] = s.encode()
        self.forget()

    def forget(self) -> None:
        """Empties the memory: ids of chunks between white space and of their parts, in two generations, so that what isn't met again for long goes."""
        self.chunks, self.old_chunks, self.words, self.old_words = {}, {}, {}, {}
        self.pairs.clear()

    def spine(self, t: int, right: bool) -> list[int]:
        """Tokens along t's right (or left) border, from the first symbol to t."""
        out = [t]
        while t in self.halves:
            t = self.halves[t][right]
            out.append(t)
        return out[::-1]

    def meets(self, a: int, b: int, until: int = 1 << 60) -> bool:
        """Whether a and b stay apart side by side until merge number until."""
        left, right = self.spine(a, True), self.spine(b, False)
        i = j = 0
        made, never = self.made, 1 << 60
        while True:
            next_a = made[left[i + 1]] if i + 1 < len(left) else never
            next_b = made[right[j + 1]] if j + 1 < len(right) else never
            across = self.rank.get((left[i], right[j]), never)
            if across < next_a and across <= next_b and across < until:
                return False
            if next_a == next_b == never:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def may_follow(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 400_000:
                self.pairs.clear()
            known = self.pairs[key] = self.meets(a, b)
        return known

    def traverse(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Each word with its ids, through the trie of all of them, depth first.

        In sorted order the next word shares its longest possible prefix with the one before: path holds the last token of each of
        the current word's prefixes, is cut back to what is shared, and grows by one node a character.
        """
        tail, chars, longer, pairs = self.tail, self.chars, self.longer, self.pairs
        path, before = [-1], ""
        for whole, word in sorted((mapped(word), word) for word in words):
            inner, shared = whole[:-1] if tail else whole, 0
            for x, y in zip(inner, before, strict=False):
                if x != y:
                    break
                shared += 1
            del path[shared + 1 :]
            for depth in range(shared + 1, len(inner) + 1):
                last = longer.get((path[-1], inner[depth - 1]))
                if last is not None and (start := depth - chars[last]):
                    follows = pairs.get(path[start] << 32 | last)
                    last = last if (follows if follows is not None else self.may_follow(path[start], last)) else None
                path.append(self._last(inner, depth, "", path) if last is None else last)
            before, out, at = inner, [], len(whole)
            if tail:
                out.append(self._last(whole, at, tail, path))
                at -= chars[out[0]]
            while at:
                out.append(path[at])
                at -= chars[path[at]]
            yield word, out[::-1]

    def _last(self, text: str, end: int, tail: str, path: list[int]) -> int:
        """The one usable token that ends text[:end] and may follow the last token of what is before it."""
        usable, pairs = self.usable, self.pairs
        for start in range(end - 1, max(-1, end - self.longest - 1), -1):
            token = usable.get(text[start:end] + tail)
            if token is not None:
                if not start:
                    return token
                known = pairs.get(path[start] << 32 | token)
                if known if known is not None else self.may_follow(path[start], token):
                    return token
        raise ValueError(f"no encoding of {text[:end]!r}")

    def learn(self, words: Iterable[str]) -> None:
        """Remembers the ids of words, traversing those not known yet."""
        known, new = self.words, []
        for word in words:
            ids = self.old_words.get(word)
            if ids is not None:
                known[word] = ids
            elif word in self.parts.specials:
                known[word] = array("I", [self.parts.specials[word]]).tobytes()
            else:
                new.append(word)
        known.update((word, array("I", ids).tobytes()) for word, ids in self.traverse(new))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        if len(self.chunks) > REMEMBERED:
            self.old_chunks, self.chunks = self.chunks, {}
        if len(self.words) > REMEMBERED:
            self.old_words, self.words = self.words, {}
        parts, chunks, words = self.parts, self.chunks, self.words
        odd = [bool(parts.odd.search(x)) or "<|" in x for x in texts]
        split = [parts.of(x) if o else x.lower().split() for x, o in zip(texts, odd, strict=True)]
        new = {w for ws, o in zip(split, odd, strict=True) if not o for w in ws if w not in chunks}
        chunks.update((w, self.old_chunks[w]) for w in new if w in self.old_chunks)
        cut = {w: parts.pattern.findall(w) for w in new if w not in chunks}
        self.learn({p for ps in cut.values() for p in ps if p not in words} | {p for ps, o in zip(split, odd, strict=True) if o for p in ps if p not in words})
        chunks.update((w, b"".join(map(words.__getitem__, ps))) for w, ps in cut.items())
        return [b"".join(map((words if o else chunks).__getitem__, ws)) for ws, o in zip(split, odd, strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens' strings with blanks between, as a tokenizer without a decoder joins them."""
        return b" ".join(map(self.strings.__getitem__, ids.tolist()))


_STATE: dict[str, TrieBpe] = {}


def _load(path: str) -> TrieBpe:
    if path not in _STATE:
        _STATE[path] = TrieBpe(path)
    return _STATE[path]


def _coder(path: str):
    bpe = _load(path)

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        for part in chunks(batch, "text", TEXT_BYTES):
            ids = bpe.encode([x or "" for x in part.column(1).to_pylist()])
            yield [part.column(0), [len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(bpe.decode(np.frombuffer(x, "<u4"))).hexdigest() for x in ids]]

    run.close = bpe.forget  # a worker that goes on to other stages doesn't hold it
    return run


def _encoder(path: str):
    bpe = _load(path)

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        for part in chunks(batch, "text", TEXT_BYTES):
            yield [part.column(0), [np.frombuffer(x, "<u4").astype(np.int32) for x in bpe.encode([x or "" for x in part.column(1).to_pylist()])]]

    run.close = bpe.forget  # a worker that goes on to other stages doesn't hold it
    return run


def _decoder(path: str):
    bpe = _load(path)

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        yield [batch.column(0), [bpe.decode(np.asarray(x or [], "<u4")).decode() for x in batch.column(1).to_pylist()]]

    return run


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and ids (array of int) of each row of docs(doc_id, text)."""
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _encoder, "doc_id long, ids array<int>", tokenizer_path)


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and text of each row of encoded(doc_id, ids); null ids give an empty text."""
    return map_batches(encoded.select("doc_id", "ids"), _decoder, "doc_id long, text string", tokenizer_path)


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Encodes and decodes each row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _coder, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", tokenizer_path)
