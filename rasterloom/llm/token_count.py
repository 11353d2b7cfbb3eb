"""Operator 4: token counts, with huge documents encoded in overlapping chunks that are joined where both sides agree.

The byte-level pattern never matches across a place between a character that isn't white space and a blank or line feed,
whatever stands before: every match that holds white space begins with it. So such a place begins a match in each encoding
of text around it, and token counts of the two sides add up. Documents over CHUNK characters are encoded in chunks that
overlap; a cut is a proven place in the overlap at which both chunks begin a token by their offsets. If the overlap
has none, it is widened, up to the whole text. Shorter documents are cut at every proven place and the counts of the pieces,
which the library gives, are remembered.

Null text is empty: 0 bytes, 0 tokens. A special token's string in a text counts as the library counts it. Repeated rows
give repeated rows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import chunks, map_batches, utf8

CHUNK = 1 << 15
OVERLAP = 256
#: White space and other characters beside which nothing is proven.
_ODD = "\t\x0b-\r\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁯　﻿"
_odd = re.compile(f"[{_ODD}]")
_proven = re.compile(f"(?<=[^ \n{_ODD}])[ \n]")
_pieces = re.compile("[ \n]*[^ \n]+|[ \n]+")


class Counter(dict):
    """Piece of text -> number of its tokens; bounded."""

    def __init__(self, path: str, limit: int = 700_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.limit = limit

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        out = self[piece] = self.whole(piece)
        return out

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        if len(text) > chunk:
            return self.spliced(text, chunk, overlap)
        if _odd.search(text):
            return self.whole(text)
        return sum(map(self.__getitem__, _pieces.findall(text)))

    def starts(self, texts: list[str]) -> list[np.ndarray]:
        """Where each token of each text begins."""
        return [np.array([a for a, _ in x.offsets], np.int64) for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def spliced(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Number of tokens of a text by overlapping chunks."""
        n = len(text)
        begins = list(range(0, n, chunk))
        wide = [(max(0, b - overlap), min(n, b + chunk)) for b in begins]
        # one chunk at a time: what is held is a chunk and the one before it, however long the text
        parts = ((a, z, self.starts([text[a:z]])[0] + a) for a, z in wide)
        total, (_, end, left), since = 0, next(parts), 0
        for a, z, right in parts:
            reach, more = overlap, right
            while (cut := self.common(text, a, end, left, more, since)) is None:
                reach *= 2
                a = max(since, end - reach)
                if a == since:  # nothing is proven: the left side is encoded with all of the right
                    more = None
                    break
                (own,) = self.starts([text[a:z]])
                more = own + a
            if more is None:
                (own,) = self.starts([text[since:z]])
                left, end = own + since, z
                continue
            total += int(np.count_nonzero((left >= since) & (left < cut)))
            left, end, since = more, z, cut
        return total + int(np.count_nonzero(left >= since))

    @staticmethod
    def common(text: str, a: int, end: int, left: np.ndarray, right: np.ndarray, since: int) -> int | None:
        """The first proven place in the overlap from a to end at which both sides begin a token."""
        for m in _proven.finditer(text, max(a + 1, since + 1), end):
            p = m.start()
            if left[min(np.searchsorted(left, p), len(left) - 1)] == p == right[min(np.searchsorted(right, p), len(right) - 1)]:
                return p
        return None


_STATE: dict[str, Counter] = {}


def _counter(path: str, limit: int, chunk: int, overlap: int):
    if path not in _STATE:
        _STATE[path] = Counter(path)
    counter = _STATE[path]

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        for part in chunks(batch, "text"):
            n_bytes = np.diff(utf8(part.column(1))[1])
            n = np.array([counter.count(x or "", chunk, overlap) for x in part.column(1).to_pylist()], np.int64)
            yield [part.column(0), n_bytes, n, n > limit]

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row of docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(rows, _counter, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", tokenizer_path, limit, chunk, overlap)
