"""Operator 6: quality classifier, a factorisation machine.

Inputs of a text: logarithmic counts of its words by hash bucket, structure statistics, and metadata columns (numbers).
score = sigmoid(b + w.x + 1/2 sum_f ((V_f . x)^2 - V_f^2 . x^2)): the sum-of-squares identity gives all pairwise interactions
in time linear in the inputs. Features of many texts are made and scored at once with numpy.

Training takes at most sample_rows labelled doc_ids, those with the smallest hash (a documented bound), one row of each: of rows that repeat a
doc_id the one whose features are the smallest bytes, so that no doc_id outweighs others and reruns agree. Features are made on the executors, the fit (Adam on the logistic loss, fixed seed) runs on the driver over a matrix of bounded size.
Scoring covers every whole text; only the model (a few hundred kilobytes) is sent to the executors.

Null text is empty and is scored like one; null metadata is zero. Without labelled rows of both kinds all scores are the
share of label 1, or 0.5 without any. Several labels for one doc_id count as the smallest. Repeated rows give repeated
rows; a null doc_id is scored and isn't held out; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import chunks, map_batches, small_batches, utf8
from rasterloom.llm.textscan import Words

BUCKETS = 1024
FACTORS = 6
SAMPLE_ROWS = 4096
N_STATS = 14
#: Bytes of text whose features are worked out at once.
TEXT_BYTES = 1 << 18


def statistics(words: Words, hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Structure statistics of each text, about 0 to 1."""
    n = len(offsets) - 1
    data = words.data
    total = np.maximum(np.diff(offsets), 1)
    n_words = np.maximum(words.count, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return np.diff(sums[offsets])

    def by_word(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return np.diff(sums[words.first]) / n_words

    length = words.end - words.start
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (words.text[1:] == words.text[:-1])
    order = np.lexsort((hashes, words.text))
    h, t = hashes[order], words.text[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    upper = (data >= 65) & (data <= 90)
    symbols = np.isin(data, np.frombuffer(b"#*$%&|<>!", np.uint8))
    lines = share(data == 10) + 1
    tail = data[words.end - 1] if len(length) else np.zeros(0, np.uint8)
    odd_tail = ~(((tail >= 97) & (tail <= 122)) | ((tail >= 65) & (tail <= 90)) | (tail >= 128) | np.isin(tail, np.frombuffer(b".,", np.uint8)))
    return np.stack(
        [
            np.log1p(words.count) / 10,
            by_word(length) / 10,
            by_word(length <= 2),
            by_word(length == 1),
            by_word(same),
            np.bincount(t[fresh], minlength=n) / n_words,
            share(upper) / total,
            share(symbols) / n_words,
            share((data >= 48) & (data <= 57)) / total,
            share(data >= 128) / total,
            share(np.isin(data, np.frombuffer(b".,;:?", np.uint8))) / n_words,
            np.log1p(lines) / 6,
            by_word(odd_tail),
            (words.count == 0).astype(float),
        ],
        axis=1,
    )


def features(batch: pa.RecordBatch) -> np.ndarray:
    """The input matrix of a batch of text (column 1) and metadata (the columns after it)."""
    data, offsets = utf8(batch.column(1))
    words = Words(data, offsets)
    h = words.hashes() if len(data) else np.zeros(0, np.uint64)
    n = batch.num_rows
    counts = np.bincount(words.text * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
    counts = np.log1p(counts)
    counts /= np.maximum(np.sqrt((counts**2).sum(axis=1, keepdims=True)), 1)
    stats = statistics(words, h, offsets)
    meta = [np.log1p(np.clip(np.nan_to_num(c.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False), nan=0, posinf=1e300), 0, None)) / 12 for c in batch.columns[2:]]
    return np.concatenate([counts, stats, *(m[:, None] for m in meta)], axis=1).astype(np.float32)


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.factors
        return self.bias + x @ self.linear + 0.5 * ((s**2).sum(axis=1) - (x**2) @ (self.factors**2).sum(axis=1))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(np.float64), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 256, rate: float = 0.02, decay: float = 1e-4) -> Model:
    """Adam on the logistic loss; both labels weigh the same in sum. Deterministic."""
    n, d = x.shape
    ones = float(y.sum())
    if not n or ones in (0.0, float(n)):
        p = min(max(ones / n if n else 0.5, 1e-6), 1 - 1e-6)
        return Model(float(np.log(p / (1 - p))), np.zeros(d, np.float32), np.zeros((d, FACTORS), np.float32))
    random = np.random.default_rng(7)
    theta = [np.zeros(1, np.float32), np.zeros(d, np.float32), random.normal(0, 0.05, (d, FACTORS)).astype(np.float32)]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    weight = np.where(y > 0, n / (2 * ones), n / (2 * (n - ones))).astype(np.float32)
    step = 0
    for _ in range(epochs):
        order = random.permutation(n)
        for a in range(0, n, batch):
            rows = order[a : a + batch]
            xb, yb = x[rows], y[rows]
            b, w, v = theta
            s = xb @ v
            z = b[0] + xb @ w + 0.5 * ((s**2).sum(axis=1) - (xb**2) @ (v**2).sum(axis=1))
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - yb) * weight[rows] / len(rows)).astype(np.float32)
            grads = [np.array([g.sum()], np.float32), xb.T @ g + decay * w, xb.T @ (g[:, None] * s) - v * ((xb**2).T @ g)[:, None] + decay * v]
            step += 1
            for t, grad, m, u in zip(theta, grads, first, second, strict=True):
                m += 0.1 * (grad - m)
                u += 0.001 * (grad**2 - u)
                t -= rate * (m / (1 - 0.9**step)) / (np.sqrt(u / (1 - 0.999**step)) + 1e-8)
    return Model(float(theta[0][0]), theta[1], theta[2])


def _feature_rows():
    def run(batch: pa.RecordBatch) -> Iterator[list]:
        for part in chunks(batch, "_text", TEXT_BYTES):
            yield [part.column(0), [row.tobytes() for row in features(part.select([0, *range(1, part.num_columns)]))]]

    return run


def _rows(docs: DataFrame, metadata: tuple[str, ...]) -> list:
    return [F.col("text").cast("string").alias("_text"), *(F.col(c).cast("double").alias(f"_m{k}") if c in docs.columns else F.lit(None).cast("double").alias(f"_m{k}") for k, c in enumerate(metadata))]


def fold(doc_id) -> object:
    """crc32 of doc_id as text, modulo 5; fold 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = ("n_chars",), sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of labels(doc_id, quality) from rows of the folds 1 to 4."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_y")).filter("_id IS NOT NULL AND _y IN (0, 1)")
    sample = known.filter(fold(F.col("_id")) != 0).groupBy("_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), *_rows(docs, metadata)).join(F.broadcast(sample), "_id")
    rows = rows.withColumn("_y", F.col("_y").cast("int")).select("_y", "_text", *(f"_m{k}" for k in range(len(metadata))), "_id")
    keyed = map_batches(rows.select(F.struct("_id", "_y").alias("_key"), "_text", *(f"_m{k}" for k in range(len(metadata)))), _feature_rows, "key struct<_id:long,_y:int>, x binary")
    # rows that repeat a doc_id are one example, whichever run or place they come from: the driver gets sample_rows rows at most
    single = keyed.select("key._id", "key._y", "x").groupBy("_id", "_y").agg(F.min("x").alias("x"))
    got = sorted(single.toArrow().to_pylist(), key=lambda r: r["_id"])
    width = BUCKETS + N_STATS + len(metadata)
    x = np.frombuffer(b"".join(r["x"] for r in got), np.float32).reshape(-1, width)
    return fit(x, np.array([r["_y"] for r in got], np.float32))


def _scorer(model, threshold: float):
    m: Model = model.value if hasattr(model, "value") else model

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        for part in chunks(batch, "_text", TEXT_BYTES):
            s = m.scores(features(part))
            yield [part.column(0), s, (s >= threshold).astype(np.int32)]

    return run


def score(docs: DataFrame, model: Model, metadata: tuple[str, ...] = ("n_chars",), threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long"), *_rows(docs, metadata))
    return map_batches(rows, _scorer, "doc_id long, score double, predicted int", sent, threshold)


def score_column(docs: DataFrame, model: Model, metadata: tuple[str, ...] = ("n_chars",)):
    """The score as a column of docs, for filters that keep all of a row's columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    small_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def scores(text: pa.Array, *meta: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text, text, *meta], names=["_id", "_text", *(f"_m{k}" for k in range(len(meta)))])
        found = np.concatenate([sent.value.scores(features(part)) for part in chunks(batch, "_text", TEXT_BYTES)])
        return pa.array(found)

    return scores(*_rows(docs, metadata))


def quality_classifier(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Trains on the folds 1 to 4 and scores every row: doc_id, held_out, score, predicted."""
    out = score(docs, train(docs, labels), threshold=threshold)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
