"""Operator 9: exact top-k search by exhaustive term-at-a-time accumulation.

A vector is a sparse row of integer weights floor(scale * x); its terms are component indexes. Queries (rows whose id is
divisible by every) are dealt to passes of a bounded number of bytes, and one pass at a time is broadcast; a block's postings
are, for each term, the queries that have it with their weights. Each task takes blocks of candidates, lays the candidates
out by term, and goes through the terms: the postings scatter weight times candidate column into a dense score array
(queries by candidates). Partition selection keeps k + 1 of each query and block, merged with what the task has found before, so that
a task sends k + 1 rows a query. These lists are merged by rank. Passes hold different queries, so each is whole when it ends.

Scores are exact: rows whose sums could leave 64 bits are scored with integers of any length, by the same steps. A score that
doesn't fit a long keeps its right rank; score is null then and exact says it in digits.

Vectors that are null or hold null or non-finite components take no part. Lengths may differ: a missing component is zero.
A query's candidates are all rows but itself: rows that share its vec_id are candidates, and a row that stands n times is n queries
and n candidates, of which each leaves out one. A null vec_id takes no part. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import arrow_schema, discard, give_back, materialize, small_batches

QUERY_BLOCK = 2048
#: Queries that one pass broadcasts, in bytes.
PASS_BYTES = 32 << 20
#: Scores of two rows each under sqrt(EXACT / length) fit in 64 bits.
EXACT = 2.0**62
#: Copies of a query that one array holds.
COPIES = 4096
_FOUND = "query_id long, query_row long, times long, vec_id long, own boolean, reach int, big binary, score long"


def plain_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and v (array of double) of the vectors that take part."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False))
    )


def _weight(x: float, scale: int) -> int:
    y = x * scale
    return math.floor(y) if math.isfinite(y) else math.floor(Fraction(x) * scale)


def _split(vectors: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and their weights as a matrix: those whose scores among themselves fit in 64 bits, then the others as integers of any length."""
    lengths = np.asarray(vectors.value_lengths().fill_null(0)).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(vectors)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    with np.errstate(over="ignore"):
        weights = np.floor(flat * float(scale))
    wide = np.zeros(len(vectors), bool)
    wide[row[np.abs(weights) > np.sqrt(EXACT / np.maximum(lengths[row], 1)) - 1]] = True
    for part, kind in ((np.flatnonzero(~wide), np.int64), (np.flatnonzero(wide), object)):
        if not len(part):
            continue
        at = np.full(len(vectors), -1)
        at[part] = np.arange(len(part))
        mine = at[row] >= 0
        out = np.zeros((len(part), int(lengths[part].max(initial=0))), kind)
        out[at[row[mine]], place[mine]] = weights[mine].astype(np.int64) if kind is np.int64 else np.array([_weight(x, scale) for x in flat[mine].tolist()], object)
        yield part, out


def accumulate(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Dense scores, queries by candidates, term at a time."""
    terms = min(q.shape[1], c.shape[1])
    kind = object
    if q.dtype != object and c.dtype != object:
        kind = np.int32 if int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(terms, 1) < 2**31 else np.int64
    scores = np.zeros((len(q), len(c)), kind)
    columns = np.ascontiguousarray(c.T.astype(kind))
    for t in range(terms):
        rows = np.flatnonzero(q[:, t])
        weights = q[rows, t].astype(kind)
        if len(rows) == len(q):
            scores += weights[:, None] * columns[t]
        elif len(rows):
            scores[rows] += weights[:, None] * columns[t]
    return scores if kind is object else scores.astype(np.int64)


def _best(at: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query, by score and then the smaller id."""
    if scores.dtype == object:
        order = np.array(sorted(range(len(at)), key=lambda i: (at[i], -scores[i], ids[i])), np.int64)
    else:
        order = np.lexsort((ids, ~scores, at))  # ~ turns the order round and can't leave 64 bits
    at, ids, scores = at[order], ids[order], scores[order]
    top = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[top], ids[top], scores[top]


def select(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query places, ids and scores of the k best candidates of each query in a block."""
    n = len(ids)
    if n > k:
        kth = np.sort(scores, axis=1)[:, n - k] if scores.dtype == object else np.partition(scores, n - k, axis=1)[:, n - k]
        at, col = np.nonzero(scores >= kth[:, None])
    else:
        at, col = np.nonzero(np.ones(scores.shape, bool))
    return _best(at, ids[col], scores[at, col], k)


def order_key(n: int) -> bytes:
    """Bytes that compare as integers of any length do."""
    digits = abs(n).to_bytes((abs(n).bit_length() + 7) // 8, "big")
    key = len(digits).to_bytes(4, "big") + digits
    return b"\x01" + key if n >= 0 else b"\x00" + bytes(255 - b for b in key)


def _from_key(key: bytes) -> int:
    return int.from_bytes(key[5:], "big") if key[0] else -int.from_bytes(bytes(255 - b for b in key[5:]), "big")


def _search(sent, k: int, scale: int, block: int):
    schema = arrow_schema(_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query_rows, times, vectors = sent.value
        blocks = []
        for rows, q in _split(vectors, scale):
            blocks += [(rows[a : a + block], q[a : a + block]) for a in range(0, len(rows), block)]
        found = [None] * len(blocks)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for part, c in _split(batch.column(1), scale):
                for b, (_, q) in enumerate(blocks):
                    new = select(ids[part], accumulate(q, c), k + 1)
                    found[b] = new if found[b] is None else _best(*(np.concatenate(x) for x in zip(found[b], new)), k + 1)
        for (rows, q), best in zip(blocks, found):
            if best is None:
                continue
            at, ids, scores = best
            own = (query_ids[rows][at] == ids) & (np.asarray((q * q).sum(axis=1))[at] == scores)
            exact = scores.tolist()
            reach = [(n > 2**63 - 1) - (n < -(2**63)) for n in exact]
            cols = [
                query_ids[rows][at], query_rows[rows][at], times[rows][at], ids, own, reach,
                [order_key(n) if far else None for n, far in zip(exact, reach)], [None if far else n for n, far in zip(exact, reach)],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema)], schema=schema)
        give_back()

    return run


def exact_topk(embeddings: DataFrame, k: int = 5, every: int = 50, scale: int = 256, block: int = QUERY_BLOCK, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score and exact (its digits) of the k best candidates of each query, ties to the smaller vec_id."""
    spark = embeddings.sparkSession
    small_batches(spark)
    vectors = plain_vectors(embeddings)
    queries = vectors.filter(F.col("vec_id") % every == 0).groupBy("vec_id", "v").agg(F.count("*").alias("times"))
    need = queries.agg(F.sum(F.size("v").cast("long") * 8 + 24)).first()[0] or 0
    passes = max(1, -(-need // pass_bytes))
    if passes > 1:
        queries = materialize(queries.withColumn("_pass", F.pmod(F.xxhash64("vec_id", "v"), F.lit(passes))), "topk-queries")
    results = []
    for i in range(passes):
        mine = (queries.filter(F.col("_pass") == i) if passes > 1 else queries).select("vec_id", "times", "v").toArrow().combine_chunks()
        if not mine.num_rows:
            continue
        v = mine.column("v").combine_chunks()
        sent = spark.sparkContext.broadcast((mine.column("vec_id").to_numpy(), np.arange(mine.num_rows), mine.column("times").to_numpy(), v))
        best = _merged(vectors.mapInArrow(_search(sent, k, scale, block), _FOUND), k)
        if passes > 1:
            best = materialize(best, "topk")
            sent.unpersist()
        results.append(best)
    if passes > 1:
        discard(queries)
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long, exact string")
    for best in results:
        out = best if best is results[0] else out.unionByName(best)
    return out


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The tasks' lists of each query as one, without the first row that is the query itself."""
    query = Window.partitionBy("query_id", "query_row")
    order = query.orderBy(F.col("reach").desc(), F.col("big").desc(), F.col("score").desc(), "vec_id")
    placed = found.withColumn("_rn", F.row_number().over(order)).withColumn("_self", F.min(F.when(F.col("own"), F.col("_rn"))).over(query))
    others = placed.filter(~F.col("_rn").eqNullSafe(F.col("_self"))).withColumn("rank", F.col("_rn") - F.coalesce(F.col("_rn") > F.col("_self"), F.lit(False)).cast("int")).filter(F.col("rank") <= k)
    digits = F.udf(lambda key: None if key is None else str(_from_key(bytes(key))), "string")
    said = F.when(F.col("reach") == 0, F.col("score").cast("string")).otherwise(digits(F.col("big")))
    # a query that stands n times has its list n times
    copies = others.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / COPIES))))
    copies = copies.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES).cast("long"), F.col("times") - F.col("_part") * COPIES))))
    return copies.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", said.alias("exact"))


ORACLE = """
WITH e AS (SELECT vec_id, row_number() OVER () AS rowid_, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rowid_, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.rowid_ <> c.rowid_)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY rowid_ ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
