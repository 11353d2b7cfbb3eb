"""Connected components: contraction inside tasks of bounded size, then alternating large stars and small stars on DataFrames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import discard, materialize


#: Edges that one task contracts at once (16 bytes each, and a table of their nodes).
TASK_EDGES = 1 << 19


def contract(batches):
    """Edges of each TASK_EDGES read, as (node, root of its tree) by union-find: connects the same nodes with at most one edge a node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def out():
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["a", "b"])
        parent.clear()

    n = 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        n += batch.num_rows
        if n > TASK_EDGES:
            yield from out()
            n = 0
    if parent:
        yield from out()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of each node of edges(a, b); lineage is cut after each round.

    Each task first contracts what it reads, in bounded pieces; if all edges are one piece, that is the answer, else stars go on.
    A large star ties a node's larger neighbours to its smallest one, a small star ties the smaller ones; a hub's neighbours
    are never gathered: its minimum is a partial aggregate, and the join that hands it on can be split by AQE.
    """
    now = materialize(edges.select("a", "b").filter("a <> b"), "edges")
    n = now.count()
    pieces = now.coalesce(max(1, n // TASK_EDGES)).mapInArrow(contract, "a long, b long")
    if n < TASK_EDGES:
        return pieces.select(F.col("a").alias("node"), F.col("b").alias("component"))
    now = materialize(_clean(pieces), "edges")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(_clean(large.unionByName(low.select("a", F.col("m").alias("b")))), "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        discard(now)
        now = materialize(_clean(small), "edges")
        discard(large)
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def _clean(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger node to the smaller one."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
