"""Operator 10 [native]: mixing sources to target weights along a time-varying curriculum.

Sizes are word counts. Sources in code-point order, null last, weigh 3, 1, 2, repeating; together they are to give share
(150%) of all words; no source gives more than most (2) times its size, and what is over is shared anew by weight until none is
above: the limit is a common level, found from one ordered pass over sources.

A source gives whole passes over its documents, in an order made by digests of doc_id and text, and then once more the documents whose middle lies
before what is missing of its target: it comes as near as half the document at that place. Its weight over training time 0..1 runs along straight lines between knots; the integral, scaled to the target, is its
cumulative demand, and a document's training position is the time at which demand reaches the document's place in its
source's stream (inverse of the integral on the line piece that holds it). Copies are range-sorted by position (in_order()): mix() gives that
stream with whole rows; digest() writes it with sizes in place of texts, reads it back and counts in it what each row gave.

Prefix sums over a source never meet in one task: documents are cut into digest buckets, whose sums are added up in a small table, and
equal rows are counted by the partition they are read in before they meet.

Null text has size 0; its source gives it no words. Rows that repeat a doc_id follow each other by text digest; equal rows have places of
their own, so a source of one repeated row is mixed like any other. A null doc_id has the digest of an empty string. Other columns, whatever their
names, are passed on by mix() and ignored by mixture(). An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import let, materialize, n_words

WEIGHTS = (3, 1, 2)
#: Weights at times 0, 1/2 and 1 as multiples of a source's mean, repeating over sources: early, late, steady.
SCHEDULES = ((1.5, 1.0, 0.5), (0.5, 1.0, 1.5), (1.0, 1.0, 1.0))
#: Hexadecimal digits of the digest that make a bucket: 4096 buckets a source.
DIGITS = 3


def named(source: Column) -> Column:
    """A source's name without nulls, in the order of the names with null last: rows join on it without a new exchange."""
    return F.when(source.isNull(), F.lit("z")).otherwise(F.concat(F.lit("a"), source))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """_source, source_size, _rank and target of each source in sizes(_source, size)."""
    per = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("_rank", (F.row_number().over(Window.orderBy("_source")) - 1).cast("int"))
    weight = F.get(F.array(*map(F.lit, weights)), F.col("_rank") % len(weights)).cast("double")
    capped = ranked.withColumns({"_w": weight, "_cap": F.col("source_size") * F.lit(float(most))})
    up = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = capped.withColumns({"_all": F.sum("source_size").over(whole) * F.lit(float(share)), "_capped": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), "_open": F.sum("_w").over(up.rowsBetween(0, Window.unboundedFollowing))})
    level = levels.withColumn("_level", (F.col("_all") - F.col("_capped")) / F.col("_open"))
    # a source is at its bound if the level among it and those after it is over what it can give
    reached = level.withColumn("_over", F.col("_level") * F.col("_w") >= F.col("_cap"))
    final = reached.withColumn("_final", F.min(F.when(~F.col("_over"), F.struct(F.col("_cap") / F.col("_w"), F.col("_rank"), F.col("_level").alias("level")))).over(whole)["level"])
    target = F.when(F.col("_over"), F.col("_cap")).otherwise(F.col("_final") * F.col("_w"))
    return final.select("_source", "source_size", "_rank", target.alias("target"))


def demand_inverse(share: Column, schedule: Column) -> Column:
    """The time at which the integral of a schedule (weights at evenly spaced knots) has reached a share (0..1) of its whole."""

    def solve(w: Column) -> Column:
        n = F.size(w) - 1
        areas = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (F.get(w, i) + F.get(w, i + 1)) / 2)

        def within(state: Column) -> Column:
            i, rest = state["i"], state["rest"]
            a, slope = F.get(w, i), F.get(w, i + 1) - F.get(w, i)
            # rest = a t + slope t^2 / 2 within the piece
            root = F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * slope * rest))
            t = F.coalesce(F.try_divide(2 * rest, a + root), F.lit(0.0))
            return F.least(F.lit(1.0), (i + F.least(F.lit(1.0), t)) / n)

        def place(sums: Column) -> Column:
            start = F.struct(F.lit(0).alias("i"), (share * F.aggregate(sums, F.lit(0.0), lambda x, y: x + y)).alias("rest"))
            here = lambda s: F.get(sums, s["i"])
            onward = lambda s: F.struct((s["i"] + 1).alias("i"), (s["rest"] - here(s)).alias("rest"))
            walk = F.aggregate(sums, start, lambda s, _: F.when((s["rest"] > here(s)) & (s["i"] < n - 1), onward(s)).otherwise(s))
            return let(walk, within)

        return let(areas, place)

    return let(schedule, solve)


def mixture(docs: DataFrame, keep: Column | None = None, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, schedules=SCHEDULES) -> DataFrame:
    """Each row's number _row, _source, size, source_size, target, copies and the positions of its copies, beside keep under _doc."""
    text, at = F.col("text").cast("string"), ["_source", "_key", "_salt"]
    key = F.concat(*(F.md5(F.coalesce(c, F.lit("")).cast("binary")) for c in (F.col("doc_id").cast("string"), text)))
    kept = (keep if keep is not None else F.col("doc_id").cast("long")).alias("_doc")
    rows = docs.select(kept, named(F.col("source").cast("string")).alias("_source"), n_words(text).alias("size"), key.alias("_key"), F.spark_partition_id().alias("_salt"), F.monotonically_increasing_id().alias("_row"))
    if keep is None:  # narrow: texts are read and words counted once
        rows = materialize(rows, "sizes")
    # prefix sums: over equal rows read in one partition, within a bucket of digests, and over the buckets of a source
    bucket = F.conv(F.substring("_key", 1, DIGITS), 16, 10).cast("int").alias("_bucket")
    cells = materialize(rows.groupBy(*at).agg(F.sum("size").alias("size")).select("*", bucket), "cells")
    sums = materialize(cells.groupBy("_source", "_bucket").agg(F.sum("size").alias("size")), "buckets")
    plan = targets(sums, weights, share, most)
    before = lambda keys, order: F.coalesce(F.sum("size").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("_source", "_bucket", before(["_source"], ["_bucket"]).alias("_start"))
    small = starts.join(plan, "_source").select("_source", "_bucket", "_start", "source_size", "target", "_rank")
    begins = cells.select(*at, "_bucket", before(["_source", "_bucket"], ["_key", "_salt"]).alias("_within")).join(small, ["_source", "_bucket"]).drop("_bucket")
    own = rows.withColumn("_in", F.row_number().over(Window.partitionBy(*at).orderBy("_key")) * F.col("size"))
    placed = own.join(begins, at)
    end = F.col("_start") + F.col("_within") + F.col("_in")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    out = placed.withColumns({"_end": end, "_passes": passes})
    extra = F.col("_end") - F.col("size") / 2 < F.col("target") - F.col("_passes") * F.col("source_size")
    copies = F.when(F.col("size") == 0, F.least(F.lit(1), F.col("_passes"))).otherwise(F.col("_passes") + F.when(extra & (F.col("_passes") < most), 1).otherwise(0))
    out = out.withColumn("copies", copies.cast("int"))
    middle = F.col("_end") - F.col("size") / 2
    knots = F.get(F.array(*(F.array(*map(F.lit, s)) for s in schedules)), F.col("_rank") % len(schedules))
    stream = F.greatest(F.col("target"), F.lit(1.0))
    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda c: demand_inverse(F.least(F.lit(1.0), (middle + c * F.col("source_size")) / stream), knots)))
    return out.select("_doc", "_row", "_source", "size", "source_size", "target", "copies", F.coalesce(positions, F.array().cast("array<double>")).alias("positions"))


def in_order(copies: DataFrame, doc_id: str) -> DataFrame:
    """Copies range-sorted by training position."""
    n = int(copies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["_position", F.xxhash64(F.col(doc_id))]
    return copies.repartitionByRange(n, *order).sortWithinPartitions(*order)


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """The training stream: docs' columns once for each copy, range-sorted by training position."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = mixture(docs, row, **parameters).select("_doc", F.explode("positions").alias("_position"))
    return in_order(rows, "_doc.doc_id").select("_doc.*")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target of each row; taken, copies and the position of its first copy, as they are in the training stream."""
    plan = materialize(mixture(docs), "mixture")
    stream = materialize(in_order(plan.select("_doc", "_row", "size", F.explode("positions").alias("_position")), "_doc"), "stream")
    given = stream.groupBy("_row").agg(F.sum("size").alias("taken"), F.count(F.lit(1)).cast("int").alias("copies"), F.round(F.min("_position"), 6).alias("position"))
    rows = plan.select("_row", F.col("_doc").alias("doc_id"), "size", "source_size", "target").join(given, "_row", "left")
    none = lambda c, kind: F.coalesce(F.col(c), F.lit(0).cast(kind)).alias(c)
    return rows.select("doc_id", "size", "source_size", "target", none("taken", "long"), none("copies", "int"), "position")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) || md5(coalesce(text, '')) AS k FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1)::INTEGER AS rank FROM p),
c AS (SELECT *, [3, 1, 2][rank % 3 + 1]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM r),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, source_size, rank, CASE WHEN level * w >= cap THEN cap ELSE w * (SELECT arg_min(level, (cap / w, rank)) FROM l WHERE level * w < cap) END AS target FROM l),
x AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.rank, coalesce(floor(t.target / nullif(t.source_size, 0)), 0)::INTEGER AS passes,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
y AS (SELECT *, CASE WHEN size = 0 THEN least(1, passes) ELSE passes + CASE WHEN stop - size / 2 < target - passes * source_size AND passes < 2 THEN 1 ELSE 0 END END AS copies FROM x),
z AS (SELECT *, least(1.0::DOUBLE, (stop - size / 2) / greatest(target, 1.0::DOUBLE)) AS u, [[1.5, 1.0, 0.5], [0.5, 1.0, 1.5], [1.0, 1.0, 1.0]][rank % 3 + 1]::DOUBLE[] AS q FROM y),
a AS (SELECT *, (q[1] + q[2]) / 2 AS a1, (q[2] + q[3]) / 2 AS a2 FROM z),
b AS (SELECT *, CASE WHEN u * (a1 + a2) > a1 THEN 1 ELSE 0 END AS i, u * (a1 + a2) - CASE WHEN u * (a1 + a2) > a1 THEN a1 ELSE 0 END AS rest FROM a)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies::INTEGER AS copies,
  CASE WHEN copies > 0 THEN round(least(1.0::DOUBLE, (i + least(1.0::DOUBLE, 2 * rest / (q[i + 1] + sqrt(greatest(0.0::DOUBLE, q[i + 1] * q[i + 1] + 2 * (q[i + 2] - q[i + 1]) * rest))))) / 2), 6) END AS position FROM b
"""
