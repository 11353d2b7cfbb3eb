"""Operator 8: exact Jaccard join of documents in the metric space of their shingle sets.

d(A, B) = 1 - |A & B| / |A | B| is a metric; documents link at d <= 0.2. The method is not a recursive Voronoi partition: no document is
assigned to a nearest pivot and no region is split again. Regions are the buckets of an inverted index over prefix shingles (as in
operator 5), and a document is replicated by its prefix, not by a triangle window. Every pair that can link shares a bucket, so results are exact:

1. Equal sets are one point: the smallest doc_id stands for its copies.
2. A region is a single shingle. For A and B to link they must share one of A's first |A| - ceil(0.8 |A|) + 1 shingles
   in any order that holds for all; that is the window, and a document is replicated to the regions of these shingles. The order
   puts shingles that are frequent (counted over all documents; of those counts only the largest are kept, as they order and
   don't select) last, so shared passages don't gather documents.
3. Within a region the smallest doc_id is the first pivot. Distances to pivots are worked out exactly; those within 0.2 are links.
   A region whose documents are in one component is done, because more links change nothing.
4. What is left of a region, its documents outside the largest component, takes further pivots from these; a pivot meets a document
   only inside the windows: |d(x, p) - d(y, p)| <= 0.2, if both distances to one pivot p are verified already (elsewhere it is open), sizes within 0.8 of each other, and sketches that
   don't prove a larger distance. While a region has many such documents, a bounded number of pivots is taken a round; each
   is then marked spent, the others stay, so every region ends, and no pair that could link is passed over.

The sketch has, in each of 512 bits (for large sets also 4096), the parity of the shingles that fall there: two sketches differ in at
most |A ^ B| bits.

Words are `[^\\x20\\x09-\\x0D]+`, A-Z in lower case; fewer than five words make one shingle of the whole; shingles are 64-bit
hashes. Null or empty texts have no shingles and no links. Rows that share a doc_id are one document with several texts;
a row with a null doc_id links with nothing and has a null component. Other columns are ignored; no table, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import chunks, discard, map_batches, materialize, utf8
from rasterloom.llm.graph import components as connected
from rasterloom.llm.textscan import Words, mix, shingle_sets

SIZE = 5
REGIONS = 4096
FLUSH = 1_000_000
HOT_LOCAL, HOT, HOT_MOST = 6, 16, 1 << 18
SKETCH = 8
WIDE, WIDE_FROM = 64, 640
LEAF, PIVOTS = 8192, 1024
BITMAP_BITS = 1 << 23


def _sets(part: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8(part.column(1))
    return shingle_sets(Words(data, offsets, lower=True), size)


def _sketches(sets: np.ndarray, at: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """So many 64-bit words of parities for each set."""
    n, width = len(at) - 1, 64 * words
    bits = np.bincount(np.repeat(np.arange(n), np.diff(at)) * width + (mix(sets) % np.uint64(width)).astype(np.int64), minlength=n * width) & 1
    return np.packbits(bits.astype(np.uint8).reshape(n, -1), axis=1).view("<i8").reshape(n, words)


def _wide(sets: np.ndarray, at: np.ndarray) -> list[np.ndarray | None]:
    """Sketches of WIDE words of the sets for which the common ones are too small, else None."""
    n = np.diff(at)
    return [_sketches(sets[at[k] : at[k + 1]], np.array([0, n[k]]), WIDE)[0] if n[k] >= WIDE_FROM else None for k in range(len(n))]


def _keys(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(sets[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)), "<i8").reshape(-1, 2)


_POINTS = "doc_id long, n long, k1 long, k2 long, sketch array<long>, wide array<long>, shingle long, hits long"


def _points(size: int):
    """A row for each document, and rows of shingles that are frequent among so many documents as one step holds."""
    held: list[np.ndarray] = []
    seen: set[bytes] = set()

    def frequent() -> list:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        seen.clear()
        keep = counts >= HOT_LOCAL
        k = int(keep.sum())
        none = pa.nulls(k, pa.int64())
        return [none, none, none, none, *[pa.nulls(k, pa.list_(pa.int64()))] * 2, values[keep].view(np.int64), counts[keep]]

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        for part in chunks(batch, "text"):
            sets, at = _sets(part, size)
            keys, n = _keys(sets, at), np.diff(at)
            sketch = pa.array(list(_sketches(sets, at)), pa.list_(pa.int64()))
            empty = pa.nulls(len(n), pa.int64())
            yield [part.column(0), n, keys[:, 0], keys[:, 1], sketch, pa.array(_wide(sets, at), pa.list_(pa.int64())), empty, empty]
            for k in range(len(n)):
                key = keys[k].tobytes()
                if key not in seen:
                    seen.add(key)
                    held.append(sets[at[k] : at[k + 1]])
            if sum(map(len, held)) > 4 * FLUSH:
                yield frequent()
        if held:
            yield frequent()

    return run


def prefix_length(n: np.ndarray) -> np.ndarray:
    """Of the first so many of n shingles a set that links shares one: n - ceil(0.8 n) + 1."""
    return n - (4 * n + 4) // 5 + 1


_ENTRIES = "region int, kind int, sigs binary, docs binary"


def _entries(size: int, sent):
    """Documents' prefixes, packed by region. Documents of one step that share a shingle are a group at once (kind 1), and only
    the smallest goes on for it (kind 0), so a frequent shingle sends one entry for each step and not one for each document."""
    hot, rank = sent.value
    sigs: list[np.ndarray] = []
    docs: list[np.ndarray] = []
    seen: set[bytes] = set()

    def flush() -> list:
        s, d = np.concatenate(sigs), np.concatenate(docs)
        sigs.clear()
        docs.clear()
        seen.clear()
        order = np.lexsort((d, s))
        s, d = s[order], d[order]
        first = np.ones(len(s), bool)
        first[1:] = s[1:] != s[:-1]
        last = np.ones(len(s), bool)
        last[:-1] = first[1:]
        group = ~(first & last)
        out: list[list] = [[], [], [], []]
        for kind, mask in ((0, first), (1, group)):
            ss, dd = s[mask], d[mask]
            region = (ss >> np.uint64(52)).astype(np.int64)
            edges = np.flatnonzero(np.diff(region, prepend=-1, append=REGIONS))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                where = int(region[a]) if kind == 0 else int(mix(dd[a : a + 1].view(np.uint64) + ss[a])[0] % np.uint64(REGIONS))
                for x, v in zip(out, (where, kind, ss[a:b].tobytes(), dd[a:b].tobytes()), strict=True):
                    x.append(v)
        return out

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        for part in chunks(batch, "text"):
            sets, at = _sets(part, size)
            keys, n = _keys(sets, at), np.diff(at)
            take = np.where(n > 0, prefix_length(n), 0)
            place = np.searchsorted(hot, sets)
            place[place == len(hot)] = 0
            level = np.where(hot[place] == sets, rank[place], 0) if len(hot) else np.zeros(len(sets), np.uint8)
            warm = np.concatenate([[0], np.cumsum(level > 0)])
            ids = part.column(0)
            for k in range(len(n)):
                key = keys[k].tobytes()
                if not n[k] or key in seen or not ids[k].is_valid:
                    continue
                seen.add(key)
                own = sets[at[k] : at[k + 1]]
                if warm[at[k + 1]] > warm[at[k]]:
                    own = own[np.argsort(level[at[k] : at[k + 1]], kind="stable")]
                sigs.append(own[: take[k]])
                docs.append(np.full(take[k], ids[k].as_py(), np.int64))
            if sum(map(len, sigs)) > FLUSH:
                yield flush()
        if sigs:
            yield flush()

    return run


def _regions(df: DataFrame) -> DataFrame:
    """sig, doc and pivot of each document in a region of two or more."""
    schema = pa.schema([("sig", pa.int64()), ("doc", pa.int64()), ("pivot", pa.int64())])

    def rows(s: np.ndarray, d: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((d, s))
        s, d = s[order], d[order]
        first = np.ones(len(s), bool)
        first[1:] = s[1:] != s[:-1]
        begin = np.flatnonzero(first)
        many = np.diff(np.append(begin, len(s)))
        pivot = np.repeat(d[begin], many)
        keep = np.repeat(many > 1, many)
        s, d, pivot = s[keep].view(np.int64), d[keep], pivot[keep]
        for a in range(0, len(s), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 16)]) for x in (s, d, pivot)], schema=schema)

    def run(batches):
        sigs, docs = [], []
        for batch in batches:
            for kind, s, d in zip(*(batch.column(k) for k in (1, 2, 3)), strict=True):
                s, d = np.frombuffer(s.as_py(), np.uint64), np.frombuffer(d.as_py(), np.int64)
                if kind.as_py():
                    yield from rows(s, d)
                else:
                    sigs.append(s)
                    docs.append(d)
        if sigs:
            yield from rows(np.concatenate(sigs), np.concatenate(docs))

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "region").mapInArrow(run, "sig long, doc long, pivot long")


def _bits():
    """A bitmap of the hashes of a batch's ids."""

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        bits = np.zeros(BITMAP_BITS, np.uint8)
        bits[(mix(batch.column(0).to_numpy().astype(np.int64).view(np.uint64)) % np.uint64(BITMAP_BITS)).astype(np.int64)] = 1
        yield [[np.packbits(bits).tobytes()]]

    return run


def _wanted_sets(size: int, sent):
    """Sets of documents whose id may be wanted (the bitmap may let others pass)."""
    bits = np.unpackbits(np.frombuffer(sent.value, np.uint8)).astype(bool)

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        ids = batch.column(0).fill_null(0).to_numpy().astype(np.int64)
        hit = bits[(mix(ids.view(np.uint64)) % np.uint64(BITMAP_BITS)).astype(np.int64)] & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        if hit.any():
            for part in chunks(batch.filter(pa.array(hit)), "text"):
                sets, at = _sets(part, size)
                yield [part.column(0), [sets[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]]

    return run


def _overlap():
    def run(batch: pa.RecordBatch) -> Iterator[list]:
        out = []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
            if len(x) > len(y):
                x, y = y, x
            place = np.searchsorted(y, x)
            place[place == len(y)] = 0
            common = int((y[place] == x).sum()) if len(y) else 0
            out.append((common, len(x) + len(y) - common))
        yield [batch.column(0), batch.column(1), [c for c, _ in out], [u for _, u in out]]

    return run


class Join:
    """The join of one table of documents; its tables live in the shared folder."""

    def __init__(self, docs: DataFrame, size: int = SIZE):
        self.spark, self.size = docs.sparkSession, size
        self.docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        scanned = materialize(map_batches(self.docs, _points, _POINTS, size), "points")
        self.rows = scanned.filter("shingle IS NULL").select("doc_id", "n", "k1", "k2", "sketch", "wide")
        frequent = scanned.filter("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("hits").alias("hits")).filter(F.col("hits") >= HOT)
        top = frequent.orderBy(F.desc("hits"), "shingle").limit(HOT_MOST).toArrow()
        hot = top.column("shingle").to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(hot)
        rank = np.log2(np.maximum(top.column("hits").to_numpy(), 1)).astype(np.uint8)
        self.order = self.spark.sparkContext.broadcast((hot[order], rank[order]))
        first = self.rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
        #: doc_id, rep, n, the set's key and sketches of each row with a doc_id and shingles
        self.points = materialize(self.rows.filter("n > 0 AND doc_id IS NOT NULL").join(first, ["k1", "k2"]).select("doc_id", "rep", "n", "k1", "k2", "sketch", "wide"), "reps")

    def regions(self) -> DataFrame:
        entries = map_batches(self.docs, _entries, _ENTRIES, self.size, self.order)
        return materialize(_regions(entries), "regions")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """pairs(a, b) with common and total: sizes of the intersection and the union of their sets."""
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        maps = map_batches(ids, _bits, "bits binary").toLocalIterator()
        bitmap = np.zeros(BITMAP_BITS // 8, np.uint8)
        for row in maps:
            bitmap |= np.frombuffer(row["bits"], np.uint8)
        sets = materialize(map_batches(self.docs, _wanted_sets, "doc_id long, members binary", self.size, self.spark.sparkContext.broadcast(bitmap.tobytes())), "sets")
        left = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("x"))
        right = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("y"))
        both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
        out = materialize(map_batches(both, _overlap, "a long, b long, common long, total long"), "verified")
        discard(sets)
        return out

    def near(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs of representatives that sizes and sketches don't rule out."""
        of = self.points
        a = of.select(F.col("doc_id").alias("a"), F.col("rep").alias("ra"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        b = of.select(F.col("doc_id").alias("b"), F.col("rep").alias("rb"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        joined = pairs.join(a, "a").join(b, "b").filter("ra <> rb").filter(possible())
        return self.wide(joined.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())

    def wide(self, pairs: DataFrame) -> DataFrame:
        """Pairs that the wide sketches of two large sets don't rule out: few enough to move whole sets for. Of several sets that one rep stands for any will do."""
        facts = self.points.filter("doc_id = rep").select("rep", "k1", "k2", "n", "wide").dropDuplicates(["rep", "k1", "k2"])
        a = facts.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("wide").alias("wa"))
        b = facts.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("wb"))
        bits = F.aggregate(F.zip_with("wa", "wb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
        return pairs.join(a, "a").join(b, "b").filter(F.coalesce(9 * bits <= F.col("na") + F.col("nb"), F.lit(True))).select("a", "b").distinct()

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Links (a, b) that connect all that are connected, and the components (node, component) of the linked documents."""
        regions = self.regions()
        verified = self.verify(materialize(self.near(regions.filter("doc <> pivot").select(F.col("doc").alias("a"), F.col("pivot").alias("b")).distinct()), "pairs"))
        links = verified.filter("5 * common >= 4 * total").select("a", "b")
        comps = materialize(connected(links), "components")
        members = self.members(regions)
        while True:
            rest = self.open(members, comps)
            most = rest.groupBy("sig").agg(F.count(F.when(F.col("minor"), 1)).alias("m")).agg(F.max("m")).first()[0]
            if not most:
                break
            chosen = self.pivots(rest, PIVOTS if most > LEAF else None)
            pairs = materialize(self.window(rest, chosen, verified), "pairs")
            found = self.verify(pairs)
            verified = materialize(verified.unionByName(found).distinct(), "verified")
            links = verified.filter("5 * common >= 4 * total").select("a", "b")
            comps = materialize(connected(links), "components")
            if most <= LEAF:
                break
            spent = chosen.select("sig", "rep", F.lit(True).alias("gone"))
            members = materialize(members.join(spent, ["sig", "rep"], "left").withColumn("spent", F.col("spent") | F.coalesce("gone", F.lit(False))).drop("gone"), "members")
        return links, comps

    def members(self, regions: DataFrame) -> DataFrame:
        """sig, rep, pivot, spent: the distinct points of each region."""
        reps = self.points.select(F.col("doc_id").alias("doc"), "rep")
        own = regions.join(reps, "doc").groupBy("sig", "rep").agg(F.min("pivot").alias("pivot"))
        return own.withColumn("spent", F.lit(False))

    def open(self, members: DataFrame, comps: DataFrame) -> DataFrame:
        """Members of regions with more than one component; minor: outside the largest one and not yet a pivot."""
        c = comps.select(F.col("node").alias("rep"), "component")
        own = members.join(c, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        by = own.groupBy("sig", "component").agg(F.count(F.lit(1)).alias("m"))
        main = by.groupBy("sig").agg(F.max(F.struct("m", F.col("component"))).alias("top"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("sig", F.col("top.component").alias("main"))
        rest = own.join(main, "sig").withColumn("minor", (F.col("component") != F.col("main")) & ~F.col("spent"))
        return materialize(rest.select("sig", "rep", "pivot", "component", "minor"), "open")

    def pivots(self, rest: DataFrame, take: int | None) -> DataFrame:
        minor = rest.filter("minor").select("sig", "rep", "pivot", "component")
        if take is None:
            return minor
        order = Window.partitionBy("sig").orderBy(F.xxhash64("rep"), "rep")
        return minor.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= take).drop("_k")

    def window(self, rest: DataFrame, chosen: DataFrame, verified: DataFrame) -> DataFrame:
        """Pairs of a chosen pivot and a member of its region inside all windows, not yet verified."""
        facts = self.points.select("rep", "k1", "k2", "n", "sketch").dropDuplicates(["rep", "k1", "k2"])
        known = verified.select(F.col("a").alias("rep"), F.col("b").alias("pivot"), (1 - F.col("common") / F.col("total")).alias("d"))
        known = known.unionByName(verified.select(F.col("b").alias("rep"), F.col("a").alias("pivot"), (1 - F.col("common") / F.col("total")).alias("d")))
        # a document of several texts has several distances, and none of them bounds the others'
        known = known.groupBy("rep", "pivot").agg(F.min("d").alias("d"), F.max("d").alias("_most")).filter("d = _most").drop("_most")
        full = rest.join(facts, "rep").join(known, ["rep", "pivot"], "left")
        x = full.select("sig", F.col("rep").alias("ra"), F.col("pivot").alias("pa"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("sketch").alias("sa"), F.col("d").alias("da"))
        picked = full.join(chosen.select("sig", "rep"), ["sig", "rep"], "left_semi")
        y = picked.select("sig", F.col("rep").alias("rb"), F.col("pivot").alias("pb"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("sketch").alias("sb"), F.col("d").alias("db"))
        ring = F.coalesce((F.col("pa") != F.col("pb")) | (F.abs(F.col("da") - F.col("db")) <= 0.2 + 1e-9), F.lit(True))
        pairs = x.join(y, "sig").filter("ca <> cb").filter(ring).filter(possible())
        pairs = pairs.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        return self.wide(pairs.join(verified.select("a", "b"), ["a", "b"], "left_anti"))


def possible() -> Column:
    """Sizes within 0.8, and sketches that differ in no more bits than sets at that distance could: 9 |A ^ B| <= |A| + |B|."""
    bits = F.lit(0)
    for k in range(SKETCH):
        bits = bits + F.bit_count(F.get("sa", F.lit(k)).bitwiseXOR(F.get("sb", F.lit(k))))
    return (5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb")) & (9 * bits <= F.col("na") + F.col("nb"))


def components(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs(doc_id, text)."""
    join = Join(docs, size)
    _, comps = join.links()
    reps = join.points.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.count_distinct("rep").alias("texts"))
    if reps.filter("texts > 1").limit(1).count():  # a doc_id with several texts ties their components together
        ties = join.points.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).unionByName(comps.select(F.col("node").alias("a"), F.col("component").alias("b")))
        comps = materialize(connected(ties), "components")
    of = reps.join(comps, reps["rep"] == comps["node"], "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    out = join.rows.select("doc_id", F.col("n").alias("n_shingles")).join(of, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.y) AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.x = w.doc_id GROUP BY ALL
"""
