"""Operator 5 [native]: line deduplication by an exact set-similarity join, with DataFrame functions alone.

A line's set is its distinct words (`[^\\x20\\x09-\\x0D]+`). A line is removed if an earlier line, by (doc_id, place in the text), is equal, or
has a Jaccard similarity of at least 0.8 to it and is itself the first of its copies.

1. Rarity: occurrences of all words, counted in hash buckets (16 a document, within bounds), on a logarithmic scale of 16
   levels, as a literal. Words in a line are sorted by it, rare ones first. Any order is exact; a rare-first one is fast.
2. Lines: one pass makes each line's hashes, size, parity sketch and prefix: the first n - ceil(0.8 n) + 1 words, which lines that
   are similar must share one of. A minimum over place leaves the first of equal lines, so copies add nothing to what follows.
3. Leaders: of many lines that share a word of their cores and are about as long, the earliest, and the earliest of those with the most copies, are
   held against the others. A line that is similar to an earlier leader needs no further witness: a group of near copies makes as many pairs as lines.
4. Join: lines without a witness bring their prefix words and their size class, every line its core, the rarest n - ceil(8 n / 9) + 1 words, which a line shares
   one of with the prefix of a longer one, for each class that may hold one (in a class above its own, only those that can be the first shared with so long a line); a line with a witness brings its whole prefix to meet the others. The condition has the length
   filter, the positional filter (the words that follow must suffice for the overlap) and the parity sketch, whose differing bits can't outnumber
   the words that differ.
5. Candidates are verified with their whole sets. Later lines of verified pairs go.

Hashes: lines by two of 64 bits, words in sets by one of 64 bits, words in prefixes by 32 bits (a collision there only adds a candidate).

Null text has no lines and stays null. Rows that share a doc_id are one document: the same lines are taken from each. Rows with a null
doc_id are left as they are. Lines without words stay. Other columns are passed on, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import SPACE_CLASS, SPACES, discard, materialize

#: Hash buckets of words, least and most, as powers of two: 16 a document between.
BUCKET_BITS = (14, 18)
#: Groups of fewer lines need no leaders: they make few pairs.
LEADER_GROUP = 16
#: The join of all lines runs over this many parts of the words, one after another, so that only one part's rows are on disk at a time.
PASSES = 2
#: With doc_ids under this, a place in a text is a long; else a decimal.
LONG_PLACES = 1 << 32
#: Lines of so few words are compared by one long of their parity sketch; the second isn't made.
ONE_LONG = 64
#: The first-level map of an aggregate in generated code holds 2**16 keys, fewer than there are buckets; beyond it each word is looked up twice.
MAP_BITS = "spark.sql.codegen.aggregate.fastHashMap.capacityBit"
#: Lists of lines under so many bytes are broadcast, so that texts stay where they are; others move the texts.
BROADCAST_BYTES = 64 << 20


def _words(line: Column) -> Column:
    """The words of a line, and empty strings between: parted at blanks, or by the slower pattern where it has other white space."""
    other = functools.reduce(Column.__or__, (F.contains(line, F.lit(c)) for c in "\t\x0b\f\r"))
    return F.when(other, F.split(line, SPACE_CLASS)).otherwise(F.split(line, " "))


def hashes(line: Column) -> Column:
    """64-bit hashes of a line's distinct words."""
    return F.array_except(F.transform(_words(line), lambda w: F.xxhash64(w)), F.array(F.xxhash64(F.lit(""))))


def _worded(line: Column) -> Column:
    """Whether a line has a word."""
    return F.ltrim(line, F.lit(SPACES)) != ""


def _texts(docs: DataFrame) -> DataFrame:
    return docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, ln and line of each line with a word."""
    return _texts(docs).select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line")).filter(_worded(F.col("line")))


def rarity(docs: DataFrame) -> tuple[Column, int]:
    """Rarity levels (0 to 15) of hash buckets by the top bits of the hash, less 8, as a literal array, and the number of those bits: both bounded."""
    bits = min(max((16 * max(1, docs.count()) - 1).bit_length(), BUCKET_BITS[0]), BUCKET_BITS[1])
    words = _texts(docs).select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    counts = words.groupBy(F.shiftrightunsigned(F.xxhash64("w"), 64 - bits).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    shifted = F.call_function("shiftleft", F.least(F.lit(15), F.floor(F.log2("c"))).cast("long"), (F.col("b").bitwiseAND(F.lit(15)) * 4).cast("int"))
    packed = counts.groupBy(F.shiftright("b", 4).alias("p")).agg(F.bit_or(shifted))  # 16 buckets a row
    conf = docs.sparkSession.conf
    held = conf.get(MAP_BITS)
    conf.set(MAP_BITS, max(int(held), bits + 1))
    try:
        rows = packed.collect()
    finally:
        conf.set(MAP_BITS, held)
    levels = ["-8"] * (1 << bits)
    for p, word in rows:
        levels[16 * p : 16 * p + 16] = [str((word >> k & 15) - 8) for k in range(0, 64, 4)]
    return F.split(F.lit(",".join(levels)), ",").cast("array<bigint>"), bits


def ranked(words: Column, table: Column, bits: int) -> Column:
    """Numbers of the words of hashes with the rarity level in the 4 high bits, rare first. The 60 low bits are the hash's 60 high ones."""

    def place(h: Column) -> Column:
        # never null, and said so: arrays that can't hold nulls are sorted as plain longs
        level = F.coalesce(F.get(table, F.shiftrightunsigned(h, 64 - bits).cast("int")), F.lit(0).cast("long"))
        return F.shiftleft(level, 60).bitwiseXOR(F.shiftrightunsigned(h, 4))

    return F.sort_array(F.transform(words, place))


def first_lines(docs: DataFrame) -> DataFrame:
    """doc_id, ln, copies, n, par, par2 (parity sketch, par2 beyond ONE_LONG words) and prefix (rare first, 31 bits of each word) of the first of each line's copies, as a table."""
    table, bits = rarity(docs)
    rows = _lines(docs).select("doc_id", "ln", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), hashes(F.col("line")).alias("ws"))
    rows = rows.withColumn("ts", ranked(F.col("ws"), table, bits)).withColumn("n", F.size("ts"))
    rows = rows.withColumn("p", F.slice("ts", F.lit(1), F.col("n") - F.floor((4 * F.col("n") + 4) / 5).cast("int") + 1))
    # each word has one of 64 bits in par; where there is par2, it has the odd words' bits as well
    flip = lambda one: lambda acc, h: acc.bitwiseXOR(F.call_function("shiftleft", one(h), F.hash(h)))
    whole, odd = (F.aggregate("ws", F.lit(0).cast("long"), flip(one)) for one in (lambda h: F.lit(1).cast("long"), lambda h: h.bitwiseAND(F.lit(1))))
    odd = F.when(F.col("n") > ONE_LONG, odd).otherwise(F.lit(0).cast("long"))
    low = F.transform("p", lambda t: F.shiftright(t, 4).bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    # one number orders places, as an aggregate by hashing can't hold a struct; all else is the same for all copies
    least, most = docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first()
    if least is None or -LONG_PLACES <= least and most < LONG_PLACES:
        number = lambda ln: F.shiftleft(F.col("doc_id"), 31) + ln
    else:
        number = lambda ln: (F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(11,0)") + ln).cast("decimal(38,0)")
    firsts = rows.select("h1", "h2", "n", whole.alias("par"), odd.alias("par2"), low.alias("prefix"), "doc_id", number(F.col("ln")).alias("place"))
    firsts = firsts.groupBy("h1", "h2", "n", "par", "par2", "prefix").agg(F.min("doc_id").alias("doc_id"), F.min("place").alias("place"), F.count(F.lit(1)).alias("copies"))
    ln = (F.col("place") - number(F.lit(0))).cast("int")
    return materialize(firsts.select("doc_id", ln.alias("ln"), "n", "par", "par2", "prefix", "copies"), "line-firsts")


def entries(lines: DataFrame, words: Column, part: int | None, *more: str) -> DataFrame:
    """A row for each of words in one part of all words (None: in all): key (word and the line's band), the word's place pos, the word before (or -1), and the line's doc_id, ln, n, sketch and more."""
    rows = lines.select("doc_id", "ln", "n", "par", "par2", "band", *more, words.alias("ws"), F.posexplode(words).alias("pos", "token"))
    if part is not None:
        rows = rows.filter(F.col("token") % PASSES == part)
    # one long, which sorts by its bits
    key = F.shiftleft(F.col("token").cast("long"), 8).bitwiseOR(F.col("band").cast("long"))
    return rows.withColumns({"key": key, "before": F.when(F.col("pos") > 0, F.get("ws", F.col("pos") - 1)).otherwise(F.lit(-1))}).drop("ws", "token", "band")


def _named(rows: DataFrame, end: str) -> DataFrame:
    return rows.select(*(F.col(c).alias(f"{end}_{c}") for c in rows.columns))


def _earlier(a: str, b: str) -> Column:
    return (F.col(f"{a}_doc_id") < F.col(f"{b}_doc_id")) | ((F.col(f"{a}_doc_id") == F.col(f"{b}_doc_id")) & (F.col(f"{a}_ln") < F.col(f"{b}_ln")))


def _packed(rows: DataFrame, end: str) -> DataFrame:
    """Entries, named, in six longs: rows that are sent and sorted are as short as can be. gone is the highest bit of n and ln."""
    long = lambda high, low: F.shiftleft(high.cast("long"), 32).bitwiseOR(low)
    line = long(F.col("n"), F.col("ln").cast("long"))
    if "gone" in rows.columns:
        line = F.when(F.col("gone"), line.bitwiseOR(F.lit(-(1 << 63)))).otherwise(line)
    at = long(F.col("pos"), F.col("before").cast("long").bitwiseAND(F.lit((1 << 32) - 1)))
    return _named(rows.select("key", "doc_id", line.alias("line"), at.alias("at"), "par", "par2"), end)


def _unpacked(end: str) -> dict[str, Column]:
    """What _packed() put away, by name."""
    line, at = F.col(f"{end}_line"), F.col(f"{end}_at")
    low = lambda x: x.bitwiseAND(F.lit((1 << 32) - 1))
    return {"doc_id": F.col(f"{end}_doc_id"), "ln": low(line), "n": F.shiftright(line, 32).bitwiseAND(F.lit((1 << 31) - 1)), "gone": line < 0, "pos": F.shiftright(at, 32), "before": low(at)}


def _near(a: dict[str, Column] | None = None, b: dict[str, Column] | None = None) -> Column:
    """Whether the lines of entries a and b may be similar: length, positional and parity filter."""
    (a_n, a_pos), (b_n, b_pos) = ([x[c] if x else F.col(f"{end}_{c}") for c in ("n", "pos")] for end, x in (("a", a), ("b", b)))
    both = a_n + b_n
    par, par2 = (F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}")) for c in ("par", "par2"))
    differ = F.when(F.least(a_n, b_n) > ONE_LONG, F.bit_count(par.bitwiseXOR(par2)) + F.bit_count(par2)).otherwise(F.bit_count(par))
    return (5 * F.least(a_n, b_n) >= 4 * F.greatest(a_n, b_n)) & (9 * F.least(a_n - a_pos, b_n - b_pos) >= 4 * both) & (9 * differ <= both)


def _core() -> Column:
    """How many words of a prefix a line must share one of with a line that is similar and not shorter: n - ceil(8 n / 9) + 1."""
    return F.floor(F.col("n") / 9).cast("int") + 1


def _in_order(met: DataFrame) -> DataFrame:
    """The pairs of met as a (earlier) and b (later), each once."""
    ends = (F.when(_earlier("a", "b"), F.col(f"{x}_{c}")).otherwise(F.col(f"{y}_{c}")).alias(f"{x}_{c}") for x, y in ("ab", "ba") for c in ("doc_id", "ln"))
    return met.select(*ends).distinct()


def leader_pairs(firsts: DataFrame, part: int | None = None) -> DataFrame:
    """Pairs (a: earlier, b: later) of a leader and a line that shares one of its rarest words, in one part of all words (None: in all), and is about as long."""
    # lines of one size that are similar share a word of their cores
    rows = entries(firsts.withColumn("band", F.floor(F.log("n") * 9).cast("int")), F.slice("prefix", F.lit(1), _core()), part, "copies").drop("before")
    groups = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= LEADER_GROUP).select("key"), "line-groups")
    crowd = materialize(rows.join(F.broadcast(groups) if groups.count() * 96 <= BROADCAST_BYTES else groups, "key"), "line-crowds")
    first = [F.min(F.struct(few.alias("few"), "doc_id", "ln", "n", "par", "par2", "pos")) for few in (F.lit(0), -F.floor(F.log2("copies")).cast("int"))]
    leaders = crowd.groupBy("key").agg(F.array_distinct(F.array(*first)).alias("at")).select("key", F.explode("at").alias("at")).select("key", "at.*")
    a, b = _named(leaders, "a"), _named(crowd.drop("copies"), "b")
    out = materialize(_in_order(a.join(b, (F.col("a_key") == F.col("b_key")) & _near() & (_earlier("a", "b") | _earlier("b", "a")))), "line-pairs")
    discard(groups, crowd)
    return out


def _band(n: Column) -> Column:
    """The size class of n words; each is two thirds longer than the one before."""
    return F.floor(F.log(n) * 2).cast("int")


def all_pairs(firsts: DataFrame, settled: DataFrame, part: int) -> DataFrame:
    """Pairs (a: earlier, b: later) of lines that share a prefix word of one part and pass the filters, where b isn't settled yet.

    Of two similar lines the shorter shares a word of its core with the whole prefix of the longer. So every open line brings its whole prefix (b), to meet
    the cores of lines that aren't longer (a); a settled line, which meets open lines alone, is in a with its whole prefix, be it shorter or longer."""
    n = F.col("n")
    known = firsts.join(settled.withColumn("gone", F.lit(True)), ["doc_id", "ln"], "left").withColumn("gone", F.col("gone").isNotNull())
    least = F.when(F.col("gone"), F.floor((4 * n + 4) / 5)).otherwise(n)
    classed = known.withColumn("band", F.explode(F.sequence(_band(least), _band(F.floor(5 * n / 4)))))
    # a word at place i is the first shared one only with lines of up to (5 n - 9 i) / 4 words; a class above n's begins beyond floor(e ** (band / 2))
    reach = F.floor((5 * n - 4 * F.floor(F.exp(F.col("band") / 2))) / 9).cast("int") + 1
    most = F.when(F.col("gone"), F.size("prefix")).otherwise(_core())
    words = F.slice("prefix", F.lit(1), F.when(F.col("band") > _band(n), F.greatest(F.lit(0), F.least(most, reach))).otherwise(most))
    left = _packed(entries(classed, words, part, "gone"), "a")
    right = _packed(entries(known.filter("NOT gone").withColumn("band", _band(n)), F.col("prefix"), part), "b")
    a, b = _unpacked("a"), _unpacked("b")
    # two open lines of one size meet in both orders
    earlier = (a["doc_id"] < b["doc_id"]) | ((a["doc_id"] == b["doc_id"]) & (a["ln"] < b["ln"]))
    turn = F.when(a["gone"], earlier).otherwise((a["n"] < b["n"]) | ((a["n"] == b["n"]) & earlier))
    # lines that share the word before too have met there: that pair passes as well
    new = (a["before"] != b["before"]) | (a["before"] == (1 << 32) - 1)
    met = left.join(right, (F.col("a_key") == F.col("b_key")) & new & _near(a, b) & turn)
    return materialize(_in_order(met.select("a_doc_id", a["ln"].cast("int").alias("a_ln"), "b_doc_id", b["ln"].cast("int").alias("b_ln"))), "line-pairs")


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, ln of each later line of a pair whose whole sets are similar, as a table."""
    ends = F.array(*(F.struct(F.col(f"{e}_doc_id").alias("doc_id"), F.col(f"{e}_ln").alias("ln")) for e in "ab"))
    wanted = materialize(pairs.select(F.explode(ends).alias("w")).select("w.*").groupBy("doc_id").agg(F.collect_set("ln").alias("lns")), "line-wanted")
    texts = _texts(docs).join(_small(wanted, "lns"), "doc_id")
    lines = texts.select("doc_id", "lns", F.posexplode(F.split("text", "\n")).alias("ln", "line")).filter(F.array_contains("lns", F.col("ln")))
    sets = materialize(lines.select("doc_id", "ln", hashes(F.col("line")).alias("set")).dropDuplicates(["doc_id", "ln"]), "line-sets")
    a = sets.select(F.col("doc_id").alias("a_doc_id"), F.col("ln").alias("a_ln"), F.col("set").alias("x"))
    b = sets.select(F.col("doc_id").alias("b_doc_id"), F.col("ln").alias("b_ln"), F.col("set").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    found = pairs.join(a, ["a_doc_id", "a_ln"]).join(b, ["b_doc_id", "b_ln"]).filter(9 * common >= 4 * (F.size("x") + F.size("y")))
    out = materialize(found.select(F.col("b_doc_id").alias("doc_id"), F.col("b_ln").alias("ln")).distinct(), "line-copies")
    discard(sets, wanted)
    return out


def _small(table: DataFrame, lists: str) -> DataFrame:
    """table, marked for broadcast if its rows and lists of numbers are under BROADCAST_BYTES as a hash relation; else as it is."""
    rows, numbers = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(lists)), F.lit(0))).first()
    return F.broadcast(table) if rows * 96 + numbers * 8 <= BROADCAST_BYTES else table


def near_copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """first_lines(), and doc_id, ln of the lines to remove for an earlier similar line, as tables."""
    firsts = first_lines(docs)
    led = _settled(docs, [leader_pairs(firsts)])
    # an equal line at a later place is removed for its first place, and a pair of two later places has one of first places too
    return firsts, led.union(_settled(docs, [all_pairs(firsts, led, part) for part in range(PASSES)]))


def _settled(docs: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """What verified() finds among the pairs of all parts, which go then."""
    out = verified(docs, functools.reduce(DataFrame.union, parts).distinct())
    discard(*parts)
    return out


def decisions(docs: DataFrame) -> DataFrame:
    """doc_id, kept and near, as a table: for each document with a first line, its lines that stay, and how many went for a similar line."""
    firsts, near = near_copies(docs)
    # both by doc_id, each line once: no join
    marked = firsts.select("doc_id", F.col("ln").alias("first"), F.lit(None).cast("int").alias("gone")).union(near.select("doc_id", F.lit(None).cast("int"), "ln"))
    lists = marked.repartition("doc_id").groupBy("doc_id").agg(F.collect_list("first").alias("firsts"), F.collect_list("gone").alias("gone"))
    kept = F.when(F.size("gone") == 0, F.col("firsts")).otherwise(F.filter("firsts", lambda ln: ~F.array_contains("gone", ln)))
    out = materialize(lists.select("doc_id", kept.alias("kept"), (F.size("firsts") - F.size(kept)).cast("long").alias("near")), "line-decisions")
    discard(firsts)
    return out


def rebuilt(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), doc_id, text, lines (of text), blank (numbers of those without words), rest (numbers of those that stay, from 0; null where doc_id or text is),
    new_text (of these) and near."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = rows.join(_small(decisions(docs), "kept"), "doc_id", "left").withColumn("lines", F.split("text", "\n"))
    wordless = F.array_except(F.transform("lines", lambda x, i: F.when(_worded(x), -1).otherwise(i)), F.array(F.lit(-1)))
    out = joined.withColumn("blank", wordless)
    # rows that share a doc_id may have lines that this text hasn't
    stay = F.filter(F.sort_array(F.array_union(F.coalesce("kept", F.array().cast("array<int>")), F.col("blank"))), lambda i: i < F.size("lines"))
    out = out.withColumn("rest", F.when(F.col("doc_id").isNotNull() & F.col("text").isNotNull(), stay))
    new_text = F.array_join(F.transform("rest", lambda i: F.get("lines", i)), "\n")
    return out.withColumn("new_text", F.when(F.col("rest").isNull(), F.col("text")).otherwise(new_text))


def dedup(docs: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """docs with the lines taken out of text; n_chars, where there is one, is the new length. drop_emptied: without the rows that lost all their words."""
    out, new = rebuilt(docs), {"text": F.col("new_text"), "n_chars": F.char_length("new_text").cast("long")}
    if drop_emptied:
        out = out.filter(F.col("rest").isNull() | _worded_text("new_text") | ~_worded_text("text"))
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def _worded_text(text: str) -> Column:
    return F.ltrim(text, F.lit(SPACES + "\n")) != ""


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (with words), n_kept, n_near and kept_sum (sum of the numbers of kept lines, from 0) of each row, counted in its rebuilt text."""
    total = F.aggregate(F.array_except("rest", "blank"), F.lit(0).cast("long"), lambda acc, i: acc + i)
    return rebuilt(docs).select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines") - F.size("blank")).cast("long").alias("n_lines"),
        F.when(F.col("rest").isNull(), 0).otherwise(F.size(F.filter(F.split("new_text", "\n"), _worded))).cast("long").alias("n_kept"),
        F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
        F.coalesce(total, F.lit(0)).cast("long").alias("kept_sum"),
    )


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT doc_id, ln, line, list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS ws FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
f AS (SELECT line, any_value(ws) AS ws, min((doc_id, ln)) AS place FROM w GROUP BY line),
t AS (SELECT place, ws, len(ws) AS n, unnest(ws) AS tok FROM f),
d AS (SELECT tok, count(*) AS c FROM t GROUP BY tok),
p AS (SELECT * FROM (SELECT place, ws, n, tok, row_number() OVER (PARTITION BY place ORDER BY c, tok) AS r FROM t JOIN d USING (tok)) WHERE r <= n - (4 * n + 4) // 5 + 1),
c AS (SELECT DISTINCT a.place AS x, b.place AS y, a.ws AS xs, b.ws AS ys FROM p a JOIN p b ON a.tok = b.tok AND a.place < b.place AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
g AS (SELECT DISTINCT y FROM c WHERE 9 * len(list_intersect(xs, ys)) >= 4 * (len(xs) + len(ys))),
k AS (SELECT place[1] AS doc_id, place[2] AS ln, place IN (SELECT y FROM g) AS gone FROM f),
s AS (SELECT doc_id, count(*) FILTER (NOT gone) AS kept, count(*) FILTER (gone) AS near, sum(ln) FILTER (NOT gone) AS total FROM k GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n.n, 0)::BIGINT AS n_lines, coalesce(kept, 0)::BIGINT AS n_kept, coalesce(near, 0)::BIGINT AS n_near, coalesce(total, 0)::BIGINT AS kept_sum
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)
"""
