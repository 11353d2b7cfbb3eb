"""Each operator on small tables with nulls, ties, repeated rows, long texts and clashing columns, against brute force."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from rasterloom.llm import curriculum, exact_topk, jaccard_join, line_dedup, quality_fm, quality_rules, token_blocks, token_count, trie_bpe, warc
from rasterloom.llm.queries import tokenizer

random.seed(11)
_W = [f"w{k}x{k * k % 97}" for k in range(400)]
_BASE = [random.choice(_W) for _ in range(120)]


def _edit(words, n):
    out = list(words)
    for k in random.sample(range(len(out)), n):
        out[k] = random.choice(_W)
    return " ".join(out)


TEXTS = [None, "", "  \n\t ", "one", "a b c d", "A B C D", " ".join(_BASE), " ".join(_BASE), _edit(_BASE, 1), _edit(_BASE, 2), _edit(_BASE, 30)]
TEXTS += ["日本語 ünï <|endoftext|> it's 'll", "x\x1cy\x85z", "long " * 9000, "z" * 5000, "first line here\nsecond line here\nfirst line here", "l1 a b c d e f g h i\nl1 a b c d e f g h j\nother"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, n_words int, rep long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", [None, "b", "a"][k % 3], len(t or ""), 7, 8, 9) for k, t in enumerate(TEXTS)]
    rows.append((None, "null id", None, None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA)


def collected(df):
    return [r.asDict() for r in df.collect()]


def oracle(docs, sql):
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    return con.execute(sql).df().astype(object).where(lambda x: x.notna(), None).to_dict("records")


def same(got, want, columns):
    key = lambda r: tuple((r[c] is None, r[c]) for c in columns)
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_token_blocks(docs):
    t = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in collected(token_blocks.token_blocks(docs, tokenizer("word_bpe_49k.json")))}
    start = 0
    for k, text in [(None, "null id"), *enumerate(TEXTS)]:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert got[k] == {"doc_id": k, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}
        start += len(ids)


def test_blocks_round_trip():
    for n in (0, 1, 255, 256, 257, 5000):
        for high in (1, 2, 1 << 16, 1 << 32):
            ids = np.array([random.randrange(high) if random.random() < 0.95 else high - 1 for _ in range(n)], "<u4")
            data = token_blocks.encode_blocks(ids)
            assert (token_blocks.decode_blocks(data) == ids).all()
            assert (token_blocks.decode_blocks(data, 1, 2) == ids[256:512]).all()


def test_warc(spark):
    pages = [(k, f"http://a/{k} é\r\nX: 1", t) for k, t in enumerate([None, "", "x" * 99, "x" * 99, "y" * 100, "y" * 100, "é\r\n\r\n" * 60])] + [(4, "again", "y" * 100), (None, None, "y" * 100)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = collected(warc.archive(df))
    want = []
    for k, _, t in pages:
        data = (t or "").encode()
        ids = [p for p, _, u in pages if (u or "") == (t or "") and p is not None]
        revisit = len(data) >= 100 and k != min(ids)
        want.append({"page_id": k, "payload_bytes": len(data), "payload_digest": hashlib.sha256(data).hexdigest(), "record_type": "revisit" if revisit else "response", "refers_to": min(ids) if revisit else None})
    same(got, want, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def test_seeking_in_a_bundle():
    writer = warc.BundleWriter(frame_bytes=500)
    for k in range(20):
        writer.add(k, warc.record(k, "u", bytes([k]) * 200, "d", 200, None, False))
    bundle = writer.finish()
    assert len(warc.seek_table(bundle)) > 5
    for k, frame, at, _ in writer.index:
        assert warc.read_record(bundle, frame, at)[1] == bytes([k]) * 200


def test_quality_rules(docs):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    known = docs.filter("doc_id IS NOT NULL")
    same(collected(quality_rules.quality_rules(known)), oracle(known, quality_rules.oracle_sql()), columns)


def test_token_counts(docs):
    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in collected(token_count.token_counts(docs, tokenizer("byte_bpe_50k.json"), chunk=300, overlap=16))}
    for k, text in enumerate(TEXTS):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert got[k] == {"doc_id": k, "n_bytes": len((text or "").encode()), "n_tokens": n, "over_limit": n > 512}


def test_line_dedup(docs):
    known = docs.filter("doc_id IS NOT NULL")
    same(collected(line_dedup.digest(known)), oracle(known, line_dedup.ORACLE), ["doc_id", "n_lines", "n_kept", "n_near", "kept_sum"])
    out = {r["doc_id"]: r for r in collected(line_dedup.dedup(docs))}
    assert out[15]["text"] == "first line here\nsecond line here" and out[16]["text"] == "l1 a b c d e f g h i\nother"
    assert out[0]["text"] is None and out[None]["text"] == "null id" and out[16]["size"] == 7


def test_line_dedup_of_odd_tables(spark):
    rows = [(1, "a b\nc d", 5, "k"), (2, "c d\na b", 6, None), (2, "c d\na b", 7, None), (3, " \n", 8, "x"), (4, "", 9, "y"), (5, "a\tb\n\nnew one", 1, "z"), (None, "a b", 2, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int, near string")
    texts = lambda out: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"], r["kept"]) for r in collected(out))
    left = [(False, 1, "a b\nc d", 5), (False, 2, "", 6), (False, 2, "", 7), (False, 3, " \n", 8), (False, 4, "", 9), (False, 5, "\nnew one", 1), (True, 0, "a b", 2)]
    assert texts(line_dedup.dedup(df)) == left and line_dedup.dedup(df).columns == df.columns
    assert texts(line_dedup.dedup(df, drop_emptied=True)) == [r for r in left if r[1] != 2]


def _related_lines(count, words):
    """Lines made by taking words out of earlier lines and putting others in, up to a little more than a pair may differ by."""
    draw, out = random.Random(5), []
    for _ in range(count):
        line = list(draw.choice(out)) if out and draw.random() < 0.7 else [f"w{draw.randrange(words)}" for _ in range(draw.randrange(1, 40))]
        for _ in range(draw.randrange(len(line) // 4 + 1)):
            line.pop(draw.randrange(len(line)))
        line += [f"w{draw.randrange(words)}" for _ in range(draw.randrange(len(line) // 8 + 2))]
        out.append(line)
    return [" ".join(line) for line in out if line]


def test_line_dedup_finds_every_similar_pair(spark, monkeypatch):
    lines = _related_lines(3000, 300)
    df = spark.createDataFrame([(k * 7919 % 601, "\n".join(lines[k::600])) for k in range(600)], "doc_id long, text string")
    want = oracle(df, line_dedup.ORACLE)
    for group in (2, 16, 1 << 30):  # with many leaders, few and none
        monkeypatch.setattr(line_dedup, "LEADER_GROUP", group)
        got = collected(line_dedup.digest(df))
        same(got, want, ["doc_id", "n_lines", "n_kept", "n_near", "kept_sum"])
    assert sum(r["n_near"] for r in got) > 300


def test_line_dedup_compares_lines_of_like_length(spark, monkeypatch):
    draw, met = random.Random(6), []
    lines = [" ".join(f"w{draw.randrange(900)}" for _ in range(draw.randrange(5, 200))) for _ in range(400)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")
    whole = line_dedup.entries
    monkeypatch.setattr(line_dedup, "entries", lambda *args: met.append(whole(*args)) or met[-1])
    firsts = line_dedup.first_lines(df)
    per_word = firsts.selectExpr("explode(prefix) AS token").groupBy("token").count().selectExpr("sum(count * count)").first()[0]
    line_dedup.all_pairs(firsts, firsts.select("doc_id", "ln").limit(0), 0).count()
    key = next(c for c in ("key", "token") if c in met[0].columns)
    a, b = (f.groupBy(key).count().withColumnRenamed("count", n) for f, n in zip(met, "ab", strict=True))
    combinations = a.join(b, key).selectExpr("sum(a * b)").first()[0]
    assert combinations * line_dedup.PASSES < per_word / 3


def test_line_dedup_of_large_ids_and_long_lines(spark, monkeypatch):
    lines = _related_lines(1500, 300)
    shift = lambda k: (k * 7919 % 601 - 300) * (1 << 40)
    small, large = (spark.createDataFrame([(f(k), "\n".join(lines[k::300])) for k in range(300)], "doc_id long, text string") for f in (lambda k: k * 7919 % 601 - 300, shift))
    monkeypatch.setattr(line_dedup, "ONE_LONG", 8)  # of two lines one, both or none has two longs of its sketch
    for df in (small, large):  # places are longs, decimals
        got = collected(line_dedup.digest(df))
        same(got, oracle(df, line_dedup.ORACLE), ["doc_id", "n_lines", "n_kept", "n_near", "kept_sum"])
    assert sum(r["n_near"] for r in got) > 100


def test_first_lines_are_neither_sorted_for_nor_sent_in_vain(spark, monkeypatch):
    df = spark.createDataFrame([(k, " ".join(f"w{k}x{i}" for i in range(46))) for k in range(50)], "doc_id long, text string")
    plans, met = [], []
    write, whole = line_dedup.materialize, line_dedup.entries
    monkeypatch.setattr(line_dedup, "materialize", lambda out, tag: plans.append(out._jdf.queryExecution().executedPlan().toString()) or write(out, tag))
    monkeypatch.setattr(line_dedup, "entries", lambda *args: met.append(whole(*args)) or met[-1])
    firsts = line_dedup.first_lines(df)
    assert "HashAggregate" in plans[0] and "SortAggregate" not in plans[0]
    # 46 words: the class above begins at 55, and a line of that size shares one of the first two words, if any, not one of all six
    for part in range(line_dedup.PASSES):
        line_dedup.all_pairs(firsts, firsts.select("doc_id", "ln").limit(0), part).count()
    assert sum(a.count() for a in met[::2]) == 50 * (6 + 2)


def test_line_digest_counts_rebuilt_texts(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b\n\nc d\na b"), (2, "c d\ne f"), (3, None), (None, "a b")], "doc_id long, text string")
    row = lambda: {r["doc_id"]: (r["n_lines"], r["n_kept"], r["n_near"], r["kept_sum"]) for r in collected(line_dedup.digest(df))}
    assert row() == {1: (3, 2, 0, 2), 2: (2, 1, 0, 1), 3: (0, 0, 0, 0), None: (1, 0, 0, 0)}
    join = line_dedup.F.array_join
    monkeypatch.setattr(line_dedup.F, "array_join", lambda col, sep: join(line_dedup.F.slice(col, 1, 0), sep) if sep == "\n" else join(col, sep))
    assert {k: v[1] for k, v in row().items()} == {1: 0, 2: 0, 3: 0, None: 0}  # texts rebuilt without lines show


def test_classifier(spark, docs):
    good = [(100 + k, " ".join(random.choices(_W, k=80)), None, None, None, 0, 0, 0) for k in range(120)]
    bad = [(300 + k, " ".join(f"{w}###" for w in random.choices(_W, k=80)), None, None, None, 0, 0, 0) for k in range(60)]
    rows = spark.createDataFrame(good + bad, SCHEMA).unionByName(docs)
    labels = spark.createDataFrame([(k, 1, 0) for k, *_ in good] + [(k, 0, 0) for k, *_ in bad], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in collected(quality_fm.quality_classifier(rows, labels))}
    assert len(got) == rows.count() and all(0 <= r["score"] <= 1 for r in got.values())
    held = [r for r in got.values() if r["held_out"] and (r["doc_id"] or 0) >= 100]
    assert held and all(r["predicted"] == (r["doc_id"] < 300) for r in held)
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items() if k is not None)


def test_repeated_documents_are_one_example(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_fm, "fit", lambda x, y: seen.append((x, y)))
    rows = [(k % 10 if k < 60 else 11, " ".join(random.choices(_W, k=5)), 1) for k in range(200)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, quality int")
    train = [k for k in range(12) if k != 10 and zlib.crc32(str(k).encode()) % 5]
    for order in (rows, rows[::-1]):
        quality_fm.train(spark.createDataFrame(order, "doc_id long, text string, n_chars long"), labels, sample_rows=len(train) + 1)
    (x, y), (again, _) = seen
    assert len(x) == len(train) and list(y) == [k % 2 for k in train] and (x == again).all()


def test_linear_time_identity():
    rng = np.random.default_rng(1)
    x, v, w = rng.normal(size=(4, 9)), rng.normal(size=(9, 3)), rng.normal(size=9)
    slow = [0.3 + r @ w + sum(v[i] @ v[j] * r[i] * r[j] for i in range(9) for j in range(i)) for r in x]
    assert np.allclose(quality_fm.Model(0.3, w, v).logits(x), slow)


def test_trie_bpe(docs):
    t = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in collected(trie_bpe.digests(docs, tokenizer("word_bpe_49k.json")))}
    for k, text in enumerate(TEXTS):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[k]["n_tokens"] == len(ids) and got[k]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("leaf", [8192, 1])
def test_jaccard_join(docs, leaf, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    known = docs.filter("doc_id IS NOT NULL")
    same(collected(jaccard_join.components(known)), oracle(known, jaccard_join.ORACLE), ["doc_id", "n_shingles", "component_id"])


def test_jaccard_join_of_several_texts(spark):
    one, two = ([f"{k}y{i}" for i in range(900)] for k in "ab")
    near = lambda words: " ".join([*words[:-1], "other"])
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, near(one)), (3, near(two))]
    assert {r["component_id"] for r in collected(jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string")))} == {1}


def test_windows_of_several_texts(spark):
    one, two = ([f"{k}y{i}" for i in range(900)] for k in "ab")
    near = lambda words: " ".join([*words[:-1], "other"])
    join = jaccard_join.Join(spark.createDataFrame([(1, " ".join(one)), (2, near(one)), (2, " ".join(two)), (3, near(two))], "doc_id long, text string"))
    rest = spark.createDataFrame([(0, k, 1, k, True) for k in (1, 2, 3)], "sig long, rep long, pivot long, component long, minor boolean")
    verified = join.verify(spark.createDataFrame([(1, 2), (1, 3)], "a long, b long"))
    found = join.window(rest, rest, verified).collect()
    assert [(r.a, r.b) for r in found] == [(2, 3)]


def _topk(rows, k=5):
    q = [(i, [int(np.floor(256 * x)) if abs(x) < 1e300 else 256 * int(x) for x in map(float, v)]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (i, v) in enumerate(q):
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), c) for other, (c, w) in enumerate(q) if other != at)[:k]
            out += [{"query_id": i, "rank": rank, "vec_id": c, "score": -s if -(2**63) <= -s < 2**63 else None, "exact": str(-s)} for rank, (s, c) in enumerate(best, 1)]
    return out


FOUND = ["query_id", "rank", "vec_id", "score", "exact"]


def test_exact_topk(spark):
    rows = [(k, [float(np.float32(random.choice([0.0, 0.5, -0.25, 0.101]))) for _ in range(random.choice([4, 6]))]) for k in range(160)]
    rows += [(200, None), (201, []), (250, [1.0, None]), (300, [float("nan")]), (350, [float("inf")]), (None, [1.0]), (400, [])]
    rows += [rows[50], rows[50], rows[3], (50, [0.5] * 6), (100, [0.25] * 4)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, rank int")
    for options in ({"block": 1}, {}, {"pass_bytes": 100}):
        same(collected(exact_topk.exact_topk(df, **options)), _topk(rows), FOUND)


def test_exact_topk_beyond_64_bits(spark):
    far = [0.0, 1.0, -3.5, 2.0**40, -(2.0**40), 2.0**70 + 2.0**20, -(2.0**1000), 1.7e308, -1.7e308, 2.0**22]
    rows = [(k % 120, [random.choice(far) for _ in range(4)]) for k in range(150)] + [(k, [2.0**40] * 4) for k in (0, 50, 51)] + [(k, [1.0, 2.0]) for k in range(200, 260)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for options in ({}, {"pass_bytes": 100}):
        same(collected(exact_topk.exact_topk(df, **options)), _topk(rows), FOUND)
    numbers = [0, 1, -1, 255, 256, -256, 2**70, -(2**70), 2**700]
    assert sorted(numbers) == sorted(numbers, key=exact_topk.order_key)


def test_curriculum(docs):
    known = docs.filter("doc_id IS NOT NULL")
    same(collected(curriculum.digest(known)), oracle(known, curriculum.ORACLE), ["doc_id", "size", "source_size", "target", "taken", "copies", "position"])
    out = curriculum.mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in collected(curriculum.digest(docs)))


def test_curriculum_of_repeated_rows(spark):
    same_row, null_row = [(5, "w " * 100, "a")] * 10, [(None, "x " * 50, "b")] * 10
    rows = same_row + null_row + [(k, "v " * (k % 9 + 1), "c") for k in range(60)] + [(7, f"text {k} " * 3, "c") for k in range(20)] + [(8, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    columns = ["doc_id", "size", "source_size", "target", "taken", "copies", "position"]
    got = collected(curriculum.digest(df))
    same(got, oracle(df, curriculum.ORACLE), columns)
    for k, size in ((5, 100), (None, 50), (7, 9)):
        own = [r for r in got if r["doc_id"] == k]
        assert all(r["taken"] <= 2 * r["size"] for r in own)
    for total in {r["source_size"] for r in got if r["source_size"]}:
        own = [r for r in got if r["source_size"] == total]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) / 2
    assert curriculum.mix(df).count() == sum(r["copies"] for r in got)


def test_curriculum_is_counted_in_its_stream(spark, monkeypatch):
    rows = [(k, "w " * (k % 7), "abc"[k % 3]) for k in range(90)] + [(5, "w " * 5, "a")] * 4 + [(None, "x y", None)]
    df, written = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), {}
    whole = curriculum.materialize
    monkeypatch.setattr(curriculum, "materialize", lambda t, tag: written.setdefault(tag, whole(t, tag)))
    got = collected(curriculum.digest(df))
    files = sorted(f for f in written["stream"].inputFiles() if "part-" in f)
    places = [[r["_position"] for r in spark.read.parquet(f).collect()] for f in files]
    assert len(files) > 1 and sum(places, []) == sorted(sum(places, []))
    assert len(sum(places, [])) == sum(r["copies"] for r in got) == curriculum.mix(df).count()
    # a stream that lost its second half takes less
    half = sorted(sum(places, []))[len(sum(places, [])) // 2]
    monkeypatch.setattr(curriculum, "materialize", lambda t, tag: whole(t.filter(f"_position < {half}") if tag == "stream" else t, tag))
    less = collected(curriculum.digest(df))
    assert len(less) == len(got) and 0 < sum(r["taken"] for r in less) < sum(r["taken"] for r in got)


def test_empty_tables(spark, docs):
    none = docs.filter("false")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    frames = [token_blocks.token_blocks(none, tokenizer("word_bpe_49k.json")), quality_rules.quality_rules(none), token_count.token_counts(none, tokenizer("byte_bpe_50k.json")), line_dedup.digest(none), line_dedup.dedup(none)]
    frames += [quality_fm.quality_classifier(none, labels), trie_bpe.digests(none, tokenizer("word_bpe_49k.json")), jaccard_join.components(none), curriculum.digest(none), curriculum.mix(none)]
    frames += [warc.archive(spark.createDataFrame([], "page_id long, url string, html string")), exact_topk.exact_topk(spark.createDataFrame([], "vec_id long, embedding array<float>"))]
    assert [f.count() for f in frames] == [0] * len(frames)
