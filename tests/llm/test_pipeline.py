"""The chained run of the corpus pipeline against a plain version of each stage, each on what the one before kept."""

import itertools
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from rasterloom.llm import curriculum, quality_fm
from rasterloom.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, source string, n_chars long, kept int, _doc string"


def corpus():
    rng = random.Random(4)
    words = [f"w{k}x{k * k % 97}" for k in range(300)]
    line = lambda n=12: " ".join(rng.choices(words, k=n))
    shared, texts = [line() for _ in range(5)], []
    for k in range(90):
        texts.append("\n".join([line() for _ in range(4)] + ([shared[k % 5]] if k % 3 else [])))
    texts += [" ".join(f"{w}###" for w in rng.choices(words, k=50)) for _ in range(50)]
    body = [line(40) for _ in range(4)]
    texts += [texts[0], texts[0], "\n".join(body), "\n".join([body[0].rsplit(" ", 1)[0] + " other", *body[1:]])]
    long = line(200).split()  # near copies whose lines differ: other breaks
    texts += [" ".join(long[:100]) + "\n" + " ".join(long[100:]), "\n".join(" ".join(long[k : k + 13]) for k in range(0, 200, 13))]
    rows = [(k, t, ["a", "b", None][k % 3], len(t), k, "x") for k, t in enumerate(texts)]
    rows += [(500, None, "a", None, 1, None), (501, "", "b", 0, 1, None), (502, " \n\t", None, 3, 1, None), (503, "many " * 3000, "a", 15000, 1, None), (None, line(30), "b", 5, 1, None)]
    return rows + [rows[4], rows[4]]


def scored(model, rows):
    """Scores with every pair of features multiplied out."""
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([r["doc_id"] for r in rows], pa.int64()), "text": pa.array([r["text"] for r in rows], pa.string()), "n_chars": pa.array([r["n_chars"] for r in rows], pa.int64())})
    out = []
    for x in quality_fm.features(batch):
        at = np.flatnonzero(x)
        pairs = sum(model.factors[i] @ model.factors[j] * x[i] * x[j] for i, j in itertools.combinations(at, 2))
        out.append(1 / (1 + np.exp(-(model.bias + x @ model.linear + pairs))))
    return out


def without_lines(rows):
    words = lambda line: set(line.split())
    first = {}
    known = [r for r in rows if r["doc_id"] is not None and r["text"] is not None]
    for r in known:
        for ln, line in enumerate(r["text"].split("\n")):
            if words(line):
                first[line] = min(first.get(line, (r["doc_id"], ln)), (r["doc_id"], ln))
    order = sorted(first, key=first.get)
    gone = {b for i, b in enumerate(order) if any(9 * len(words(a) & words(b)) >= 4 * (len(words(a)) + len(words(b))) for a in order[:i])}
    out = []
    for r in rows:
        if r in known:
            new = "\n".join(x for ln, x in enumerate(r["text"].split("\n")) if not words(x) or (first[x] == (r["doc_id"], ln) and x not in gone))
            if r["text"].split() and not new.split():
                continue
            r = r | {"text": new}
        out.append(r | {"n_chars": None if r["text"] is None else len(r["text"])})
    return out


def without_copies(rows):
    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    known = [(r["doc_id"], shingles(r["text"])) for r in rows if r["doc_id"] is not None]
    leader = {k: k for k, _ in known}
    for (a, s), (b, t) in itertools.combinations(known, 2):
        if s and t and 100 * len(s & t) >= 80 * len(s | t):
            low, high = sorted((leader[a], leader[b]))
            leader = {k: low if v == high else v for k, v in leader.items()}
    return [r for r in rows if r["doc_id"] is None or leader[r["doc_id"]] == r["doc_id"]]


def mixed(rows):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r["doc_id"] for r in rows], pa.int64()), "text": pa.array([r["text"] for r in rows], pa.string()), "source": pa.array([r["source"] for r in rows], pa.string())}))
    return {k: n for k, n in con.execute(f"SELECT doc_id, sum(copies) FROM ({curriculum.ORACLE}) GROUP BY doc_id").fetchall()}


def same_rows(got, want):
    key = lambda r: repr(sorted(r.items()))
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_pipeline(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(k, 0 if 90 <= k < 140 else 1) for k in range(140)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = quality_fm.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    dicts = [r.asDict() for r in docs.collect()]
    stages, kept = dict(corpus_pipeline.STAGES), {}
    kept["quality"] = [r for r, s in zip(dicts, scored(model, dicts), strict=True) if s >= corpus_pipeline.QUALITY]
    kept["lines"] = without_lines(kept["quality"])
    kept["near_duplicates"] = without_copies(kept["lines"])
    before = docs
    for name in ("quality", "lines", "near_duplicates"):
        got = stages[name](spark, before, str(tmp_path))
        assert got.columns == docs.columns
        same_rows([r.asDict() for r in got.collect()], kept[name])
        before = spark.createDataFrame([tuple(r.values()) for r in kept[name]], docs.schema)
    held = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    left = {r["doc_id"] for r in kept["quality"]}
    assert all((k in left) == (k < 90) for k in held)
    assert 90 < len(kept["near_duplicates"]) < len(kept["lines"]) < len(kept["quality"]) < len(rows)
    t = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in kept["near_duplicates"]}
    assert len(texts) == len({(r["doc_id"], r["text"]) for r in kept["near_duplicates"]})
    want = {k: (n, tuple(t.encode(texts[k] or "", add_special_tokens=False).ids)) for k, n in mixed(kept["near_duplicates"]).items() if n}
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        ids = tuple(r["ids"])
        n, before = got.get(r["doc_id"], (0, ids))
        assert before == ids
        got[r["doc_id"]] = (n + 1, ids)
    assert got == want


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
