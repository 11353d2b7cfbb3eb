"""Operator 3: quality rules. A table of thresholds is compiled into one projection of built-in functions.

RULES is data: (name, measure, low, high); a text passes a rule if its measure lies within the bounds that are given. The
measures are length, symbol, stop-word and line ratios; compile_rules() turns the table into one Column, so all rules are
evaluated in one pass over a text, inside the JVM, without shuffle.

Words are `[^\\x20\\x09-\\x0D]+`. A null or empty text has no words, fails the base rule, and isn't kept. Repeated rows give
repeated rows; other columns are ignored or passed on by the caller; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import SPACE_CLASS, SPACES, let

SYMBOLS = "#*$%&|<>"

# Common words of the four languages.
STOP_WORDS = "the and of to in a is that it for on with as was by this be are from at or an un une le la les de des du et en que qui dans pour par sur pas est au el los las y una por con para se del al lo der die das und ist von zu mit den dem ein eine im auf für nicht sich als auch".split()

#: (name, measure, lowest, highest): None where a side is open.
RULES: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("mean_word_length", "word_chars / n_words", 1.5, 14.0),
    ("symbol_ratio", "n_symbols / n_words", None, 0.3),
    ("upper_ratio", "n_upper / word_chars", None, 0.5),
    ("stop_word_ratio", "n_stop / n_words", 0.02, None),
    ("repeat_ratio", "n_repeat_words / n_words", None, 0.3),
    ("duplicate_line_ratio", "n_dup_lines / n_lines", None, 0.5),
)


def measures(text: Column) -> dict[str, Column]:
    """Columns in the order in which they build on each other; to be added one level after another."""
    return {
        "_text": F.coalesce(text.cast("string"), F.lit("")),
        "_trim": F.btrim(F.col("_text"), F.lit(SPACES)),
        "_words": F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split(F.col("_trim"), SPACE_CLASS)),
        "_lines": F.filter(F.split(F.col("_text"), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""),
        "n_words": F.size("_words").cast("long"),
        "_windows": F.when(
            F.col("n_words") >= 3,
            F.transform(F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")), lambda i: F.concat_ws(" ", F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))),
        ).otherwise(F.array().cast("array<string>")),
        "n_repeat_words": F.when(F.size(F.array_distinct("_windows")) == F.size("_windows"), F.lit(0)).otherwise(covered(F.col("_windows"))).cast("long"),
        "word_chars": F.char_length(F.translate("_text", SPACES, "")).cast("long"),
        "n_symbols": (F.char_length("_text") - F.char_length(F.translate("_text", SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_upper": (F.char_length("_text") - F.char_length(F.translate("_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"),
        "n_stop": F.size(F.filter("_words", lambda w: w.isin(STOP_WORDS))).cast("long"),
    }


def covered(windows: Column) -> Column:
    """How many words lie in a window that stands in the text twice or more: sorted windows meet their copies."""

    def own(s: Column) -> Column:
        twins = F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["w"] == x["w"]) | (F.get(s, k + 1)["w"] == x["w"]), x["i"]))
        # each window covers three words, less what the one before covers too
        return F.aggregate(
            F.sort_array(F.filter(twins, lambda i: i.isNotNull())),
            F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )

    return let(F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))), own)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def compile_rules(rules=RULES) -> Column:
    """One Column that is true if every rule of the table holds; a measure with a zero divisor holds."""
    out = F.lit(True)
    for _, measure, low, high in rules:
        top, bottom = (F.col(x.strip()) for x in measure.split("/"))
        ratio = F.try_divide(top.cast("double"), bottom.cast("double"))
        for bound, ok in ((low, ratio >= low if low is not None else None), (high, ratio <= high if high is not None else None)):
            if bound is not None:
                out = out & F.coalesce(ok, F.lit(True))
    return out


def quality_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of each row of docs(doc_id, text)."""
    out = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    for name, column in measures(F.col("text")).items():
        out = out.withColumn(name, column)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & compile_rules(rules)).alias("kept"),
    )


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, ws, CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) ELSE [] END AS gs FROM w),
x AS (SELECT doc_id, unnest(gs) AS gram, unnest(range(len(gs))) AS i FROM g),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM x) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM d, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
  length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
  len(ls) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
  len(list_filter(ws, lambda x: x IN (STOPS))) AS n_stop FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND RULES AS kept FROM b
"""


def oracle_sql(rules=RULES) -> str:
    """The same table of thresholds as DuckDB SQL."""
    parts = []
    for _, measure, low, high in rules:
        top, bottom = (x.strip() for x in measure.split("/"))
        ratio = f"{top}::DOUBLE / nullif({bottom}, 0)::DOUBLE"
        parts += [f"coalesce({ratio} {op} {bound}::DOUBLE, true)" for op, bound in ((">=", low), ("<=", high)) if bound is not None]
    return ORACLE.replace("STOPS", ", ".join(f"'{w}'" for w in STOP_WORDS)).replace("RULES", " AND ".join(parts) or "true")
