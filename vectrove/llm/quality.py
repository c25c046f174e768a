"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Every rule is a Column that is true where a text fails it.  On a bounded sample
(``sample_rows`` rows, used for the order alone) each rule is timed from the raw
text and its rejections are counted; rules then run in the order of rejections
per second, and a ``CASE`` stops at the first one that rejects a text.  Features
that are reported are computed for every text; those of a single rule only where
no rule before it has rejected the text.  The order never changes a verdict, only
what it costs.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrove.llm._common import WORD_SPACES, table, text_or_empty

SYMBOLS = "#*$%&|<>"
#: Rows of the sample that decides the order, and runs of each rule over it.
SAMPLE_ROWS, REPEATS = 500, 2


@dataclass(frozen=True)
class Rule:
    """``fails`` reads the feature columns and __text; null counts as passing."""

    name: str
    fails: Column


def default_rules() -> list[Rule]:
    """The base rules first; the others are wide enough to leave ordinary prose alone."""
    n = F.col("n_words")
    return [
        Rule("too_few_words", n < 50),
        Rule("repeated_words", 100 * F.col("n_repeat_words") > 50 * n),
        Rule("symbols", 10 * F.col("n_symbols") > 3 * n),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n)),
        Rule("duplicate_lines", 10 * F.col("n_dup_lines") > 5 * F.col("__n_lines")),
        Rule("few_letters", 2 * F.length(F.regexp_replace("__text", r"[^\p{L}]+", "")) < F.col("word_chars")),
        Rule("digits", 2 * F.length(F.regexp_replace("__text", "[^0-9]+", "")) > F.col("word_chars")),
        Rule("capitals", 10 * F.length(F.regexp_replace("__text", "[^A-Z]+", "")) > 8 * F.col("word_chars")),
    ]


BASE_RULES = ("too_few_words", "repeated_words")


def quality_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Adds the helper columns __text and __n_lines.  A null text counts as empty.
    Windows of three words are compared by 64-bit hash inside one text.
    """
    split = docs.withColumn("__text", text_or_empty(text_col))
    split = split.withColumn("__w", F.array_remove(F.split("__text", r"[\x20\x09-\x0D]+"), ""))
    split = split.withColumn("__l", F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    split = split.withColumn("n_words", F.size("__w").cast("long")).withColumn("__n_lines", F.size("__l").cast("long"))
    hashed = split.withColumn(
        "__h",
        F.when(F.col("n_words") < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("__w") - 2)), lambda i: F.xxhash64(F.get("__w", i - 1), F.get("__w", i), F.get("__w", i + 1)))
        ),
    )
    # Starts of windows that occur twice or more, in order: sort by (hash, place), keep what equals a neighbour, sort by place.
    placed = hashed.withColumn(
        "__s",
        F.when(F.size(F.array_distinct("__h")) == F.size("__h"), F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(
            F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        ),
    )
    starts = placed.withColumn(
        "__p",
        F.sort_array(
            F.filter(
                F.transform("__s", lambda s, j: F.when((F.get("__s", j - 1)["h"] == s["h"]) | (F.get("__s", j + 1)["h"] == s["h"]), s["i"])),
                lambda x: x.isNotNull(),
            )
        ),
    )
    # A window covers three words, of which the next one may cover some again.
    covered = F.aggregate(
        F.transform("__p", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("__p", j + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    out = (
        starts.withColumn("word_chars", F.length(F.translate("__text", WORD_SPACES, "")).cast("long"))
        .withColumn("n_symbols", (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
        .withColumn("n_repeat_words", covered)
    )
    return out.drop("__w", "__l", "__h", "__s", "__p")


def order_rules(docs: DataFrame, rules: list[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS, repeats: int = REPEATS) -> list[Rule]:
    """Rules by rejections per second on the first ``sample_rows`` rows, most first.

    Each rule is run from the raw text, with the features that it alone needs, and
    brings back a boolean a row; Spark reads partition after partition only until
    it has the rows.  Its cost is the least of some runs, less that of reading the
    rows.  Ties keep the order given.
    """
    raw = docs.select(F.col(text_col).alias("text"))

    def timed(rows: DataFrame) -> tuple[float, int]:
        took = []
        for _ in range(repeats):
            began = time.perf_counter()
            rejected = sum(r[0] for r in rows.limit(sample_rows).collect())
            took.append(time.perf_counter() - began)
        return min(took), rejected

    read, found = timed(raw.select((F.length("text") >= 0).cast("int").alias("x")).select(F.coalesce("x", F.lit(0))))
    if not found:
        return rules
    features, gain = quality_features(raw), []
    for rule in rules:
        took, rejected = timed(features.select(F.coalesce(rule.fails, F.lit(False)).cast("int")))
        gain.append(rejected / max(took - read, 1e-3))
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: -gain[i])]


def quality_cascade(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` plus the features, ``failed_rule`` (the first that rejected the
    row; null if none did), ``base_failed`` and ``kept``.

    Every row comes back, repeated ones and null ids included.  A null or empty
    text has no words and fails; texts are read whole.  Columns of ``docs`` named
    like an added one are replaced.  Ties in the order of rules keep that given.
    """
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed_rule", "base_failed", "kept")
    features = quality_features(docs.drop(*(c for c in added if c != text_col)), text_col)
    rules = rules or default_rules()
    ordered = order_rules(docs, rules, text_col, sample_rows)
    cascade = F.when(F.coalesce(ordered[0].fails, F.lit(False)), F.lit(ordered[0].name))
    for rule in ordered[1:]:
        cascade = cascade.when(F.coalesce(rule.fails, F.lit(False)), F.lit(rule.name))
    base = F.lit(False)
    for rule in rules:
        if rule.name in BASE_RULES:
            base = base | F.coalesce(rule.fails, F.lit(False))
    return features.withColumn("failed_rule", cascade).withColumn("base_failed", base).withColumn("kept", F.col("failed_rule").isNull()).drop("__text", "__n_lines")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the counts, base_failed and the cascade's verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_cascade(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, ROW_NUMBER() OVER () AS rid FROM documents),
s AS (
  SELECT doc_id, rid, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM s WHERE len(w) >= 3),
k AS (SELECT rid, i, COUNT(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM g),
c AS (SELECT rid, COUNT(DISTINCT i + o) AS n FROM k, (VALUES (0), (1), (2)) AS v(o) WHERE k.n > 1 GROUP BY rid),
f AS (
  SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         len(l) AS n_lines, length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS letters,
         length(regexp_replace(t, '[^0-9]+', '', 'g')) AS digits, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS capitals
  FROM s LEFT JOIN c USING (rid)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 10 * n_dup_lines > 5 * n_lines OR 2 * letters < word_chars OR 2 * digits > word_chars OR 10 * capitals > 8 * word_chars) AS kept
FROM b
"""
