"""The corpus pipeline: five stages from raw documents to encoded ones.

Each stage gets what its predecessor kept, written as Parquet and read again.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectrove.llm._common import materialize, release, sized, table
from vectrove.llm.bpe import bpe_encode
from vectrove.llm.decontaminate import decontaminate
from vectrove.llm.jaccard_join import ngram_jaccard_join
from vectrove.llm.language import DIM, UNDETERMINED, fit_language_profiles, identify_language
from vectrove.llm.line_dedup import line_dedup

#: A text is in a language learned if its cosine reaches this share of what a text of its length is expected to have, less so many standard deviations of the noise of random vectors.
LANGUAGE_SHARE, LANGUAGE_NOISE = 0.3, 3.0
#: Stands for a missing id, above all others; the text's hash goes into the lower bits.
NO_ID = 1 << 62


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: texts without a letter (null and empty ones too), and texts like none of the languages, go.

    The cut is one formula of a text's length; for a word or two it is below 0,
    as so few letters tell nothing.  Profiles are learned from all rows with a
    language, those that are then judged included.  Ids play no part, repeated
    rows fare alike, and columns may have any name that does not begin with two
    underscores, here and in the stages below.
    """
    model = fit_language_profiles(docs)
    columns = docs.columns
    told = identify_language(docs, model, keep=tuple(columns), out=("__lang", "__score", "__expected"))
    alike = F.col("__score") >= LANGUAGE_SHARE * F.col("__expected") - LANGUAGE_NOISE / DIM**0.5
    return told.where((F.col("__lang") != UNDETERMINED) & alike).select(*columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: later copies of runs of 50 words or more are cut out; documents of which nothing is left go.

    Order is by doc_id, null first, so ties do not arise; rows of one id and
    text are one document here, which all of them keep or lose alike.  Null and
    empty texts stay.  n_chars follows the text where it has changed.
    """
    cut = line_dedup(docs, out=("__n_lines", "__n_deleted", "__emptied")).where(~F.col("__emptied"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("__n_deleted") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (five words, similarity of 0.8): one document of each group stays, that with the smallest id.

    Rows without id come after all others, by a hash of their text.  Of rows
    that share an id, which are one document to the join, the one with the
    smallest hash of its text stays.  Null and empty texts are in no group: all
    of them stay, but for rows that share an id.
    """
    named = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(NO_ID - 1).bitwiseOR(NO_ID))
    rows = docs.withColumn("__id", named)
    groups = ngram_jaccard_join(rows, id_col="__id", k=5, num=8, den=10)
    gone = materialize(groups.where("component_id < __id").select(F.col("__id").alias("__gone")).distinct(), "pipeline-gone")
    kept = rows.join(sized(gone), F.col("__id") == F.col("__gone"), "left_anti")
    again = materialize(kept.groupBy(F.col("__id").alias("__again")).agg(F.count("*").alias("__n")).where("__n > 1").select("__again"), "pipeline-again")
    if again.limit(1).count():
        first = Window.partitionBy("__id").orderBy(F.xxhash64("text"), *(c for c in docs.columns if c != "text"))
        same = F.col("__id") == F.col("__again")
        one = kept.join(sized(again), same, "left_semi").withColumn("__row", F.row_number().over(first)).where("__row = 1").drop("__row")
        kept = kept.join(sized(again), same, "left_anti").unionByName(one)
    return kept.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item go.

    Null and empty texts hold none; each row is judged by itself, so ids may be
    null or repeat.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: doc_id, n_tokens and digests of the ids and of the bytes decoded from them, a row for each row."""
    return bpe_encode(docs, digests=True)


STAGES = [
    ("language_id", keep_languages),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: Language profiles, edit-distance LSH and BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    last = None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            release(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
