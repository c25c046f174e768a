"""Line dedup over whole corpora by a suffix array of line ids.

Lines are named by two 64-bit hashes.  Only lines that occur twice or more can
be part of a repeated run, so documents fall into segments of such lines, and
segments of too few words go.  Distributed prefix doubling ranks the suffixes
of what is left: the rank of 2m lines is the sorted rank of the pair (rank of m
lines, rank of the next m), where ranks come from a range-partitioned sort of
the distinct pairs, so they follow suffix order and equal prefixes share one.

All suffixes that share their first m lines form an interval of the suffix
array whose longest common prefix is m or more; the ranks of the first and of
the last power of two lines in the window name it.  A run counts when it has
``min_words`` words.  From each line the shortest such window onwards and
backwards is taken: the windows that recur cover exactly the maximal repeated
runs.  Doubling thus ends at the longest window, min_words lines at most,
whatever the length of the copies.  The first window of an interval stays whole,
by (doc_id, line); the lines of the others are deleted, but for those that a
copy which overlaps the first one shares with it.  Frequent lines and ranks are
joined apart from the others.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectrove.llm._common import materialize, release, table, text_or_empty
from vectrove.llm._exchange import split_join

#: Words from which a repeated run counts; edits (documents to change) up to which their table is broadcast, and ranges up to which.
MIN_WORDS, BROADCAST_DOCS, BROADCAST_RANGES = 50, 1 << 19, 1 << 21


def _word_lines(docs: DataFrame) -> DataFrame:
    """A row per line that has a word: doc_id, th (hash of the text), seq (place among such lines), pos (place among all), nw, h1, h2."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("line"), i.alias("pos"))), lambda s: s["line"].rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(lines).alias("seq", "x"))
    line = F.col("x.line")
    return rows.select("doc_id", "th", "seq", F.col("x.pos").alias("pos"), F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")).alias("nw"), F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


def _ranked(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(ka, kb, n, rank): ranks grow in the order of the distinct pairs; they need not be dense."""
    distinct = pairs.groupBy(F.col(a).alias("ka"), F.col(b).alias("kb")).agg(F.count("*").alias("n"))
    return distinct.repartitionByRange("ka", "kb").sortWithinPartitions("ka", "kb").withColumn("rank", F.monotonically_increasing_id())


def _windows(levels: int, min_words: int):
    """Of each segment (its lines in order): windows to compare, named by level ranks."""
    names = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("seq", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("m", pa.int32()), ("ra", pa.int64()), ("rb", pa.int64())])

    def run(batches):
        for batch in batches:
            out = {f.name: [] for f in names}
            for doc_id, th, lines in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = [x["nw"] for x in lines]
                spans, end, total = set(), 0, 0
                for start in range(len(words)):  # the shortest window onwards
                    while end < len(words) and total < min_words:
                        total += words[end]
                        end += 1
                    if total >= min_words:
                        spans.add((start, end))
                    total -= words[start]
                start = len(words)
                total = 0
                for end in range(len(words), 0, -1):  # and backwards
                    while start > 0 and total < min_words:
                        start -= 1
                        total += words[start]
                    if total >= min_words:
                        spans.add((start, end))
                    total -= words[end - 1]
                for start, end in spans:
                    m = end - start
                    k = m.bit_length() - 1
                    x = (doc_id, th, lines[start]["seq"], lines[start]["pos"], lines[end - 1]["pos"], m, lines[start][f"r{k}"], lines[end - (1 << k)][f"r{k}"])
                    for name, value in zip(out, x):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=names)

    return run


def repeated_line_runs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, th, ranges: per document the line ranges (first, last, counted from
    0, both included, merged) that repeat an earlier run of ``min_words`` words,
    beyond the end of that run.

    th is xxhash64 of the text; a document is the pair (doc_id, th).  Order is
    by doc_id (null first), th, line, so there are no ties.  A run may repeat an
    earlier one of its own document.  Lines without a word do not count and go
    with the run they stand in.  Null and empty texts have no lines; repeated
    rows are one document; texts are read whole, a document's repeated lines in
    one row; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    lines = _word_lines(rows)
    twice = materialize(lines.groupBy(F.col("h1").alias("g1"), F.col("h2").alias("g2")).agg(F.count("*").alias("n")).where("n > 1"), "lines-twice")
    total = twice.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Equal rows of the input are one document.
    again = split_join(lines, twice, [("h1", "g1"), ("h2", "g2")], "n", total).drop("g1", "g2", "n").dropDuplicates(["doc_id", "th", "seq"])
    own = Window.partitionBy("doc_id", "th")
    again = again.withColumn("seg", F.col("seq") - F.row_number().over(own.orderBy("seq")))
    again = again.withColumn("words", F.sum("nw").over(Window.partitionBy("doc_id", "th", "seg"))).where(F.col("words") >= min_words).drop("words")
    now = materialize(again, "lines-repeated")
    release(twice)
    total = now.count()
    ordered = Window.partitionBy("doc_id", "th", "seg").orderBy("seq")
    # The longest window that is taken: lines from one on until they have min_words words (backwards it may take one more).
    onwards = F.collect_list("nw").over(ordered.rowsBetween(0, min_words - 1))
    start = F.struct(F.lit(0).alias("w"), F.lit(0).alias("m"))
    need = F.aggregate("ahead", start, lambda s, x: F.when(s["w"] < min_words, F.struct((s["w"] + x).alias("w"), (s["m"] + 1).alias("m"))).otherwise(s), lambda s: s["m"])
    longest = now.select(onwards.alias("ahead")).agg(F.max(need)).first()[0] or 1
    levels = (int(longest) + 1).bit_length()
    ranks = _ranked(now, "h1", "h2")
    ranks = materialize(ranks, "lines-rank-table")
    level = materialize(split_join(now, ranks, [("h1", "ka"), ("h2", "kb")], "n", total).select("doc_id", "th", "seg", "seq", "pos", "nw", F.col("rank").alias("r0")), "lines-rank0")
    release(now, ranks)
    for k in range(1, levels):
        paired = level.withColumn("next", F.coalesce(F.lead(f"r{k - 1}", 1 << (k - 1)).over(ordered), F.lit(-1).cast("long")))
        paired = materialize(paired, "lines-pairs")
        release(level)
        ranks = materialize(_ranked(paired, f"r{k - 1}", "next"), "lines-rank-table")
        joined = split_join(paired, ranks, [(f"r{k - 1}", "ka"), ("next", "kb")], "n", total)
        level = materialize(joined.select("doc_id", "th", "seg", "seq", "pos", "nw", *(f"r{i}" for i in range(k)), F.col("rank").alias(f"r{k}")), "lines-ranks")
        release(paired, ranks)
    fields = ["seq", "pos", "nw", *(f"r{i}" for i in range(levels))]
    segments = level.groupBy("doc_id", "th", "seg").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("lines")).select("doc_id", "th", "lines")
    windows = materialize(segments.mapInArrow(_windows(levels, min_words), "doc_id long, th long, seq int, first int, last int, m int, ra long, rb long"), "lines-windows")
    release(level)
    intervals = windows.groupBy(F.col("m").alias("im"), F.col("ra").alias("ia"), F.col("rb").alias("ib")).agg(F.min(F.struct("doc_id", "th", "seq", "last")).alias("kept"), F.count("*").alias("n")).where("n > 1")
    intervals = materialize(intervals, "lines-intervals")
    shared = split_join(windows, intervals, [("m", "im"), ("ra", "ia"), ("rb", "ib")], "n", windows.count())
    # A copy that overlaps the window that stays loses what goes beyond it.
    own = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("th") == F.col("kept.th"))
    later = shared.where(~(own & (F.col("seq") == F.col("kept.seq")))).withColumn("first", F.when(own, F.greatest("first", F.col("kept.last") + 1)).otherwise(F.col("first")))
    found = later.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("ranges"))
    runs = materialize(found.mapInArrow(_merged, "doc_id long, th long, ranges array<struct<first:int,last:int>>"), "lines-runs")
    release(windows, intervals)
    return runs


def _merged(batches):
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    for batch in batches:
        every = []
        for ranges in batch.column(2).to_pylist():
            out = []
            for r in ranges:
                if out and r["first"] <= out[-1]["last"] + 1:
                    out[-1]["last"] = max(out[-1]["last"], r["last"])
                else:
                    out.append(dict(r))
            every.append(out)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(every, kind)], names=["doc_id", "th", "ranges"])


def line_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_words: int = MIN_WORDS, out: tuple[str, str, str] = ("n_lines", "n_deleted", "emptied")) -> DataFrame:
    """``docs`` with the text's later copies of repeated runs deleted, plus
    n_lines, n_deleted (lines) and emptied (no line with a word is left of some),
    named by ``out``.

    Every row comes back, repeated ones alike.  A null text stays null, with no
    lines; null ids come first.  Columns of ``docs`` named like an added one are
    replaced.
    """
    n_lines, n_deleted, emptied = out
    runs = repeated_line_runs(docs, text_col, id_col, min_words)
    size = runs.agg(F.count("*"), F.coalesce(F.sum(F.size("ranges")), F.lit(0))).first()
    edits = runs.select(F.col("doc_id").alias("__id"), F.col("th").alias("__edit_th"), F.col("ranges").alias("__ranges"))
    edits = F.broadcast(edits) if size[0] <= BROADCAST_DOCS and size[1] <= BROADCAST_RANGES else edits.hint("shuffle_hash")
    rows = docs.drop(*(c for c in out if c not in (text_col, id_col)))
    rows = rows.withColumn("__th", F.xxhash64(text_or_empty(text_col)))
    rows = rows.join(edits, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__edit_th")), "left")
    rows = rows.withColumn("__lines", F.split(text_or_empty(text_col), "\n"))
    left = F.filter("__lines", lambda x, i: ~F.exists("__ranges", lambda r: (i >= r["first"]) & (i <= r["last"])))
    rows = rows.withColumn("__left", F.when(F.col("__ranges").isNull(), F.col("__lines")).otherwise(left))
    text = F.when(F.col("__ranges").isNull(), F.col(text_col)).otherwise(F.array_join("__left", "\n"))
    number = F.when(text_or_empty(text_col) == "", F.lit(0)).otherwise(F.size("__lines"))
    made = rows.withColumn(n_lines, number.cast("long")).withColumn(n_deleted, (F.size("__lines") - F.size("__left")).cast("long"))
    made = made.withColumn(emptied, F.col("__ranges").isNotNull() & ~F.exists("__left", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return made.withColumn(text_col, text).drop("__id", "__edit_th", "__ranges", "__th", "__lines", "__left")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without later copies of repeated runs, n_lines, n_deleted, emptied."""
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
