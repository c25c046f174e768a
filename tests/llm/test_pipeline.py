import corpus_pipeline
from cases import EDGE, LONG, frame, prose
from pyspark.sql import functions as F


def test_stages_take_effect(spark, tmp_path):
    item = "rare zanzibar words that only the benchmark has quux plugh xyzzy frobnicate and so on for it"
    passage = "\n".join(f"passage line {i} of ten words that repeats in many documents" for i in range(8))
    near = prose(31, 300).split()
    rows = [
        *[x for x in EDGE if x[1] != LONG and x[0] is not None and x[0] != 7],
        (20, "Intro. " + item + " " + prose(20, 60)),
        (21, "own start 21\n" + passage),
        (22, "own start 22\n" + passage),
        (23, "own start 23\n" + passage),
        (30, " ".join(near)),
        (31, " ".join([*near[:150], "changed", *near[151:]])),
        (40, prose(40, 100)),
        (41, "12345 67 !"),
    ]
    docs = frame(spark, rows, clash=False)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, now = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        if i < 4:
            assert now.columns == docs.columns
        kept[name] = {r.doc_id: r for r in now.collect()}
        now = spark.createDataFrame(list(kept[name].values()), now.schema)
    assert {1, 2, 3, 41}.isdisjoint(kept["language_id"]) and {4, 5, 20, 40} <= set(kept["language_id"])
    assert "passage line" in kept["line_dedup"][21].text
    assert kept["line_dedup"][22].text == "own start 22" and kept["line_dedup"][22].n_chars == 12
    assert 31 not in kept["ngram_jaccard"] and 30 in kept["ngram_jaccard"]
    assert 20 in kept["ngram_jaccard"] and 20 not in kept["decontamination"] and 40 in kept["decontamination"]
    assert set(kept["byte_bpe"]) == set(kept["decontamination"])
    whole = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {i: r.n_tokens for i, r in kept["byte_bpe"].items()}


def test_no_documents(spark, tmp_path):
    frame(spark, [], clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_without_id_repeated_rows_and_clashing_columns(spark, tmp_path):
    text = prose(31, 300)
    rows = [(1, text), (1, text), (1, prose(32, 80)), (None, text), (None, prose(33, 90)), (None, prose(33, 90)), (2, text + " more"), (3, None), (3, None), (4, "")]
    docs = frame(spark, rows).withColumn("emptied", F.lit("mine")).withColumn("n_deleted", F.lit(-5)).withColumn("n_lines", F.lit(None).cast("double"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    one = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert one.schema == docs.schema
    kept = sorted(((r.doc_id is None, r.doc_id or 0, len(r.text or "")) for r in one.collect()))
    assert kept[0][:2] == (False, 1) and kept[1:] == [(False, 3, 0), (False, 4, 0), (True, 0, len(prose(33, 90)))]
    lines = corpus_pipeline.drop_repeated_lines(spark, docs, "")
    assert lines.schema == docs.schema and {(r.emptied, r.n_deleted, r.n_lines) for r in lines.collect()} == {("mine", -5, None)}
    assert corpus_pipeline.keep_languages(spark, docs, "").schema == docs.schema
    spark.createDataFrame([(None, "x"), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).count() == len(rows)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_texts_in_no_language_learned_go(spark):
    known = [(i, prose(i, 60)) for i in range(60)]
    other = [(100, "Ο ήλιος λάμπει πάνω από τη θάλασσα και τα νησιά " * 4), (101, "zxq vwk jqz xkv " * 30), (102, "Ab"), (103, "the")]
    kept = {r.doc_id for r in corpus_pipeline.keep_languages(spark, frame(spark, known + other[:0]).unionByName(frame(spark, other).withColumn("lang", F.lit(None).cast("string"))), "").collect()}
    assert kept == {*range(60), 102, 103}
