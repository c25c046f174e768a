import math
from collections import Counter

import pytest
from cases import EDGE, frame
from pyspark.sql import functions as F

from vectrove.llm.lm_score import PRIOR, mark_targets, op7_lm_score, score_counted_texts


def brute(rows, good):
    """(doc_id, n_tokens, losses rounded) by plain counting of words and pairs."""
    texts = [(i, (t or "").encode().lower().split()) for i, t in rows]
    sides = []
    for keep in (lambda i: i in good, lambda i: i not in good):
        words, pairs = Counter(), Counter()
        for i, w in texts:
            if keep(i):
                words.update(w)
                pairs.update(zip(w, w[1:]))
        sides.append((words, pairs))
    vocabulary, out = len({x for _, w in texts for x in w}), []
    for i, w in texts:
        row = [i, len(w)]
        for words, pairs in sides:
            total = sum(words.values())
            p = lambda b: (words[b] + 1) / (total + vocabulary)
            loss = [-math.log(p(b)) if a is None else -math.log((pairs[a, b] + PRIOR * p(b)) / (words[a] + PRIOR)) for a, b in zip([None, *w], w)]
            row.append(round(sum(loss) / len(loss), 9) if loss else None)
        out.append(tuple(row))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_tokens, *(None if x is None else round(x, 9) for x in (r.target_loss, r.background_loss))) for r in df.collect()), key=repr)


ROWS = [r for r in EDGE if len(r[1] or "") < 10_000] + [(100 + i, " ".join(f"w{i * 7 + j % 40}" for j in range(60))) for i in range(40)]
GOOD = {6, 7, 9, *range(100, 140, 3)}


def test_op7_counts_exactly(spark, tmp_path):
    frame(spark, ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in GOOD] + [(4, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert found(op7_lm_score(spark, str(tmp_path))) == brute(ROWS, GOOD)


@pytest.mark.parametrize("parts, chunk_tokens", [(1, 1 << 20), (5, 50), (3, 1)])
def test_chunks_and_parts_change_nothing(spark, parts, chunk_tokens):
    docs = mark_targets(frame(spark, ROWS), spark.createDataFrame([(i,) for i in GOOD], "id long"))
    assert found(score_counted_texts(docs, parts=parts, chunk_tokens=chunk_tokens)) == brute(ROWS, GOOD)


def test_no_rows(spark):
    assert score_counted_texts(frame(spark, []).withColumn("__target", F.lit(True))).count() == 0
