"""Rows that every operator has to bear, and frames of them."""

import random

WORDS = "the of and to in is it you that he was for on are with as his they be at one have this from or had by hot but some what".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))


LONG = prose(99, 40_000)
EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Two words"), (6, prose(6, 300)), (7, prose(6, 300)), (7, prose(6, 300)), (8, LONG),
    (None, prose(8, 80)), (None, None), (9, "日本語 текст émoji 👍🏽 <|endoftext|> x"), (10, prose(6, 299) + " changed"),
]

#: Columns of the input that clash with what operators add.
CLASH = "n_tokens long, n_bytes long, kept string, score string, lang_pred int, component_id string, n_shingles int, n_words string, spans int, base string, emptied int, n_lines string, start int, ids string, rank int"


def frame(spark, rows, clash=True):
    extra = ([None] * len(CLASH.split(","))) if clash else []
    schema = "doc_id long, text string, lang string, source string, n_chars long" + (", " + CLASH if clash else "")
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *extra) for i, t in rows], schema)
