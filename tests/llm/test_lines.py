import random
import re

from cases import EDGE, LONG, frame

from vectrove.llm.line_dedup import line_dedup

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute(rows, min_words):
    """Every window of lines with min_words words that occurs before, (doc_id, line) first, goes, but for what it shares with the first one."""
    every = sorted({(i, t or "") for i, t in rows}, key=lambda x: (x[0] is not None, x[0] or 0))
    first, gone = {}, {}
    for i, t in every:
        lines = t.split("\n")
        seq = [(p, x, len(WORD.findall(x))) for p, x in enumerate(lines) if WORD.search(x)]
        cut = gone.setdefault((i, t), set())
        for a in range(len(seq)):
            n = 0
            for b in range(a, len(seq)):
                n += seq[b][2]
                if n >= min_words:
                    key = tuple(x for _, x, _ in seq[a : b + 1])
                    kept = first.setdefault(key, (i, t, a, seq[b][0]))
                    if kept[:3] != (i, t, a):
                        cut.update(range(max(seq[a][0], kept[3] + 1 if kept[:2] == (i, t) else 0), seq[b][0] + 1))
    return {k: "\n".join(x for p, x in enumerate(k[1].split("\n")) if p not in v) for k, v in gone.items()}


def compare(spark, rows, min_words):
    want = brute(rows, min_words)
    got = line_dedup(frame(spark, rows).withColumnRenamed("source", "before").drop("before"), min_words=min_words).collect()
    assert len(got) == len(rows)
    left = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got))
    assert left == sorted((i is None, i or 0, want[i, t or ""]) for i, t in rows)
    return got


def test_random_lines_against_brute_force(spark):
    r = random.Random(1)
    pool = [" ".join(r.choice("abcdefg") for _ in range(r.randint(1, 5))) for _ in range(12)]
    for seed in range(2):
        r = random.Random(seed)
        rows = [(i, "\n".join(r.choice([*pool, "", "  ", f"own {i} {r.random()}"]) for _ in range(r.randint(0, 30)))) for i in range(40)]
        compare(spark, rows, 9)


def test_long_copies_and_self_repeats(spark):
    block = "\n".join(f"line number {i} of it" for i in range(150))
    rows = [(1, block), (2, "before\n" + block + "\nafter"), (3, block), (3, block), (4, "same line here\n" * 40), (None, block)]
    got = compare(spark, rows, 50)
    assert {r.doc_id: r.emptied for r in got} == {None: False, 1: True, 2: False, 3: True, 4: False}


def test_the_first_of_overlapping_copies_stays_whole(spark):
    same, pair, other = "five words in a line\n" * 40, "one two three\nfour five six seven\n" * 30, "\n".join(f"line {i} of the repeated block" for i in range(20))
    got = {r.doc_id: r.text for r in compare(spark, [(1, same), (2, pair), (3, "\n".join([other] * 3)), (4, "start\n" + same)], 50)}
    assert len(WORD.findall(got[1])) == 50 and len(WORD.findall(got[2])) >= 50 and got[3].startswith(other) and got[4].strip() == "start"


def test_frequent_lines_and_clashing_columns(spark):
    rows = [(i, f"the line of all\n\nown {i}\nthe line of all") for i in range(300)] + [(i, "the line of all\n" * 60) for i in range(300, 306)]
    compare(spark, rows, 50)
    named = frame(spark, [(1, "a\nb"), (1, "a\nb")], clash=False).selectExpr("doc_id", "text", "7 as n_lines", "'x' as emptied")
    assert [(r.n_lines, r.emptied, r.b) for r in line_dedup(named, out=("a", "b", "c")).collect()] == [(7, "x", 0)] * 2


def test_edges(spark):
    # The brute force is quadratic in a document's lines; the long text is checked apart.
    compare(spark, [x for x in EDGE if x[1] != LONG], 50)
    assert sorted(r.n_deleted for r in line_dedup(frame(spark, [(1, LONG), (2, LONG)])).collect())[0] == 0
    assert line_dedup(frame(spark, [])).count() == 0
    null = [r for r in line_dedup(frame(spark, [(1, None)])).collect()][0]
    assert null.text is None and null.n_deleted == 0 and null.n_lines == 0
