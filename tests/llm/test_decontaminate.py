import random

import numpy as np
from cases import EDGE, frame, prose

from vectrove.llm.decontaminate import Matcher, cgk_walk, decontaminate, edit_distance, find_contamination, words_of


def brute_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, w in enumerate(p, 1):
        row, before = [i] + [0] * len(t), row
        for j, v in enumerate(t, 1):
            row[j] = min(before[j - 1] + (w != v), before[j] + 1, row[j - 1] + 1)
    return min(row)


def items(n=40):
    r = random.Random(3)
    rare = [f"{a}{b}" for a in "bcdfgh" for b in ("ank", "orp", "ilt", "umz")]
    return [(i, " ".join(r.choice([*rare, "the", "of", "and"]) for _ in range(r.randint(6, 40)))) for i in range(n)]


def changed(words, edits, r):
    w = list(words)
    for _ in range(edits):
        kind, at = r.random(), r.randrange(len(w))
        if kind < 0.4:
            w[at] = "changed"
        elif kind < 0.7:
            w.insert(at, "extra")
        elif len(w) > 1:
            w.pop(at)
    return w


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_edit_distance_is_exact():
    r = random.Random(1)
    for _ in range(300):
        p, t = [r.randrange(4) for _ in range(r.randint(1, 70))], [r.randrange(4) for _ in range(r.randint(0, 90))]
        assert edit_distance(p, t)[0] == brute_distance(p, t)


def test_walk_reads_equal_rows_alike_and_near_rows_mostly():
    r = np.random.default_rng(1)
    x = r.integers(1, 500, (200, 30))
    y = x.copy()
    y[:, 10] = 501
    a, b = cgk_walk(x, 0, 60), cgk_walk(y, 0, 60)
    assert (cgk_walk(x, 0, 60) == a).all()
    assert (a == b).mean() > 0.6


def test_recall_at_the_threshold_and_no_false_match():
    bank, r = items(), random.Random(9)
    m = Matcher(bank)
    docs, want = [], []
    for k in range(len(m.items)):
        words = words_of(bank[k][1])
        docs.append(prose(k, 60).split() + changed(words, m.edits(len(words)), r) + prose(k + 500, 60).split())
        want.append(k)
    docs = [words_of(" ".join(d)) for d in docs]
    found = m.matches(docs)
    assert sum(k in [h[0] for h in hits] for k, hits in zip(want, found)) >= 0.97 * len(want)
    for doc, hits in zip(docs, found):
        for k, a, b, edits in hits:
            assert brute_distance(words_of(bank[k][1]), doc[a:b]) == edits <= m.edits(len(m.items[k][1]))
    assert not any(m.matches([words_of(prose(i, 400)) for i in range(50)]))


def test_spans_and_filter(spark):
    bank = items(10)
    text = "Intro words here. " + bank[4][1].upper() + " And an end."
    rows = [*EDGE, (50, text), (50, text), (51, bank[4][1])]
    found = find_contamination(frame(spark, rows), bench(spark, [*bank, (None, None), (11, ""), (12, bank[4][1])])).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == sorted([(50, 4), (50, 4), (50, 12), (50, 12), (51, 4), (51, 12)])
    assert {text[r.start : r.end] for r in found if r.doc_id == 50} == {bank[4][1].upper()}
    left = decontaminate(frame(spark, rows), bench(spark, bank))
    assert left.count() == len(EDGE) and left.columns == frame(spark, rows).columns


def test_items_in_blocks_and_empty_tables(spark):
    bank = items(30)
    docs = frame(spark, [(i, "x " + t + " y") for i, t in bank])
    whole = sorted(map(tuple, find_contamination(docs, bench(spark, bank)).collect()))
    assert sorted(map(tuple, find_contamination(docs, bench(spark, bank), block_bytes=500).collect())) == whole and len(whole) >= 30
    assert find_contamination(frame(spark, []), bench(spark, bank)).count() == 0
    assert find_contamination(docs, bench(spark, [])).count() == 0
    assert decontaminate(docs, bench(spark, [])).count() == 30
    assert find_contamination(frame(spark, [(1, "just one")]), bench(spark, [(1, "one")])).count() == 1


def edited(words, edits, kind, r):
    """``edits`` edits of one kind, evenly spread or in the first third."""
    w, third = list(words), r.random() < 0.5
    for i in range(edits):
        at = r.randrange(max(1, len(w) // 3)) if third else (len(w) * i // edits + r.randrange(3)) % len(w)
        if kind == "change":
            w[at] = "changed"
        elif kind == "insert":
            w.insert(at, "extra")
        else:
            w.pop(at)
    return w


def test_recall_of_items_of_all_sizes_under_each_kind_of_edit():
    r = random.Random(4)
    sizes = (10, 24, 48, 49, 100, 200, 400)
    bank = [(i, " ".join(f"w{r.randrange(3000)}" for _ in range(sizes[i % len(sizes)]))) for i in range(70)]
    m, wanted, caught = Matcher(bank), {n: 0 for n in sizes}, {n: 0 for n in sizes}
    for kind in ("change", "insert", "drop"):
        docs = [["start"] * 5 + edited(t.split(), m.edits(len(t.split())), kind, r) + ["end"] * 5 for _, t in bank]
        for k, (doc, hits) in enumerate(zip(docs, m.matches(docs))):
            n = sizes[k % len(sizes)]
            if brute_distance(m.items[k][1], [m.vocabulary.get(w, 0) for w in doc]) <= m.edits(n):
                wanted[n] += 1
                caught[n] += k in [h[0] for h in hits]
    assert sum(wanted.values()) > 200 and all(caught[n] >= 0.96 * wanted[n] for n in sizes), (wanted, caught)


def test_all_matches_and_nothing_else():
    """Every (document, item) pair against the distance of every span."""
    r, bank = random.Random(12), items(24)
    m = Matcher(bank)
    docs = []
    for i in range(100):
        words = prose(900 + i, r.randint(0, 40)).split()
        for k in r.sample(range(24), r.randint(0, 2)):
            t = words_of(bank[k][1])
            words += changed(t, r.randint(0, m.edits(len(t)) + 1), r) + prose(i * 7 + k, r.randint(0, 20)).split()
        docs.append(words_of(" ".join(words)))
    want = {(i, k) for i, doc in enumerate(docs) for k, (_, t) in enumerate(bank) if brute_distance(words_of(t), doc) <= m.edits(len(words_of(t)))}
    found = {(i, h[0]) for i, hits in enumerate(m.matches(docs)) for h in hits}
    assert found <= want and len(found) >= 0.97 * len(want) and len(want) > 40
