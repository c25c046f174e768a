import random
from collections import Counter

import numpy as np
import pytest
from cases import EDGE, frame, prose

from vectrove.llm import jaccard_join
from vectrove.llm.jaccard_join import Sizes, divide_skip, listed, merge_skip, ngram_jaccard_join


def sets_of(rows, k):
    out = {}
    for n, (i, t) in enumerate(rows):
        w = (t or "").encode().lower().split()
        out[n] = frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    return out


def brute(rows, k, num, den):
    sets, up = sets_of(rows, k), {i: i for i, _ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            if i is not None and j is not None and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return sorted((i is None, i or 0, len(sets[n]), None if i is None else root(i)) for n, (i, _) in enumerate(rows))


def edited(text, seed, n):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"edit{r.random()}"
    return " ".join(w)


def compare(spark, rows, k, num, den):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_jaccard_join(frame(spark, rows), k=k, num=num, den=den).collect())
    assert got == brute(rows, k, num, den)


ROWS = []
for base in range(6):
    text = prose(base, 60 + 150 * base)
    ROWS += [(100 * base + i, edited(text, i, i % 7)) for i in range(12)]
passage = prose(77, 60)
ROWS += [(1000 + i, passage + " " + prose(200 + i, 40)) for i in range(20)]
ROWS += [(2000, "a b c"), (2001, "A B c"), (2002, "a b"), (2003, "a  b"), (2004, "a"), (3, prose(0, 60))]


@pytest.mark.parametrize("k,num,den", [(3, 9, 10), (5, 8, 10), (1, 7, 10)])
def test_against_brute_force(spark, k, num, den):
    compare(spark, ROWS, k, num, den)


def test_edges(spark):
    compare(spark, EDGE, 3, 9, 10)
    assert ngram_jaccard_join(frame(spark, [])).count() == 0


def test_rows_that_share_an_id_are_one(spark):
    rows = [(5, prose(1, 90)), (5, prose(2, 90)), (9, edited(prose(2, 90), 1, 1)), (3, prose(1, 90))]
    got = {r.component_id for r in ngram_jaccard_join(frame(spark, rows), k=3, num=9, den=10).collect()}
    assert got == {3}


def test_large_groups_go_block_against_block(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    text = prose(5, 400)
    compare(spark, [(i, edited(text, i, 1 + i % 3)) for i in range(60)], 3, 9, 10)


def joined(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("labelled", [False, True])
def test_divide_skip_links_all_and_only_similar_sets(labelled):
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, 400, dtype=np.uint64)
    sets = []
    for i in range(120):
        s = base[: 100 + 3 * (i % 60)].copy()
        at = r.integers(0, len(s), int(r.integers(0, 14)))
        s[at] = r.integers(0, 2**63, len(at), dtype=np.uint64)
        sets.append(np.unique(s))
    sets.sort(key=len)
    as_sets = [set(s.tolist()) for s in sets]
    similar = [(a, b) for a in range(len(sets)) for b in range(a) if 10 * len(as_sets[a] & as_sets[b]) >= 9 * len(as_sets[a] | as_sets[b])]
    known = [(a, a - 1) for a in range(1, len(sets)) if a % 3] if labelled else []
    links = divide_skip(sets, 9, 10, joined(len(sets), known) if labelled else None)
    assert set(links) <= set(similar) and len(links) < len(sets)
    assert joined(len(sets), links + known) == joined(len(sets), similar + known)


def test_merge_skip_finds_what_occurs_often_enough():
    r = random.Random(1)
    for _ in range(300):
        lists = [sorted(r.sample(range(40), r.randrange(0, 25))) for _ in range(r.randrange(1, 12))]
        need = r.randrange(1, 8)
        counts = Counter(x for lst in lists for x in lst)
        assert list(merge_skip(lists, need)) == sorted((x, n) for x, n in counts.items() if n >= need)


@pytest.mark.parametrize("num,den", [(9, 10), (8, 10)])
def test_listed_elements_lose_no_linked_pair(num, den):
    r = np.random.default_rng(5)
    for _ in range(400):
        n = int(r.integers(1, 500))
        x = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        most = len(x) * (den - num) // num
        drop = int(r.integers(0, most + 1))
        y = np.unique(np.concatenate([np.delete(x, r.choice(len(x), drop, replace=False)), r.integers(0, 2**64, int(r.integers(0, most - drop + 1)), dtype=np.uint64)]))
        common = len(np.intersect1d(x, y))
        if len(y) and den * common >= num * (len(x) + len(y) - common):
            assert set(x[: listed(len(x), num, den)].tolist()) & set(y[: listed(len(y), num, den)].tolist())
            sizes = Sizes(num, den)
            assert set(sizes.classes(len(x))) & set(sizes.classes(len(y)))


def test_shared_passages_make_no_candidates(spark, monkeypatch):
    """Boilerplate links thousands of unlike documents into no group: their rarest shingles are their own."""
    from vectrove.llm import jaccard_join as jj

    seen = []
    monkeypatch.setattr(jj, "_candidate_edges", lambda some, _f=jj._candidate_edges: seen.append(some.count()) or _f(some))
    passages = [prose(500 + i, 40) for i in range(12)]
    rows = [(i, " ".join([passages[i % 12], passages[(i * 5 + 1) % 12], " ".join(f"own{i}x{j}" for j in range(60))])) for i in range(2000)]
    got = ngram_jaccard_join(frame(spark, rows, clash=False), k=3, num=9, den=10).where("component_id = doc_id").count()
    assert got == 2000 and seen == [0]


def test_chunks_and_parts(spark):
    rows = [x for x in ROWS if x[0] < 300]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard_join(frame(spark, rows), k=3, num=9, den=10, parts=5, chunk_shingles=700).collect())
    assert got == [x[1:] for x in brute(rows, 3, 9, 10)]


def test_repeated_and_nameless_rows(spark):
    rows = [(4, prose(1, 90))] * 3 + [(None, prose(1, 90))] * 2 + [(6, prose(1, 90)), (None, prose(2, 50)), (None, prose(2, 50)), (7, edited(prose(1, 90), 3, 1))]
    compare(spark, rows, 3, 9, 10)


def test_workers_get_a_partition_in_small_batches(spark, monkeypatch, tmp_path):
    """A whole partition at once is held by the executor and by its worker."""
    sizes, made = str(tmp_path / "sizes"), jaccard_join._send

    def noted(*args):
        run = made(*args)

        def noting(batches):
            for batch in batches:
                with open(sizes, "a") as f:
                    f.write(f"{batch.nbytes}\n")
                yield batch

        return lambda batches: run(noting(batches))

    monkeypatch.setattr(jaccard_join, "_send", noted)
    rows = [(i, f"word{i} " * 25_000) for i in range(60)]
    got = ngram_jaccard_join(frame(spark, rows, clash=False).coalesce(1), k=3, num=9, den=10)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == [(i, 1, i) for i in range(60)]
    with open(sizes) as f:
        found = [int(x) for x in f]
    assert sum(found) > 8 << 20 and max(found) < 3 << 20
