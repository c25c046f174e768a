"""Benchmark decontamination: find benchmark items in documents up to an edit distance.

Items and documents are sequences of words (runs of letters and digits, in
lower case).  An item of n words is found where a span of the document is
within ``max_share`` * n word edits of it.

* An item of more than PIECE_WORDS words is looked for by pieces: of the edits
  that it may have, some piece has no more than its own share, as the pieces'
  shares add up to the item's.  Shorter items are one piece.
* Windows of a piece's size start at every word.  An edit spoils two word pairs at
  the most, so a window of n words can only match a piece of that size if it holds
  n - 1 - 2d word pairs of such pieces; the others are dropped and lose no match.
* CGK embedding (Chakraborty, Goldenberg, Koucky, STOC 2016): a random walk
  reads the window, at each step stays or moves on by a random bit of the step
  and the word, and writes the word it is on.  Sequences at a small edit
  distance come out at a small Hamming distance.
* Bit-sampling LSH: tables of a few sampled places of the output, over several
  walks; equal samples make a candidate.  Their number follows from the recall
  aimed at if matches agree on a share AGREE of the output.  Insertions and
  deletions early in a window agree on less (0.14 on average at the threshold for
  40 words), which the windows around a match make up for: the tests measure the
  recall of items of 10 to 400 words under each kind of edit.
* Candidates are verified by exact edit distance of the whole item (bit-parallel,
  free ends in the document around the window).
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrove.llm._common import in_arrow, table

#: Edits per item word; recall aimed at; share of output places on which a match is taken to agree; places to a sample; walks.
MAX_SHARE, RECALL, AGREE, PLACES, WALKS = 0.2, 0.999, 0.35, 2, 8
#: Words of the largest piece of an item.
PIECE_WORDS = 48
#: Bytes of items that one pass over the documents holds; larger benchmarks take more passes.
BLOCK_BYTES = 16 << 20
#: Documents whose words stand in one array.
DOCS_AT_ONCE = 256

_WORD = re.compile(r"[^\W_]+")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: str | None) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)] if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


def cgk_walk(rows: np.ndarray, walk: int, steps: int) -> np.ndarray:
    """Embed word-id rows (n words each) into ``steps`` places; past its end a row writes -1."""
    n = rows.shape[1]
    padded = np.concatenate([rows, np.full((len(rows), 1), -1, rows.dtype)], axis=1)
    at, out, every = np.zeros(len(rows), np.int64), np.empty((len(rows), steps), np.int64), np.arange(len(rows))
    for j in range(steps):
        word = padded[every, at]
        out[:, j] = word
        bit = _mix(word.astype(np.uint64) * _A + np.array([(walk + 1) * 1_000_003 + j], np.uint64) * _B) >> np.uint64(63)
        at = np.minimum(at + bit.astype(np.int64), n)
    return out


def edit_distance(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """(least edits of the pattern against any span of the text, end of the first such span); Myers' bit vectors."""
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, w in enumerate(text):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def _cuts(n: int) -> list[tuple[int, int]]:
    """Bounds of the fewest nearly equal pieces of n words that hold PIECE_WORDS words or fewer."""
    many = -(-n // PIECE_WORDS)
    return [(n * i // many, n * (i + 1) // many) for i in range(many)]


class Matcher:
    """A block of benchmark items, ready to be looked for."""

    def __init__(self, items: list[tuple[int | None, str | None]], max_share: float = MAX_SHARE, recall: float = RECALL):
        if max_share >= 0.4:
            raise ValueError("max_share must be below 0.4: beyond it a match need not keep a word pair")
        self.vocabulary: dict[str, int] = {}
        self.items = []
        for item_id, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if words:
                self.items.append((item_id, words))
        self.share = max_share
        self._sampled: dict[tuple[int, int], np.ndarray] = {}
        # Pieces: (item, its first word in the item, words); those of an item differ by a word in size.
        self.probes = [(k, a, words[a:b]) for k, (_, words) in enumerate(self.items) for a, b in _cuts(len(words))]
        self.by_size: dict[int, list[int]] = {}
        for p, (_, _, words) in enumerate(self.probes):
            self.by_size.setdefault(len(words), []).append(p)
        # Word pairs of the benchmark and, for each, the item sizes it occurs in (a one-word item is its word and no second one).
        width = len(self.vocabulary) + 1
        pairs = {(len(w), x * width + y) for _, _, w in self.probes for x, y in (zip(w, w[1:]) if len(w) > 1 else [(w[0], 0)])}
        listed = sorted((code, n) for n, code in pairs)
        codes, self.pair_sizes = np.array([c for c, _ in listed], np.int64), np.array([n for _, n in listed], np.int64)
        # The distinct pairs of the items of a size, and the fewest that one of them has.
        self.pairs_of = {n: codes[self.pair_sizes == n] for n in self.by_size}
        self.fewest = {n: min(len(set(zip(w, w[1:]))) if n > 1 else 1 for w in (self.probes[k][2] for k in ks)) for n, ks in self.by_size.items()}
        self.pairs, self.pair_at = np.unique(codes, return_index=True)
        self.pair_at = np.append(self.pair_at, len(codes))
        # A table finds a match with probability AGREE ** PLACES.
        tables = math.ceil(math.log(1 - recall) / math.log(1 - AGREE**PLACES))
        self.per_walk = -(-tables // WALKS)
        self.tables = {n: self._tables(n, ks) for n, ks in self.by_size.items()}

    def edits(self, n: int) -> int:
        return int(self.share * n + 1e-9)

    def _samples(self, n: int, walk: int) -> np.ndarray:
        if (n, walk) not in self._sampled:
            self._sampled[n, walk] = np.random.default_rng([n, walk, 7]).integers(0, 2 * n, (self.per_walk, PLACES))
        return self._sampled[n, walk]

    def _tables(self, n: int, ks: list[int]) -> list[dict[tuple[int, ...], list[int]]]:
        rows, out = np.array([self.probes[k][2] for k in ks], np.int64), []
        for walk in range(WALKS):
            embedded = cgk_walk(rows, walk, 2 * n)
            for places in self._samples(n, walk):
                found: dict[tuple[int, ...], list[int]] = {}
                for k, key in zip(ks, map(tuple, embedded[:, places].tolist())):
                    found.setdefault(key, []).append(k)
                out.append(found)
        return out

    def candidates(self, flat: np.ndarray):
        """(piece, window starts) for windows of ``flat`` (0: no word of the benchmark) that share a sample with an item."""
        longest = max(self.by_size, default=0)
        known = np.concatenate([flat, np.zeros(longest + 1, flat.dtype)])
        for n, starts in self._windows(flat, known):
            found: dict[int, set[int]] = {}
            for lo in range(0, len(starts), 4096):
                part = starts[lo : lo + 4096]
                rows = known[part[:, None] + np.arange(n)]
                if n > 1:  # repetitive text has many pairs but few distinct ones
                    code = rows[:, :-1] * (len(self.vocabulary) + 1) + rows[:, 1:]
                    of = self.pairs_of[n]
                    code[of[np.minimum(np.searchsorted(of, code), len(of) - 1)] != code] = -1
                    code.sort(axis=1)
                    distinct = (code[:, 0] >= 0) + ((np.diff(code, axis=1) != 0) & (code[:, 1:] >= 0)).sum(axis=1)
                    enough = distinct >= max(1, self.fewest[n] - 2 * self.edits(n))
                    part, rows = part[enough], rows[enough]
                    if not len(part):
                        continue
                t = 0
                for walk in range(WALKS):
                    embedded = cgk_walk(rows, walk, 2 * n)
                    for places in self._samples(n, walk):
                        lookup = self.tables[n][t]
                        t += 1
                        for at, key in zip(part.tolist(), map(tuple, embedded[:, places].tolist())):
                            for k in lookup.get(key, ()):
                                found.setdefault(k, set()).add(at)
            yield from ((k, sorted(ats)) for k, ats in found.items())

    def _windows(self, flat: np.ndarray, known: np.ndarray):
        """(item size, starts of the windows that hold enough word pairs of items of that size)."""
        width = len(self.vocabulary) + 1
        inside = np.flatnonzero(flat)
        places, sizes = [], []
        for follow in (known[inside + 1], np.zeros(len(inside), np.int64)) if 1 in self.by_size else (known[inside + 1],):
            code = flat[inside] * width + follow
            slot = np.minimum(np.searchsorted(self.pairs, code), max(0, len(self.pairs) - 1))
            hit = self.pairs[slot] == code if len(self.pairs) else np.zeros(len(code), bool)
            first, number = self.pair_at[slot[hit]], np.diff(self.pair_at)[slot[hit]]
            places.append(np.repeat(inside[hit], number))
            sizes.append(self.pair_sizes[np.repeat(first - np.cumsum(number) + number, number) + np.arange(number.sum())])
        place, size = np.concatenate(places), np.concatenate(sizes)
        for n in self.by_size:
            at = np.unique(place[size == n])
            least = max(1, n - 1 - 2 * self.edits(n))
            if len(at) < least:
                continue
            span = max(0, n - 2)
            low, high = at[least - 1 :] - span, at[: len(at) - least + 1]
            low, high = np.maximum(low[low <= high], 0), high[low <= high]
            if len(low):
                marks = np.zeros(len(flat) + 2, np.int64)
                np.add.at(marks, low, 1)
                np.add.at(marks, high + 1, -1)
                yield n, np.flatnonzero(np.cumsum(marks[: len(flat)]) > 0)

    def matches(self, docs: list[list[str]]) -> list[list[tuple[int, int, int, int]]]:
        """Per document (its words): (item, first word, end word, edits) of every item found, its first best place."""
        longest = max((len(words) for _, words in self.items), default=0)
        get, gap = self.vocabulary.get, [0] * (longest + 1)
        ids: list[int] = []
        bounds = []
        for words in docs:
            first = len(ids)
            ids += [get(w, 0) for w in words]
            bounds.append((first, len(ids)))
            ids += gap
        flat = np.array(ids, np.int64)
        ends = np.array([b for _, b in bounds])
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in docs]
        # Where an item may begin: a window's start less the place of its piece in the item.
        places: dict[int, list[int]] = {}
        for p, found in self.candidates(flat) if len(flat) else ():
            k, offset, _ = self.probes[p]
            places.setdefault(k, []).extend(at - offset for at in found)
        for k, starts in places.items():
            pattern, starts = self.items[k][1], sorted(set(starts))
            n, d = len(pattern), self.edits(len(pattern))
            slack = d if n <= PIECE_WORDS else 2 * d  # edits before a piece move it by as many words
            best: dict[int, tuple[int, int, int]] = {}
            lo = 0
            while lo < len(starts):
                hi = lo + 1
                while hi < len(starts) and starts[hi] - starts[hi - 1] <= n and starts[hi] - starts[lo] < 8 * n:
                    hi += 1
                low, high = starts[lo] - slack, starts[hi - 1] + n + slack
                # The documents that the places reach into: one, but for places before a document's first word.
                for doc in range(int(np.searchsorted(ends, low, side="right")), len(bounds)):
                    first, end = bounds[doc]
                    a, b = max(first, low), min(end, high)
                    if first >= high:
                        break
                    if a < b:
                        edits, stop = edit_distance(pattern, ids[a:b])
                        if edits <= d and (doc not in best or edits < best[doc][0]):
                            back = edit_distance(pattern[::-1], ids[a : a + stop][::-1])[1]
                            best[doc] = (edits, a + stop - back - first, a + stop - first)
                lo = hi
            for doc, (edits, a, b) in best.items():
                out[doc].append((k, a, b, edits))
        return out


@lru_cache(maxsize=1)
def _matcher(items: tuple[tuple[int | None, str | None], ...], max_share: float) -> Matcher:
    """A worker prepares a block of items once, not once a task."""
    return Matcher(list(items), max_share)


def _blocks(benchmark: DataFrame, text_col: str, id_col: str, block_bytes: int):
    """Items in blocks of about ``block_bytes``: a stated query set, held a block at a time."""
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    size = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        yield [(r["i"], r["t"]) for r in part.sort("i", "t").collect()]


def _spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD.finditer(text)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text_col: str = "text", max_share: float = MAX_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, start, end (code points), n_edits: one row per row of
    ``docs`` and item found in it, at its first best place.

    Null and empty texts, and items without a word, match nothing; null ids are
    carried; repeated rows and items each give their rows.
    """
    kind = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("n_edits", pa.int32())])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for items in _blocks(benchmark, item_text_col, item_col, block_bytes):

        def run(batches, items=items):
            matcher = _matcher(tuple(items), max_share)
            for batch in batches:
                for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                    ids, texts = (c.to_pylist() for c in batch.slice(at, DOCS_AT_ONCE).columns)
                    found = []
                    for doc_id, text, hits in zip(ids, texts, matcher.matches([words_of(t) for t in texts])):
                        spans = _spans(text) if hits else ()
                        found += [{"doc_id": doc_id, "item_id": matcher.items[k][0], "start": spans[a][0], "end": spans[b - 1][1], "n_edits": edits} for k, a, b, edits in hits]
                    if found:
                        yield pa.RecordBatch.from_pylist(found, schema=kind)

        part = in_arrow(rows, run, "doc_id long, item_id long, start long, end long, n_edits int")
        out = part if out is None else out.union(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_share: float = MAX_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns as they are."""
    schema, place = docs.schema, docs.columns.index(text_col)
    for items in _blocks(benchmark, item_text_col, item_col, block_bytes):

        def run(batches, items=items):
            matcher = _matcher(tuple(items), max_share)
            for batch in batches:
                for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                    part = batch.slice(at, DOCS_AT_ONCE)
                    hits = matcher.matches([words_of(t) for t in part.column(place).to_pylist()])
                    yield part.filter(pa.array([not h for h in hits], pa.bool_()))

        docs = in_arrow(docs, run, T.StructType(schema.fields))
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, start, end, n_edits of every benchmark item in every document."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
