"""Join of documents whose sets of word n-grams have a high Jaccard similarity.

Candidates come from inverted lists over the rarest elements of each set:

* Texts that are equal byte for byte are one node, named by its smallest id.
* A distributed count gives every shingle its number of nodes.  Tasks send the
  different shingles of a chunk of nodes to the parts that count them, and each
  chunk gets back the counts it asked for; shingles travel as differences of
  sorted hashes, a byte or two each, and a frequent shingle is sent once a chunk.
* Sets are put into one order, the rarest shingles first.  Two sets that link
  share one of their first n - ceil(n * t) + 1 elements (n the set's own size, t
  the threshold), so only these are listed, and of these only such as occur in
  another set.  Most documents are their own in more than that: they list
  nothing, however many passages they share with others.
* Nodes that share a list belong to one candidate group.

Search within a group is a T-occurrence search with DivideSkip: per query its
inverted lists are split into long and short ones by the cost formula of Li, Lu
and Lu (ICDE 2008), short lists are merged on a heap, which skips what cannot
occur often enough, candidates are looked up in the long lists by binary search,
and sets that reach the overlap which the threshold asks for are linked.  What
is found is a spanning forest: a query stops at sets it is connected with.

A group of more than BLOCK nodes (or BLOCK_SHINGLES shingles) is dealt to blocks by size class and hash.
Blocks are searched each by itself, then the roots of their trees, and only
nodes that still share a list with a node of another tree are compared further,
those outside a group's main tree against the others: a group of near copies
costs a multiple of its size, not its square.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrove.llm._common import in_arrow, materialize, release, sized, table, text_or_empty
from vectrove.llm._components import connected_components
from vectrove.llm._exchange import split_join
from vectrove.llm._packed import pack, pack_keys, unpack, unpack_keys

#: Sets in a block of a candidate group, and their shingles.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21
#: Shingles to a chunk of documents (a longer text is one by itself), and characters of text to each part of the counts.
CHUNK_SHINGLES, PART_CHARS = 1 << 20, 1 << 23
#: The weight of a long list's look-up in the cost formula, and candidates looked up at once.
MU, AT_ONCE = 0.0085, 32

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """64-bit hashes of words; a worker keeps those of its last 2^16 or fewer words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 1 << 16:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hash_of = _WordHashes().__getitem__


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; a text of fewer words is one shingle, one without words none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hash_of, words), np.uint64, len(words))
    if len(h) < k:
        x = np.array([len(h)], np.uint64)
        for v in h:
            x = _mix(x * _M1 + v)
        return x
    x = h[: len(h) - k + 1]
    for i in range(1, k):
        x = _mix(x * _M1 + h[i : len(h) - k + 1 + i])
    return np.unique(_mix(x))


def listed(n: int, num: int, den: int) -> int:
    """How many of the first elements of a set of n hold one of any set it links to."""
    return n - -(-n * num // den) + 1


class Sizes:
    """Size classes, each a quarter wide."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.low = num, den, [1]

    def class_of(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(max(self.low[-1] + 1, self.low[-1] * 5 // 4))
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def classes(self, n: int) -> range:
        """Classes of the smaller sets that a set of n elements can link to, and its own."""
        return range(self.class_of(max(1, -(-n * self.num // self.den))), self.class_of(n) + 1)


# ---------------------------------------------------------------- counts of shingles

_SENT = "route int, part int, chunk long, keys binary, counts binary, sizes binary, ids binary, texts binary"
_ANSWER = "route int, part int, chunk long, keys binary, counts binary, sizes binary, ids binary, texts binary"
_LISTED = "node long, th binary, n long, keys array<long>"


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def _part_of(keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Rises with the key, so that the keys of a part stand together."""
    return np.minimum((keys.astype(np.float64) * (parts / 2.0**bits)).astype(np.int64), parts - 1)


def _rarity(counts: np.ndarray) -> np.ndarray:
    """Counts in a byte: exact up to 64, then eight steps to each power of two."""
    large = 64 + np.log2(np.maximum(counts, 64) / 64) * 8
    return np.where(counts < 64, counts, np.minimum(large, 255)).astype(np.uint8)


def _send(k: int, bits: int, parts: int, chunk_shingles: int):
    """Of each chunk of nodes: a row with its sets, and a row for each part that counts some of its shingles.

    Shingles are cut to their first ``bits`` bits, in all documents alike; two
    that become one this way only look less rare than they are.
    """
    schema, cut = _arrow_schema(_SENT), np.uint64(64 - bits)

    def close(chunk, ids, texts, sets):
        sizes = np.array([len(s) for s in sets], np.int64)
        different, place, counts = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_inverse=True, return_counts=True)
        place = np.diff(place, prepend=0)
        starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        place[starts] = np.cumsum(place)[starts]
        body = {"part": -1, "chunk": chunk, "route": chunk % 1_000_003 % parts, "keys": None, "counts": pack(place), "sizes": pack(sizes), "ids": _ids(ids), "texts": b"".join(texts)}
        yield pa.RecordBatch.from_pylist([body], schema=schema)
        of = np.searchsorted(_part_of(different, bits, parts), np.arange(parts + 1))
        rows = []
        for part in range(parts):
            a, b = int(of[part]), int(of[part + 1])
            if a < b:
                rows.append({"route": part, "part": part, "chunk": chunk, "keys": pack_keys(different[a:b]), "counts": pack(counts[a:b])})
            if len(rows) == 256:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def run(batches):
        from pyspark import TaskContext

        chunk, n = TaskContext.get().partitionId() << 32, 0
        ids, texts, sets = [], [], []
        for batch in batches:
            for node, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                s = shingle_set(text.as_py(), k) >> cut
                ids.append(node)
                texts.append(th)
                sets.append(s)
                n += len(s)
                if n >= chunk_shingles:
                    yield from close(chunk, ids, texts, sets)
                    chunk, n, ids, texts, sets = chunk + 1, 0, [], [], []
        if ids:
            yield from close(chunk, ids, texts, sets)

    return run


def _ids(ids: list[int | None]) -> bytes:
    """Ids and which of them are null."""
    return np.array([i or 0 for i in ids], "<i8").tobytes() + bytes(i is None for i in ids)


def _ids_back(data: bytes) -> list[int | None]:
    n = len(data) // 9
    return [None if gone else i for i, gone in zip(np.frombuffer(data, "<i8", n).tolist(), data[8 * n :])]


def _answer(batches):
    """Rows come sorted by (part, chunk): a part adds up what all chunks sent and answers each of them; the chunks' own rows pass."""
    schema = _arrow_schema(_ANSWER)

    def close(part, held):
        keys = [unpack_keys(r["keys"]) for r in held]
        different, place = np.unique(np.concatenate(keys), return_inverse=True)
        rarity = _rarity(np.bincount(place, np.concatenate([unpack(r["counts"]) for r in held]), len(different)))
        for r, mine, at in zip(held, keys, np.split(place, np.cumsum([len(x) for x in keys])[:-1])):
            found = rarity[at]
            yield pa.RecordBatch.from_pylist([{"route": r["chunk"] % 1_000_003, "part": part, "chunk": r["chunk"], "keys": pack_keys(mine[found > 1]), "counts": pack(found)}], schema=schema)

    part, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] < 0:
                yield pa.RecordBatch.from_pylist([row | {"route": row["chunk"] % 1_000_003}], schema=schema)
                continue
            if row["part"] != part and held:
                yield from close(part, held)
                held = []
            part = row["part"]
            held.append(row)
    if held:
        yield from close(part, held)


def _lists(num: int, den: int):
    """Rows come sorted by (chunk, part): a chunk's sets, then what its parts answered in the order of the keys."""
    schema = _arrow_schema(_LISTED)

    def close(body, answers):
        sizes, place = unpack(body["sizes"]), unpack(body["counts"])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        full = np.flatnonzero(sizes)
        # Back from steps within a set to places among the chunk's shingles.
        run = np.cumsum(place)
        place = run - np.repeat((run[starts[full]] - place[starts[full]]), sizes[full])
        rarity = np.concatenate([np.zeros(0, np.int64), *(unpack(a["counts"]) for a in answers)])
        keys = np.zeros(len(rarity), np.uint64)
        keys[rarity > 1] = np.concatenate([np.zeros(0, np.uint64), *(unpack_keys(a["keys"]) for a in answers)])
        of = rarity[place] if len(place) else place
        own = np.zeros(len(sizes), np.int64)
        if len(full):
            own[full] = np.add.reduceat((of == 1).astype(np.int64), starts[full])
        rows = []
        for i, (node, th) in enumerate(zip(_ids_back(body["ids"]), (body["texts"][16 * j : 16 * j + 16] for j in range(len(sizes))))):
            n = int(sizes[i])
            more, some = listed(n, num, den) - int(own[i]) if n else 0, []
            if more > 0 and node is not None:
                at, c = place[starts[i] : ends[i]], of[starts[i] : ends[i]]
                at, c = at[c > 1], c[c > 1]
                some = np.unique(keys[at[np.argsort(c, kind="stable")[:more]]]).view(np.int64)
            rows.append({"node": node, "th": th, "n": n, "keys": some})
            if len(rows) == 1024:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def run(batches):
        body, answers = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] < 0:
                    if body is not None:
                        yield from close(body, answers)
                    body, answers = row, []
                else:
                    answers.append(row)
        if body is not None:
            yield from close(body, answers)

    return run


# ---------------------------------------------------------------- search

def merge_skip(lists: list[list[int]], need: int):
    """(id, in how many) for the ids that stand in ``need`` of the rising ``lists`` or more, merged on a heap."""
    at = [0] * len(lists)
    heap = [(x[0], i) for i, x in enumerate(lists) if x]
    heapq.heapify(heap)
    while len(heap) >= need:
        top, out = heap[0][0], []
        while heap and heap[0][0] == top:
            out.append(heapq.heappop(heap)[1])
        if len(out) >= need:
            yield top, len(out)
            to = top + 1
        else:
            # What stands before the next top is in need - 1 lists at the most.
            while heap and len(out) < need - 1:
                out.append(heapq.heappop(heap)[1])
            if not heap:
                return
            to = heap[0][0]
        for i in out:
            at[i] = bisect_left(lists[i], to, at[i])
            if at[i] < len(lists[i]):
                heapq.heappush(heap, (lists[i][at[i]], i))


def divide_skip(sets: list[np.ndarray], num: int, den: int, labels: list[int] | None = None) -> list[tuple[int, int]]:
    """Links (later, earlier) between sets whose overlap reaches the threshold: a
    forest that connects all that links connect.  Sets are in order of size; those
    of one label are connected already."""
    links, sizes = [], np.array([len(s) for s in sets])
    label = np.arange(len(sets)) if labels is None else np.unique(np.array(labels), return_inverse=True)[1]
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    owners = np.repeat(np.arange(len(sets)), sizes)[order]  # rising within a list
    starts = np.flatnonzero(np.concatenate([[True], np.diff(flat[order]) != 0]))
    ends = np.append(starts[1:], len(flat))
    list_of = np.empty(len(flat), np.int64)
    list_of[order] = np.repeat(np.arange(len(starts)), ends - starts)
    postings = list_of[order] * len(sets) + owners  # all lists, one after another, to be searched at once
    at = np.concatenate([[0], np.cumsum(sizes)])
    smallest = -(-sizes * num // den)
    first = np.searchsorted(sizes, smallest)
    for q in range(1, len(sets)):
        n, lo = int(sizes[q]), int(first[q])
        if lo >= q or (label[lo:q] == label[q]).all():
            continue
        need = -(-num * (n + int(smallest[q])) // (num + den))
        mine = list_of[at[q] : at[q + 1]]
        lengths = ends[mine] - starts[mine]
        mine, lengths = mine[lengths > 1], lengths[lengths > 1]
        if len(mine) < need:
            continue
        n_long = min(need - 1, int(need / (MU * math.log2(int(lengths.max())) + 1)))
        mine = mine[np.argsort(lengths, kind="stable")]
        short, long = mine[: len(mine) - n_long], mine[len(mine) - n_long :]
        # The short lists' entries, one list after another.
        length = ends[short] - starts[short]
        whose = np.repeat(np.arange(len(short)), length)
        entries = owners[np.repeat(starts[short] - np.cumsum(length) + length, length) + np.arange(length.sum())]
        keep = (entries >= lo) & (entries < q)
        whose, entries = whose[keep], entries[keep]
        while True:
            keep = label[entries] != label[q]
            whose, entries = whose[keep], entries[keep]
            if len(entries) < need - n_long:
                break
            bounds = np.flatnonzero(np.diff(whose)) + 1
            merged, at_once, linked = merge_skip([x.tolist() for x in np.split(entries, bounds)], need - n_long), 1, False
            while not linked:
                some = list(islice(merged, at_once))
                if not some:
                    break
                ids, counts = np.array(some, np.int64).T
                probes = long[:, None] * len(sets) + ids
                place = np.searchsorted(postings, probes.ravel())
                hit = postings[np.minimum(place, len(postings) - 1)] == probes.ravel()
                common = counts + hit.reshape(probes.shape).sum(axis=0)
                for d in ids[den * common >= num * (n + sizes[ids] - common)].tolist():
                    if label[d] != label[q]:
                        links.append((q, d))
                        label[label == label[d]] = label[q]
                        linked = True
                at_once = AT_ONCE
            if not linked:
                break
    return links


def _sets(k: int, num: int, den: int):
    """Sets of candidate nodes, with the size classes in which each takes part."""
    schema = pa.schema([("component", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("classes", pa.list_(pa.int32())), ("s", pa.binary())])

    def run(batches):
        sizes = Sizes(num, den)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = []
                for component, node, text in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns)):
                    s = shingle_set(text, k)
                    if len(s):
                        rows.append({"component": component, "node": node, "n": len(s), "classes": list(sizes.classes(len(s))), "s": s.tobytes()})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _search(num: int, den: int, n_key: int, labelled: bool = False):
    """Rows come sorted by their first ``n_key`` columns, the group; then node, set and, where labelled, the tree of the node so far."""

    def links(nodes, sets, labels):
        order = sorted(range(len(nodes)), key=lambda i: (len(sets[i]), nodes[i]))
        found = divide_skip([sets[i] for i in order], num, den, [labels[i] for i in order] if labelled else None)
        return [(nodes[order[a]], nodes[order[b]]) for a, b in found]

    def run(batches):
        key, nodes, sets, labels, out = None, [], [], [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:n_key] != key:
                    if len(nodes) > 1:
                        out += links(nodes, sets, labels)
                    key, nodes, sets, labels = row[:n_key], [], [], []
                nodes.append(row[n_key])
                sets.append(np.frombuffer(row[n_key + 1], np.uint64))
                labels.append(row[-1])
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        if len(nodes) > 1:
            out += links(nodes, sets, labels)
        if out:
            yield _edges(out)

    return run


def _edges(pairs):
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["u", "v"])


def _searched(dealt: DataFrame, keys: list[str], num: int, den: int, labelled: bool = False) -> DataFrame:
    columns = [*keys, "node", "s", *(["label"] if labelled else [])]
    return in_arrow(dealt.select(*columns).repartition(*keys).sortWithinPartitions(*keys), _search(num, den, len(keys), labelled), "u long, v long")


def _candidate_edges(listed_keys: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """u, v: every node of a list with the smallest one; lists of one node and hot lists included."""
    members = listed_keys.select("node", F.explode("keys").alias("key"), *extra)
    total = listed_keys.agg(F.sum(F.size("keys"))).first()[0] or 0
    lists = members.groupBy(F.col("key").alias("k")).agg(F.min("node").alias("first"), F.count("*").alias("n_nodes")).where("n_nodes > 1")
    joined = split_join(members, lists, [("key", "k")], "n_nodes", total)
    return joined.where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v")).distinct()


def _blocks(rows: Column | None = None, shingles: Column | None = None) -> Column:
    """How many blocks a number of sets with a number of shingles makes."""
    rows, shingles = (F.count("*"), F.sum("n")) if rows is None else (rows, shingles)
    return F.greatest(F.ceil(rows / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def _large_groups(sets: DataFrame, large: DataFrame, prefixes: DataFrame, num: int, den: int) -> DataFrame:
    """u, v: links that connect what links connect in the groups of ``large`` (c)."""
    own = sets.join(sized(large), F.col("component") == F.col("c"), "left_semi").select("component", "node", "n", F.explode("classes").alias("cls"), "s")

    def block(n):
        return F.pmod(F.xxhash64("node"), n).cast("int")

    def blocks_of(rows):
        """Blocks of each (component, cls)."""
        return sized(materialize(rows.groupBy(F.col("component").alias("c"), F.col("cls").alias("l")).agg(_blocks().alias("blocks")), "jaccard-blocks"))

    same = (F.col("component") == F.col("c")) & (F.col("cls") == F.col("l"))
    keys = ["component", "cls"]
    one = materialize(_searched(own.join(blocks_of(own), same).withColumn("i", block(F.col("blocks"))), [*keys, "i"], num, den), "jaccard-block-links")
    trees = materialize(connected_components(one, "jaccard-block-trees"), "jaccard-block-roots")
    roots = own.join(trees.where("node <> component").select(F.col("node").alias("below")), F.col("node") == F.col("below"), "left_anti")
    two = materialize(_searched(roots.join(blocks_of(roots), same).withColumn("i", block(F.col("blocks"))), [*keys, "i"], num, den), "jaccard-root-links")
    far = one.union(two)
    after = materialize(connected_components(far, "jaccard-large-trees"), "jaccard-large-roots").select(F.col("node").alias("w"), F.col("component").alias("tree"))
    # Only lists that still hold nodes of two trees can give another link.
    label = F.coalesce("tree", "node")
    lists = prefixes.join(own.select(F.col("node").alias("o")).distinct(), F.col("node") == F.col("o"), "left_semi").join(after, F.col("node") == F.col("w"), "left").select("node", label.alias("label"), F.explode("keys").alias("key"))
    lists = materialize(lists, "jaccard-large-lists")
    mixed = lists.groupBy(F.col("key").alias("k")).agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("n_nodes")).where("a < b")
    open_ = materialize(split_join(lists, mixed, [("key", "k")], "n_nodes", lists.count()).select(F.col("node").alias("o"), "label").distinct(), "jaccard-open-nodes")
    if not open_.limit(1).count():
        release(lists, open_, trees)
        return far
    # The largest tree of a group and size class is its main one; nodes of others are compared with all open nodes.
    rest = own.join(sized(open_), F.col("node") == F.col("o")).drop("o")
    size = rest.groupBy(*keys, "label").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    main = size.groupBy(F.col("component").alias("c"), F.col("cls").alias("l")).agg(F.max(F.struct("rows", F.negate("label").alias("m"), "n")).alias("x"), F.sum("rows").alias("rows"), F.sum("n").alias("n"))
    main = main.select("c", "l", F.negate(F.col("x.m")).alias("main"), _blocks(F.col("rows"), F.col("n")).alias("blocks"), _blocks(F.col("rows") - F.col("x.rows"), F.col("n") - F.col("x.n")).alias("outer")).where("outer > 0")
    dealt = rest.join(sized(materialize(main, "jaccard-main-trees")), same)
    members = dealt.withColumn("i", block(F.col("blocks"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("outer") - 1)))
    others = dealt.where(F.col("label") != F.col("main")).withColumn("j", block(F.col("outer"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # A node may stand in a group twice, under one label.
    three = _searched(members.unionByName(others), [*keys, "i", "j"], num, den, labelled=True)
    release(lists, trees)
    return far.union(materialize(three, "jaccard-open-links"))


def ngram_jaccard_join(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = 5, num: int = 8, den: int = 10, parts: int | None = None, chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """``id_col``, n_shingles, component_id per row of ``docs``.

    Rows link when intersection / union of their sets of k-word shingles is
    num / den or more; component_id is the smallest id that links reach.  Words
    are runs of anything but ASCII white space, A-Z lower-cased; texts are read
    whole, whatever their length.  A null or empty text has an empty set and
    links with nothing.  Rows that share an id are one document and reach what
    any of them reaches; repeated rows come back each.  A row without id
    cannot name a component: it comes back with its set's size and a null
    component, and links nothing.  Other columns are not read, so they may have
    any name.  An empty table gives no rows.  Ties do not arise.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("th"), text.alias("text"))
    named = rows.select("id", "th")
    total, chars = rows.agg(F.count("*"), F.sum(F.length("text"))).first()
    parts = parts or max(1, math.ceil((chars or 0) / PART_CHARS))
    bits = min(56, max(32, math.ceil(math.log2((chars or 0) + 2)) + 6))
    pairs = named.groupBy("id", "th").agg(F.count("*").alias("n"))
    texts = materialize(pairs.groupBy(F.col("th").alias("t")).agg(F.min("id").alias("first"), F.sum("n").alias("n_rows"), F.max("n").alias("most")), "jaccard-texts")
    # Equal texts count once: all rows but those that name the text are left out.
    repeated = texts.where("n_rows > 1 AND first IS NOT NULL")
    copies = materialize(split_join(named, repeated, [("th", "t")], "n_rows", total).where("id IS NULL OR id <> first").select(F.coalesce("id", F.lit(-1)).alias("c"), F.col("t").alias("ct"), F.col("id").isNull().alias("cn")).distinct(), "jaccard-copies")
    own = rows.join(sized(copies), (F.coalesce("id", F.lit(-1)) == F.col("c")) & (F.col("th") == F.col("ct")) & (F.col("id").isNull() == F.col("cn")), "left_anti")
    # Of rows that repeat an id and its text one is left.
    twice = texts.where("most > 1").select(F.col("t").alias("twice"))
    if twice.limit(1).count():
        twice, again = sized(twice), F.col("th") == F.col("twice")
        own = own.join(twice, again, "left_anti").unionByName(own.join(twice, again, "left_semi").dropDuplicates(["id", "th"]))
    # Counts of shingles, and from them each node's first elements.
    sent = in_arrow(own.select("id", "th", "text"), _send(k, bits, parts, chunk_shingles), _SENT)
    asked = in_arrow(sent.repartitionById(parts, "route").sortWithinPartitions("part", "chunk"), _answer, _ANSWER)
    prefixes = materialize(in_arrow(asked.repartitionById(parts, "route").sortWithinPartitions("chunk", "part"), _lists(num, den), _LISTED), "jaccard-prefixes")
    some = prefixes.where(F.size("keys") > 0)
    groups = materialize(connected_components(_candidate_edges(some), "jaccard-candidates"), "jaccard-groups")
    wanted = own.join(sized(groups), F.col("id") == F.col("node")).select("component", "node", "text")
    sets = materialize(in_arrow(wanted, _sets(k, num, den), "component long, node long, n long, classes array<int>, s binary"), "jaccard-candidate-sets")
    large = materialize(sets.groupBy(F.col("component").alias("c")).agg(_blocks().alias("blocks")).where("blocks > 1").select("c"), "jaccard-large-groups")
    n_large = large.count()
    small = sets if not n_large else sets.join(sized(large), F.col("component") == F.col("c"), "left_anti")
    links = materialize(_searched(small, ["component"], num, den), "jaccard-links")
    if n_large:
        links = links.union(_large_groups(sets, large, some.select("node", "keys"), num, den))
    # Rows that share an id are one document, though their texts be different nodes.
    shared = named.where("id IS NOT NULL").groupBy(F.col("id").alias("i")).agg(F.min("th").alias("a"), F.max("th").alias("b")).where("a < b").select("i")
    shared = materialize(shared, "jaccard-shared-ids")
    if shared.limit(1).count():
        nodes = named.join(sized(shared), F.col("id") == F.col("i"), "left_semi").join(texts, F.col("th") == F.col("t")).select("id", F.col("first").alias("node")).distinct()
        least = nodes.groupBy(F.col("id").alias("g")).agg(F.min("node").alias("v"))
        links = links.union(nodes.join(least, F.col("id") == F.col("g")).where("node > v").select(F.col("node").alias("u"), "v"))
    linked = materialize(connected_components(links, "jaccard-joined"), "jaccard-components")
    release(sets, groups, copies)
    known = prefixes.select("th", "n").join(texts, F.col("th") == F.col("t")).select(F.col("t"), "n", "first", "n_rows")
    known = known.join(linked.withColumnRenamed("node", "w"), F.col("first") == F.col("w"), "left").select("t", "n", "first", "component", "n_rows")
    found = split_join(named, known, [("th", "t")], "n_rows", total)
    component = F.when(F.col("n") > 0, F.coalesce("component", "first")).otherwise(F.col("id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id: three-word shingles, similarity of 0.9 or more."""
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), k=3, num=9, den=10)
