"""Cross-entropy difference of documents between a target and a background
language model.

Both are word bigram models of one form: the same words, the same vocabulary
(the words of all texts), the same smoothing; only the texts they count differ.
A document's score is its mean loss per token under the target model less that
under the background model: the lower, the more it reads like the target.

``score_counted_texts`` scores the texts that it counts, by words and pairs
counted each for itself in tables that are spread over the cluster and grow with
the corpus.  A task sends the different words and pairs of a chunk of documents
to the parts that add them up, and each chunk gets back the counts it asked for.
However frequent a word, a chunk sends it once.  Keys are hashes of 64 bits.

``fit_models`` and ``cross_entropy_difference`` are for models small enough to be
broadcast: they count by hashed slots, in tables of a size that the caller sets.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrove.llm._common import table, text_or_empty
from vectrove.llm._packed import pack, pack_keys, unpack, unpack_keys

#: Slots (as powers of two) for words and for word pairs, slots to a chunk, and the weight of the word model in the pair model.
WORD_BITS, PAIR_BITS, CHUNK, PRIOR = 18, 21, 1 << 13, 20.0
#: Target ids up to which their table is broadcast (16 bytes each).
BROADCAST_IDS = 1 << 20
#: Tokens to a chunk of documents (a longer text is one by itself), and characters of text to each part of the exact counts.
CHUNK_TOKENS, PART_CHARS = 1 << 21, 1 << 24

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


@lru_cache(maxsize=1 << 17)
def _word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def _pair_key(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    pair = (before * _A) ^ (h + (before >> np.uint64(29)))
    return (pair ^ (pair >> np.uint64(32))) * _B


def slots(text: str, word_bits: int = WORD_BITS, pair_bits: int = PAIR_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Word slot and pair slot of every token; the first token pairs with the start of the text."""
    h = np.array([_word_hash(w) for w in text.encode("utf-8", "surrogatepass").lower().split()], np.uint64)
    before = np.concatenate([np.zeros(1, np.uint64), h[:-1]]) if len(h) else h
    pair = _pair_key(before, h)
    return (h >> np.uint64(64 - word_bits)).astype(np.int64), (pair >> np.uint64(64 - pair_bits)).astype(np.int64)


_COUNTS = pa.schema([("tab", pa.int32()), ("chunk", pa.int32()), ("at", pa.binary()), ("target", pa.binary()), ("background", pa.binary())])


def _count(word_bits: int, pair_bits: int):
    def run(batches):
        counts = [np.zeros((2, 1 << bits), np.int64) for bits in (word_bits, pair_bits)]
        for batch in batches:
            for is_target, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                for held, at in zip(counts, slots(value.as_py(), word_bits, pair_bits)):
                    for side in (0, 1) if is_target else (1,):
                        np.add.at(held[side], at, 1)
        for tab, held in enumerate(counts):
            for chunk, lo in enumerate(range(0, held.shape[1], CHUNK)):
                part = held[:, lo : lo + CHUNK]
                at = np.flatnonzero(part[1])
                if len(at):
                    kind = "<u4" if part.max() < 1 << 32 else "<u8"
                    yield pa.RecordBatch.from_pylist([{"tab": tab, "chunk": chunk, "at": at.astype("<u2").tobytes(), "target": part[0, at].astype(kind).tobytes(), "background": part[1, at].astype(kind).tobytes()}], schema=_COUNTS)

    return run


def _add(batches):
    """Rows come sorted by (tab, chunk); each chunk's counts are added up."""
    key, total = None, None

    def close():
        return pa.RecordBatch.from_pylist([{"tab": key[0], "chunk": key[1], "target": total[0].astype("<f4").tobytes(), "background": total[1].astype("<f4").tobytes()}], schema=pa.schema([("tab", pa.int32()), ("chunk", pa.int32()), ("target", pa.binary()), ("background", pa.binary())]))

    for batch in batches:
        for row in batch.to_pylist():
            if (row["tab"], row["chunk"]) != key:
                if key is not None:
                    yield close()
                key, total = (row["tab"], row["chunk"]), np.zeros((2, CHUNK), np.int64)
            at = np.frombuffer(row["at"], "<u2")
            for side, name in enumerate(("target", "background")):
                total[side, at] += np.frombuffer(row[name], f"<u{len(row[name]) // len(at)}").astype(np.int64)
    if key is not None:
        yield close()


def fit_models(docs: DataFrame, text_col: str, target_col: str, word_bits: int = WORD_BITS, pair_bits: int = PAIR_BITS) -> list[np.ndarray]:
    """[words, pairs]: counts by slot, row 0 of the texts where ``target_col`` is true, row 1 of all texts."""
    rows = docs.select(F.coalesce(F.col(target_col), F.lit(False)).alias("target"), text_or_empty(text_col).alias("text"))
    counted = rows.mapInArrow(_count(word_bits, pair_bits), "tab int, chunk int, at binary, target binary, background binary")
    summed = counted.repartition("tab", "chunk").sortWithinPartitions("tab", "chunk").mapInArrow(_add, "tab int, chunk int, target binary, background binary")
    model = [np.zeros((2, 1 << bits), np.float32) for bits in (word_bits, pair_bits)]
    for row in summed.collect():  # bounded by the slots: 8 bytes each
        lo = row["chunk"] * CHUNK
        for side, name in enumerate(("target", "background")):
            part = np.frombuffer(row[name], "<f4")
            room = model[row["tab"]][side, lo : lo + CHUNK]
            room[:] = part[: len(room)]
    return model


def losses(words: np.ndarray, pairs: np.ndarray, model: list[np.ndarray]) -> np.ndarray:
    """Mean negative log probability per token, under the target and the background model."""
    out = np.empty(2)
    n_slots = model[0].shape[1]
    for side in (0, 1):
        total = float(model[0][side].sum(dtype=np.float64))
        one = model[0][side, words].astype(np.float64)
        p_word = (one + 1.0) / (total + n_slots)
        before = np.concatenate([[0.0], one[:-1]])  # the count of the word before; the start of a text has the word model alone
        seen = np.minimum(model[1][side, pairs], before)
        out[side] = -np.log((seen + PRIOR * p_word) / (before + PRIOR)).mean()
    return out


def cross_entropy_difference(docs: DataFrame, model: list[np.ndarray], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus n_tokens, target_loss, background_loss, score.

    A text without words (null and empty ones too) has no tokens and null
    losses and score.  Every row comes back; other columns are not read.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    word_bits, pair_bits = (int(m.shape[1]).bit_length() - 1 for m in model)
    kinds = (pa.int64(), pa.float64(), pa.float64(), pa.float64())

    def run(batches):
        held = sent.value
        for batch in batches:
            rows = []
            for value in batch.column(len(keep)):
                words, pairs = slots(value.as_py(), word_bits, pair_bits)
                if len(words):
                    target, background = losses(words, pairs, held).tolist()
                    rows.append((len(words), target, background, target - background))
                else:
                    rows.append((0, None, None, None))
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names=[*keep, "n_tokens", "target_loss", "background_loss", "score"])

    made = T._parse_datatype_string("n_tokens long, target_loss double, background_loss double, score double").fields
    return docs.select(*keep, text_or_empty(text_col).alias("__text")).mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), *made]))


class _Ids(dict):
    """Numbers words in the order they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _pairs_of(keys: np.ndarray, tokens: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pair keys in order, for each pair its place among them, and which tokens have a word before them."""
    inner = np.ones(len(tokens), bool)
    inner[(np.cumsum(lens) - lens)[lens > 0]] = False
    at = np.flatnonzero(inner)
    different, place = np.unique(_pair_key(keys[tokens[at - 1]], keys[tokens[at]]), return_inverse=True)
    return different, place, at


_VOCABULARY = "part int, words binary, n_target long, n_all long"
_SENT = "route long, part int, chunk long, words binary, word_target binary, word_all binary, pairs binary, pair_target binary, pair_all binary, kept binary"
_ANSWER = "chunk long, part int, words binary, word_target binary, word_all binary, pairs binary, pair_target binary, pair_all binary, kept binary"


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def _words(parts: int, chunk_tokens: int):
    """Of each chunk of documents: its different words by part; its numbers of tokens in the first row."""

    def close(seen, n):
        import xxhash

        keys = np.sort(np.fromiter(map(xxhash.xxh64_intdigest, seen), np.uint64, len(seen)))
        of = np.searchsorted(_part_of(keys, parts), np.arange(parts + 1))
        rows = [{"part": part, "words": pack_keys(keys[of[part] : of[part + 1]]), "n_target": 0, "n_all": 0} for part in range(parts) if of[part] < of[part + 1]]
        rows[0] |= {"n_target": n[0], "n_all": n[1]}
        return pa.RecordBatch.from_pylist(rows, schema=_arrow_schema(_VOCABULARY))

    def run(batches):
        seen, n, since = set(), [0, 0], 0
        for batch in batches:
            for is_target, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = value.as_py().encode("utf-8", "surrogatepass").lower().split()
                seen.update(words)
                n[0] += is_target and len(words)
                n[1] += len(words)
                since += len(words)
                if since >= chunk_tokens:
                    yield close(seen, n)
                    seen, n, since = set(), [0, 0], 0
        if seen:
            yield close(seen, n)

    return run


def _count_words(batches):
    """Rows come sorted by part: the number of different words of each, and of all tokens."""

    def close(part, held, n):
        return pa.RecordBatch.from_pylist([{"part": part, "n_words": len(np.unique(np.concatenate(held))), "n_target": n[0], "n_all": n[1]}], schema=_arrow_schema("part int, n_words long, n_target long, n_all long"))

    part, held, n = None, [], [0, 0]
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != part and held:
                yield close(part, held, n)
                held, n = [], [0, 0]
            part = row["part"]
            held.append(unpack_keys(row["words"]))
            n = [n[0] + row["n_target"], n[1] + row["n_all"]]
    if held:
        yield close(part, held, n)


def _send(parts: int, n_keep: int, chunk_tokens: int):
    """Of each chunk of documents: a row with its tokens, and a row for each part that counts some of its words or pairs."""

    def close(chunk, ids, tokens, lens, targets, kept):
        import xxhash

        hashes = np.fromiter(map(xxhash.xxh64_intdigest, ids), np.uint64, len(ids))
        keys, rank = np.unique(hashes, return_inverse=True)
        tokens = rank[np.concatenate(tokens)] if tokens else np.zeros(0, np.int64)
        lens = np.array(lens, np.int64)
        good = np.repeat(np.array(targets, bool), lens)
        pairs, place, at = _pairs_of(keys, tokens, lens)
        sink = pa.BufferOutputStream()
        held = pa.Table.from_batches(kept)
        with pa.ipc.new_stream(sink, held.schema) as out:
            out.write_table(held)
        rows = [{"route": chunk % 1_000_003 % parts, "part": -1, "chunk": chunk, "words": pack_keys(keys), "word_all": pack(tokens), "pair_all": pack(lens), "kept": sink.getvalue().to_pybytes()}]
        made = []
        for different, place in ((keys, tokens), (pairs, place)):
            of = np.searchsorted(_part_of(different, parts), np.arange(parts + 1))
            made.append((different, np.bincount(place[good if different is keys else good[at]], minlength=len(different)), np.bincount(place, minlength=len(different)), of))
        for part in range(parts):
            if all(of[part] == of[part + 1] for *_, of in made):
                continue
            row = {"route": part, "part": part, "chunk": chunk}
            for name, (different, target, every, of) in zip(("word", "pair"), made):
                a, b = of[part], of[part + 1]
                row |= {f"{name}s": pack_keys(different[a:b]), f"{name}_target": pack(target[a:b]), f"{name}_all": pack(every[a:b])}
            rows.append(row)
        return pa.RecordBatch.from_pylist(rows, schema=_arrow_schema(_SENT))

    def run(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        fresh = lambda: (_Ids(), [], [], [], [])
        (ids, tokens, lens, targets, kept), n = fresh(), 0
        for batch in batches:
            rest = pa.RecordBatch.from_arrays(batch.columns[:n_keep], schema=pa.schema(list(batch.schema)[:n_keep]))
            done = 0
            for i, (is_target, value) in enumerate(zip(batch.column(n_keep).to_pylist(), batch.column(n_keep + 1)), 1):
                words = value.as_py().encode("utf-8", "surrogatepass").lower().split()
                tokens.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
                lens.append(len(words))
                targets.append(is_target)
                n += len(words)
                if n >= chunk_tokens:
                    yield close(chunk, ids, tokens, lens, targets, [*kept, rest.slice(done, i - done)])
                    (ids, tokens, lens, targets, kept), n, done, chunk = fresh(), 0, i, chunk + 1
            if done < batch.num_rows:
                kept.append(rest.slice(done))
        if lens:
            yield close(chunk, ids, tokens, lens, targets, kept)

    return run


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Rises with the key, so that the keys of a part stand together."""
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _answer(batches):
    """Rows come sorted by (part, chunk): a part adds up what all chunks sent, and answers each of them."""
    schema = _arrow_schema(_ANSWER)

    def close(part, held):
        rows = [{"chunk": r["chunk"], "part": part} for r in held]
        for name in ("word", "pair"):
            keys = [unpack_keys(r[f"{name}s"]) for r in held]
            ends = np.cumsum([len(k) for k in keys])[:-1]
            different, place = np.unique(np.concatenate(keys), return_inverse=True)
            for side in ("target", "all"):
                # Sums of whole numbers, exact in doubles up to 2^53.
                total = np.bincount(place, np.concatenate([unpack(r[f"{name}_{side}"]) for r in held]), len(different)).astype(np.int64)
                for row, counts in zip(rows, np.split(total[place], ends)):
                    row[f"{name}_{side}"] = pack(counts)
        for lo in range(0, len(rows), 64):
            yield pa.RecordBatch.from_pylist(rows[lo : lo + 64], schema=schema)

    part, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] < 0:
                yield pa.RecordBatch.from_pylist([{k: v for k, v in row.items() if k != "route"}], schema=schema)
                continue
            if row["part"] != part and held:
                yield from close(part, held)
                held = []
            part = row["part"]
            held.append(row)
    if held:
        yield from close(part, held)


def _score(n_words: int, totals: tuple[int, int]):
    """Rows come sorted by (chunk, part): a chunk's tokens, then what its parts answered in the order of the keys."""

    def close(body, answers):
        keys, tokens, lens = unpack_keys(body["words"]), unpack(body["word_all"]), unpack(body["pair_all"])
        pairs, place, at = _pairs_of(keys, tokens, lens)
        counts = lambda name: np.concatenate([np.zeros(0, np.int64), *(unpack(r[name]) for r in answers)])
        loss = []
        (one_target, both_target), (one_all, both_all) = ((counts(f"word_{side}"), counts(f"pair_{side}")) for side in ("target", "all"))
        # The background is all other texts.
        for one, both, total in ((one_target, both_target, totals[0]), (one_all - one_target, both_all - both_target, totals[1] - totals[0])):
            if len(one) != len(keys) or len(both) != len(pairs):
                raise RuntimeError("a chunk of documents lacks counts it asked for")
            one = one[tokens].astype(np.float64)
            p_word = (one + 1.0) / (total + n_words)
            before, seen = np.zeros(len(tokens)), np.zeros(len(tokens))  # the start of a text has the word model alone
            before[at], seen[at] = one[at - 1], both[place]
            each = -np.log((seen + PRIOR * p_word) / (before + PRIOR))
            some = np.flatnonzero(lens > 0)
            mean = np.zeros(len(lens))
            if len(some):
                mean[some] = np.add.reduceat(each, (np.cumsum(lens) - lens)[some]) / lens[some]
            loss.append(mean)
        none = lens == 0
        kept = pa.ipc.open_stream(body["kept"]).read_all().combine_chunks()
        made = [pa.array(lens), *(pa.array(v, pa.float64(), mask=none) for v in (*loss, loss[0] - loss[1]))]
        return pa.table([*kept.columns, *made], names=[*kept.column_names, "n_tokens", "target_loss", "background_loss", "score"]).to_batches()

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


def score_counted_texts(docs: DataFrame, text_col: str = "text", target_col: str = "__target", keep: tuple[str, ...] = ("doc_id",), parts: int | None = None, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """``keep`` columns plus n_tokens, target_loss, background_loss, score, under models of the texts of ``docs`` themselves.

    The target model counts the rows where ``target_col`` is true, the background
    model the others; both share the vocabulary of all rows.  A text without words
    (null and empty ones too) has no tokens and null losses and score.  Texts are
    read whole; repeated rows count each and come back each; an empty table gives
    no rows; columns of ``docs`` that are not in ``keep`` are not read.
    """
    rows = docs.select(*keep, F.coalesce(F.col(target_col), F.lit(False)).alias("__good"), text_or_empty(text_col).alias("__text"))
    if parts is None:
        parts = max(1, math.ceil((rows.agg(F.sum(F.length("__text"))).first()[0] or 0) / PART_CHARS))
    vocabulary = rows.select("__good", "__text").mapInArrow(_words(parts, chunk_tokens), _VOCABULARY).repartition(parts, "part").sortWithinPartitions("part")
    counted = vocabulary.mapInArrow(_count_words, "part int, n_words long, n_target long, n_all long")
    n_words, *totals = counted.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_words", "n_target", "n_all"))).first()
    sent = rows.mapInArrow(_send(parts, len(keep), chunk_tokens), _SENT)
    asked = sent.repartition(parts, "route").sortWithinPartitions("part", "chunk").mapInArrow(_answer, _ANSWER)
    made = T._parse_datatype_string("n_tokens long, target_loss double, background_loss double, score double").fields
    schema = T.StructType([*(docs.schema[c] for c in keep), *made])
    return asked.repartition(parts, "chunk").sortWithinPartitions("chunk", "part").mapInArrow(_score(n_words, tuple(totals)), schema)


def mark_targets(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with a boolean ``__target``: whether the id is one of ``ids`` (one column, any number of rows)."""
    found = ids.select(F.col(ids.columns[0]).alias("__t")).where("__t IS NOT NULL").distinct()
    found = F.broadcast(found) if found.count() <= BROADCAST_IDS else found.hint("shuffle_hash")
    return docs.join(found, F.col(id_col) == F.col("__t"), "left").withColumn("__target", F.col("__t").isNotNull()).drop("__t")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of every document;
    the target is the documents labelled of good quality, the background the others."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return score_counted_texts(mark_targets(docs, good))
