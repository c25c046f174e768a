"""Token counts of documents under a byte-level BPE vocabulary.

Pieces are counted once per distinct pre-token.  Three steps, two shuffles:

1. Each task cuts its documents into blocks and writes, per block and hash
   bucket of pre-tokens, the block's distinct pre-tokens of that bucket and the
   frequencies of each in the block's documents.  A frequent pre-token is one
   entry a block however often it occurs, so no bucket is hot.
2. A bucket sees all entries of its pre-tokens.  It asks the tokenizers library
   for the number of pieces of each distinct pre-token, joins it to the
   frequencies and adds up per document of the block, which gives one sparse
   row of sums per block and bucket.
3. The sums of a block meet and give its documents' totals.

Ids are never made, and what moves is at most a few bytes per distinct
(document, pre-token) pair.
"""

from __future__ import annotations

import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrove.llm._common import shuffle_partitions, table, text_or_empty

#: Bounds of a block: documents (an index has 16 bits) and code points.
BLOCK_DOCS, BLOCK_CHARS = 1 << 15, 12_000_000
#: Below this code point the regex module and the library split alike (checked code point by code point in the tests).
SAME_SPLIT_BELOW = 0x558
#: Pre-tokens whose piece counts a worker keeps at once.
MEMO = 1 << 19


class PreTokenizer:
    """Splits as the tokenizer's file says: special strings first, each one token by itself, then the library's own pre-tokenizer on what lies between."""

    def __init__(self, path: str | None):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        path = path or public_tokenizers.path("byte_bpe_50k.json")
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("this operator counts for byte-level BPE without normalizer or prefix space")
        added = spec.get("added_tokens") or []
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in added):
            raise ValueError("added tokens with strip, word or normalizing rules are not supported")
        special = sorted((a["content"] for a in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.findall = regex.compile(public_tokenizers.PATTERN).findall
        self.unusual = regex.compile(f"[^\\x00-\\u{SAME_SPLIT_BELOW - 1:04x}]").search

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of ``text`` and the number of special strings in it."""
        if self.special is None or not self.special.search(text):
            return self._ordinary(text), 0
        parts = self.special.split(text)
        return [w for p in parts if p for w in self._ordinary(p)], len(parts) - 1

    def _ordinary(self, text: str) -> list[str]:
        if text.isascii() or not self.unusual(text):
            return self.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def count_pieces(self, words: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]


@lru_cache(maxsize=2)
def pre_tokenizer(path: str | None) -> PreTokenizer:
    return PreTokenizer(path)


_BLOCKS = pa.schema([("bucket", pa.int32()), ("block", pa.string()), ("words", pa.list_(pa.string())), ("lengths", pa.binary()), ("postings", pa.binary()), ("ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("special", pa.list_(pa.int64()))])
_BLOCKS_DDL = "bucket int, block string, words array<string>, lengths binary, postings binary, ids array<long>, n_bytes array<long>, special array<long>"


def _blocks(path: str | None, n_buckets: int):
    """Step 1. A posting is the document's index in 16 bits and a frequency in 16."""

    def close(name, ids, sizes, special, found):
        yield {"bucket": zlib.crc32(name.encode()) % n_buckets, "block": name, "words": None, "lengths": None, "postings": None, "ids": ids, "n_bytes": sizes, "special": special}
        dealt: list[list[str]] = [[] for _ in range(n_buckets)]
        for word in found:
            dealt[zlib.crc32(word.encode("utf-8", "surrogatepass")) % n_buckets].append(word)
        for b, words in enumerate(dealt):
            if words:
                lists = [found[w] for w in words]
                flat = np.fromiter((x for lst in lists for x in lst), dtype="<u4", count=sum(map(len, lists)))
                yield {"bucket": b, "block": name, "words": words, "lengths": np.fromiter(map(len, lists), "<u4", len(lists)).tobytes(), "postings": flat.tobytes(), "ids": None, "n_bytes": None, "special": None}

    def pack(rows):
        some, size = [], 0
        for row in rows:
            some.append(row)
            size += len(row["postings"] or b"")
            if len(some) >= 512 or size >= 4 << 20:
                yield pa.RecordBatch.from_pylist(some, schema=_BLOCKS)
                some, size = [], 0
        if some:
            yield pa.RecordBatch.from_pylist(some, schema=_BLOCKS)

    def run(batches):
        pre, part, seq = pre_tokenizer(path), TaskContext.get().partitionId(), 0
        ids, sizes, special, found, chars = [], [], [], {}, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                words, n_special = pre.split(text)
                at = len(ids) << 16
                for word, n in Counter(words).items():
                    if word not in found:
                        found[word] = []
                    while n > 0xFFFF:
                        found[word].append(at | 0xFFFF)
                        n -= 0xFFFF
                    found[word].append(at | n)
                ids.append(doc_id)
                sizes.append(len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass")))
                special.append(n_special)
                chars += len(text)
                if len(ids) >= BLOCK_DOCS or chars >= BLOCK_CHARS:
                    yield from pack(close(f"{part}.{seq}", ids, sizes, special, found))
                    ids, sizes, special, found, chars, seq = [], [], [], {}, 0, seq + 1
        if ids:
            yield from pack(close(f"{part}.{seq}", ids, sizes, special, found))

    return run


_SUMS = pa.schema([("block", pa.string()), ("docs", pa.binary()), ("sums", pa.binary()), ("ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("special", pa.list_(pa.int64()))])
_SUMS_DDL = "block string, docs binary, sums binary, ids array<long>, n_bytes array<long>, special array<long>"


def _sums(path: str | None):
    """Step 2: rows come sorted by bucket; a bucket's piece counts are kept while it lasts."""

    def run(batches):
        pre, known, bucket = pre_tokenizer(path), {}, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["words"] is None:
                    yield pa.RecordBatch.from_pylist([{"block": row["block"], "docs": None, "sums": None, "ids": row["ids"], "n_bytes": row["n_bytes"], "special": row["special"]}], schema=_SUMS)
                    continue
                if row["bucket"] != bucket or len(known) > MEMO:
                    known, bucket = {}, row["bucket"]
                words = row["words"]
                if new := [w for w in words if w not in known]:
                    known.update(zip(new, pre.count_pieces(new)))
                pieces = np.fromiter((known[w] for w in words), np.int64, len(words))
                posts = np.frombuffer(row["postings"], "<u4")
                totals = np.bincount(posts >> 16, weights=np.repeat(pieces, np.frombuffer(row["lengths"], "<u4")) * (posts & 0xFFFF))
                docs = np.flatnonzero(totals)
                yield pa.RecordBatch.from_pylist([{"block": row["block"], "docs": docs.astype("<u2").tobytes(), "sums": totals[docs].astype("<u4" if totals.max(initial=0) < 2**32 else "<u8").tobytes(), "ids": None, "n_bytes": None, "special": None}], schema=_SUMS)

    return run


def _totals(batches):
    """Step 3: rows come sorted by block, the one with the documents first."""
    ids = sizes = totals = None

    def close():
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    for batch in batches:
        for row in batch.to_pylist():
            if row["ids"] is not None:
                if ids is not None:
                    yield close()
                ids, sizes, totals = row["ids"], row["n_bytes"], np.array(row["special"], np.int64)
            else:
                docs = np.frombuffer(row["docs"], "<u2")
                totals[docs] += np.frombuffer(row["sums"], f"<u{len(row['sums']) // max(1, len(docs))}").astype(np.int64) if len(docs) else 0
    if ids is not None:
        yield close()


def token_counts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", tokenizer_path: str | None = None, n_buckets: int | None = None) -> DataFrame:
    """``id_col``, n_bytes, n_tokens per row of ``docs``.

    A null text is an empty one and has no tokens.  Ids may be null or repeat:
    rows are told apart by their place in a block.  Other columns are not read.
    ``n_buckets`` (the session's shuffle partitions unless given) sets how many
    parts the distinct pre-tokens are dealt to.
    """
    spark = docs.sparkSession
    n = n_buckets or shuffle_partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    blocks = rows.mapInArrow(_blocks(tokenizer_path, n), _BLOCKS_DDL)
    sums = blocks.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_sums(tokenizer_path), _SUMS_DDL)
    totals = sums.repartition(n, "block").sortWithinPartitions("block", F.col("docs").isNotNull())
    return totals.mapInArrow(_totals, "doc_id long, n_bytes long, n_tokens long").withColumnRenamed("doc_id", id_col)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    return token_counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 1024)
