"""Byte-level BPE encoding and decoding with the tiktoken library.

The ranks come from a local file.  A long text is cut before it reaches the
library, at places where the pre-splitting pattern has a boundary whatever
stands further left or right, so that the ids are those of the uncut text and
the memory for one call is bounded.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrove.llm._common import in_arrow, table, text_or_empty

#: Texts longer than this many code points go to the library in pieces of about this length.
PIECE_CHARS = 1 << 16


@lru_cache(maxsize=4)
def load_encoding(ranks_path: str | None = None, pattern: str | None = None):
    import public_tokenizers
    import tiktoken

    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local_ranks", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Places where every match of the pattern ends, whatever stands further left or
#: right: before a space or line end that follows anything but white space (no
#: alternative goes on into white space), and between a sentence mark and a letter
#: of scripts that write no spaces (no alternative holds both).  Characters whose
#: class differs between versions of Unicode, or between libraries, are left out.
_BOUNDARY = r"[^\s\x1c-\x1f\x85\u180e\u200b\u2060\ufeff](?=[ \n\r\t])|[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f](?=[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5])"


@lru_cache(maxsize=1)
def _boundary():
    import regex

    return regex.compile(_BOUNDARY)


def safe_pieces(text: str, limit: int = PIECE_CHARS) -> list[str]:
    """Cut ``text`` at the first safe boundary after every ``limit`` code points.

    The search runs forward, so its time is linear in the text.  What holds no
    boundary (a run of letters without spaces or sentence marks) stays whole:
    it is one pre-token, which the pattern does not split either.
    """
    if len(text) <= limit:
        return [text]
    pieces, start, search = [], 0, _boundary().search
    while len(text) - start > limit and (found := search(text, start + limit - 1)):
        pieces.append(text[start : found.end()])
        start = found.end()
    pieces.append(text[start:])
    return pieces


def encode_text(encoding, text: str, limit: int = PIECE_CHARS) -> np.ndarray:
    parts = [encoding.encode_to_numpy(p, disallowed_special=()) for p in safe_pieces(text, limit)]
    ids = parts[0] if len(parts) == 1 else np.concatenate(parts)
    return np.asarray(ids, dtype="<u4")


def bpe_encode(docs: DataFrame, text_col: str = "text", ranks_path: str | None = None, keep: tuple[str, ...] = ("doc_id",), digests: bool = False) -> DataFrame:
    """``keep`` columns plus ``ids`` array<int>; a null text is an empty one.

    With ``digests`` the ids and the decoded bytes stay on the worker and their
    SHA-256 sums come back instead (n_tokens, ids_sha256, decoded_sha256).
    Empty texts give no ids; texts are encoded whole, long ones piece by piece;
    repeated rows and null ids come back each; other columns of ``docs`` are not
    read, and an empty table gives no rows.
    """
    keep_types = [docs.schema[c] for c in keep]
    made = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] if digests else [T.StructField("ids", T.ArrayType(T.IntegerType()))]

    def run(batches):
        enc = load_encoding(ranks_path)
        for batch in batches:
            texts, out = batch.column(len(keep)), []
            for value in texts:
                ids = encode_text(enc, value.as_py())
                if digests:
                    out.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(enc.decode_bytes(ids.tolist())).hexdigest()))
                else:
                    out.append((ids.astype(np.int32),))
            columns = list(zip(*out)) if out else [()] * len(made)
            types = [pa.int64(), pa.string(), pa.string()] if digests else [pa.list_(pa.int32())]
            arrays = [batch.column(i) for i in range(len(keep))] + [pa.array(list(c), type=t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *(f.name for f in made)])

    return in_arrow(docs.select(*keep, text_or_empty(text_col).alias("__text")), run, T.StructType([*keep_types, *made]))


def bpe_decode(encoded: DataFrame, ids_col: str = "ids", ranks_path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus ``decoded`` binary: the raw bytes of the ids, which
    need not be valid UTF-8 (null ids: no bytes)."""
    fields = [*(encoded.schema[c] for c in keep), T.StructField("decoded", T.BinaryType())]

    def run(batches):
        enc = load_encoding(ranks_path)
        for batch in batches:
            raw = [enc.decode_bytes(x.as_py() or []) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(raw, type=pa.binary())], names=[*keep, "decoded"])

    return in_arrow(encoded.select(*keep, F.col(ids_col).alias("__ids")), run, T.StructType(fields))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return bpe_encode(table(spark, sf_dir, "documents"), digests=True)
