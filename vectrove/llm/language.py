"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1.  A trigram's vector binds
(multiplies) its letters' vectors, each permuted (rotated) by its place; a
text's vector bundles (adds) those of its trigrams, and a language's prototype
bundles those of all its training texts.  A text gets the language whose
prototype has the greatest cosine with it.

Bundling is a sum, so a task adds up what it has read and a prototype is the
sum of the tasks' rows: training reads every labelled row and shuffles a few
vectors a task.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrove.llm._common import in_arrow, materialize, table

#: Length of a vector, and how many trigram vectors a worker keeps.
DIM, KEPT_VECTORS = 1024, 1 << 14
#: Bytes of prototypes that are compared with the documents in one pass over them.
MODEL_BYTES = 64 << 20
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=1 << 14)
def _letter_vector(code: int, dim: int) -> np.ndarray:
    return np.random.default_rng([code, dim]).integers(0, 2, dim, dtype=np.int8) * np.int8(2) - np.int8(1)


def _trigram_vector(code: int, dim: int) -> np.ndarray:
    a, b, c = code >> 42, (code >> 21) & 0x1FFFFF, code & 0x1FFFFF
    return np.roll(_letter_vector(a, dim), 2) * np.roll(_letter_vector(b, dim), 1) * _letter_vector(c, dim)


class Vectors:
    """Trigram vectors by row number.  Rows are filled as trigrams turn up; when
    there is no room for a text's new ones, the rows are begun anew."""

    def __init__(self, dim: int, room: int = KEPT_VECTORS):
        self.dim, self.row_of = dim, {}
        self.rows = np.empty((room, dim), np.float32)

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the trigrams' vectors, each times its count, in whole numbers."""
        out = np.zeros(self.dim)
        step = min(4096, len(self.rows))
        for lo in range(0, len(codes), step):
            part = codes[lo : lo + step].tolist()
            if len(self.row_of) + sum(c not in self.row_of for c in part) > len(self.rows):
                self.row_of.clear()
            for code in part:
                if code not in self.row_of:
                    self.row_of[code] = row = len(self.row_of)
                    self.rows[row] = _trigram_vector(code, self.dim)
            at = np.fromiter(map(self.row_of.__getitem__, part), np.int64, len(part))
            n = counts[lo : lo + step]
            # Single precision holds whole numbers up to 2**24.
            exact = np.float32 if n.sum() < 1 << 24 else np.float64
            out += n.astype(exact) @ self.rows[at].astype(exact, copy=False)
        return out


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct trigrams of the lower-cased letters and their counts; every run
    of other characters is one space, and the text stands between spaces."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32)
    keep = letter | np.concatenate([[True], letter[:-1]])
    codes = np.concatenate([[32], codes[keep], [32]] if codes[keep][-1] != 32 else [[32], codes[keep]])
    if codes[1] == 32:
        codes = codes[1:]
    return np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:], return_counts=True)


def fit_language_profiles(train: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM) -> DataFrame:
    """lang, v, n: by language its prototype and how many trigrams it bundles, from
    every row of ``train`` with a language and a letter.

    Trigram counts are added up per language within a task.  Vectors are summed
    in double precision, where whole numbers below 2**53 are exact, so that a
    prototype does not depend on the order of rows.  Repeated rows count each;
    rows without text or language not at all; an empty table gives no prototype.
    """

    def run(batches):
        held: dict[str, dict[int, int]] = {}
        sums: dict[str, np.ndarray] = {}
        vectors = Vectors(dim)

        def empty(lang):
            part = held.pop(lang)
            codes, counts = np.fromiter(part.keys(), np.int64, len(part)), np.fromiter(part.values(), np.int64, len(part))
            sums[lang] = sums.get(lang, 0) + np.append(vectors.bundle(codes, counts), counts.sum())

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = trigrams(text.as_py())
                if found is None:
                    continue
                part = held.setdefault(lang, {})
                for code, n in zip(found[0].tolist(), found[1].tolist()):
                    part[code] = part.get(code, 0) + n
                if len(part) > 1 << 17:
                    empty(lang)
        for lang in list(held):
            empty(lang)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (dim + 1)), pa.array(range(dim + 1), pa.int32()), pa.array(total)], names=["lang", "i", "x"])

    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    summed = in_arrow(rows, run, "lang string, i int, x double").groupBy("lang", "i").agg(F.sum("x").alias("x"))
    every = summed.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    return materialize(every.select("lang", F.slice("v", 1, dim).alias("v"), F.get("v", F.lit(dim)).alias("n")), "language-profiles")


def expected_cosine(n: np.ndarray | float, prototype: np.ndarray, n_prototype: float) -> np.ndarray | float:
    """The cosine that a text of n trigrams drawn from a language has with its prototype.

    With s the chance that two trigrams of the language are the same, n of them
    bundle to a squared length of n + n^2 s (times the dimension), of which n^2 s
    lies along the prototype.
    """
    s = max(0.0, (prototype @ prototype / len(prototype) - n_prototype) / max(1.0, n_prototype * (n_prototype - 1)))
    return np.sqrt(n * s / (1 + n * s))


def _pieces(model: DataFrame, dim: int, model_bytes: int):
    """The prototypes in the order of their names, as many at a time as ``model_bytes`` hold."""
    names, vectors, sizes = [], [], []
    for row in model.sort("lang").toLocalIterator():
        names.append(row["lang"])
        vectors.append(np.array(row["v"]))
        sizes.append(row["n"])
        if len(names) * 8 * dim >= model_bytes:
            yield names, np.stack(vectors), sizes
            names, vectors, sizes = [], [], []
    if names:
        yield names, np.stack(vectors), sizes


def identify_language(docs: DataFrame, model: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), dim: int = DIM, out: tuple[str, str, str] = ("lang_pred", "score", "expected"), model_bytes: int = MODEL_BYTES) -> DataFrame:
    """``keep`` columns plus, named by ``out``, the language predicted, the cosine
    with its prototype (0 where negative) and the cosine that a text of this
    length in that language is expected to have.

    Without a letter (null and empty texts too) or without a model a text is
    ``und`` with score 0.  Equal cosines give the language that sorts first.
    Texts are read whole; every row comes back, repeated ones alike; columns not
    named in ``keep`` are not read.  A model of more than ``model_bytes`` is
    compared piece by piece, in as many passes.
    """
    told = [T.StructField("__lang", T.StringType()), T.StructField("__score", T.DoubleType()), T.StructField("__expected", T.DoubleType())]
    kept = [docs.schema[c] for c in keep]
    rows = docs.select(*keep, F.lit(UNDETERMINED).alias("__lang"), F.lit(-2.0).alias("__score"), F.lit(0.0).alias("__expected"), F.col(text_col).alias("__text"))
    pieces = _pieces(model, dim, model_bytes)
    now = next(pieces, None)
    while now is not None:
        names, vectors, sizes = now
        now = next(pieces, None)
        length = np.linalg.norm(vectors, axis=1)
        unit = vectors / np.where(length > 0, length, 1)[:, None]
        n_out = len(keep) + 3 + (now is not None)  # texts go on while there are prototypes left

        def run(batches, names=names, vectors=vectors, sizes=sizes, unit=unit, n_out=n_out):
            made = Vectors(dim)
            for batch in batches:
                best = [batch.column(len(keep) + i).to_pylist() for i in range(3)]
                for i, value in enumerate(batch.column(len(keep) + 3)):
                    found = trigrams(value.as_py())
                    if found is None:
                        continue
                    v = made.bundle(*found)
                    cos = unit @ v / (np.linalg.norm(v) or 1)
                    at = int(np.argmax(cos))
                    if cos[at] > best[1][i]:
                        best[0][i], best[1][i], best[2][i] = names[at], float(cos[at]), float(expected_cosine(float(found[1].sum()), vectors[at], sizes[at]))
                columns = [*batch.columns[: len(keep)], *(pa.array(x, k) for x, k in zip(best, (pa.string(), pa.float64(), pa.float64()))), batch.column(len(keep) + 3)]
                yield pa.RecordBatch.from_arrays(columns[:n_out], names=batch.schema.names[:n_out])

        rows = in_arrow(rows, run, T.StructType([*kept, *told, T.StructField("__text", T.StringType())][:n_out]))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("__score")))
    return rows.select(*keep, F.col("__lang").alias(out[0]), score.alias(out[1]), F.col("__expected").alias(out[2]))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, expected; learned from the documents not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = fit_language_profiles(docs.where(~held))
    return identify_language(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "expected")
