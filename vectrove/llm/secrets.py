"""Secret scans of whole texts.

Fixed patterns find assignments, access keys and hex strings.  The method adds
*novel* spans: an opaque-looking string in a sensitive context is compressed by
Zstandard together with the code around it, the compressor primed with a
dictionary of identifiers: those that stand most often around such strings in the
corpus itself, counted over all documents, and a short list of common ones.  The bytes it costs beyond the context alone are its
marginal size, which is held against that of random strings of the same length
and alphabet in its place: words, paths and identifiers cost less, keys as much.
"""

from __future__ import annotations

import random
import re
import string
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrove.llm._common import table, text_or_empty

KINDS = ("assign", "access", "hex", "novel")

# Keywords are matched in either case, in ASCII only.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# A maximal run that is too short never holds a longer match, so the lower bound can stand in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: What may be a secret, and what has to stand shortly before it.
_OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_SENSITIVE = re.compile(r"auth|bearer|credential|private|signature|session|cookie|client|passw|pwd|secret|token|access|api|key", re.IGNORECASE | re.ASCII)

#: Code points before a candidate that make its context sensitive, code points of surrounding text on either side, share of a random string's marginal bytes from which it is reported, and random strings drawn for each candidate.
NEAR, AROUND, NOVELTY, DRAWS = 48, 256, 0.85, 4

#: What keys are written in, the smallest first; signs of a string are added to the first that holds the rest of it.
ALPHABETS = tuple(map(frozenset, (string.digits, "0123456789abcdef", "0123456789ABCDEF", string.ascii_lowercase, string.ascii_uppercase, string.digits + string.ascii_lowercase, string.digits + string.ascii_uppercase, string.ascii_letters, string.digits + string.ascii_letters)))

# Common identifiers of source code and configuration files: what a string has to be unlike.
IDENTIFIERS = (
    "access account action address admin api app application args array async auth authorization backend base64 bearer body bool boolean buffer "
    "bytes cache callback catch certificate class client cluster code collection column command commit config configuration connection const "
    "constructor content context control cookie count create credential data database date debug decode default delete description dict directory "
    "domain download email enable encode endpoint entry environment error event example exception execute export extends false field file filter "
    "float format from function generate get handler hash header hidden host html http https id image implements import index info init input "
    "instance int integer interface internal item json key label length level library license limit line link list load local localhost log login "
    "long main manager map max memory message metadata method min model module name namespace network new node null number object offset option "
    "order output package page param parameter parse password path pattern payload pipeline plugin port prefix print private process project "
    "property protected protocol provider proxy public query queue random range read record redirect register release remote remove render "
    "replace repository request require reset resource response result return role root route row run sample schema scope script search secret "
    "section select self send sequence server service session set setting signature size socket source start state static status storage string "
    "struct style suffix system table tag target task template test text thread time timeout timestamp title token total trace transaction true "
    "type undefined unit update upload url user username util uuid valid validate value variable vector version view void warning web while "
    "width window with worker write xml year zone ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789 "
)
# Constants and camel case are written of the same words.
IDENTIFIERS = IDENTIFIERS.upper().replace(" ", "_") + IDENTIFIERS.title().replace(" ", "") + IDENTIFIERS


#: Identifiers of the corpus in the dictionary at most, and documents in which one has to stand.
CORPUS_WORDS, MIN_DOCS = 4096, 3
#: Shorter than any candidate, so that no candidate is a word of the dictionary.
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{2,18}")


@lru_cache(maxsize=2)
def _compressor(words: str):
    import zstandard

    dictionary = zstandard.ZstdCompressionDict(words.encode("utf-8", "surrogatepass"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(level=3)
    return zstandard.ZstdCompressor(level=3, dict_data=dictionary)


def _size(text: str, words: str = IDENTIFIERS) -> int:
    return len(_compressor(words).compress(text.encode("utf-8", "surrogatepass")))


def marginal_bytes(text: str, start: int, end: int, around: int = AROUND, words: str = IDENTIFIERS) -> int:
    """Compressed bytes that text[start:end] adds to the text on its two sides."""
    before, after = text[max(0, start - around) : start], text[end : end + around]
    return _size(before + text[start:end] + after, words) - _size(before + after, words)


def random_likeness(text: str, start: int, end: int, words: str = IDENTIFIERS) -> float:
    """Marginal bytes of text[start:end] as a share of what random strings of its length and alphabet cost in its place."""
    word = text[start:end]
    used = set(word)
    signs = used - ALPHABETS[-1]
    symbols = sorted(next(a for a in ALPHABETS if used - signs <= a) | signs)
    r = random.Random(word)  # the same draws for the same string
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    none = _size(before + after, words)
    drawn = sum(_size(before + "".join(r.choices(symbols, k=len(word))) + after, words) for _ in range(DRAWS)) / DRAWS
    return (_size(before + word + after, words) - none) / max(drawn - none, 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, in code points, per kind leftmost and without overlap."""
    spans = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    spans += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    spans += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(spans, key=_order)


def candidates(text: str):
    """(start, end) of the opaque strings in a sensitive context."""
    for m in _OPAQUE.finditer(text):
        if _SENSITIVE.search(text, max(0, m.start() - NEAR), m.start()):
            yield m.span()


def novel_spans(text: str, taken: list[tuple[str, int, int]], novelty: float = NOVELTY, words: str = IDENTIFIERS) -> list[tuple[str, int, int]]:
    """Incompressible strings in a sensitive context that no base span (``taken``, by start) overlaps."""
    found, starts, ends = [], [], []
    for _, a, b in taken:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for start, end in candidates(text):
        before = bisect_left(starts, end) - 1  # the last base span that begins before the candidate's end
        if before >= 0 and ends[before] > start:
            continue
        if random_likeness(text, start, end, words) >= novelty:
            found.append(("novel", start, end))
    return found


def corpus_identifiers(docs: DataFrame, text_col: str = "text", most: int = CORPUS_WORDS) -> str:
    """The dictionary's words: the common list, after the up to ``most``
    identifiers that stand near candidates in the most documents (MIN_DOCS at
    least, ties by word), the most frequent ones last."""

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                text, near = value.as_py(), set()
                for start, end in candidates(text):
                    for part in (text[max(0, start - AROUND) : start], text[end : end + AROUND]):
                        near.update(_IDENTIFIER.findall(part))
                held.update(near)
            if len(held) > 1 << 17:
                yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())})
                held = Counter()
        if held:
            yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())})

    some = docs.select(F.col(text_col).alias("text")).where(F.col("text").rlike(_OPAQUE.pattern))
    counted = some.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_DOCS)
    found = [r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(most).collect()]
    return "".join(f"{w} " for w in reversed(found)) + IDENTIFIERS


def _order(span: tuple[str, int, int]) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


_SPAN = "array<struct<kind:string,start:long,end:long>>"


def secret_scan(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), novelty: float = NOVELTY, words: str | None = None) -> DataFrame:
    """``keep`` columns plus ``base`` and ``novel``, arrays of (kind, start, end) spans.

    One row per input row, repeated rows and null ids included; a null or empty
    text has no spans; texts are scanned whole; columns not named in ``keep`` are
    not read, so they may have any name.  Base spans that begin together stand in
    the order of the kinds.  ``words`` is the dictionary, made from ``docs``
    unless given; of an empty table it is the common list alone.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    words = corpus_identifiers(docs, text_col) if words is None else words

    def run(batches):
        for batch in batches:
            base, novel = [], []
            for value in batch.column(len(keep)):
                text = value.as_py()
                b = base_spans(text)
                base.append([dict(zip(("kind", "start", "end"), s)) for s in b])
                novel.append([dict(zip(("kind", "start", "end"), s)) for s in novel_spans(text, b, novelty, words)])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(base, span), pa.array(novel, span)], names=[*keep, "base", "novel"])

    kept = T.StructType([docs.schema[c] for c in keep])
    return docs.select(*keep, text_or_empty(text_col).alias("__text")).mapInArrow(run, T.StructType([*kept.fields, *T._parse_datatype_string(f"base {_SPAN}, novel {_SPAN}").fields]))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts by kind, a digest of the base spans, and all spans as text."""
    found = secret_scan(table(spark, sf_dir, "documents"))

    def text(s: Column) -> Column:
        return F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))

    def number(spans: str, kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    # Base spans are in order; no novel one begins where a base one does.
    placed = F.concat(F.transform("base", lambda s, i: F.struct(s["start"].alias("at"), i.alias("i"), text(s).alias("t"))), F.transform("novel", lambda s, i: F.struct(s["start"].alias("at"), i.alias("i"), text(s).alias("t"))))
    return found.select(
        "doc_id",
        *(number("base", kind).alias(f"n_{kind}") for kind in KINDS[:3]),
        F.size("novel").cast("long").alias("n_novel"),
        F.sha2(F.array_join(F.transform("base", text), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform(F.sort_array(placed), lambda s: s["t"]), ",").alias("spans"),
    )
