"""SQL functions under names that Spark does not have, as SQL expressions that the optimizer inlines."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.pandas.functions import arrow_udf

# Signature and body of each function.
FUNCTIONS = {
    "starts_with": ("s STRING, p STRING", "BOOLEAN", "startswith(s, p)"),
    "ends_with": ("s STRING, p STRING", "BOOLEAN", "endswith(s, p)"),
    "strpos": ("s STRING, p STRING", "INT", "instr(s, p)"),
    "to_hex": ("n BIGINT", "STRING", "lower(hex(n))"),
    "string_to_array": ("s STRING, p STRING", "ARRAY<STRING>", "split(s, concat('\\\\Q', p, '\\\\E'))"),
    "sha256": ("s STRING", "STRING", "sha2(s, 256)"),
    "date_bin": ("width INTERVAL DAY TO SECOND, t TIMESTAMP, origin TIMESTAMP DEFAULT TIMESTAMP'1970-01-01 00:00:00'", "TIMESTAMP", "origin + width * floor((unix_micros(t) - unix_micros(origin)) / (extract(DAY FROM width) * 86400000000 + extract(HOUR FROM width) * 3600000000 + extract(MINUTE FROM width) * 60000000 + extract(SECOND FROM width) * 1000000))"),
    "to_unixtime": ("t TIMESTAMP", "BIGINT", "unix_seconds(t)"),
    "to_local_time": ("t TIMESTAMP", "TIMESTAMP_NTZ", "CAST(t AS TIMESTAMP_NTZ)"),
    "trunc_number": ("x DOUBLE, n INT DEFAULT 0", "DOUBLE", "sign(x) * floor(abs(x) * power(10, n)) / power(10, n)"),
}


# Names that differ from Spark's, where the arguments are the same.
RENAMED = {
    "make_array": "array",
    "make_list": "array",
    "array_has": "array_contains",
    "list_has": "array_contains",
    "array_has_any": "arrays_overlap",
    "list_has_any": "arrays_overlap",
    "array_cat": "concat",
    "array_concat": "concat",
    "list_concat": "concat",
    "array_element": "try_element_at",
    "list_element": "try_element_at",
    "array_to_string": "array_join",
    "list_to_string": "array_join",
    "array_length": "size",
    "approx_distinct": "approx_count_distinct",
    "approx_percentile_cont": "approx_percentile",
    "to_timestamp_seconds": "timestamp_seconds",
    "to_timestamp_millis": "timestamp_millis",
    "to_timestamp_micros": "timestamp_micros",
}

#: String literals, quoted names and comments, which stay as they are; or a name that is called.
_PARTS = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|(?<![\w.])([A-Za-z_]\w*)(?=\s*\()""", re.DOTALL)


#: As _PARTS; or a word or a bracket.
_TOKENS = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|([A-Za-z_]\w*|[()\[\];])""", re.DOTALL)
#: Words that end the condition of QUALIFY.
_AFTER_QUALIFY = ("ORDER", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "MINUS", "WINDOW")


def translated(text: str) -> str:
    """``text`` with the calls of RENAMED functions under Spark's names, and without QUALIFY."""

    def name(m: re.Match) -> str:
        return RENAMED.get(m[1].lower(), m[1]) if m[1] else m[0]

    text = _PARTS.sub(name, text)
    while (changed := _without_qualify(text)) is not None:
        text = changed
    return text


def _without_qualify(text: str) -> str | None:
    """The last QUALIFY of ``text`` as a filter around its query block; None if there is none.

    Its condition becomes one more column of the block.  What follows it (ORDER
    BY, LIMIT, set operations) sees the columns of the select list.
    """
    words, depth = [], 0  # (word, start, end, depth)
    for m in _TOKENS.finditer(text):
        if m[1]:
            depth -= m[1] in ")]"
            words.append((m[1].upper(), m.start(), m.end(), depth))
            depth += m[1] in "(["
    # A name may be called so too: QUALIFY as a clause follows something and is not behind a dot or AS.
    clauses = [i for i, (w, start, _, _) in enumerate(words) if w == "QUALIFY" and i and words[i - 1][0] not in ("AS", "SELECT") and not text[:start].rstrip().endswith((".", ","))]
    if not clauses:
        return None
    at = clauses[-1]
    level = words[at][3]
    begin = next((i for i in range(at, -1, -1) if words[i][0] == "SELECT" and words[i][3] == level), None)
    if begin is None:
        return None
    source = next((i for i in range(begin, at) if words[i][0] == "FROM" and words[i][3] == level and words[i - 1][0] != "DISTINCT"), None)
    if source is None:
        return None
    end = next((start for w, start, _, d in words[at + 1 :] if d < level or (d == level and (w in _AFTER_QUALIFY or w == ";"))), len(text))
    after = words[begin][2]
    distinct = words[begin + 1][0] == "DISTINCT" and words[begin + 1][3] == level
    if distinct:
        after = words[begin + 1][2]
    column = f"__qualify{at}"
    inner = f"SELECT{text[after : words[source][1]].rstrip()}, ({text[words[at][2] : end].strip()}) AS {column} {text[words[source][1] : words[at][1]].rstrip()}"
    outer = f"SELECT {'DISTINCT ' if distinct else ''}* EXCEPT ({column}) FROM ({inner}) WHERE {column} "
    return text[: words[begin][1]] + outer + text[end:]


def register_dialect(spark: SparkSession) -> None:
    """Define the functions for this session."""
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    for name, kernel in (("gcd", np.gcd), ("lcm", np.lcm)):
        spark.udf.register(name, arrow_udf(_pairwise(kernel), "bigint"))


def _pairwise(kernel):
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        known = np.array(a.is_valid()) & np.array(b.is_valid())
        x, y = (np.asarray(c.cast(pa.int64()).fill_null(1)) for c in (a, b))
        return pa.array(kernel(x, y), mask=~known)

    return run
