"""The queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vectrove.llm.bpe import op9_byte_bpe
from vectrove.llm.decontaminate import op3_decontamination
from vectrove.llm.jaccard_join import op8_ngram_jaccard
from vectrove.llm.language import op6_language_id
from vectrove.llm.line_dedup import op2_line_dedup
from vectrove.llm.lm_score import op7_lm_score
from vectrove.llm.quality import OP5_SQL, op5_quality_rules
from vectrove.llm.secrets import op4_secret_scan
from vectrove.llm.token_counts import op1_token_counts
from vectrove.llm.warc import OP10_SQL, op10_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_line_dedup": op2_line_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_secret_scan": op4_secret_scan,
    "op5_quality_rules": op5_quality_rules,
    "op6_language_id": op6_language_id,
    "op7_lm_score": op7_lm_score,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_warc": op10_warc,
}

ORACLE_SQL: dict[str, str] = {
    "op5_quality_rules": OP5_SQL,
    "op10_warc": OP10_SQL,
}
