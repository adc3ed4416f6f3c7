"""The queries of the corpus operators, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm.decontamination import op1_decontamination
from wordloom.llm.jaccard_join import op10_jaccard_join
from wordloom.llm.language import op9_language_id
from wordloom.llm.licenses import op8_license_scan
from wordloom.llm.line_dedup import op7_line_dedup
from wordloom.llm.packing import op3_packing
from wordloom.llm.quality import op6_quality_rules
from wordloom.llm.secrets import op5_secret_scan
from wordloom.llm.sql import SQL
from wordloom.llm.substring_dedup import op4_substring_dedup
from wordloom.llm.token_counts import op2_token_counts

ALL = (op1_decontamination, op2_token_counts, op3_packing, op4_substring_dedup, op5_secret_scan, op6_quality_rules, op7_line_dedup, op8_license_scan, op9_language_id, op10_jaccard_join)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
