"""Queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from .common import whole_texts
from .decontamination import op10_decontamination
from .html_text import op6_html_text
from .language_id import op2_language_id
from .packing import op5_packing
from .pii import op9_pii
from .prefix_trie import OP12_SQL, op12_prefix_trie
from .simhash import op3_simhash
from .spelling import OP11_SQL, op11_spelling
from .substring_dedup import op8_substring_dedup
from .token_files import op4_token_files
from .topk import OP1_SQL, op1_topk
from .toxicity import op7_toxicity
from .url_filter import OP13_SQL, op13_url_filter


def _with_whole_texts(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        whole_texts(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_topk, op2_language_id, op3_simhash, op4_token_files, op5_packing, op6_html_text, op7_toxicity, op8_substring_dedup, op9_pii, op10_decontamination, op11_spelling, op12_prefix_trie, op13_url_filter)
    return {f.__name__: _with_whole_texts(f) for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": OP1_SQL, "op11_spelling": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_url_filter": OP13_SQL}
