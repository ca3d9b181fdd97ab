"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import bpe, decontaminate, exact_dedup, html_text, langid, quality, sharding, simhash, suffix_dedup, token_count


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [bpe.op1_bpe, quality.op2_quality, token_count.op3_token_counts, html_text.op4_html_text, suffix_dedup.op5_suffix_dedup, simhash.op6_simhash, exact_dedup.op7_exact_dedup, langid.op8_langid, sharding.op9_sharding, decontaminate.op10_decontamination]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": exact_dedup.OP7_SQL, "op10_decontamination": decontaminate.OP10_SQL}
