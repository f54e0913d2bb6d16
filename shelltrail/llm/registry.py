"""The queries of this folder and of the pipeline, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from shelltrail.llm import (
    bpe,
    decontaminate,
    language,
    lexical,
    license_scan,
    lm_scoring,
    neardup,
    periodic,
    quality,
    sharding,
    token_files,
    topk,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_sharding": sharding.query,
        "op2_lm_scoring": lm_scoring.query,
        "op3_byte_bpe": bpe.query,
        "op4_quality": quality.query,
        "op5_topk": topk.query,
        "op6_neardup": neardup.query,
        "op7_decontamination": decontaminate.query,
        "op8_token_files": token_files.query,
        "op9_toxicity": toxicity.query,
        "op10_license_scan": license_scan.query,
        "op11_periodic_runs": periodic.query,
        "op12_lexical_search": lexical.query,
        "op13_language": language.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_lm_scoring": lm_scoring.ORACLE,
        "op5_topk": topk.ORACLE,
        "op6_neardup": neardup.ORACLE,
        "op11_periodic_runs": periodic.ORACLE,
        "op12_lexical_search": lexical.ORACLE,
    }
