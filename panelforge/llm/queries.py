"""The corpus queries by name, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from panelforge.llm import ann, bpe, divergence, embed_dedup, importance, minhash, packing, pii, secret_scan, substring, token_count, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_near_dedup": embed_dedup.query,
        "op2_token_counts": token_count.query,
        "op3_block_matrix_neighbours": ann.query,
        "op4_best_fit_packing": packing.query,
        "op5_substring_dedup": substring.query,
        "op6_pii_surrogates": pii.query,
        "op7_minhash_near_dedup": minhash.query,
        "op8_toxicity": toxicity.query,
        "op9_secret_scan": secret_scan.query,
        "op10_bpe_round_trip": bpe.query,
        "op11_importance_resampling": importance.query,
        "op12_source_divergence": divergence.query,
        "op13_warc_archive": warc.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_near_dedup": embed_dedup.SQL,
        "op3_block_matrix_neighbours": ann.SQL,
        "op11_importance_resampling": importance.SQL,
        "op12_source_divergence": divergence.SQL,
        "op13_warc_archive": warc.SQL,
    }
