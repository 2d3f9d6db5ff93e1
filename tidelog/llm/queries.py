"""The registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, html_extract, license_scan, mixing, near_dedup, packing, secret_scan, token_count, topk, toxicity
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": lambda spark, sf: html_extract.extract(read(spark, sf, "pages")),
    "op2_minhash_near_dedup": lambda spark, sf: near_dedup.near_query(read(spark, sf, "documents")),
    "op3_license_scan": lambda spark, sf: license_scan.scan_licenses(read(spark, sf, "documents")),
    "op4_best_fit_packing": lambda spark, sf: packing.pack(read(spark, sf, "documents")),
    "op5_secret_scan": lambda spark, sf: secret_scan.scan_query(read(spark, sf, "documents")),
    "op6_source_mixing": lambda spark, sf: mixing.mix_query(read(spark, sf, "documents")),
    "op7_token_count": lambda spark, sf: token_count.count_tokens(read(spark, sf, "documents")),
    "op8_toxicity": lambda spark, sf: toxicity.score_query(read(spark, sf, "documents"), read(spark, sf, "labels")),
    "op9_exact_dedup": lambda spark, sf: exact_dedup.exact_dedup(read(spark, sf, "documents")),
    "op10_topk_search": lambda spark, sf: topk.top_k(read(spark, sf, "embeddings")),
}

#: The other operators need a tokenizer, a trained model, a parser, random draws or a graph's
#: components, which SQL can't express; tests/llm holds them against brute force.
ORACLES: dict[str, str] = {"op9_exact_dedup": exact_dedup.ORACLE, "op10_topk_search": topk.ORACLE}
