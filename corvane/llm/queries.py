"""The queries of the training-data operators and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import ball_kmeans, bpe, embedding_dedup, fingerprints, fm_dedup, html_text, impact_search, license_scan, minhash_dedup, mixing, quality, suffix_dedup, url_reputation


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fm_dedup": fm_dedup.op1_fm_dedup,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_fingerprints": fingerprints.op3_fingerprints,
        "op4_bpe": bpe.op4_bpe,
        "op5_html_text": html_text.op5_html_text,
        "op6_quality": quality.op6_quality,
        "op7_url_reputation": url_reputation.op7_url_reputation,
        "op8_minhash": minhash_dedup.op8_minhash,
        "op9_source_mixing": mixing.op9_source_mixing,
        "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
        "op11_impact_search": impact_search.op11_impact_search,
        "op12_license_scan": license_scan.op12_license_scan,
        "op13_ball_kmeans": ball_kmeans.op13_ball_kmeans,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_url_reputation": url_reputation.SQL, "op11_impact_search": impact_search.SQL, "op12_license_scan": license_scan.SQL, "op13_ball_kmeans": ball_kmeans.SQL}
