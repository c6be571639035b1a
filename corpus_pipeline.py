"""A training corpus from the table documents: each stage's result is written as Parquet and read by the next one.

The classifier's rejects go, one document of each near-duplicate group stays, passages that start earlier are taken out,
the rest gets its place in the mix of sources, and every document is encoded. Nulls, empty and very long texts, ties and
repeated rows are treated as each stage's operator says; rows with a null id go with the second stage. Further columns of
any name are carried on up to the last stage, whose columns are its own. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import bpe, minhash_dedup, mixing, quality, suffix_dedup
from corvane.llm.common import discard, stored

STAGES = [
    ("quality", quality.quality_stage),
    ("minhash", minhash_dedup.minhash_stage),
    ("suffix", suffix_dedup.suffix_stage),
    ("mixing", mixing.mixing_stage),
    ("bpe", bpe.bpe_stage),
]

#: Fitted classifiers, suffix sorts and BPE can't be stated in SQL; tests/llm/test_pipeline.py holds the stages and the
#: whole against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; between two stages stands a Parquet table in the shared folder.

    A table goes once the next one is written; the last one stays, as the result is read from it.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        if i:
            docs = stored(docs)
            if before is not None:
                discard(before)
            before = docs
        docs = stage(spark, docs, sf_dir)
    return docs
