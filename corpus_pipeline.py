"""The corpus pipeline: classify, deduplicate, decontaminate, remove secrets, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chatlake.llm import pipeline_stages as S
from chatlake.llm.common import saved, table

STAGES = [
    ("quality_classifier", S.classified),
    ("simhash_dedup", S.deduplicate),
    ("decontaminate", S.decontaminated),
    ("secret_scan", S.without_secrets),
    ("vector_packing", S.packed),
]

#: SQL has no XXH64 fingerprints, trained models or tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"pipeline-{name}")
    return docs
