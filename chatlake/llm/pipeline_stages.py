"""The stages of the corpus pipeline. Each takes (spark, docs, sf_dir); all but
the last return the columns of ``docs``.

Null texts are empty, null ids are ids like any other; rows alike in every
column are copies of each other. Empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm import decontaminate, packing, quality, secrets, simhash
from chatlake.llm.common import fresh, saved, table
from chatlake.llm.queries import TOKENIZER


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    verdict, = fresh(docs, "verdict")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.with_score(docs, verdict, model).where(f"{verdict}.kept").drop(verdict)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, that with the least id
    (then the least hash of its text)."""
    text_hash, = fresh(docs, "text_hash")
    docs = docs.withColumn(text_hash, F.xxhash64("text"))
    rows = saved(simhash.near_duplicates(docs, keep=(text_hash,)), "pipeline-simhash")
    # null ids come after all others
    least = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", text_hash)).alias("k"))
    stay = least.select(F.col("k.doc_id").alias("k_id"), F.col(f"k.{text_hash}").alias("k_hash"))
    out = docs.join(stay, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col(text_hash) == F.col("k_hash")), "left_semi")
    if not rows.groupBy("doc_id", text_hash).count().where("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", text_hash])  # the row that stays may itself be repeated
    return out.drop(text_hash)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    overlap, = fresh(docs, "overlap")
    out = decontaminate.with_overlap(docs, table(spark, sf_dir, "benchmark"), overlap)
    return out.where(f"not {overlap}.contaminated").drop(overlap)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text. No document goes."""
    spans, = fresh(docs, "spans")
    out = secrets.with_spans(docs, spans, secrets.train(docs))
    hit = F.size(spans) > 0
    out = out.withColumn("text", F.when(hit, secrets.redacted(F.col("text"), F.col(spans))).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).drop(spans)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its ids and its place in a sequence."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), with_ids=True)
