"""The registered queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm import decontaminate, html_text, language_model, merkle, oracle, outliers, packing, quality, repeats, secrets, shards, simhash, spelling, toxicity
from chatlake.llm.common import held_out, table

SHARDS = 16
TOKENIZER = "word_bpe_49k.json"


def op1_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.with_score(docs, "quality", quality.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", *[f"quality.{c}" for c in ("score", "content_score", "metadata_score", "kept")])


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5))
    out = toxicity.with_score(docs, "found", *toxicity.fit(docs, labels))
    return out.select("doc_id", held_out("doc_id", 5).alias("held_out"), "found.score", (F.col("found.score") >= 0.5).cast("int").alias("predicted"), "found.n_passages")


def op4_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.external_shuffle(table(spark, sf_dir, "documents"), SHARDS)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                      F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.with_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "text")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = language_model.train(docs.where(~held_out("doc_id", 10)))
    out = language_model.with_score(docs, model)
    return out.select("doc_id", held_out("doc_id", 10).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
                      "base_score", "score", "perplexity")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = secrets.with_spans(docs, "found", secrets.train(docs)).select("doc_id", "found")
    n = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("found", lambda s: s["kind"] < 3)
    return out.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                      F.sha2(secrets.written(base).cast("binary"), 256).alias("base_sha256"), secrets.written(F.col("found")).alias("spans"))


def op9_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judged(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.with_overlap(docs, table(spark, sf_dir, "benchmark"), "overlap")
    return out.select("doc_id", *[f"overlap.{c}" for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")])


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    fields = ["doc_id", "source", "lang", "n_chars"]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "lang", merkle.leaf(*fields, "text").alias("leaf"),
                       F.when(tampered, merkle.leaf(*fields, F.translate("text", upper, upper.lower()))).alias("changed"))
    out = merkle.manifest(rows, "lang", ["doc_id"], "leaf", ["doc_id", "changed"])
    out = out.withColumn("folded_root", merkle.fold(F.coalesce("changed", "leaf"), "path"))
    return out.select("doc_id", "leaf", "subroot", "root", merkle.path_digest("path").alias("proof_sha256"), "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {f.__name__: f for f in (
    op1_co_training, op2_simhash_dedup, op3_toxic_segments, op4_external_shuffle, op5_vector_packing, op6_text_density, op7_kneser_ney,
    op8_secret_scan, op9_robust_outliers, op10_decontaminate, op11_substring_dedup, op12_spelling_variants, op13_merkle_manifest)}

#: Words of the texts, strings of window length at every place, and those that the benchmark has.
_OP10_SQL = r"""WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark),
strings AS (
  SELECT DISTINCT item, n, unnest([array_to_string(w[i:i + n - 1], ' ') for i in generate_series(1, len(w) - n + 1)]) AS s
  FROM (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0)),
places AS (
  SELECT r, n, unnest(generate_series(1, len(w) - n + 1)) AS i,
         unnest([array_to_string(w[i:i + n - 1], ' ') for i in generate_series(1, len(w) - n + 1)]) AS s
  FROM d, (SELECT DISTINCT n FROM strings) WHERE len(w) >= n),
found AS (SELECT r, i, n, item FROM places JOIN strings USING (n, s)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""

#: The other operators rest on XXH64, CRC-32, tokenizers, trained models or seeded
#: shuffles, which SQL does not have: tests/llm compares these with plain Python.
ORACLE_SQL: dict[str, str] = {"op10_decontaminate": _OP10_SQL, "op11_substring_dedup": oracle.OP11,
                              "op12_spelling_variants": oracle.OP12, "op13_merkle_manifest": oracle.OP13}
