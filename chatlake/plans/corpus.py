"""The 8 tables built from the driver's Parquet tables (synthesised corpus).

The parsed entries are written once as a bronze Parquet table under the
session's checkpoint folder and every table is built from that copy: the
raw JSON is parsed once, the lineage is cut (a lost executor re-reads
Parquet instead of re-rendering and re-parsing), and each report's plan
stays small enough for Catalyst and whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.pricing import price_table
from ..operators.cowork import build_cowork_sessions
from ..operators.parse import parse_lines
from ..operators.tables import build_tables
from ..session import joins_by_seen_size, scratch_path, spread
from ..sources import files
from ..sources.synth import CORPUS_PRICES, PART_BYTES, conversation_sidecars, corpus_files, corpus_lines, corpus_parts, write_corpus_files
from ..sources.synth_rules import rule_lines
from .pipeline import DiskSource

#: Documents that a task renders and parses: eight lines each, some with the text repeated.
DOCUMENTS_EACH = 1000

_BRONZE: dict[tuple, str] = {}


def corpus_entries(spark: SparkSession, sf_dir: str, which: str = "all") -> DataFrame:
    """Bronze entries of the corpus, written once per application and input."""
    key = (spark.sparkContext.applicationId, sf_dir, which)
    path = _BRONZE.get(key)
    if path is None:
        path = scratch_path(spark, "bronze-entries")
        if which == "rules":
            lines = rule_lines(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), DOCUMENTS_EACH))
        else:
            lines = corpus_lines(spark, sf_dir, which)
        # zstd: texts stand in several lines of a session, which a longer window finds
        with joins_by_seen_size(spark):
            parse_lines(lines).write.mode("overwrite").option("compression", "zstd").parquet(path)
        _BRONZE[key] = path
    return spark.read.parquet(path)


def corpus_tables(spark: SparkSession, sf_dir: str, which: str = "all",
                  extracted_at=None) -> dict[str, DataFrame]:
    """Tables of the corpus rendered from ``sf_dir`` (lazy, over bronze entries)."""
    entries = corpus_entries(spark, sf_dir, which)
    if which == "rules":
        return build_tables(entries, price_table(spark, CORPUS_PRICES), extracted_at=extracted_at)
    tables = build_tables(entries, price_table(spark, CORPUS_PRICES),
                          files=corpus_files(spark, sf_dir, which), extracted_at=extracted_at)
    if which in ("all", "conversations"):
        tables._builders["cowork_sessions"] = lambda: build_cowork_sessions(
            conversation_sidecars(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return tables


@dataclass
class CorpusTrees:
    """The corpus as transcript trees and sidecars on disk, under a fresh folder ``root``.

    A file takes a block of the disk, however small it is, so a large corpus is
    written in parts: the files of one go once it has been read, before the next one
    is written, and the last stays. All sessions are in some part, each whole in one."""
    sf_dir: str
    root: str
    part_bytes: int = PART_BYTES
    derives_project_paths = True

    def parts(self, spark: SparkSession) -> Iterator[DiskSource]:
        n = corpus_parts(spark, self.sf_dir, self.part_bytes)
        for k in range(n):
            trees = f"{self.root}/part-{k}"
            write_corpus_files(spark, self.sf_dir, trees, k, n)
            source = DiskSource(f"{trees}/claude", f"{trees}/cowork")
            yield source
            if k + 1 < n:
                files.remove(source.found)
                # what is left are sidecars and folders
                where = spark._jvm.org.apache.hadoop.fs.Path(trees)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
