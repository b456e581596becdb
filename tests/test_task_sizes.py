"""Work dealt to tasks: rules over few row groups, lines that need no shuffle, compressed exports."""

import os

from pyspark.sql import functions as F

from chatlake import schemas
from chatlake.plans import corpus, pipeline
from chatlake.sources.export import export_csv, read_csv
from helpers import lines_df
from test_exact_sources import wide_exchanges


def test_documents_of_one_row_group_go_to_several_tasks(spark, tmp_path, monkeypatch):
    docs = spark.range(250).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus, "DOCUMENTS_EACH", 50, raising=False)
    entries = corpus.corpus_entries(spark, str(tmp_path), "rules")
    assert len(entries.inputFiles()) == 5
    assert entries.count() == 8 * 250 and entries.select("session_id").distinct().count() == 250


def test_lines_of_a_whole_run_are_not_shuffled(spark):
    lines = lines_df(spark, {f"s{k}": [f"line {k} {i}" for i in range(k % 3 + 1)] for k in range(30)})
    nowhere = lines.limit(1).withColumn("file_path", F.lit(None).cast("string"))
    files = lines.select(*schemas.FILE_COLS).distinct()
    source = pipeline.LinesSource(lines.unionByName(nowhere), files)
    path = F.col("file_path")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for whole, chosen in ((True, files), (True, files.filter(~path.endswith("s7.jsonl"))), (False, files.filter(path.endswith("1.jsonl")))):
            out = source.lines(spark, chosen, whole=whole)
            assert not wide_exchanges(out, "value")
            want = lines.join(chosen.select("file_path"), "file_path", "left_semi")
            assert sorted(out.select("file_path", "value").collect()) == sorted(want.select("file_path", "value").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_compressed_csv_reads_back(spark, tmp_path):
    rows = [(1, 'a "b"\n c '), (2, "d,e")]
    df = spark.createDataFrame(rows, "n int, t string")
    assert export_csv(df, f"{tmp_path}/c", compression="gzip") and export_csv(df, f"{tmp_path}/p")
    assert {n.rpartition(".")[2] for n in os.listdir(tmp_path / "c") if n.startswith("part-")} == {"gz"}
    assert {n.rpartition(".")[2] for n in os.listdir(tmp_path / "p") if n.startswith("part-")} == {"csv"}
    for folder in "cp":
        assert sorted((int(r.n), r.t) for r in read_csv(spark, f"{tmp_path}/{folder}").collect()) == rows
