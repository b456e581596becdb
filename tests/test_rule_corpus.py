"""The corpus of rare rules against its SQL, odd texts included, and CSV round trips."""
import csv
import glob

import duckdb
import pytest

import __spark_entry__ as entry
from chatlake.sources.export import export_csv, read_csv

TEXTS = [None, "", " ", "x", 'a "quoted" \\ back\\slash, comma', "line\nend\r\nand \t tab", "é 中文 \U0001F600 <b>tag</b>", "word " * 30_000,
         "<command-args>", "[1, 2]", '{"type":"text"}', "  edges  ", " wide "]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    # ids that end a text at each of the lengths, and share calls with the next session
    path = str(tmp_path_factory.mktemp("rules"))
    rows = [(d, TEXTS[d % len(TEXTS)]) for d in [*range(30), 49, 50, 99, 100, 150, 499, 999]]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["p4_rule_messages", "p7_rule_tool_calls", "f14_rule_commands", "p6_rule_model_usage", "s11_csv_messages"])
def test_rules_equal_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet/*.parquet'")
    rel = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in rel.description]
    df = entry.queries()[name](spark, sf_dir)
    assert sorted(cols) == sorted(df.columns)
    got, want = ([tuple(map(str, r)) for r in rows] for rows in (df.select(*cols).collect(), rel.fetchall()))
    assert sorted(got) == sorted(want) and got


def test_csv_is_read_alike_by_others(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS) if t]
    path = str(tmp_path / "csv")
    assert export_csv(spark.createDataFrame(rows, "n int, text string"), path, single_file=True)
    assert sorted(map(tuple, read_csv(spark, path).collect())) == sorted((str(i), t) for i, t in rows)
    with open(glob.glob(f"{path}/part-*")[0], newline="", encoding="utf-8") as f:
        csv.field_size_limit(1 << 30)
        assert list(csv.reader(f)) == [["n", "text"]] + [[str(i), t] for i, t in rows]


def test_csv_of_nothing_writes_nothing(spark, tmp_path):
    assert not export_csv(spark.createDataFrame([], "n int"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
