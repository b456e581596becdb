"""Skew-safe positions, J3, S11, S12, I4, entry contract."""
import os
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from chatlake.operators.ordinal import dense_position, line_position
from chatlake.plans.incremental import changed_files


def test_dense_position_matches_row_number_on_a_hot_key(spark):
    rnd = random.Random(7)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 20)}", rnd.randint(0, 10_000), i)
            for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, t long, id long")
    got = dense_position(df, ["k"], ["t", "id"], F.floor(F.col("t") / 97), out="pos")
    want = df.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")) - 1)
    assert sorted(map(tuple, got.select("k", "id", "pos").collect())) == \
        sorted(map(tuple, want.select("k", "id", "pos").collect()))


def test_line_position_small_blocks(spark):
    df = spark.createDataFrame([("s", i * 3) for i in range(500)], "s string, line_num long")
    got = line_position(df, ["s"], block_size=16).orderBy("line_num").select("position").collect()
    assert [r[0] for r in got] == list(range(500))


def test_changed_files(spark):
    disc = spark.createDataFrame([("a", 1, None), ("b", 2, None), ("c", 3, None), ("d", 4, None)],
                                 "file_path string, file_size long, file_mtime timestamp")
    st = spark.createDataFrame([("a", 1, None), ("b", 9, None), ("c", 3, None)],
                               "file_path string, file_size_bytes long, file_modified_at timestamp")
    got = {r["file_path"]: r["reason"] for r in changed_files(disc, st).collect()}
    assert got == {"b": "size", "d": "new"}


def test_export_csv(spark, tmpdir_path):
    from chatlake.sources.export import export_csv
    df = spark.createDataFrame([("x", 1)], "a string, b long")
    assert export_csv(df, f"{tmpdir_path}/out", single_file=True) is True
    text = spark.read.text(f"{tmpdir_path}/out").collect()
    assert [r[0] for r in text] == ["a,b", "x,1"]
    assert export_csv(df.filter("b > 5"), f"{tmpdir_path}/empty") is False
    assert not os.path.exists(f"{tmpdir_path}/empty")


def test_team_daily(spark, tmpdir_path):
    from chatlake.sources.team import read_team_exports, team_daily, team_map
    d = f"{tmpdir_path}/team"
    os.makedirs(d)
    for user, rows in {"alice": ["2026-01-02,2,1.5,0.5,10"], "bob": ["2026-01-02,1,0.5,0.25,3"],
                       "carol": ["2026-01-01,4,2.0,1.0,7"], "dave": []}.items():
        with open(f"{d}/{user}.csv", "w") as f:
            f.write("day,sessions,hours,cost,messages\n" + "".join(r + "\n" for r in rows))
    out = team_daily(read_team_exports(spark, d), team_map(spark, {"eng": ["alice", "bob"]})).collect()
    got = {(r["team"], str(r["day"])): (r["users"], r["sessions"], r["cost"], r["messages"]) for r in out}
    assert got == {("eng", "2026-01-02"): (2, 3, 0.75, 13), ("unassigned", "2026-01-01"): (1, 4, 1.0, 7)}


def test_team_export_round_trip(spark, tmpdir_path):
    from chatlake.sources.team import DAILY_SCHEMA, export_team, read_team_exports
    rows = [("a b/c=d", "2026-01-02", 2, 1.1, 0.1 + 0.2, 10), ("u1", "2026-01-02", 1, None, 0.25, 3), ("u1", None, 4, 2.0, 1e-9, 7), (None, "2026-01-03", 1, 0.0, 0.0, 0)]
    df = spark.createDataFrame(rows, "user string, day string, sessions long, hours double, cost double, messages long").withColumn("day", F.col("day").cast("date"))
    export_team(df.withColumn("extra", F.lit(1)), f"{tmpdir_path}/exports")
    back = read_team_exports(spark, f"{tmpdir_path}/exports")
    assert back.schema.simpleString() == f"struct<user:string,{DAILY_SCHEMA.replace(', ', ',').replace(' ', ':').replace('long', 'bigint')}>"
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_periodic_once(spark, tmpdir_path):
    import json
    from chatlake.plans import pipeline
    from chatlake.streaming.periodic import start_periodic
    from conftest import write_jsonl
    write_jsonl(f"{tmpdir_path}/c/projects/p/s.jsonl",
                [json.dumps({"type": "user", "timestamp": "2026-01-01T00:00:00Z", "message": {"content": "x"}})])
    q = start_periodic(spark, pipeline.DiskSource(f"{tmpdir_path}/c"), f"{tmpdir_path}/t", once=True,
                       name="test-periodic")
    q.awaitTermination(120)
    assert q.results and q.results[0].files_extracted == 1


def test_entry_contract(spark):
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"project_path", "sessions", "total_cost", "total_hours"}


def test_load_config(tmpdir_path):
    from chatlake.config import load_config
    p = f"{tmpdir_path}/config.yaml"
    with open(p, "w") as f:
        f.write("sources:\n  claude_code:\n    path: /data/claude\n  cowork:\n    path: auto\n"
                "pricing:\n  my-model:\n    input: 1.0\n    output: 2.0\n    cache_read: 0.1\n    cache_create: 1.5\n"
                "  default:\n    input: 9\n    output: 9\n    cache_read: 9\n    cache_create: 9\n"
                "analysis:\n  teams:\n    eng: [alice]\n")
    cfg = load_config(p)
    assert cfg["claude_dir"] == "/data/claude" and cfg["cowork_dir"] is None
    assert cfg["prices"]["my-model"] == (1.0, 2.0, 0.1, 1.5)
    assert "default" not in cfg["prices"] and "claude-opus-4-6" in cfg["prices"]
    assert cfg["teams"] == {"eng": ["alice"]}


def test_hot_session_is_spread_over_tasks(spark):
    """One session holding most lines: positions stay exact and the ranking
    work lands in several tasks instead of one."""
    hot = spark.range(0, 120_000).select(F.lit("hot").alias("s"), F.col("id").alias("line_num"))
    small = spark.range(0, 2_000).select(F.concat(F.lit("s"), (F.col("id") % 200).cast("string")).alias("s"),
                                         (F.col("id") / 200).cast("long").alias("line_num"))
    df = hot.unionByName(small)
    got = line_position(df, ["s"], block_size=4096).withColumn("pid", F.spark_partition_id())
    hot_rows = got.filter("s = 'hot'")
    assert hot_rows.filter(F.col("position") != F.col("line_num")).count() == 0
    assert hot_rows.select("pid").distinct().count() >= 3
