"""The disk path at size: rounds of a listing, lines of many files split at once, joins not broadcast by file size."""

import datetime as dt
import os
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chatlake.plans import corpus, pipeline
from chatlake.sources import files, transcripts as T
from conftest import write_jsonl


def test_deep_trees_are_listed_in_few_jobs(spark, tmp_path, monkeypatch):
    want = set()
    for k in range(30):
        path = tmp_path / f"local_{k}/.claude/projects/p{k % 3}/x/y/s{k}.jsonl"
        path.parent.mkdir(parents=True)
        path.write_text("a\n" * k)
        want.add((str(path), 2 * k))
    jobs, written = [], files._written
    monkeypatch.setattr(files, "_written", lambda *a: jobs.append(1) or written(*a))
    assert {(r.path, r.file_size) for r in files.list_tree(spark, str(tmp_path)).collect()} == want
    assert len(jobs) <= 2  # was one for each of 7 levels


def test_bounded_walk_leaves_folders_for_the_next_job(tmp_path):
    want = set()
    for k in range(40):
        path = tmp_path / f"a{k % 4}/b{k % 10}/c{k}.txt"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
        want.add(str(path))
    for names in (0, 1, 2, 5, 17, 1000):
        found, rounds, level = [], 0, [str(tmp_path)]
        while level:
            rows = [r for b in files._children([pa.RecordBatch.from_pydict({"path": level})], names) for r in b.to_pylist()]
            found += [r["path"] for r in rows if not r["is_dir"]]
            level, rounds = [r["path"] for r in rows if r["is_dir"]], rounds + 1
        assert sorted(found) == sorted(want), names
        assert rounds == 1 if names == 1000 else rounds <= 3


def test_files_that_share_a_batch_keep_their_lines(spark, tmp_path):
    bodies = [b"", b"\n", b"a", b"a\nb", b"\nx\r\n\r\ny\r", b"\r", b"\n\n", "é\rß".encode(), b"q" * 3000 + b"\n" + b"z", b"a\r\n"]
    rows, want = [], {}
    for k in range(200):
        path = f"{tmp_path}/s{k}.jsonl"
        body = bodies[k % len(bodies)]
        with open(path, "wb") as f:
            f.write(body)
        # every fourth file grew or shrank after it was listed: lines that begin in what was listed count
        size = max(0, len(body) + (k % 4 == 3) * (-2 if k % 8 == 3 else 5))
        rows.append(("claude-code", path, f"s{k}", False, "d", "p", size, None, 0))
        text = body.decode().replace("\r\n", "\n").replace("\r", "\n")
        lines = text.split("\n")[:-1] if text.endswith("\n") or not text else text.split("\n")
        if lines and size >= len(body):
            want[path] = lines
    chosen = spark.createDataFrame(rows, "source string, file_path string, session_id string, is_agent boolean, project_dir_name string, "
                                         "project_path string, file_size long, file_mtime timestamp, load_rank int")
    got = {}
    for r in T.read_lines(spark, chosen).collect():
        assert r.line_num not in got.setdefault(r.file_path, {}) and r.session_id == os.path.basename(r.file_path)[:-6]
        got[r.file_path][r.line_num] = r.value
    whole = {p: [v[i] for i in range(len(v))] for p, v in got.items()}
    assert {p: v for p, v in whole.items() if p in want} == want
    for source, path, _, _, _, _, size, _, _ in rows:
        if path not in want:
            with open(path, "rb") as f:
                want_cut = [x.decode() for data in files._chunks(f, 0, size) for x in files.split_lines(data).to_pylist()] if size else []
            assert whole.get(path, []) == want_cut


def test_runs_do_not_broadcast_by_file_size(spark, tmp_path):
    write_jsonl(f"{tmp_path}/projects/-p/s1.jsonl", [{"type": "user", "uuid": "u1", "message": {"role": "user", "content": "x"}}])
    seen, key = [], "spark.sql.autoBroadcastJoinThreshold"

    class Source(pipeline.DiskSource):
        def lines(self, spark, chosen, whole=False):
            seen.append((spark.conf.get(key), spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold")))
            return super().lines(spark, chosen, whole)

    old = spark.conf.get(key)
    res = pipeline.run(spark, Source(str(tmp_path)), f"{tmp_path}/out", mode="full")
    assert seen == [("-1", str(10 << 20))] and res.summary["messages"] == 1
    assert spark.conf.get(key) == old and spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None


def test_team_exports_have_a_file_for_each_user(spark, tmp_path):
    from chatlake.sources.team import DAILY_COLUMNS, DAILY_SCHEMA, export_team, read_team_exports
    users = [f"u{k}" for k in range(40)] + [f"x{chr(c)}y" for c in (*range(1, 128), 233, 8364) if chr(c) not in "\n\r"] + ["", None, "a%2Fb", "%25", "..z"]
    rows = [(u, f"2026-01-{d:02d}", d, d / 7, 1e-9 * d if d % 3 else None, k) for k, u in enumerate(users) for d in range(1, 9)]
    df = (spark.createDataFrame(rows, "user string, day string, sessions long, hours double, cost double, messages long")
          .withColumn("day", F.col("day").cast("date")).repartition(8))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        export_team(df, f"{tmp_path}/own")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    df.select("user", *DAILY_COLUMNS).write.option("header", True).partitionBy("user").csv(f"{tmp_path}/spark")
    kept = {n: [f for f in os.listdir(f"{tmp_path}/own/{n}") if not f.startswith(".")] for n in os.listdir(f"{tmp_path}/own") if n.startswith("user=")}
    assert set(kept) == {n for n in os.listdir(f"{tmp_path}/spark") if n.startswith("user=")}
    assert all(len(f) == 1 for f in kept.values())  # was one for each user and task
    want = sorted(str((None if u == "" else u, *v)) for u, *v in rows)
    for folder in ("own", "spark"):
        back = read_team_exports(spark, f"{tmp_path}/{folder}")
        assert back.schema.simpleString() == f"struct<user:string,{DAILY_SCHEMA.replace(', ', ',').replace(' ', ':').replace('long', 'bigint')}>"
        assert sorted(str((r.user, str(r.day), r.sessions, r.hours, r.cost, r.messages)) for r in back.collect()) == want
        assert len(back.inputFiles()) < 50  # no path of a user on the driver
    export_team(df.filter("user = 'u1'"), f"{tmp_path}/own")  # replaces what was there
    assert {r.user for r in read_team_exports(spark, f"{tmp_path}/own").collect()} == {"u1"}
    export_team(df.limit(0), f"{tmp_path}/own")
    assert read_team_exports(spark, f"{tmp_path}/own").count() == 0


def _corpus(spark, folder) -> str:
    """60 conversations of 4 turns (15 of them cowork, with sidecars) and 300 events of 100 sessions."""
    turns = [(c, t, ("user", "assistant", "system", "assistant")[t], f"text {c} {t} é") for c in range(60) for t in range(4)]
    events = [(e, dt.datetime(2024, 1, 1 + e % 5, 1, e % 60, e % 7), e // 5 % 20, "click" if e % 3 else "view", e / 7, f'{{"k": {e % 9}}}') for e in range(300)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def _transcripts(root) -> set:
    return {f for _, _, names in os.walk(root) for f in names if f.endswith(".jsonl")}


def _shuffled(spark) -> set:
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_") and name.endswith(".data")}


def test_trees_of_a_large_corpus_are_on_disk_a_part_at_a_time(spark, tmp_path, monkeypatch):
    sf_dir, there = _corpus(spark, tmp_path / "tables"), []

    class Seen(corpus.CorpusTrees):
        def parts(self, spark):
            for source in super().parts(spark):
                there.append(_transcripts(self.root))
                yield source

    tables, summaries = [], []
    for part_bytes in (1 << 40, 200_000):
        there.clear()
        monkeypatch.setattr(entry, "CorpusTrees", lambda d, trees: Seen(d, trees, part_bytes))
        monkeypatch.setattr(entry, "_DISK_RUNS", {})
        names = [q for q in entry.queries() if q.startswith(("s1_disk_", "s3_disk_", "i3_disk_", "a14_disk_"))]
        tables.append({q: sorted(map(str, entry.queries()[q](spark, sf_dir).collect())) for q in names})
        root = next(iter(entry._DISK_RUNS.values()))[0]
        summaries.append(spark.read.parquet(f"{root}/*/etl_state").count())
        if part_bytes == 1 << 40:
            assert len(there) == 1 and len(there[0]) == 160
    assert len(there) > 2 and max(map(len, there)) < 100  # was all 160 at once
    assert len(set().union(*there)) == sum(map(len, there)) == 160  # each session in one part
    assert tables[0] == tables[1] and summaries == [160, 160]
    assert len(tables[1]["s1_disk_sessions"]) == 160 and len(tables[1]["s3_disk_cowork_sessions"]) == 15


def test_parts_hold_whole_sessions(spark, tmp_path):
    line = {"type": "user", "uuid": "u1", "message": {"role": "user", "content": "x"}}
    write_jsonl(f"{tmp_path}/a/projects/-p/s1.jsonl", [line])
    write_jsonl(f"{tmp_path}/b/projects/-q/s1.jsonl", [line])
    write_jsonl(f"{tmp_path}/b/projects/-q/s2.jsonl", [line])
    os.makedirs(f"{tmp_path}/empty/projects")

    class Parts:
        def __init__(self, *names):
            self.names = names

        def parts(self, spark):
            return (pipeline.DiskSource(f"{tmp_path}/{n}", f"{tmp_path}/none") for n in self.names)

    with pytest.raises(ValueError, match="several parts"):
        pipeline.run(spark, Parts("a", "b"), f"{tmp_path}/out1", mode="full")
    res = pipeline.run(spark, Parts("empty", "b", "empty"), f"{tmp_path}/out2", mode="full")
    assert res.files_extracted == 2 and res.summary["messages"] == 2
    res = pipeline.run(spark, Parts("b", "empty"), f"{tmp_path}/out2")
    assert res.files_extracted == 0
    assert pipeline.run(spark, Parts("empty"), f"{tmp_path}/out3").files_extracted == 0
    write_jsonl(f"{tmp_path}/c/projects/-p/s3.jsonl", [line])
    now = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
    for names in (("b", "c"), ("c",)):  # a retry of a batch replaces it, parts that it no longer has too
        res = pipeline.run(spark, Parts(*names), f"{tmp_path}/out4", mode="full", now=now)
        views = pipeline.TableRoot(spark, f"{tmp_path}/out4").views()
        assert res.files_extracted == views["etl_state"].count() == views["sessions"].count() == (3 if len(names) == 2 else 1)


def test_shuffles_of_a_run_leave_the_disk(spark, tmp_path):
    sf_dir, before, key = _corpus(spark, tmp_path / "tables"), _shuffled(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key)
    pipeline.run(spark, corpus.CorpusTrees(sf_dir, f"{tmp_path}/trees"), f"{tmp_path}/out", mode="full")
    until = time.time() + 10
    while _shuffled(spark) - before and time.time() < until:  # executors delete them a little later
        time.sleep(0.1)
    assert not _shuffled(spark) - before  # those of the last steps were there until the driver's heap was collected
    assert spark.conf.get(key) == old


def test_files_are_removed_in_tasks(spark, tmp_path):
    for k in range(30):
        (tmp_path / f"d{k % 3}").mkdir(exist_ok=True)
        (tmp_path / f"d{k % 3}/s{k}.jsonl").write_text("x")
    rows = [(f"{tmp_path}/d{k % 3}/s{k}.jsonl",) for k in range(25)] + [(f"{tmp_path}/d0/gone.jsonl",)]
    files.remove(spark.createDataFrame(rows, "file_path string").repartition(4))
    assert _transcripts(tmp_path) == {f"s{k}.jsonl" for k in range(25, 30)}
