"""Disk layout (S1-S6), sidecars (S3/J4), incremental state (J3, I1-I3, W5), S8 splits."""
import json
import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from conftest import write_jsonl
from chatlake.plans import pipeline
from chatlake.sources import transcripts as T


def _user(uuid, text, ts="2026-01-01T00:00:00Z", **kw):
    return {"type": "user", "uuid": uuid, "timestamp": ts, "message": {"content": text}, **kw}


def _asst(uuid, ts="2026-01-01T00:00:05Z", model="claude-sonnet-4-6", **kw):
    return {"type": "assistant", "uuid": uuid, "timestamp": ts,
            "message": {"model": model, "content": [{"type": "text", "text": "ok"}],
                        "usage": {"input_tokens": 10, "output_tokens": 2}}, **kw}


@pytest.fixture()
def layout(tmpdir_path):
    base = tmpdir_path
    c = f"{base}/claude/projects"
    write_jsonl(f"{c}/-home-u-proj/s1.jsonl", [_user("s1u", "hi", cwd="/home/u/proj"), _asst("s1a")])
    write_jsonl(f"{c}/-home-u-proj/agent-a1.jsonl", [_user("a1u", "sub")])
    write_jsonl(f"{c}/-home-u-proj/sub/nested.jsonl", [_user("n1", "nested")])
    write_jsonl(f"{c}/-opt-x-y/s 2.jsonl", [_user("s2u", "space")])
    write_jsonl(f"{c}/plain/s3.jsonl", [_user("s3u", "plain")])
    w = f"{base}/cowork"
    write_jsonl(f"{w}/org/local_abc/.claude/projects/-w/c1.jsonl", [_user("c1u", "cw")])
    with open(f"{w}/org/local_abc.json", "w") as f:
        json.dump({"sessionId": "sess-abc", "title": "My Task", "initialMessage": "hi" * 3000,
                   "model": "m", "createdAt": "2026-01-01T00:00:00Z", "lastActivityAt": 1767229200000,
                   "vmProcessName": "vm", "userSelectedFolders": ["/a"], "isArchived": True}, f)
    write_jsonl(f"{w}/org/local_bad/c2.jsonl", [_user("c2u", "bad sidecar")])
    with open(f"{w}/org/local_bad.json", "w") as f:
        f.write("{not json")
    write_jsonl(f"{w}/org/local_none/c3.jsonl", [_user("c3u", "no sidecar")])
    write_jsonl(f"{w}/org/audit.jsonl", [_user("au", "audit")])
    write_jsonl(f"{w}/cowork_plugins/p.jsonl", [_user("pu", "plugin")])
    write_jsonl(f"{w}/loose.jsonl", [_user("lu", "loose")])
    return base


def _views(spark, root):
    return pipeline.TableRoot(spark, root).views()


def test_disk_layout_full_run(spark, layout):
    src = pipeline.DiskSource(f"{layout}/claude", f"{layout}/cowork")
    root = f"{layout}/tables"
    res = pipeline.run(spark, src, root, mode="full")
    assert res.files_extracted == 8
    v = _views(spark, root)
    s = {r["session_id"]: r.asDict() for r in v["sessions"].collect()}
    assert set(s) == {"s1", "agent-a1", "s 2", "s3", "c1", "c2", "c3", "loose"}
    assert s["s1"]["project_path"] == "/home/u/proj"           # decoded through the observed cwd
    assert s["s 2"]["project_path"] == "/opt/x/y"              # fallback decode
    assert s["s3"]["project_path"] == "plain"
    assert s["agent-a1"]["is_agent"] is True and s["s1"]["is_agent"] is False
    assert s["s 2"]["file_path"].endswith("/-opt-x-y/s 2.jsonl")
    assert s["c1"]["project_path"] == "cowork://My Task" and s["c1"]["project_dir_name"] == "-w"
    assert s["c2"]["project_path"] == "cowork://local_bad"
    assert s["c3"]["project_path"] == "cowork://local_none"
    assert s["loose"]["project_path"] == "cowork://unknown" and s["loose"]["project_dir_name"] == "cowork"
    assert s["c1"]["source"] == "cowork" and s["s1"]["source"] == "claude-code"
    assert s["s1"]["file_size_bytes"] == os.path.getsize(f"{layout}/claude/projects/-home-u-proj/s1.jsonl")
    assert s["s1"]["estimated_total_cost_usd"] == pytest.approx(10 / 1e6 * 3 + 2 / 1e6 * 15)
    cw = [r.asDict() for r in v["cowork_sessions"].collect()]
    assert len(cw) == 1
    assert cw[0]["cowork_session_id"] == "sess-abc" and cw[0]["jsonl_session_id"] == "c1"
    assert len(cw[0]["initial_message"]) == 5000 and cw[0]["is_archived"] is True
    assert cw[0]["user_selected_folders"] == ["/a"]
    assert str(cw[0]["last_activity_at"]) == "2026-01-01 01:00:00"
    st = v["etl_state"]
    assert st.count() == 8


def test_code_only_and_missing_dirs(spark, layout):
    src = pipeline.DiskSource(f"{layout}/claude", f"{layout}/nope", code_only=True)
    assert src.discover(spark).count() == 4
    assert pipeline.DiskSource(f"{layout}/missing", None).discover(spark).count() == 0


def test_incremental_runs(spark, layout):
    src = pipeline.DiskSource(f"{layout}/claude", f"{layout}/cowork")
    root = f"{layout}/tables-inc"
    assert pipeline.run(spark, src, root).files_extracted == 8
    assert pipeline.run(spark, src, root).files_extracted == 0          # nothing changed
    p = f"{layout}/claude/projects/-home-u-proj/s1.jsonl"
    with open(p, "a") as f:                                             # the conversation grew
        f.write(json.dumps(_user("s1u2", "more", ts="2026-01-01T00:01:00Z")) + "\n")
    assert pipeline.run(spark, src, root).files_extracted == 1
    s1 = _views(spark, root)["sessions"].filter("session_id = 's1'").first()
    assert s1["user_message_count"] == 2 and s1["duration_seconds"] == 60
    assert _views(spark, root)["messages"].filter("session_id = 's1'").count() == 3
    write_jsonl(f"{layout}/claude/projects/plain/s4.jsonl", [_user("s4u", "new")])
    assert pipeline.run(spark, src, root).files_extracted == 1          # a new file
    t = time.time() + 100
    os.utime(f"{layout}/claude/projects/plain/s3.jsonl", (t, t))         # mtime only
    assert pipeline.run(spark, src, root).files_extracted == 1
    assert _views(spark, root)["sessions"].count() == 9
    # Same stem in another project: the newly read file replaces the session.
    write_jsonl(f"{layout}/claude/projects/zz/s1.jsonl", [_user("z1", "other", cwd="/zz")])
    assert pipeline.run(spark, src, root).files_extracted == 1
    v = _views(spark, root)
    s1 = v["sessions"].filter("session_id = 's1'").first()
    assert s1["project_dir_name"] == "zz" and s1["user_message_count"] == 1
    assert [r[0] for r in v["messages"].filter("session_id = 's1'").select("message_id").collect()] == ["z1"]
    # Rows of a batch without manifest rows (a crash before I3) stay invisible.
    store = pipeline.TableRoot(spark, root)
    gen = store.current_generation()
    src_part = [d for d in os.listdir(store.path(gen, "sessions")) if d.startswith("batch_id=")][0]
    shutil.copytree(f"{store.path(gen, 'sessions')}/{src_part}", store.path(gen, "sessions", "bz-orphan"))
    assert _views(spark, root)["sessions"].count() == 9
    # Full rebuild into a new generation gives the same sessions.
    full_root = f"{layout}/tables-full"
    pipeline.run(spark, src, full_root, mode="full")
    cols = ["session_id", "project_path", "user_message_count", "total_input_tokens", "started_at"]
    inc = sorted(tuple(r) for r in _views(spark, root)["sessions"].select(*cols).collect())
    full = sorted(tuple(r) for r in _views(spark, full_root)["sessions"].select(*cols).collect())
    # The full run keeps the later file of a duplicated stem in load order too.
    assert inc == full


def test_line_numbers_across_splits(spark, tmpdir_path):
    path = f"{tmpdir_path}/big/s.jsonl"
    write_jsonl(path, [_user(f"m{i}", "x" * (i % 50)) for i in range(3000)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        files = spark.createDataFrame(
            [("claude-code", path, "s", False, "big", "/big", os.path.getsize(path), None, 0)],
            "source string, file_path string, session_id string, is_agent boolean, "
            "project_dir_name string, project_path string, file_size long, file_mtime timestamp, load_rank int")
        lines = T.read_lines(spark, files, [path])
        assert spark.read.text(path).rdd.getNumPartitions() > 4
        got = lines.select("line_num", F.get_json_object("value", "$.uuid").alias("u")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r["line_num"], r["u"]) for r in got) == [(i, f"m{i}") for i in range(3000)]


def test_on_error_file_retries_next_run(spark, tmpdir_path):
    c = f"{tmpdir_path}/claude/projects/p"
    write_jsonl(f"{c}/good.jsonl", [_user("g1", "fine"), "{broken", ""])
    write_jsonl(f"{c}/bad.jsonl", [_user("b1", "x"), "[1, 2]"])
    src = pipeline.DiskSource(f"{tmpdir_path}/claude")
    root = f"{tmpdir_path}/t"
    res = pipeline.run(spark, src, root, on_error="file")
    assert res.summary["skipped_by_reason"] == {"malformed_json": 1, "blank": 1, "not_object": 1}
    v = pipeline.TableRoot(spark, root).views()
    assert [r[0] for r in v["sessions"].select("session_id").collect()] == ["good"]
    # The failed file has no manifest row, so the next run tries it again.
    assert pipeline.run(spark, src, root, on_error="file").files_extracted == 1
    # In the default line mode it is kept, minus the bad line.
    res = pipeline.run(spark, src, f"{tmpdir_path}/t2")
    v2 = pipeline.TableRoot(spark, f"{tmpdir_path}/t2").views()
    assert sorted(r[0] for r in v2["sessions"].select("session_id").collect()) == ["bad", "good"]
    q = sorted((r["session_id"], r["line_num"], r["reason"]) for r in v2["quarantine"].collect())
    assert q == [("bad", 1, "not_object"), ("good", 1, "malformed_json"), ("good", 2, "blank")]


def test_compaction_keeps_views(spark, layout):
    src = pipeline.DiskSource(f"{layout}/claude", f"{layout}/cowork")
    root = f"{layout}/tables-c"
    pipeline.run(spark, src, root)
    with open(f"{layout}/claude/projects/plain/s3.jsonl", "a") as f:
        f.write(json.dumps(_user("s3b", "again", ts="2026-01-01T00:02:00Z")) + "\n{oops\n")
    pipeline.run(spark, src, root)

    def snap():
        v = _views(spark, root)
        return {t: sorted(map(str, v[t].drop("extracted_at").collect())) for t in
                ("sessions", "messages", "cowork_sessions", "files_referenced", "quarantine")}
    before = snap()
    assert len(before["quarantine"]) == 1
    gen = pipeline.compact(spark, root)
    assert pipeline.TableRoot(spark, root).current_generation() == gen
    assert snap() == before
    assert pipeline.run(spark, src, root).files_extracted == 0   # manifest carried over
    # nothing is replaced any more: the view is the scan of the batches in the manifest
    plan = _views(spark, root)["messages"]._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "batch_id" in plan
    assert len(pipeline.remove_old_generations(spark, root)) == 1
    assert pipeline.TableRoot(spark, root).current_generation() == gen and snap() == before
    assert pipeline.remove_old_generations(spark, root) == [] == pipeline.remove_old_generations(spark, f"{layout}/none")
    pipeline.run(spark, src, root, mode="full")
    assert pipeline.TableRoot(spark, root).current_generation() > gen


def test_file_names_with_glob_characters(spark, tmpdir_path):
    write_jsonl(f"{tmpdir_path}/claude/projects/p/x[1]{{a}}.jsonl", [_user("g1", "brackets")])
    write_jsonl(f"{tmpdir_path}/claude/projects/p/x1a.jsonl", [_user("g2", "plain")])
    root = f"{tmpdir_path}/t"
    pipeline.run(spark, pipeline.DiskSource(f"{tmpdir_path}/claude"), root)
    v = pipeline.TableRoot(spark, root).views()
    got = sorted((r["session_id"], r["message_id"]) for r in v["messages"].collect())
    assert got == [("x1a", "g2"), ("x[1]{a}", "g1")]


def test_folder_read_equals_path_read(spark, layout):
    """A full run reads code folders by their pattern: same lines and numbers
    as by a list of paths, also across splits and beside a cowork tree."""
    write_jsonl(f"{layout}/claude/projects/plain/long.jsonl", [_user(f"l{i}", "x" * (i % 50)) for i in range(400)])
    write_jsonl(f"{layout}/cowork/org/local_abc/.claude/projects/-w/c4.jsonl", [_user(f"c{i}", "y" * 40) for i in range(200)])
    src = pipeline.DiskSource(f"{layout}/claude", f"{layout}/cowork")
    chosen = src.discover(spark)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        got = [sorted((r["session_id"], r["line_num"], r["value"]) for r in src.lines(spark, chosen, whole=w).collect()) for w in (True, False)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got[0] == got[1]
    assert [n for s, n, _ in got[0] if s == "long"] == list(range(400)) and [n for s, n, _ in got[0] if s == "c4"] == list(range(200))
    # what is in the folder but not chosen is left out
    few = chosen.filter(F.col("session_id") != "long")
    assert "long" not in {r["session_id"] for r in src.lines(spark, few, whole=True).select("session_id").distinct().collect()}
