"""Tool-call ids that several sessions have: kept by each batch, resolved in the view alone."""

import re

from chatlake.plans import pipeline, reports as R
from conftest import write_jsonl


def call(tool, cid, n):
    return {"type": "assistant", "uuid": f"m{n}", "timestamp": "2024-01-01T00:00:00Z", "message": {
        "role": "assistant", "content": [{"type": "tool_use", "id": cid, "name": tool, "input": {}}]}}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ids_of_several_sessions(spark, tmpdir_path):
    c, root = f"{tmpdir_path}/claude/projects/p", f"{tmpdir_path}/tables"
    src = pipeline.DiskSource(f"{tmpdir_path}/claude")
    write_jsonl(f"{c}/a.jsonl", [call("A", "only-a", 1), call("A", "x", 2)])
    write_jsonl(f"{c}/b.jsonl", [call("B", "only-b", 1)])
    pipeline.run(spark, src, root, mode="full")
    t = pipeline.TableRoot(spark, root).views()
    # no id is shared: the calls are read without an aggregate over ids
    assert "Aggregate" not in plan(t["tool_calls"])
    assert {(r.tool_call_id, r.tool_name) for r in t["tool_calls"].collect()} == {("only-a", "A"), ("x", "A"), ("only-b", "B")}

    write_jsonl(f"{c}/0.jsonl", [call("Z", "x", 1), call("Z", "y", 2)])     # before a in load order: its x is the one that counts
    write_jsonl(f"{c}/c.jsonl", [call("C", "y", 1), call("C", "z", 2)])
    pipeline.run(spark, src, root)
    want = {("only-a", "A"), ("only-b", "B"), ("x", "Z"), ("y", "Z"), ("z", "C")}
    store = pipeline.TableRoot(spark, root)
    views = store.views()
    assert {(r.tool_call_id, r.tool_name) for r in views["tool_calls"].collect()} == want
    gen = store.current_generation()
    assert {r.tool_call_id for r in store.read(gen, "shared_calls").collect()} == {"x", "y"}
    # what stands alone is anti-joined to a broadcast: it is not aggregated by id
    assert re.search(r"LeftAnti", plan(views["tool_calls"]))
    assert {r.tool_name: r.uses for r in R.r14_tool_ranking(views).collect()} == {"A": 1, "B": 1, "C": 1, "Z": 2}

    # the other session loses its file's x: the id stays in the index, the rows are right
    write_jsonl(f"{c}/0.jsonl", [call("Z", "q", 1)])
    pipeline.run(spark, src, root)
    now = {("only-a", "A"), ("only-b", "B"), ("x", "A"), ("y", "C"), ("z", "C"), ("q", "Z")}
    assert {(r.tool_call_id, r.tool_name) for r in pipeline.TableRoot(spark, root).views()["tool_calls"].collect()} == now
    full = f"{tmpdir_path}/again"
    pipeline.run(spark, src, full, mode="full")
    assert {(r.tool_call_id, r.tool_name) for r in pipeline.TableRoot(spark, full).views()["tool_calls"].collect()} == now
    pipeline.compact(spark, root)
    assert {(r.tool_call_id, r.tool_name) for r in pipeline.TableRoot(spark, root).views()["tool_calls"].collect()} == now
