"""S10 merges of batches by tier; R1-R23 from stored sums; the sketch of distinct files."""
import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import write_jsonl
from chatlake.plans import partials, pipeline, reports as R, tiers

TABLES = ("sessions", "messages", "tool_calls", "command_invocations", "files_referenced", "model_usage", "cowork_sessions", "quarantine", "etl_state")
STORED = [("r1_session_count", {}), ("r2_sessions_by_source", {}), ("r3_agent_session_count", {}), ("r4_table_counts", {}),
          ("r5_unique_files", {}), ("r6_token_totals", {}), ("r7_model_usage", {}), ("r8_top_commands", {}), ("r9_top_tools", {}),
          ("r10_sessions_by_project", {}), ("r13_cost_by_project", {}), ("r14_tool_ranking", {}), ("r15_model_breakdown", {}),
          ("r16_daily_summary", {"as_of": "2026-01-10", "days": 7}), ("r17_sessions_by_day", {}), ("r19_tool_error_rates", {}),
          ("r20_command_usage", {}), ("r21_cache_by_model", {}), ("r22_most_edited", {}), ("r23_projects_by_sessions", {})]


def _session(name, day, files, n=1, call_ids=(), cwd=None, usage=True):
    content = [{"type": "tool_use", "id": c, "name": "Edit", "input": {"file_path": f}} for c, f in zip(call_ids or [f"{name}-{i}" for i in range(len(files))], files)]
    out = [{"type": "user", "uuid": f"{name}-u{i}", "timestamp": f"2026-01-{day:02d}T00:0{i}:00Z", "message": {"content": "/go now" if i else "hi"},
            **({"cwd": cwd} if cwd else {})} for i in range(n)]
    message = {"model": f"claude-sonnet-4-{day % 2 + 5}", "content": content}
    if usage:
        message["usage"] = {"input_tokens": 1000 * day, "output_tokens": 7, "cache_read_input_tokens": 333}
    out.append({"type": "assistant", "uuid": f"{name}-a", "timestamp": f"2026-01-{day:02d}T00:09:00Z", "message": message})
    if content:
        out.append({"type": "user", "uuid": f"{name}-r", "timestamp": f"2026-01-{day:02d}T00:09:30Z", "message": {"content": [
            {"type": "tool_result", "tool_use_id": content[0]["id"], "is_error": True, "content": "no"}]}})
    return out


@pytest.fixture()
def grown(spark, tmpdir_path):
    """A function that makes the next of five runs, in which sessions are new, grow, shrink, share ids and change files."""
    c = f"{tmpdir_path}/claude/projects"
    root = f"{tmpdir_path}/tables"
    steps = [
        {"-p-a/s1": _session("s1", 3, ["/a", "/b"]), "-p-a/s2": _session("s2", 4, ["/b"], 2), "-p-b/agent-x": _session("x", 4, [], usage=False)},
        {"-p-a/s1": _session("s1", 3, ["/a"]) + ["{bad"], "-p-b/s3": _session("s3", 5, ["/c"], call_ids=["s2-0"], cwd="/p/b")},
        {"-p-b/s4": _session("s4", 9, ["/d", "/a"], 3, call_ids=["s1-0", "own"]), "-p-a/s2": _session("s2", 4, ["/e"], 3)},
        {"-p-a/s5": _session("s5", 9, [], 1, usage=False)},
        {"-p-b/s4": _session("s4", 9, ["/d"], 3, call_ids=["other"]), "-p-b/s1": _session("s1", 8, ["/z"])},
    ]

    def step(i):
        for name, lines in steps[i].items():
            write_jsonl(f"{c}/{name}.jsonl", lines)
        return pipeline.run(spark, pipeline.DiskSource(f"{tmpdir_path}/claude"), root)
    step.root, step.n = root, len(steps)
    return step


def _rows(df):
    return sorted((json.dumps(r.asDict(), default=str, sort_keys=True) for r in df.collect()))


def _snap(spark, root):
    v = pipeline.TableRoot(spark, root).views()
    return {t: _rows(v[t].drop("batch_id")) for t in TABLES}


def _check_reports(spark, root, some=("r4_table_counts", "r6_token_totals", "r9_top_tools", "r22_most_edited")):
    v, stored = pipeline.TableRoot(spark, root).views(), partials.StoredReports(spark, root)
    for name, kw in [x for x in STORED if some is None or x[0] in some]:
        want, got = getattr(R, name)(v, **kw), getattr(stored, name)(**kw)
        assert got.dtypes == want.dtypes, name
        assert [r.asDict() for r in got.collect()] == [r.asDict() for r in want.collect()], name
    assert stored.r5_unique_files(approx=True).first()[0] == v["files_referenced"].agg(F.count_distinct("file_path")).first()[0]


def test_stored_sums_follow_the_runs(spark, grown):
    """Reports from stored sums equal those from the tables after each refresh, over one run or several, and after merges."""
    grown(0)
    _check_reports(spark, grown.root)
    grown(1)                                     # a session replaced, an id becomes shared
    _check_reports(spark, grown.root)
    assert partials.refresh(spark, grown.root) is None
    grown(2)
    grown(3)                                     # two runs at one refresh
    assert tiers.compact_tiers(spark, grown.root, fanout=4)
    _check_reports(spark, grown.root)
    grown(4)                                     # replaces sessions of the merged batch
    _check_reports(spark, grown.root, None)
    # no report reads a fact table
    files = [f for f in partials.StoredReports(spark, grown.root).r9_top_tools().inputFiles()]
    assert files and all("/partials/" in f for f in files)
    # a refresh that stopped before its last table does not count
    store = pipeline.TableRoot(spark, grown.root)
    gen = store.current_generation()
    spark.range(5).selectExpr("id AS _rows").write.parquet(f"{grown.root}/{gen}/partials/by_message/refresh_id=r9-broken")
    _check_reports(spark, grown.root)
    pipeline.compact(spark, grown.root)
    _check_reports(spark, grown.root)


def test_merges_keep_views(spark, grown):
    for i in range(grown.n - 1):
        grown(i)
    before = _snap(spark, grown.root)
    store = pipeline.TableRoot(spark, grown.root)
    gen = store.current_generation()
    batches = store.live_batches(gen)
    # the middle two, whose sessions replace some before them and are replaced after
    merged = tiers.merge_batches(store, gen, batches[1:3])
    assert store.live_batches(gen) == [batches[0], merged, batches[3]]
    assert _snap(spark, grown.root) == before
    assert pipeline.run(spark, pipeline.DiskSource(os.path.dirname(grown.root) + "/claude"), grown.root).files_extracted == 0
    done = tiers.compact_tiers(spark, grown.root, fanout=2)
    assert [d[1] for d in done] == [[batches[0], merged, batches[3]]]
    assert _snap(spark, grown.root) == before and len(store.live_batches(gen)) == 1
    grown(4)
    before = _snap(spark, grown.root)
    gone = tiers.remove_merged(spark, grown.root)
    assert gone == sorted([*batches, merged]) and tiers.remove_merged(spark, grown.root) == []
    assert _snap(spark, grown.root) == before and len(store.live_batches(gen)) == 2
    assert tiers.compact_tiers(spark, grown.root) == []


def test_merge_without_a_manifest_is_not_seen(spark, grown):
    for i in range(2):
        grown(i)
    before = _snap(spark, grown.root)
    store = pipeline.TableRoot(spark, grown.root)
    gen = store.current_generation()
    batches = store.live_batches(gen)
    spark.createDataFrame([(b,) for b in batches], "input string").write.parquet(store.path(gen, "merged", batches[-1] + "m"))
    store.read(gen, "messages").limit(1).drop("batch_id").write.parquet(store.path(gen, "messages", batches[-1] + "m"))
    assert store.live_batches(gen) == batches and _snap(spark, grown.root) == before
    tiers.merge_batches(store, gen, batches)      # done again, it overwrites what the first left
    assert _snap(spark, grown.root) == before


def test_bytes_rewritten_follow_new_data():
    """10,000 batches of like size: each byte is rewritten once for each of the log(10,000) / log(8) tiers, at most."""
    fanout, base, sizes, rewritten, most = 8, 100, [], 0, 0
    for i in range(10_000):
        sizes.append((f"{i:05d}", 100))
        while run := tiers.choose(sizes, fanout, base):
            at = [b for b, _ in sizes].index(run[0])
            n = sum(x for _, x in sizes[at:at + len(run)])
            assert [b for b, _ in sizes[at:at + len(run)]] == run
            sizes[at:at + len(run)] = [(run[-1] + "m", n)]
            rewritten += n
        most = max(most, len(sizes))
    assert sum(n for _, n in sizes) == 1_000_000 and rewritten <= 5 * 1_000_000 and most <= 8 * 6
    assert tiers.choose([("a", 1), ("b", 10 ** 9), ("c", 1)], 2, 100) == []
    with pytest.raises(ValueError):
        tiers.compact_tiers(None, "x", fanout=1)


def test_sketch_error(spark):
    """The sketch's estimate of 200,000 files, merged from ten runs that share half of them, is within 2 %."""
    rows = spark.range(300_000).selectExpr("id % 200000 AS f", "id % 10 AS run")
    sketches = rows.groupBy("run").agg(F.hll_sketch_agg(F.concat(F.lit("/home/u/"), "f"), partials.SKETCH_BITS).alias("s"))
    got = sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("s"))).first()[0]
    assert abs(got / 200_000 - 1) < 0.02
