"""Golden mini-corpora (hand-written lines, expected rows worked out by hand)."""
import datetime as dt

import pytest

from helpers import rows, tables_for
from chatlake.operators.parse import parse_lines, quarantine
from helpers import lines_df

T0 = "2026-01-01T00:00:00Z"
E0 = 1767225600000  # same instant in epoch millis


@pytest.fixture(scope="module")
def basic(spark):
    return tables_for(spark, {"s1": [
        {"type": "user", "timestamp": T0, "uuid": "u1", "message": {"role": "user", "content": "hello"}},
        {"type": "assistant", "timestamp": E0 + 5000, "uuid": "a1", "parentUuid": "u1",
         "message": {"role": "assistant", "model": "claude-opus-4-6", "id": "msg_1",
                     "content": [{"type": "text", "text": "hi"}],
                     "usage": {"input_tokens": 100, "output_tokens": 50,
                               "cache_creation_input_tokens": 1000, "cache_read_input_tokens": 3000,
                               "service_tier": "standard"}}},
    ]})


def test_basic_session(basic):
    s = rows(basic["sessions"])[0]
    assert s["started_at"] == dt.datetime(2026, 1, 1, 0, 0, 0)
    assert s["ended_at"] == dt.datetime(2026, 1, 1, 0, 0, 5)
    assert s["duration_seconds"] == 5
    assert (s["user_message_count"], s["assistant_message_count"]) == (1, 1)
    assert (s["total_input_tokens"], s["total_output_tokens"],
            s["total_cache_creation_tokens"], s["total_cache_read_tokens"]) == (100, 50, 1000, 3000)
    assert s["cache_hit_rate"] == pytest.approx(3000 / 4100)
    assert s["estimated_input_cost_usd"] == pytest.approx(0.0015 + 0.01875 + 0.0045)
    assert s["estimated_output_cost_usd"] == pytest.approx(0.00375)
    assert s["estimated_total_cost_usd"] == pytest.approx(0.0285)
    assert s["model"] == "claude-opus-4-6"


def test_basic_messages(basic):
    m = rows(basic["messages"], ["sequence_number"])
    assert [x["message_id"] for x in m] == ["u1", "a1"]
    assert [x["sequence_number"] for x in m] == [0, 1]
    assert m[1]["parent_uuid"] == "u1" and m[1]["api_message_id"] == "msg_1"
    assert m[0]["input_tokens"] is None and m[1]["input_tokens"] == 100
    assert m[1]["service_tier"] == "standard"
    mu = rows(basic["model_usage"])
    assert mu == [{"session_id": "s1", "model": "claude-opus-4-6", "message_count": 1,
                   "total_input_tokens": 100, "total_output_tokens": 50,
                   "total_cache_creation_tokens": 1000, "total_cache_read_tokens": 3000}]


@pytest.fixture(scope="module")
def blocks(spark):
    return tables_for(spark, {"s2": [
        {"type": "assistant", "timestamp": T0, "uuid": "a0", "message": {"content": [
            {"type": "text", "text": "a"}, {"type": "thinking", "thinking": "t1"},
            {"type": "thinking", "thinking": ""},
            {"type": "tool_use", "id": "T1", "name": "Read", "input": {"file_path": "/a.py"}},
            {"type": "tool_use", "id": "T2", "name": "Bash",
             "input": {"command": "ls /tmp/x.txt; cat /etc/y.conf|wc /tmp/nodot", "description": "d"}},
            {"type": "tool_use", "id": None, "name": "Edit", "input": {"path": "/b.py"}},
            {"type": "tool_use", "id": "T1", "name": "Write", "input": {"file_path": "/c.py"}},
        ]}},
        {"type": "user", "timestamp": T0, "uuid": "u1", "message": {"content": [
            {"type": "tool_result", "tool_use_id": "T1", "is_error": True, "content": "boom" * 60},
            {"type": "tool_result", "tool_use_id": "T2", "is_error": False,
             "content": [{"type": "text", "text": "out"}, {"type": "image"}]},
            "bare string",
        ]}},
        {"type": "user", "timestamp": T0, "uuid": "u2", "message": {"content": [
            {"type": "tool_result", "tool_use_id": "T1", "is_error": False}]}},
    ]})


def test_block_text_and_thinking(blocks):
    m = {x["message_id"]: x for x in rows(blocks["messages"])}
    assert m["a0"]["content_text"] == "a"
    assert m["a0"]["has_thinking"] is True
    assert m["a0"]["thinking_text"] == "t1\n---\n"
    assert m["u1"]["content_text"] == "[tool_result: " + ("boom" * 60)[:200] + "]\n[tool_result: out]"
    assert m["u2"]["content_text"] == "[tool_result: ]"
    assert m["u1"]["has_thinking"] is False and m["u1"]["thinking_text"] is None


def test_tool_calls_link_and_dedupe(blocks):
    tc = {x["tool_call_id"]: x for x in rows(blocks["tool_calls"])}
    assert set(tc) == {"T1", "T2"}                      # NULL id dropped, repeated id: first wins
    assert tc["T1"]["tool_name"] == "Read" and tc["T1"]["file_path"] == "/a.py"
    assert tc["T1"]["has_error"] is False               # the later result wins
    assert tc["T2"]["has_error"] is False and tc["T2"]["description"] == "d"
    assert tc["T1"]["input_summary"] == '{"file_path":"/a.py"}'
    assert tc["T1"]["result_message_id"] is None
    s = rows(blocks["sessions"])[0]
    assert s["tool_call_count"] == 4                    # counted before the drop and dedupe


def test_files_referenced(blocks):
    f = {(x["file_path"], x["operation"]): x["reference_count"] for x in rows(blocks["files_referenced"])}
    assert f == {("/a.py", "read"): 1, ("/b.py", "edit"): 1, ("/c.py", "write"): 1,
                 ("/tmp/x.txt", "bash"): 1, ("/etc/y.conf", "bash"): 1}
    firsts = {x["first_referenced_at"] for x in rows(blocks["files_referenced"])}
    assert firsts == {dt.datetime(2026, 1, 1)}


@pytest.fixture(scope="module")
def commands(spark):
    return tables_for(spark, {"s3": [
        {"type": "user", "uuid": "c0", "timestamp": T0, "message": {"content":
            "<command-message>  review  </command-message>\n<command-name>/review</command-name>"
            "<command-args>  file.py </command-args>"}},
        {"type": "user", "uuid": "c1", "timestamp": T0, "message": {"content": "<command-name>/plugin:do</command-name>"}},
        {"type": "user", "uuid": "c2", "timestamp": T0, "message": {"content": "<command-message>x</command-message>"}},
        {"type": "user", "uuid": "c3", "timestamp": T0,
         "message": {"content": "<command-message>y</command-message><command-args></command-args>"}},
        {"type": "user", "uuid": "c4", "timestamp": T0,
         "message": {"content": [{"type": "text", "text": "<command-message>z</command-message>"}]}},
        {"type": "assistant", "uuid": "c5", "timestamp": T0,
         "message": {"content": "<command-message>q</command-message>"}},
        {"type": "user", "uuid": "c6", "timestamp": T0,
         "message": {"content": "<command-message> \t </command-message><command-args>" + "a" * 600 + "</command-args>"}},
    ]})


def test_commands(commands):
    c = {x["message_id"]: x for x in rows(commands["command_invocations"])}
    assert set(c) == {"c0", "c1", "c2", "c3", "c4", "c6"}
    assert (c["c0"]["command_name"], c["c0"]["command_args"], c["c0"]["is_skill"]) == ("review", "file.py", False)
    assert (c["c1"]["command_name"], c["c1"]["command_args"], c["c1"]["is_skill"]) == ("plugin:do", None, True)
    assert c["c2"]["command_args"] is None and c["c3"]["command_args"] == ""
    assert c["c4"]["command_name"] == "z"
    assert c["c6"]["command_name"] == "" and c["c6"]["command_args"] == "a" * 500 + "... [truncated]"
    assert rows(commands["sessions"])[0]["command_count"] == 6


@pytest.fixture(scope="module")
def attrs(spark):
    return tables_for(spark, {"s4": [
        {"type": "summary", "timestamp": "2025-12-31T23:00:00Z", "gitBranch": "", "cwd": "/w"},
        {"type": "user", "timestamp": "2026-01-01T00:00:00+01:00", "gitBranch": "main", "version": "1.2",
         "uuid": "x1", "message": {"content": "x"}},
        {"type": "system", "subtype": "turn_duration", "durationMs": 1500, "timestamp": "2026-01-01T00:10:00Z"},
        {"type": "system", "subtype": "turn_duration", "durationMs": 500},
        {"type": "system", "subtype": "other", "durationMs": 999},
        {"type": "assistant", "timestamp": "2026-01-01T00:00:30Z", "gitBranch": "dev", "slug": "s-lug",
         "uuid": "x2", "message": {"model": "", "content": "str content"}},
        {"type": "assistant", "uuid": "x3", "message": {"model": "claude-sonnet-4-6", "content": []}},
    ]})


def test_first_truthy_attrs_and_turns(attrs):
    s = rows(attrs["sessions"])[0]
    assert s["started_at"] == dt.datetime(2025, 12, 31, 23, 0, 0)
    assert s["ended_at"] == dt.datetime(2026, 1, 1, 0, 10, 0)
    assert s["duration_seconds"] == 4200
    assert (s["git_branch"], s["cwd"], s["claude_version"], s["slug"]) == ("main", "/w", "1.2", "s-lug")
    assert s["model"] == "claude-sonnet-4-6"
    assert (s["total_turn_duration_ms"], s["turn_count"], s["avg_turn_duration_ms"]) == (2000, 2, 1000.0)
    assert (s["user_message_count"], s["assistant_message_count"]) == (1, 2)
    assert s["cache_hit_rate"] is None and s["estimated_total_cost_usd"] == 0.0
    m = {x["message_id"]: x for x in rows(attrs["messages"])}
    assert m["x2"]["role"] == "assistant" and m["x2"]["content_text"] == "str content"
    assert m["x3"]["timestamp"] is None and m["x3"]["content_text"] == ""
    assert m["x2"]["git_branch"] == "dev"


def test_dirty_lines(spark):
    sess = {"s5": [
        "", "   ", "{bad json", "[1,2]",
        {"type": "user", "uuid": None, "timestamp": "17", "message": {"content": "a"}},
        {"type": "user", "timestamp": 17, "message": {"content": "b"}},
        '{"type":"user","type":"assistant","message":{"content":"dup"}}',
        {"type": "assistant", "message": {"usage": {}, "content": "u"}},
        {"type": "assistant", "message": {"usage": {"input_tokens": 5}, "content": "v"}},
        {"type": "user", "message": {"usage": {"input_tokens": 7}, "content": "w"}},
    ]}
    t = tables_for(spark, sess)
    m = rows(t["messages"], ["sequence_number"])
    assert [x["message_id"] for x in m] == ["s5-4", "s5-5", "s5-6", "s5-7", "s5-8", "s5-9"]
    assert [x["sequence_number"] for x in m] == [0, 1, 2, 3, 4, 5]
    assert m[0]["timestamp"] is None
    assert m[1]["timestamp"] == dt.datetime(1970, 1, 1, 0, 0, 0, 17000)
    assert m[2]["role"] == "assistant"
    assert m[3]["input_tokens"] is None
    assert (m[4]["input_tokens"], m[4]["output_tokens"]) == (5, 0)
    assert m[5]["input_tokens"] == 7
    s = rows(t["sessions"])[0]
    assert (s["user_message_count"], s["assistant_message_count"], s["total_input_tokens"]) == (3, 3, 5)
    assert rows(t["model_usage"]) == [{"session_id": "s5", "model": "unknown", "message_count": 1,
                                       "total_input_tokens": 5, "total_output_tokens": 0,
                                       "total_cache_creation_tokens": 0, "total_cache_read_tokens": 0}]
    q = rows(quarantine(lines_df(spark, sess)), ["line_num"])
    assert [(x["line_num"], x["reason"]) for x in q] == [
        (0, "blank"), (1, "blank"), (2, "malformed_json"), (3, "not_object")]


def test_truncation_counts_code_points(spark):
    big = "\U0001F600" * 50001
    t = tables_for(spark, {"s6": [
        {"type": "user", "uuid": "l0", "timestamp": T0, "message": {"content": big}},
        {"type": "assistant", "uuid": "l1", "timestamp": T0, "message": {"content": [
            {"type": "tool_use", "id": "B1", "name": "Bash", "input": {"command": "x" * 1001}},
            {"type": "tool_use", "id": "B2", "name": "Read", "input": {"file_path": "/f", "pad": "y" * 3000}}]}},
    ]})
    m = {x["message_id"]: x for x in rows(t["messages"])}
    assert m["l0"]["content_text"] == "\U0001F600" * 50000 + "... [truncated]"
    tc = {x["tool_call_id"]: x for x in rows(t["tool_calls"])}
    assert tc["B1"]["command"] == "x" * 1000 + "... [truncated]"
    assert len(tc["B2"]["input_summary"]) == 2000 + len("... [truncated]")


def test_bash_paths_unicode_space(spark):
    t = tables_for(spark, {"s7": [
        {"type": "assistant", "uuid": "b0", "timestamp": T0, "message": {"content": [
            {"type": "tool_use", "id": "B", "name": "Bash",
             "input": {"command": "/bin/run.sh /opt/a.txt>/tmp/o.log &/x/y.z cat\u00a0/opt/nb.txt"}}]}}]})
    f = {(x["file_path"], x["operation"]) for x in rows(t["files_referenced"])}
    # "&/x/y.z" has no whitespace before the slash; a no-break space counts.
    assert f == {("/bin/run.sh", "bash"), ("/opt/a.txt", "bash"), ("/opt/nb.txt", "bash")}


def test_out_of_range_values_do_not_fail_the_job(spark):
    t = tables_for(spark, {"s8": [
        {"type": "user", "uuid": "o1", "timestamp": 17, "message": {"content": "a"}},
        {"type": "user", "uuid": "o2", "timestamp": "9999-12-31T00:00:00Z", "message": {"content": "b"}},
        {"type": "assistant", "uuid": "o3", "timestamp": "2026-01-01T00:00:00Z",
         "message": {"content": "c", "usage": {"input_tokens": 99999999999}}},
        {"type": "system", "subtype": "turn_duration", "durationMs": 1e300},
    ]})
    s = rows(t["sessions"])[0]
    assert s["duration_seconds"] is None                 # beyond INT, like the columnar backend
    assert s["total_input_tokens"] == 99999999999
    m = {x["message_id"]: x for x in rows(t["messages"])}
    assert m["o3"]["input_tokens"] is None               # beyond the INT column


def test_prices_primary_model_override_and_fallback(spark):
    from chatlake.functions.pricing import merge_prices

    def asst(uuid, model, n):
        return {"type": "assistant", "uuid": uuid, "timestamp": T0,
                "message": {"model": model, "content": "x", "usage": {"input_tokens": n, "output_tokens": n}}}
    prices = merge_prices({"my-model": {"input": 1.0, "output": 2.0, "cache_read": 0.0, "cache_create": 0.0},
                           "default": {"input": 99, "output": 99, "cache_read": 99, "cache_create": 99}})
    t = tables_for(spark, {
        "mixed": [asst("m1", "claude-sonnet-4-6", 1000), asst("m2", "claude-opus-4-6", 1000)],
        "custom": [asst("c1", "my-model", 1_000_000)],
        "unknown": [asst("u1", "some-new-model", 1_000_000)],
    }, prices=prices)
    s = {r["session_id"]: r for r in rows(t["sessions"])}
    # Q1: all tokens at the primary (first) model's rates
    assert s["mixed"]["model"] == "claude-sonnet-4-6"
    assert s["mixed"]["estimated_total_cost_usd"] == pytest.approx(2000 / 1e6 * 3 + 2000 / 1e6 * 15)
    assert s["custom"]["estimated_total_cost_usd"] == pytest.approx(1.0 + 2.0)
    # Q5: the 'default' row is ignored; unknown models take the fixed fallback
    assert s["unknown"]["estimated_total_cost_usd"] == pytest.approx(3.0 + 15.0)
    mu = {(r["session_id"], r["model"]): r["message_count"] for r in rows(t["model_usage"])}
    assert mu[("mixed", "claude-opus-4-6")] == 1 and mu[("mixed", "claude-sonnet-4-6")] == 1


def test_tool_result_content_kinds(spark):
    t = tables_for(spark, {"s9": [
        {"type": "user", "uuid": "k1", "timestamp": T0, "message": {"content": [
            {"type": "tool_result", "tool_use_id": "a", "content": '[{"type": "text", "text": "looks like a list"}]'},
            {"type": "tool_result", "tool_use_id": "b", "content": None},
            {"type": "tool_result", "tool_use_id": "c"},
            {"type": "tool_result", "tool_use_id": "d", "content": 5},
            {"type": "tool_result", "tool_use_id": "e", "content": ["x", {"type": "text", "text": "y"},
                                                                     {"type": "image"}]},
        ]}}]})
    m = rows(t["messages"])[0]
    assert m["content_text"] == "\n".join([
        '[tool_result: [{"type": "text", "text": "looks like a list"}]]',   # a string stays a string
        "[tool_result: ]",                                                  # missing content
        "[tool_result: y]",                                                 # list: text items only
    ])
