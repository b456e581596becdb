"""Lines and files as they are: exact JSON, listing and range reads in tasks, one shuffle of texts."""

import json
import os
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatlake.operators.ordinal import dense_position
from chatlake.operators.parse import parse_lines, quarantine, quarantine_of
from chatlake.operators.tables import build_messages, build_tool_calls
from chatlake.sources import files, transcripts as T
from helpers import lines_df

DEEP = "[" * 1100 + "]" * 1100


def lines(spark, values):
    return lines_df(spark, {"s1": values})


def test_deep_and_long_json_keep_their_rows(spark):
    tool = '{"type":"assistant","uuid":"u2","message":{"role":"assistant","content":[{"type":"text","text":"t"},{"type":"tool_use","id":"c1","name":"Read","input":{"file_path":"/a","x":%s}}]}}' % DEEP
    values = [tool, '{"type":"user","uuid":"u3","n":%s,"message":{"role":"user","content":"long number"}}' % ("7" * 1500),
              '{"type":"user","uuid":"u4","x":%s,"message":{"role":"user","content":"deep beside"}}' % DEEP]
    entries = parse_lines(lines(spark, values)).cache()
    assert [(r.uuid, r.text) for r in entries.orderBy("line_num").collect()] == [("u2", "t"), ("u3", "long number"), ("u4", "deep beside")]
    assert [(r.tool_call_id, r.tool_name, r.file_path) for r in build_tool_calls(entries).collect()] == [("c1", "Read", "/a")]
    assert build_messages(entries).count() == 3
    # its input's text is not in the tables, so the whole line is beside them
    assert [(r.reason, r.value) for r in quarantine_of(entries).collect()] == [("unread_input", tool)]


@pytest.mark.parametrize("line", ['{"type":"user"}%s' % x for x in (
    '{"type":"user"}', "}", "]", ',{"a":1}', ',"b":2', " x", "}{", "]}", ',{"chatlake_end":1}', ',{"chatlake_end":1}]', '},{"chatlake_end":1}', "[", " 1", "//c")])
def test_text_behind_an_object(spark, line):
    with pytest.raises(json.JSONDecodeError):
        json.loads(line)
    df = lines(spark, [line, '{"type":"user","chatlake_end":1,"uuid":"u"} \t'])
    assert [r.reason for r in quarantine(df).collect()] == ["trailing_content"]
    assert sorted((r.parse_error, r.type) for r in parse_lines(df).collect() if r.parse_error) == [("trailing_content", None)]


def test_reasons_agree_with_python(spark):
    rng = random.Random(6)
    base = ['{"type":"user","a":[1,{"b":"}{"}]}', "[1,2]", '"x"', "{'type':1}", '{"a":NaN}', "{bad", "null", '{"a":1,}', '{"a":"\\u00e9"}', "5", "{}", '{"a":tru}']
    values = list(base)
    for _ in range(60):
        v = list(rng.choice(base))
        for _ in range(rng.randrange(1, 3)):
            k = rng.randrange(len(v) + 1)
            v[k:k + rng.randrange(2)] = rng.choice('{}[],:"1 a')
        values.append("".join(v))
    got = {r.line_num: r.reason for r in quarantine(lines(spark, values)).collect()}
    for n, v in enumerate(values):
        try:
            want = None if isinstance(json.loads(v), dict) else "not_object"
        except json.JSONDecodeError:
            want = "blank" if not v.strip() else "bad"
        have = got.get(n)
        assert (have if have in (None, "not_object", "blank") else "bad") == want, v


def wide_exchanges(df, column):
    """Exchanges of the plan that carry ``column``."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")) if not plan else \
        df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [b for b in re.split(r"\n\n", plan) if re.match(r"\(\d+\) Exchange", b) and re.search(rf"Input \[\d+\]: .*\b{column}#", b)]


def test_messages_shuffle_texts_once(spark, tmp_path):
    values = [json.dumps({"type": "user", "uuid": f"u{k % 40}" if k % 3 else None, "message": {"role": "user", "content": f"text {k}"}}) for k in range(100)]
    parse_lines(lines(spark, values)).write.parquet(f"{tmp_path}/e")
    entries = spark.read.parquet(f"{tmp_path}/e")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = build_messages(entries)
        assert len(wide_exchanges(out, "content_text")) == 1
        assert len(wide_exchanges(dense_position(entries.select("session_id", "line_num", "text"), ["session_id"], ["line_num"], F.col("line_num") % 1), "text")) == 1
        rows = out.orderBy("sequence_number").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    seen, want = set(), []
    for k, v in enumerate(values):
        key = json.loads(v)["uuid"] or f"s1-{k}"
        if key not in seen:
            want.append((len(want), key, f"text {k}"))
        seen.add(key)
    assert [(r.sequence_number, r.message_id, r.content_text) for r in rows] == want


def test_positions_of_null_keys(spark):
    rows = [(rng_k, k) for k in range(90) for rng_k in (None, "a")]
    df = spark.createDataFrame(rows, "g string, o int").withColumn("b", F.when(F.col("o") >= 10, F.floor(F.col("o") / 10)))
    got = dense_position(df, ["g"], ["o"], F.col("b")).collect()
    assert {(r.g, r.o): r.position for r in got} == {(g, o): o for g, o in rows}


# ---------------------------------------------------------------- files
@pytest.mark.parametrize("text", [b"", b"\n", b"a", b"a\nb", b"a\r\nb\r\n", b"a\rb\r\r\nc\n\r", "é\r\nß\n".encode() * 5, b"x" * 50 + b"\n" + b"y\r\n" * 9, b"\r" * 7, b"\r\n" * 7, b"\xff\n\xfe"])
def test_ranges_of_any_size_give_the_same_lines(text, tmp_path, monkeypatch):
    import io
    want = [x.rstrip("\r\n") for x in io.TextIOWrapper(io.BytesIO(text), "latin-1", newline=None).read().replace("\r", "\n").split("\n")]
    want = want[:-1] if want[-1] == "" else want
    assert [x.decode("latin-1") for x in files.split_lines(text).to_pylist()] == want
    (tmp_path / "f").write_bytes(text)
    for step in (1, 2, 3, 7, 1000):
        monkeypatch.setattr(files, "STEP_BYTES", step)
        for size in (1, 2, 3, 5, 8, 13, 1000):
            got = []
            for begin in range(0, max(1, len(text)), size):
                with pa.OSFile(str(tmp_path / "f"), "rb") as f:
                    for data in files._chunks(f, begin, min(len(text), begin + size)):
                        got += files.split_lines(data).to_pylist()
            assert [x.decode("latin-1") for x in got] == want, (step, size)


def test_tree_listing(spark, tmp_path):
    paths = [".claude/projects/p%20 [1]/a.jsonl", "local_1/.claude/x/y/b.jsonl", "local_1.json", "empty/", "_h/audit.jsonl", "é/ü.jsonl"]
    for p in paths:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).mkdir() if p.endswith("/") else (tmp_path / p).write_text("x" * len(p))
    got = {r.path: (r.file_size, r.ms) for r in files.list_tree(spark, f"{tmp_path}/").select("*", F.unix_millis("file_mtime").alias("ms")).collect()}
    assert got == {f"{tmp_path}/{p}": (len(p), os.stat(tmp_path / p).st_mtime_ns // 1_000_000) for p in paths if not p.endswith("/")}
    old = {(r.path, r.file_size, r.file_mtime) for r in T._list_tree(spark, str(tmp_path)).collect()}
    assert old == {(r.path, r.file_size, r.file_mtime) for r in files.list_tree(spark, f"file:{tmp_path}").collect()}
    assert files.list_tree(spark, f"{tmp_path}/none").count() == 0
    assert not files.reachable("viewfs://store/x") and files.reachable("/data")


def test_chosen_files_are_read_in_ranges(spark, tmp_path):
    rng, want, rows = random.Random(7), {}, []
    for k in range(12):
        path = f"{tmp_path}/f%{k} *.jsonl"
        body = "".join("x" * rng.randrange(0, 40) + rng.choice(["\n", "\r\n"]) for _ in range(rng.randrange(0, 60))) + "end"
        if k != 5:
            open(path, "w", newline="").write(body)
            want[path] = body.replace("\r\n", "\n").split("\n")
        rows.append(("claude-code", path, f"s{k}", False, "d", "p", len(body), None, 0))
    chosen = spark.createDataFrame(rows, "source string, file_path string, session_id string, is_agent boolean, project_dir_name string, "
                                         "project_path string, file_size long, file_mtime timestamp, load_rank int")
    got = {}
    for r in T.read_lines(spark, chosen, range_bytes=37).collect():
        got.setdefault(r.file_path, {})[r.line_num] = r.value
    assert {p: [v[i] for i in range(len(v))] for p, v in got.items()} == want
    assert T.read_lines(spark, chosen.limit(0)).count() == 0


def test_code_transcripts_leave_no_paths_on_the_driver(spark, tmp_path):
    from chatlake import schemas
    from chatlake.plans import pipeline
    want = {}
    for k in range(300):
        path = tmp_path / f"projects/-p-{k % 3}/s{k}.jsonl"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("".join(f"{k} {i}\n" for i in range(k % 4)))
        want[str(path)] = {i: f"{k} {i}" for i in range(k % 4)}
    for other in ("projects/loose.jsonl", "projects/-p-0/deep/er.jsonl", "projects/-p-0/.hidden.jsonl", "projects/-p-0/_hidden.jsonl", "projects/-p-0/a.txt"):
        (tmp_path / other).parent.mkdir(exist_ok=True)
        (tmp_path / other).write_text("x\n")
    found = T.discover_code_files(spark, str(tmp_path))
    assert {r.file_path for r in found.collect()} == set(want)
    # files that a plan names are listed on the driver: here those of the listing alone
    assert len(found.inputFiles()) < 50
    chosen = found.select(*schemas.FILE_COLS)
    lines = pipeline.DiskSource(claude_dir=str(tmp_path)).lines(spark, chosen, whole=True)
    assert len(lines.inputFiles()) < 50
    got = {}
    for r in lines.collect():
        got.setdefault(r.file_path, {})[r.line_num] = r.value
        assert (r.session_id, r.project_dir_name) == tuple(r.file_path.removesuffix(".jsonl").split("/")[:-3:-1])
    assert got == {p: v for p, v in want.items() if v}
    assert T.discover_code_files(spark, f"{tmp_path}/none").count() == 0
