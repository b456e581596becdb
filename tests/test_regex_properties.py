"""Spark's JVM regexes vs Python's ``re`` on generated text (brute force).

Java and Python regex engines differ in corner cases (Unicode whitespace,
anchors, greedy classes); the extractors must agree with Python's meaning.
All generated cases are checked in one Spark job.
"""
import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from chatlake.functions.commands import (COMMAND_ARGS_PATTERN, COMMAND_MESSAGE_PATTERN,
                                         COMMAND_NAME_PATTERN, command_invocation)
from chatlake.functions.text import bash_paths, strip

ALPHABET = list("ab./-_x:;|&> \t\n") + [" ", " ", "é", "\U0001F600", "<", "/"]
TAGS = ["<command-message>", "</command-message>", "<command-args>", "</command-args>",
        "<command-name>/", "</command-name>"]
words = st.lists(st.one_of(st.sampled_from(ALPHABET), st.sampled_from(TAGS)), max_size=30).map("".join)

PATH = re.compile(r"(?:^|\s)(/[^\s;|&>]+)")


def py_paths(cmd):
    return [m for m in PATH.findall(cmd) if "." in m.split("/")[-1]]


def py_command(text):
    m = re.search(COMMAND_MESSAGE_PATTERN, text)
    if m:
        a = re.search(COMMAND_ARGS_PATTERN, text)
        name = m.group(1).strip()
        return (name, a.group(1).strip() if a else None, ":" in name)
    m = re.search(COMMAND_NAME_PATTERN, text)
    if m:
        name = m.group(1).strip()
        return (name, None, ":" in name)
    return None


@settings(max_examples=8, deadline=None)
@given(st.lists(words, min_size=300, max_size=300))
def test_extractors_agree_with_python(spark, cases):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s string")
    got = {r["i"]: r for r in df.select(
        "i", bash_paths("s").alias("paths"), strip("s").alias("stripped"),
        command_invocation(F.col("s")).alias("cmd")).collect()}
    for i, c in enumerate(cases):
        r = got[i]
        assert list(r["paths"]) == py_paths(c), c
        assert r["stripped"] == c.strip(), c
        cmd = r["cmd"]
        want = py_command(c)
        assert (None if cmd is None else (cmd["command_name"], cmd["command_args"], cmd["is_skill"])) == want, c
