"""Secret scans by patterns and character Markov models.

Three patterns give the base spans. Two first-order Markov chains over
characters, of random strings and of ordinary identifiers, are trained on
labelled samples: what the patterns found in a bounded sample of documents is
labelled random, other runs of characters there are labelled ordinary. A run
of ``CANDIDATE`` characters whose log-likelihood ratio is high adds a span of
kind "markov", unless base spans cover all of it. Everything is DataFrame
expressions; the chains come to the driver as counts of pairs of ASCII
characters, at most 128 x 128.

Null texts are empty and have no spans. Positions are code points, ends
exclusive. Each row is judged by itself, so repeated rows get equal results;
without any labelled random string that chain is uniform.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import fresh

# The base patterns, the least length of what counts, and the
# group that the length is taken of.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Runs that the Markov models judge.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
IDENTIFIER = r"[A-Za-z0-9+/_=-]{8,}"
#: Mean log-likelihood ratio for each pair of characters, and in all, from which a run is a secret.
RATIO, RATIO_SUM = 1.0, 20.0
#: About so many documents are labelled by the patterns to train the chains.
SAMPLE_DOCS = 10_000
_A = 128
#: Characters that a run may have; the prior of both chains is uniform over them.
_N = 26 * 2 + 10 + 5


def _matches(text: Column, pattern: str, seen: str, value_group: int, least: int, kind: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, kind), those whose
    value is long enough. ``seen``: cheap pattern of texts that may have any.

    Each match is taken with the gap before it, and the rest of the text by
    the end, so that one pass over the text finds all."""
    with_gap = rf"(?s)(.*?)({pattern}|\z)"
    part = lambda g: F.transform(F.regexp_extract_all(text, F.lit(with_gap), F.lit(g)), F.length)
    parts = F.arrays_zip(part(1).alias("g"), part(2).alias("m"), part(2 + value_group).alias("v"))
    none = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    placed = F.aggregate(
        parts, F.struct(F.lit(0).alias("at"), none.alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + x["g"] + x["m"]).cast("int").alias("at"),
            F.when((x["m"] > 0) & (x["v"] >= least), F.concat(a["spans"], F.array(F.struct(
                (a["at"] + x["g"]).cast("int").alias("start"), (a["at"] + x["g"] + x["m"]).cast("int").alias("end"), F.lit(KINDS.index(kind)).alias("kind")))))
            .otherwise(a["spans"]).alias("spans")),
        lambda a: a["spans"])
    return F.when(text.rlike(seen), placed).otherwise(none)


def base_spans(text: Column) -> Column:
    return F.array_sort(F.concat(
        _matches(text, ASSIGN, ASSIGN, 1, LEAST["assign"], "assign"),
        _matches(text, ACCESS, f"AKIA[A-Z0-9]{{{LEAST['access'] - 4}}}", 0, LEAST["access"], "access"),
        _matches(text, rf"[0-9a-f]{{{LEAST['hex']},}}", f"[0-9a-f]{{{LEAST['hex']}}}", 0, LEAST["hex"], "hex")))


def train(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> list[float]:
    """Log-likelihood ratios of each pair of ASCII codes (row-major), random over ordinary."""
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = max(1, docs.count())
    some = docs.select(t.alias("t")).where(F.pmod(F.xxhash64(F.lit("train"), "t"), F.lit(rows)) < sample_docs)
    t = F.col("t")
    found = F.concat(F.filter(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(1)), lambda x: F.length(x) >= LEAST["assign"]),
                     F.regexp_extract_all(t, F.lit(rf"{ACCESS}|[0-9a-f]{{{LEAST['hex']},}}"), F.lit(0)))
    other = F.regexp_extract_all(F.regexp_replace(t, rf"{ASSIGN}|{ACCESS}|[0-9a-f]{{{LEAST['hex']},}}", " "), F.lit(IDENTIFIER), F.lit(0))
    runs = some.select(F.explode(F.concat(
        F.transform(found, lambda x: F.struct(F.lit(1).alias("random"), x.alias("run"))),
        F.transform(other, lambda x: F.struct(F.lit(0).alias("random"), x.alias("run"))))).alias("x")).select("x.*").distinct()
    pairs = runs.where(F.length("run") > 1).select("random", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("run") - 1), lambda i: F.substr(F.col("run"), i, F.lit(2)))).alias("pair"))
    counts = {(r, p): n for r, p, n in pairs.groupBy("random", "pair").count().collect()}
    return ratios(counts)


def ratios(counts: dict[tuple[int, str], int], prior: float = 20.0) -> list[float]:
    """From counts by (label, pair of characters); each chain has a uniform Dirichlet prior."""
    first: Counter = Counter()
    for (label, pair), n in counts.items():
        first[label, pair[0]] += n
    out = []
    for a in map(chr, range(_A)):
        for b in map(chr, range(_A)):
            p = [(counts.get((label, a + b), 0) + prior / _N) / (first[label, a] + prior) for label in (0, 1)]
            out.append(math.log(p[1] / p[0]))
    return out


def _ratio(run: Column, table: Column) -> Column:
    code = lambda i: F.ascii(F.substr(run, i, F.lit(1)))
    return F.aggregate(F.sequence(F.lit(2), F.length(run)), F.lit(0.0), lambda a, i: a + F.get(table, code(i - 1) * _A + code(i)))


def with_spans(docs: DataFrame, out_col: str, model: list[float], text_col: str = "text") -> DataFrame:
    """``docs`` with ``out_col``: array of (start, end, kind index) by start, then kind."""
    t, base, runs = fresh(docs, "t0", "base0", "runs0")
    text = F.col(t)
    table = F.split(F.lit(",".join(f"{x:.6g}" for x in model)), ",").cast("array<double>")
    random = lambda run: (lambda r: (r >= RATIO_SUM) & (r >= RATIO * (F.length(run) - 1)))(_ratio(run, table))
    with_gap = rf"(?s)(.*?)({CANDIDATE}|\z)"
    # a run that is no secret is left out before any position is counted
    some = F.exists(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), random)
    none = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    gaps, found = (F.regexp_extract_all(text, F.lit(with_gap), F.lit(g)) for g in (1, 2))
    placed = F.aggregate(
        F.arrays_zip(F.transform(gaps, F.length).alias("g"), found.alias("m")), F.struct(F.lit(0).alias("at"), none.alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + x["g"] + F.length(x["m"])).cast("int").alias("at"),
            F.when((F.length(x["m"]) > 1) & random(x["m"]), F.concat(a["spans"], F.array(F.struct(
                (a["at"] + x["g"]).cast("int").alias("start"), (a["at"] + x["g"] + F.length(x["m"])).cast("int").alias("end"), F.lit(KINDS.index("markov")).alias("kind")))))
            .otherwise(a["spans"]).alias("spans")),
        lambda a: a["spans"])
    df = docs.withColumn(t, F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).withColumn(base, base_spans(text))
    df = df.withColumn(runs, F.when(some, placed).otherwise(none))
    # base spans are in order of their starts: how far they cover a run from its start on, without a gap
    reach = lambda r: F.aggregate(base, r["start"], lambda at, b: F.when(b["start"] <= at, F.greatest(at, b["end"])).otherwise(at))
    added = F.filter(runs, lambda r: reach(r) < r["end"])
    return df.withColumn(out_col, F.array_sort(F.concat(F.col(base), added))).drop(t, base, runs)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(
        spans, start,
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).alias("out")),
        lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)))
