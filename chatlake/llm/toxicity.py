"""Toxicity by maximum-scoring segment search.

Tokens are lower-cased runs of letters. Their log-odds of toxic against other
documents have a Dirichlet prior centred on what is known of the token's
prefixes, so that words unseen in training take after their stem. Clean words
count with their own negative log-odds; those near zero, of either sign, count
as a little clean. The running
sum of log-odds is cut, in one linear scan, into all maximal-scoring segments
(disjoint, none can be extended with profit); of each segment the extreme-value
law gives how likely a segment so high is by chance in a text of that length.
The evidence of a text is that of its significant segments together; a
logistic fit on training documents turns it into a probability.

The models are fitted on a bounded sample of labelled rows (``TRAIN_DOCS``);
every term of it that ``LEAST_DOCS`` of its documents have is used. Only the
text of a document is an input of its score, and the whole of it: a very long
text takes time and memory in proportion, in one task. Null and empty texts have no segments and
get the score of a text without evidence. Repeated rows get equal scores, and
so do tied terms, whatever their order. An empty table gives no rows; without
labels of both kinds every document has the same small score.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import defaultdict
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import bounded_sample, python_workers, saved

#: Labelled documents that the models are fitted on, at most.
TRAIN_DOCS = 20_000
#: A token or prefix must stand in so many training documents to be kept, and in so many toxic ones to speak for toxicity.
#: This, ``EVIDENT`` and ``NEUTRAL`` have the least log loss on folds of the training labels (tests/llm/toxic_folds.py).
LEAST_DOCS = 5
#: Weight of a Dirichlet prior, in documents.
PRIOR = 4.0
PREFIXES = range(3, 8)
#: Expected number of chance segments so high, below which a segment counts.
SIGNIFICANT = 0.05
#: Score of a token that no term speaks of, and of one whose log-odds are between this and ``EVIDENT``.
NEUTRAL = -0.25
EVIDENT = 1.5
#: A token's log-odds are held within this, so that one token is no proof by itself alone.
CLIP = 6.0

_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def terms(token: str) -> list[str]:
    """The token and its prefixes, shortest first; ``$`` ends a whole token."""
    return [token[:k] for k in PREFIXES if k < len(token)] + [token + "$"]


def log_odds(counts: dict[str, tuple[int, int]], toxic_docs: int, other_docs: int) -> dict[str, float]:
    """Log-odds by term. The Dirichlet prior of a term is worth ``PRIOR``
    documents, toxic and other in the shares that its longest known prefix has
    (a term without one: in the shares of all documents, which says nothing).

    ``counts``: toxic and other documents of each term.
    """
    even = toxic_docs / max(1, toxic_docs + other_docs)
    shares: dict[str, float] = {}
    out = {}
    for term in sorted(counts, key=lambda t: (len(t) - t.endswith("$"), t.endswith("$"), t)):
        stem = term.removesuffix("$")
        prior = next((shares[stem[:k]] for k in reversed(PREFIXES) if k < len(stem) and stem[:k] in shares), even)
        t, o = counts[term]
        share = (t + PRIOR * prior) / (t + o + PRIOR)
        if not term.endswith("$"):
            shares[term] = share
        share, least = min(max(share, 1e-9), 1 - 1e-9), min(max(even, 1e-9), 1 - 1e-9)
        out[term] = max(-CLIP, min(CLIP, math.log(share / (1 - share)) - math.log(least / (1 - least))))
    return out


def evident(counts: dict[str, tuple[int, int]], toxic_docs: int, other_docs: int) -> dict[str, float]:
    """Log-odds by term; those that speak for toxicity from too few toxic documents are 0."""
    odds = log_odds(counts, toxic_docs, other_docs)
    return {k: v if v <= EVIDENT or counts[k][0] >= LEAST_DOCS else 0.0 for k, v in odds.items()}


def effective(value: float) -> float:
    """The score of a token with these log-odds."""
    return value if value > EVIDENT else min(value, NEUTRAL)


def needed(odds: dict[str, float]) -> dict[str, float]:
    """``odds`` without the terms whose score a token gets from a shorter prefix, or from none, as well."""
    out: dict[str, float] = {}
    for term in sorted(odds, key=lambda t: (len(t) - t.endswith("$"), not t.endswith("$"), t)):
        stem = term.removesuffix("$")
        shorter = next((out[stem[:k]] for k in reversed(PREFIXES) if k < len(stem) and stem[:k] in out), 0.0)
        if effective(odds[term]) != effective(shorter):
            out[term] = odds[term]
    return out


def term_odds(counted: DataFrame, toxic_docs: int, other_docs: int) -> DataFrame:
    """Term and log-odds of all terms that a scorer needs, from the toxic (t) and
    other (o) documents of each ``term``. A term takes after its prefixes alone,
    so those that begin alike are judged together, in tasks."""

    def judged(group: pa.Table) -> pa.Table:
        counts = {k: (t, o) for k, t, o in zip(*(group.column(c).to_pylist() for c in ("term", "t", "o")))}
        odds = needed(evident(counts, toxic_docs, other_docs))
        return pa.table({"term": pa.array(list(odds), pa.string()), "odds": pa.array(list(odds.values()), pa.float64())})

    kept = counted.where(F.col("t") + F.col("o") >= LEAST_DOCS).select("term", "t", "o")
    return kept.groupBy(F.substring("term", 1, PREFIXES[0])).applyInArrow(judged, "term string, odds double")


class Scorer:
    """Scores of tokens, and segments of texts. Words are remembered up to a bound."""

    def __init__(self, odds: dict[str, float], decay: float = 1.0, scale: float = 1.0):
        self.odds, self.decay, self.scale = odds, decay, scale
        self._seen: dict[str, float] = {}

    def token(self, w: str) -> float:
        got = self.odds.get(w + "$")
        if got is None:
            got = next((self.odds[w[:k]] for k in reversed(PREFIXES) if k < len(w) and w[:k] in self.odds), 0.0)
        return effective(got)

    def scores(self, words: list[str]) -> np.ndarray:
        seen = self._seen
        if len(seen) > 500_000:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = self.token(w)
        out = np.fromiter(map(seen.__getitem__, words), dtype=np.float64, count=len(words))
        # a token said again at once is no further evidence
        again = np.fromiter(map(eq, words[1:], words), dtype=bool, count=max(0, len(words) - 1))
        out[1:][again] = np.minimum(out[1:][again], 0.0)
        return out

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        return maximal_segments(self.scores(words))

    def significant(self, words: list[str]) -> list[tuple[int, int, float, float]]:
        """(start, end, score, log10 of the expected number by chance) of each significant passage."""
        out = []
        for a, b, s in self.segments(words):
            expected = math.log10(self.scale * max(1, len(words))) - self.decay * s / math.log(10)
            if expected < math.log10(SIGNIFICANT):
                out.append((a, b, s, expected))
        return out

    def evidence(self, words: list[str]) -> tuple[float, float, float]:
        """-log10 of the best segment's chance, the sum over significant ones, their share."""
        found = self.significant(words)
        chance = [-e for *_, e in found]
        if not found:
            best = max((s for *_, s in self.segments(words)), default=0.0)
            return (max(0.0, self.decay * best - math.log(max(1, len(words)))) / math.log(10) * 0.5, 0.0, 0.0)
        return (max(chance), math.log1p(sum(chance)), sum(b - a for a, b, *_ in found) / len(words))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments as (start, end, score), in order; linear in the text.

    Runs without a positive score only lower the running sum, so the scan
    visits positive scores alone.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    # start, end, running sum before and after, and the last segment before it whose sum before is less
    stack: list[tuple[int, int, float, float, int]] = []
    for i in np.flatnonzero(scores > 0).tolist():
        start, low, high = i, float(total[i]), float(total[i + 1])
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append((start, i + 1, low, high, j))
                break
            start, _, low, _, before = stack[j]
            del stack[j:]
            j = before
    return [(a, b, high - low) for a, b, low, high, _ in stack]


#: Values of decay at which the sums of exp(decay * score) are taken.
DECAYS = np.linspace(0.01, 2.0, 200)
#: Texts, sum of their highest segments, of the logarithms of their lengths; tokens, sum of their scores, highest score, and the sums of DECAYS.
_BEFORE = 6


def moments(tables) -> np.ndarray:
    """What the law needs of the token scores of texts; those of two parts add up, but for the highest score."""
    out = np.zeros(_BEFORE + len(DECAYS))
    out[5] = -np.inf
    for s in tables:
        if len(s):
            out[:5] += 1, max((x for *_, x in maximal_segments(s)), default=0.0), math.log(len(s)), len(s), s.sum()
            out[5] = max(out[5], s.max())
            value, n = np.unique(s, return_counts=True)
            out[_BEFORE:] += [np.dot(np.exp(d * value), n) for d in DECAYS]
    return out


def extreme_value(parts: list[np.ndarray]) -> tuple[float, float]:
    """(decay, scale) of the law of the highest segment, from the moments of
    training documents without toxicity: decay solves mean(exp(decay*s)) = 1."""
    if not parts:
        return 1.0, 1.0
    texts, best, log_length, n, total, _, *sums = np.sum(parts, axis=0)
    if not n or max(p[5] for p in parts) <= 0 or total >= 0:
        return 1.0, 1.0
    mean = np.array(sums) / n
    under = np.flatnonzero(mean < 1)
    k = int(under[-1]) if len(under) else 0
    decay = float(DECAYS[k])
    if len(under) and k + 1 < len(DECAYS):
        decay += float((1 - mean[k]) / (mean[k + 1] - mean[k]) * (DECAYS[k + 1] - DECAYS[k]))
    # scale from the mean of decay*highest - log(length), whose law is Gumbel's with mean log(scale) + 0.5772
    return decay, max(1e-4, math.exp((decay * best - log_length) / texts - 0.5772))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights (the last is the intercept) by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        train_docs: int = TRAIN_DOCS) -> tuple[Scorer, np.ndarray]:
    """The scorer and the weights of the logistic fit. ``labels`` has one row
    for each training document; contradicting labels of an id count as toxic."""
    python_workers(docs.sparkSession)
    label = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y"))
    some = bounded_sample(label, train_docs, id_col)  # at most train_docs rows of two numbers: may be broadcast
    train = saved(docs.select(id_col, F.col(f"`{text_col}`").alias("text")).join(F.broadcast(some), id_col).select(F.col("y").cast("int"), "text"), "toxic-train")

    def found(batches):
        for batch in batches:
            by: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for term in set().union(*map(terms, set(tokens(text)))) if text else ():
                    by[term][y] += 1
            yield pa.RecordBatch.from_pydict({"term": list(by), "other": [v[0] for v in by.values()], "toxic": [v[1] for v in by.values()]},
                                             schema=pa.schema([("term", pa.string()), ("other", pa.int64()), ("toxic", pa.int64())]))

    # terms are counted in two thirds of the sample, and the rest, new to them, calibrates
    part = F.pmod(F.xxhash64("text"), F.lit(3))
    count = train.where(part > 0)
    n = dict(count.groupBy("y").count().collect())
    counted = count.select("y", "text").mapInArrow(found, "term string, other long, toxic long").groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o"))
    # a model of a bounded sample: its terms are those of LEAST_DOCS of its documents or more
    odds = dict(sorted(map(tuple, term_odds(counted, n.get(1, 0), n.get(0, 0)).collect())))
    plain = Scorer(odds)

    # texts of any length are reduced in tasks: to a row of moments for each task, then to a row of evidence for each text
    def summed(batches):
        texts = (plain.scores(tokens(t)) for batch in batches for t in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([moments(texts)], pa.list_(pa.float64()))], names=["m"])

    held = train.where(part == 0)
    parts = sorted(r["m"] for r in held.where("y = 0").select("text").mapInArrow(summed, "m array<double>").collect())
    scorer = Scorer(odds, *extreme_value([np.array(m) for m in parts]))

    def judged(batches):
        for batch in batches:
            found = [scorer.evidence(tokens(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["y", "e"])

    rows = sorted((r["y"], r["e"]) for r in held.select("y", "text").mapInArrow(judged, "y int, e array<double>").collect())
    y = np.array([float(r[0]) for r in rows])
    return scorer, logistic(np.array([r[1] for r in rows]), y) if len(set(y)) == 2 else np.array([0.0, 0.0, 0.0, -2.0])


_scorers: dict[str, Scorer] = {}


def with_score(docs: DataFrame, out_col: str, scorer: Scorer, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct: score, n_passages, passages (start, end token, score, log10 expected)."""
    python_workers(docs.sparkSession)
    odds = docs.sparkSession.sparkContext.broadcast(scorer.odds)  # the terms of a bounded sample
    key = uuid.uuid4().hex
    decay, scale, w = scorer.decay, scorer.scale, [float(x) for x in weights]

    @F.pandas_udf("score double, n_passages int, passages array<struct<start:int,end:int,score:double,expected:double>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        if key not in _scorers:  # once for each worker and model
            _scorers.clear()
            _scorers[key] = Scorer(odds.value, decay, scale)
        scorer, rows = _scorers[key], []
        for text in texts:
            words = tokens(text)
            z = float(np.dot(scorer.evidence(words), w[:3]) + w[3])
            found = scorer.significant(words)
            rows.append((1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), len(found), [{"start": a, "end": b, "score": s, "expected": e} for a, b, s, e in found]))
        return pd.DataFrame(rows, columns=["score", "n_passages", "passages"])

    return docs.withColumn(out_col, run(F.col(f"`{text_col}`")))
