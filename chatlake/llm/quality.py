"""Quality classifier by co-training.

Two views of a document: its text content (shares of symbols, capitals,
digits and repeated words, word shapes and letters) and the page's metadata
(language, source, length, lines). Each view has a logistic classifier. In
each round both are fitted, each names the unlabelled documents it is surest
of, and these, with that label, join the training rows of the other view.
After the last round each view is calibrated on labelled rows kept aside, and
the calibrated log-odds, weighted by a last fit on the same rows, score every
document.

Fitting uses a bounded sample of labelled and of unlabelled rows; scoring
covers all. Null texts count as empty, null languages and sources as names of
their own, a null length as that of the text. Repeated rows get equal scores;
without labels of both kinds every document scores 0.5 and is kept.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import bounded_sample, python_workers, saved

#: Rows that the classifiers are fitted on, at most: labelled, and unlabelled ones that may get a pseudo-label.
LABELLED, UNLABELLED = 12_000, 12_000
ROUNDS = 4
#: Share of the unlabelled rows that a view hands over in a round, for each label at its frequency.
HANDED = 0.05
#: Pseudo-labels must be at least this sure.
SURE = 0.95
#: A document goes if its score is under this: only what is surely bad.
KEEP = 0.3
_SHAPES, _NAMES = 32, 32
_SYMBOLS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)


def content(text: str | None) -> list[float]:
    """The text view."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256).astype(np.float64)
    words = raw.split()
    n, size = max(1, len(words)), max(1.0, float(len(raw)))
    unique = len(set(words))
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = lambda a, b: float(count[a:b].sum()) / size
    out = [
        math.sqrt(float(count[_SYMBOLS].sum()) / n), math.sqrt(share(65, 91)), math.sqrt(share(48, 58)), math.sqrt(float(count[33]) / n),
        math.sqrt(float(count[124]) / n), math.sqrt(float(count[44] + count[46]) / n), share(128, 256), share(97, 123),
        unique / n, pairs / max(1, n - 1), math.log1p(sum(map(len, words)) / n), math.log1p(max(map(len, words), default=0)) / 5,
        1 - len(set(lines)) / max(1, len(lines)), math.log1p(n) / 10, float(n < 5)]
    # shapes of the words: their last character and length, hashed
    shapes = np.zeros(_SHAPES)
    for w, k in zip(*np.unique([(x[-1] % 32 * 8 + min(len(x), 15) // 2) % 251 for x in words] or [0], return_counts=True)):
        shapes[int(w) % _SHAPES] += k
    return out + np.sqrt(shapes / n).tolist()


def metadata(lang: str | None, source: str | None, n_chars: int | None, text: str | None) -> list[float]:
    """The page view: names of language and source, length, bytes and lines."""
    size = len(text or "")
    length = size if n_chars is None else max(0, n_chars)
    lines = (text or "").count("\n") + 1
    names = [0.0] * _NAMES
    names[zlib.crc32(f"lang:{lang}".encode()) % _NAMES] += 1.0
    names[zlib.crc32(f"source:{source}".encode()) % _NAMES] += 1.0
    return [math.log1p(length) / 10, math.log1p(lines) / 5, math.log1p(length / lines) / 8, float(length < 60)] + names


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights, the last of them the intercept, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.ones(len(y)) if weight is None else weight
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + penalty, x.T @ (weight * (p - y)) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def co_train(views: list[np.ndarray], y: np.ndarray, others: list[np.ndarray], rounds: int = ROUNDS, handed: float = HANDED, sure: float = SURE):
    """Both views' weights, and the weights that join their calibrated log-odds.

    ``views``: the labelled rows in each view, ``others``: the unlabelled ones.
    Every fourth labelled row is kept aside for calibration.
    """
    aside = np.arange(len(y)) % 4 == 0
    if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
        aside[:] = False
    mean = [np.concatenate(p).mean(axis=0) for p in zip(views, others)]
    spread = [np.concatenate(p).std(axis=0) + 1e-3 for p in zip(views, others)]
    views, others = ([(x - m) / s for x, m, s in zip(part, mean, spread)] for part in (views, others))
    rate = float(y[~aside].mean())
    extra = [np.full(len(others[0]), -1, dtype=np.int8) for _ in views]  # pseudo-labels that a view was given
    weights = []
    for turn in range(rounds + 1):
        weights = []
        for v, x in enumerate(views):
            got = extra[v] >= 0
            weights.append(fit_logistic(np.concatenate([x[~aside], others[v][got]]), np.concatenate([y[~aside], extra[v][got]]),
                                        np.concatenate([np.ones((~aside).sum()), np.full(got.sum(), 0.5)])))
        if turn == rounds or not len(others[0]):
            break
        for v, w in enumerate(weights):
            p = 1 / (1 + np.exp(-np.clip(_odds(others[v], w), -30, 30)))
            for label, certainty, part in ((1, p, rate), (0, 1 - p, 1 - rate)):
                free = np.flatnonzero((extra[1 - v] < 0) & (certainty >= sure))
                best = free[np.argsort(-certainty[free], kind="stable")][:max(1, int(handed * part * len(p)))]
                extra[1 - v][best] = label
    rows = aside if aside.any() else ~aside
    odds = np.column_stack([np.clip(_odds(x[rows], w), -12, 12) for x, w in zip(views, weights)])
    scale = [fit_logistic(odds[:, [v]], y[rows], ridge=0.1) for v in range(2)]
    calibrated = np.column_stack([np.clip(odds[:, v] * scale[v][0] + scale[v][1], -12, 12) for v in range(2)])
    joined = fit_logistic(calibrated, y[rows], ridge=0.1)
    return {"mean": mean, "spread": spread, "weights": weights, "scale": scale, "joined": joined}


def scores(model: dict, views: list[np.ndarray]) -> np.ndarray:
    """Per row: the joined score, and the calibrated score of each view."""
    out = []
    for v, x in enumerate(views):
        odds = np.clip(_odds((x - model["mean"][v]) / model["spread"][v], model["weights"][v]), -12, 12)
        out.append(np.clip(odds * model["scale"][v][0] + model["scale"][v][1], -12, 12))
    joined = _odds(np.column_stack(out), model["joined"])
    return 1 / (1 + np.exp(-np.clip(np.column_stack([joined, *out]), -30, 30)))


def _views(texts, langs, sources, lengths) -> list[np.ndarray]:
    rows = list(zip(texts, langs, sources, lengths))
    lengths_ok = lambda n: None if n is None or n != n else int(n)
    return [np.array([content(t) for t, *_ in rows]), np.array([metadata(lang, s, lengths_ok(n), t) for t, lang, s, n in rows])]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> dict | None:
    """The co-trained model; None without labels of both kinds."""
    python_workers(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.min(label_col).alias("y"))
    some = bounded_sample(known, labelled, "doc_id")
    pool = bounded_sample(docs.select("doc_id").distinct().join(known, "doc_id", "left_anti"), unlabelled, "doc_id").withColumn("y", F.lit(-1))
    chosen = saved(some.select("doc_id", F.col("y").cast("int")).unionByName(pool), "quality-rows")

    def views(batches):
        for batch in batches:
            y, *columns = (c.to_pylist() for c in batch.columns)
            a, b = _views(*columns) if y else ([], [])
            yield pa.RecordBatch.from_pydict({"y": y, "a": list(a), "b": list(b)}, schema=pa.schema([("y", pa.int32()), ("a", pa.list_(pa.float64())), ("b", pa.list_(pa.float64()))]))

    # at most LABELLED + UNLABELLED ids: broadcast, so that no text is moved
    rows = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).join(F.broadcast(chosen), "doc_id")
    rows = rows.dropDuplicates(["doc_id"]).select("y", "text", "lang", "source", "n_chars").mapInArrow(views, "y int, a array<double>, b array<double>")
    got = sorted(rows.collect(), key=lambda r: (r["y"], r["a"], r["b"]))
    order = np.random.default_rng(7).permutation(len(got))
    got = [got[i] for i in order]
    y = np.array([r["y"] for r in got if r["y"] >= 0], dtype=np.float64)
    if len(set(y)) < 2:
        return None
    side = lambda c, k: np.array([r[c] for r in got if (r["y"] >= 0) == k]).reshape(-1, len(got[0][c]))
    return co_train([side("a", True), side("b", True)], y, [side("a", False), side("b", False)])


def with_score(docs: DataFrame, out_col: str, model: dict | None, keep: float = KEEP) -> DataFrame:
    """``docs`` with a struct: score (of good quality), content_score, metadata_score, kept."""
    python_workers(docs.sparkSession)

    @F.pandas_udf("score double, content_score double, metadata_score double, kept boolean")
    def run(texts: pd.Series, langs: pd.Series, sources: pd.Series, lengths: pd.Series) -> pd.DataFrame:
        none = lambda s: [None if x is None or x != x else x for x in s]
        p = np.full((len(texts), 3), 0.5) if model is None or not len(texts) else scores(model, _views(none(texts), none(langs), none(sources), none(lengths)))
        return pd.DataFrame({"score": p[:, 0], "content_score": p[:, 1], "metadata_score": p[:, 2], "kept": p[:, 0] >= keep})

    return docs.withColumn(out_col, run("text", "lang", "source", F.col("n_chars").cast("double")))
