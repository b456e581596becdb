"""The robust estimates of op9 against numpy, by definition."""
import numpy as np
from pyspark.sql import functions as F

from chatlake.llm import outliers as O


def _docs(spark, rng):
    """Texts of two sources: words, symbols, capitals, repeats and lines vary together, some far out."""
    out = []
    for d in range(520):
        odd = rng.random() < 0.08
        words = ["".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 9)))) for _ in range(int(rng.integers(60, 140)))]
        for i in range(len(words)):
            if rng.random() < (0.5 if odd else 0.05):
                words[i] = words[i].upper() if rng.random() < 0.5 else words[i] + "#$"
        if rng.random() < 0.4:
            words += words[:int(rng.integers(3, 12))]
        lines = [" ".join(words[i:i + 12]) for i in range(0, len(words), 12)]
        out.append((d, "\n".join(lines + lines[:int(rng.integers(0, 3))]), "en", "web" if d % 2 else "book"))
    return spark.createDataFrame(out, "doc_id long, text string, lang string, source string")


def _factor(s):
    p = len(O.VECTOR)
    low = np.zeros((p, p))
    for j in range(p):
        low[j, j] = np.sqrt(max(s[j, j] - (low[j, :j] ** 2).sum(), O.FLOOR[j] ** 2 / 4))
        for i in range(j + 1, p):
            low[i, j] = (s[i, j] - (low[i, :j] * low[j, :j]).sum()) / low[j, j]
    return low


def _d2(x, mu, low):
    return (np.linalg.solve(low, (x - mu).T) ** 2).sum(0)


def _median(a):
    return np.sort(a, axis=0)[(len(a) + 1) // 2 - 1]


def _fits(x, core, steps):
    """Logarithm of the determinant, mean and factor at the end of each start."""
    floor = np.array(O.FLOOR)
    mu = _median(x)
    sd = np.sqrt((O._MAD * _median(abs(x - mu))) ** 2 + floor ** 2)
    z = (x - mu) / sd
    norm = np.linalg.norm(z, axis=1, keepdims=True)
    out = []
    for a in (None, np.tanh(z), np.where(norm > 0, z / np.where(norm > 0, norm, 1), 0)):
        s = np.diag(sd ** 2)
        if a is not None:
            c = np.cov(a.T, bias=True)
            v = np.sqrt(np.outer(np.diag(c), np.diag(c)))
            s = np.where(np.eye(len(sd)) > 0, s, np.where(v > 0, c / np.where(v > 0, v, 1), 0) * np.outer(sd, sd))
        m, low, last = mu, _factor(s), None
        for _ in range(steps):
            b = np.ceil(np.log(np.maximum(_d2(x, m, low), 1e-12)) * 64)
            edge = np.sort(b)[int(np.ceil(core * len(b))) - 1]
            near = x[b <= edge]
            m1, low1 = near.mean(0), _factor(np.cov(near.T, bias=True) * O._CONSISTENCY + np.diag(floor ** 2))
            det = 2 * np.log(np.diag(low1)).sum()
            if last is not None and not det < last - O.LEAST_FALL:
                break
            m, low, last = m1, low1, det
        out.append((last, m, low))
    return out


def test_least_determinant(spark):
    docs = _docs(spark, np.random.default_rng(7))
    stats = O._vector(O.statistics(docs, "text", "doc_id", "source")).collect()
    got = {r["doc_id"]: r for r in O.judged(docs).collect()}
    ends = []
    for source in ("web", "book"):
        use = [r for r in stats if r["source"] == source and not got[r["doc_id"]]["base_failed"]]
        x = np.array([[r[v] for v in O.VECTOR] for r in use])
        fits = _fits(x, O.CORE, O.STEPS)
        ends += [round(f[0], 6) for f in fits]
        _, m, low = min(fits, key=lambda f: f[0])
        assert len(use) >= O.MIN_GROUP
        np.testing.assert_allclose([got[r["doc_id"]]["distance2"] for r in use], _d2(x, m, low), rtol=1e-6)
        assert all(got[r["doc_id"]]["kept"] == (got[r["doc_id"]]["distance2"] <= O.CUTOFF) for r in use)
    assert len(ends) == 6


def test_small_sources_and_steps(spark):
    """A source of few documents is judged by its language; one step is a fit as well; order and partitions do not matter."""
    docs = _docs(spark, np.random.default_rng(8)).withColumn("source", F.when(F.col("doc_id") < 5, "tiny").otherwise(F.col("source")))
    one = {r["doc_id"]: r["distance2"] for r in O.judged(docs, steps=1).collect()}
    assert len(one) == 520 and all(v is None or v >= 0 for v in one.values())
    a, b = ({r["doc_id"]: r["kept"] for r in O.judged(d).collect()} for d in (docs, docs.repartition(13, F.col("text")).orderBy(F.desc("doc_id"))))
    assert a == b
