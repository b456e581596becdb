"""Choice of the constants of toxicity.py, on folds of the training labels alone.

``python tests/llm/toxic_folds.py SF_DIR``: no row whose crc32(doc_id) mod 5 is
0 is read. Each of five folds (by the start of the text, so that copies share
one) is judged by a model of the others, fitted as ``fit()`` does. The choice
is the setting with the least log loss. Figures of the held-out rows, for the
constants as they stand in the module, come from ``--held-out``.
"""

import itertools
import math
import multiprocessing
import sys
import zlib
from collections import defaultdict

import duckdb
import numpy as np

from chatlake.llm import toxicity as t

GRID = list(itertools.product((3, 5, 8), (0.5, 1.0, 1.5, 2.0), (-0.1, -0.25, -0.5, -1.0)))
DOCS: list = []


def read(sf_dir: str, held_out: bool) -> list:
    rows = duckdb.sql(f"select d.doc_id, d.text, max(l.toxic) from '{sf_dir}/documents.parquet' d join '{sf_dir}/labels.parquet' l using (doc_id) "
                      "where l.toxic is not null group by 1, 2 order by 1").fetchall()
    mine = [r for r in rows if (zlib.crc32(str(r[0]).encode()) % 5 == 0) == held_out]
    return [(zlib.crc32((text or "")[:100].encode()), t.tokens(text), y) for _, text, y in mine]


def fitted(docs: list):
    counts, n = defaultdict(lambda: [0, 0]), [0, 0]
    rest = []
    for key, words, y in docs:
        if key // 5 % 3 == 0:
            rest.append((words, y))
            continue
        n[y] += 1
        for term in set().union(*map(t.terms, set(words))) if words else ():
            counts[term][1 - y] += 1
    odds = t.evident({k: tuple(v) for k, v in counts.items() if sum(v) >= t.LEAST_DOCS}, n[1], n[0])
    plain = t.Scorer(odds)
    scorer = t.Scorer(odds, *t.extreme_value([t.moments(plain.scores(w) for w, y in rest if not y)]))
    return scorer, t.logistic(np.array([scorer.evidence(w) for w, _ in rest]), np.array([float(y) for _, y in rest]))


def judged(scorer, weights, docs: list) -> np.ndarray:
    """Toxic documents found and in all, others flagged and in all, log loss."""
    out = np.zeros(5)
    for _, words, y in docs:
        z = float(np.clip(np.dot(scorer.evidence(words), weights[:3]) + weights[3], -30, 30))
        p = 1 / (1 + math.exp(-z))
        out += [y * (p >= 0.5), y, (1 - y) * (p >= 0.5), 1 - y, -math.log(max(1e-9, p if y else 1 - p))]
    return out


def setting(values: tuple) -> tuple:
    t.LEAST_DOCS, t.EVIDENT, t.NEUTRAL = values
    total = np.zeros(5)
    for fold in range(5):
        total += judged(*fitted([d for d in DOCS if d[0] % 5 != fold]), [d for d in DOCS if d[0] % 5 == fold])
    return values, total


if __name__ == "__main__":
    DOCS = read(sys.argv[1], False)
    if "--held-out" in sys.argv:
        print(judged(*fitted(DOCS), read(sys.argv[1], True)))
    else:
        with multiprocessing.get_context("fork").Pool(8) as pool:
            for values, total in sorted(pool.imap_unordered(setting, GRID), key=lambda r: r[1][4]):
                print(values, "found %d of %d, flagged %d of %d, log loss %.1f" % tuple(total), flush=True)
