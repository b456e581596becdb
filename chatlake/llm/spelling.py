"""Spelling variants: words one edit apart, grouped under their commonest form.

Words are letter runs of the texts, counted over all of them. A word is a row
of letter counts; two words one edit apart have rows at a squared distance of
two at most, in blocks of equal or adjacent length. NumPy products of blocks
(Gram matrices) give these distances, and pairs within it are compared letter
by letter. Blocks are parted further by how many letters of three classes a
word has, as one edit moves such a count by one at most: no pair is lost.
A block is cut into chunks, and a task holds two chunks at a time.

A null text has no words, a null id is written ``null``. Empty texts have no
words; very long texts are read whole, a batch at a time. Repeated rows count
each. Ties between forms go to the smallest in code-point order. An empty
table, or one without frequent words, gives no row. Other columns of the
documents are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import python_workers, saved
from chatlake.llm.ranks import ranked

MIN_LENGTH, MIN_COUNT, RATIO, DAMAGED = 6, 5, 5, 199
#: Words whose counts a worker holds before it passes them on.
HELD = 300_000
#: Words of a chunk: two chunks' Gram matrix has the square of it.
CHUNK = 1024
#: Letters whose numbers in a word part the blocks.
CLASSES = ("aeiou", "lnrs", "cdmt")

# bytes of Latin-1 text: letters stay, A-Z in lower case, all else parts words
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: Columns of a word's row: a to z, and six for the letters beyond (sums of counts keep distances a lower bound).
_COLUMN = np.array([b - 97 if 97 <= b <= 122 else 26 + b % 6 for b in range(256)])
_SHORT = 64


class _Runs(dict):
    """The number of each run seen, with its UTF-8 length and CRC-32."""

    def __init__(self):
        super().__init__()
        self.crc, self.length = [], []

    def __missing__(self, run: bytes) -> int:
        utf8 = run.decode("latin-1").encode()
        self.crc.append(zlib.crc32(utf8))
        self.length.append(len(utf8))
        self[run] = n = len(self)
        return n


def _shifted(prefix: bytes) -> list[int]:
    """By length L: crc32(prefix + x) ^ crc32(x) for any x of L bytes (CRC-32 is linear)."""
    a, b, out = zlib.crc32(prefix), 0, []
    for _ in range(_SHORT + 1):
        out.append(a ^ b)
        a, b = zlib.crc32(b"\0", a), zlib.crc32(b"\0", b)
    return out


def _counts(batches, least: int):
    """(word, n) of the runs in the batches, damaged ones with their letter gone."""
    runs, held, odd = _Runs(), np.zeros(0, dtype=np.int64), {}

    def out():
        pairs = [(w, int(n)) for w, n in zip(runs, held) if n and len(w) >= least]
        pairs += [(w, n) for w, n in odd.items() if len(w) >= least]
        for i in range(0, len(pairs), 50_000):
            part = pairs[i:i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w, _ in part], pa.string()),
                                              pa.array([n for _, n in part], pa.int64())], names=["word", "n"])

    for batch in batches:
        ids = batch.column(0).to_pylist()
        found = [(t or "").encode("latin-1", "replace").translate(_LETTERS).split() for t in batch.column(1).to_pylist()]
        flat = [r for f in found for r in f]
        at = np.fromiter(map(runs.__getitem__, flat), dtype=np.int64, count=len(flat))
        prefixes = [f"{'null' if i is None else i}:".encode() for i in ids]
        shift = np.array([_shifted(p) for p in prefixes], dtype=np.int64).reshape(len(ids), _SHORT + 1)
        crc, length = np.array(runs.crc, dtype=np.int64), np.array(runs.length, dtype=np.int64)
        doc = np.repeat(np.arange(len(ids)), [len(f) for f in found])
        h = shift[doc, np.minimum(length[at], _SHORT)] ^ crc[at]
        for k in np.flatnonzero(length[at] > _SHORT):
            h[k] = zlib.crc32(flat[k].decode("latin-1").encode(), zlib.crc32(prefixes[doc[k]]))
        hit = h % DAMAGED == 0
        for k in np.flatnonzero(hit):
            run, gone = flat[k], int(h[k]) % len(flat[k])
            word = run[:gone] + run[gone + 1:]
            odd[word] = odd.get(word, 0) + 1
        n = np.bincount(at[~hit], minlength=len(runs))
        n[:len(held)] += held
        held = n
        if len(runs) > HELD:
            yield from out()
            runs, held, odd = _Runs(), np.zeros(0, dtype=np.int64), {}
    yield from out()


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
          min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the words of ``min_length`` letters and ``min_count`` occurrences or more.

    A run of letters whose CRC-32 (of id, colon and run) is a multiple of 199
    loses the letter that the CRC names, as the task's contract asks."""
    python_workers(docs.sparkSession)
    parts = docs.select(id_col, text_col).mapInArrow(lambda b: _counts(b, min_length), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _chunks(found: DataFrame) -> DataFrame:
    """key (length and class counts), chunk, words and their counts: 1024 words at most a row."""
    n_of = [F.length("word") - F.length(F.translate("word", c, "")) for c in CLASSES]
    keyed = found.select(F.concat_ws("/", F.length("word"), *n_of).alias("key"), F.length("word").alias("length"),
                         *[n.alias(f"c{k}") for k, n in enumerate(n_of)], "word", "n")
    placed = ranked(keyed, ["key"], ["word"])
    one = placed.groupBy("key", "length", *[f"c{k}" for k in range(len(CLASSES))], F.floor(F.col("position") / CHUNK).alias("chunk"))
    rows = one.agg(F.collect_list(F.struct("word", "n")).alias("w"))
    return saved(rows.select("key", "length", "c0", "c1", "c2", "chunk", F.col("w.word").alias("words"), F.col("w.n").alias("ns")), "chunks")


def _partners(length, *counts):
    """Keys of the blocks to compare a block with: its own, and one edit away. Of two blocks of one
    length each names the other; the pair is taken where the first key is the smaller text."""
    rest = (0,) * len(counts)
    unit = [tuple(int(i == k) for i in range(len(counts))) for k in range(len(counts))] + [rest]
    moves = {(0, tuple(a - b for a, b in zip(u, v))) for u in unit for v in unit} | {(1, u) for u in unit}
    return F.array(*[F.concat_ws("/", length + dl, *[c + d for c, d in zip(counts, by)]) for dl, by in sorted(moves)])


def _matrix(words: list[str]):
    """Letters of the words (of one length) as bytes, and their rows of letter counts."""
    letters = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), -1)
    rows, each = np.zeros((len(words), 32), dtype=np.float32), np.arange(len(words))
    for column in _COLUMN[letters].T:
        rows[each, column] += 1
    return letters, rows


def near(x_words: list[str], y_words: list[str], same: bool = False):
    """Index pairs of words one edit apart; words of ``y_words`` are as long as those of ``x_words`` or by one longer.
    ``same``: both are one list, each pair once."""
    (x, rx), (y, ry) = _matrix(x_words), _matrix(y_words)
    apart = (rx * rx).sum(1)[:, None] + (ry * ry).sum(1)[None, :] - 2 * (rx @ ry.T)
    i, j = np.nonzero(apart <= 2.5)  # whole numbers, but for rounding
    if same:
        i, j = i[i < j], j[i < j]
    if x.shape[1] == y.shape[1]:
        ok = (x[i] != y[j]).sum(1) == 1
    else:
        ahead = np.logical_and.accumulate(x[i] == y[j][:, :-1], axis=1).sum(1)
        behind = np.logical_and.accumulate((x[i] == y[j][:, 1:])[:, ::-1], axis=1).sum(1)
        ok = ahead + behind >= x.shape[1]
    return i[ok], j[ok]


def near_pairs(found: DataFrame) -> DataFrame:
    """word, other, other_n: each pair of words one edit apart, both ways."""
    python_workers(found.sparkSession)
    chunks = _chunks(found)
    left = chunks.withColumn("partner", F.explode(_partners(F.col("length"), F.col("c0"), F.col("c1"), F.col("c2"))))
    right = chunks.select(F.col("key").alias("partner"), F.col("chunk").alias("chunk2"), F.col("length").alias("length2"),
                          F.col("words").alias("words2"), F.col("ns").alias("ns2"))
    pairs = left.join(right, "partner").where(
        (F.col("length2") > F.col("length")) | (F.col("key") < F.col("partner")) | ((F.col("key") == F.col("partner")) & (F.col("chunk") <= F.col("chunk2"))))
    pairs = pairs.select("words", "ns", "words2", "ns2", ((F.col("key") == F.col("partner")) & (F.col("chunk") == F.col("chunk2"))).alias("same"))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                w, n, w2, n2, same = (c[k].as_py() for c in batch.columns)
                i, j = near(w, w2, same)
                a, b, an, bn = (np.asarray(v, dtype=object) for v in (w, w2, n, n2))
                yield pa.RecordBatch.from_arrays([pa.array([*a[i], *b[j]], pa.string()), pa.array([*b[j], *a[i]], pa.string()),
                                                  pa.array([*bn[j], *an[i]], pa.int64())], names=["word", "other", "other_n"])

    return pairs.mapInArrow(run, "word string, other string, other_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms of (word, form) end. A form is commoner than its word, so there is an end;
    each round doubles the steps, and a count bounds them at some 27."""
    to = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        to = saved(to.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = to.where("moved").limit(1).count()
        to = to.drop("moved")
        if not moved:
            return to


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
             min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """A row for each word: word, n, n_near, form, form_n, root. ``form`` is the commonest word one edit
    away, if it is ``ratio`` times as common or more; ``root`` is where the forms lead."""
    found = saved(words(docs, id_col, text_col, min_length, min_count), "words")
    best = near_pairs(found).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    most = -F.col("best.minus")
    out = found.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(most >= ratio * F.col("n"), F.col("best.other")).alias("form"),
        F.when(most >= ratio * F.col("n"), most).alias("form_n"))
    out = saved(out, "forms")
    ends = roots(out.where(F.col("form").isNotNull()))
    return out.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
