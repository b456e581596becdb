"""Interpolated modified Kneser-Ney bigram model, counted in Spark.

Words are lower-cased (A-Z) runs without white space; each text starts in a
start state and ends with an end token. A word is its 64-bit hash, a bigram
the mixed hash of both.

Counting. Each task counts its texts into sorted arrays and sends, to each of
many ranges of history hashes, one row of packed arrays: what crosses the
shuffle is already summed. Histories that hold a large part of all tokens (at
most ``HOT`` of them can) are spread over the ranges by the second word. A
range is merged by one task, and its size follows from the number of tokens.

Storage. Each range is a file of sorted hashes and their values in the shared
scratch folder; workers map them into memory and look up sorted batches of
hashes, so that what a worker holds is what it touches.

A null or empty text is its end token alone. Repeated rows count each, and
get equal scores. If there is no training text, every score is that of the
uniform distribution over the one end token.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import python_workers, saved
from chatlake.session import scratch_path

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
END, START = np.uint64(1), np.uint64(2)  # hashes of the end token and of the start state
#: Tokens whose bigrams a range of hashes holds on average.
RANGE_TOKENS = 1_250_000
#: A history with more than one token in so many is spread over all ranges.
HOT = 128
#: Tokens that a task counts before it sends them on.
CHUNK_TOKENS = 2_000_000
#: Lengths of the counts-of-counts that the discounts come from.
_LEVELS = 4


def word_hashes(text: str | bytes | None) -> np.ndarray:
    """The hashes of the words and of the end."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    digest = xxhash.xxh3_64_intdigest
    w = raw.translate(_FOLD).split()
    out = np.empty(len(w) + 1, dtype=np.uint64)
    out[:-1] = np.fromiter(map(digest, w), dtype=np.uint64, count=len(w))
    np.maximum(out[:-1], 3, out=out[:-1])
    out[-1] = END
    return out


def mixed(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of each bigram."""
    x = history * np.uint64(0x9E3779B97F4A7C15) ^ (word + np.uint64(0x632BE59BD9B4E019))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def histories(words: np.ndarray) -> np.ndarray:
    return np.concatenate([[START], words[:-1]])


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _summed(keys: tuple[np.ndarray, ...], values: tuple[np.ndarray, ...]):
    """Rows with equal keys added up, in the order of the keys."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    keys = tuple(k[order] for k in keys)
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return tuple(k[at] for k in keys), tuple(np.add.reduceat(v[order], at).astype(v.dtype) if len(at) else v[:0] for v in values)


def _pack(*columns: np.ndarray) -> list[bytes]:
    return [c.tobytes() for c in columns]


def _unpack(rows: pa.Table, types: dict[str, str]) -> list[np.ndarray]:
    out = []
    for name, kind in types.items():
        parts = [np.frombuffer(b.as_buffer(), dtype=kind) for b in rows[name].combine_chunks()] if rows.num_rows else []
        out.append(np.concatenate(parts) if parts else np.zeros(0, dtype=kind))
    return out


def _ranges_of_rows(part: np.ndarray, ranges: int):
    """(range, slice) of arrays that are sorted by ``part``."""
    edges = np.searchsorted(part, np.arange(ranges + 1))
    return [(k, slice(a, b)) for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if a < b]


def _counted(texts: DataFrame, ranges: int, hot: list[int] | None) -> DataFrame:
    """Rows (part, keys, counts) of words, or with ``hot`` rows (part, h, w, n) of bigrams."""
    bigrams = hot is not None
    schema = "part int, h binary, w binary, n binary" if bigrams else "part int, w binary, n binary"
    hot_words = np.sort(np.array(hot or [], dtype=np.uint64))

    def sent(held: list[np.ndarray]):
        if bigrams:
            h, w = np.concatenate([histories(x) for x in held]), np.concatenate(held)
            (h, w), (n,) = _summed((h, w), (np.ones(len(h), dtype=np.uint32),))
            part = _range_of(h, ranges)
            if len(hot_words):
                at = np.minimum(np.searchsorted(hot_words, h), len(hot_words) - 1)
                part = np.where(hot_words[at] == h, _range_of(w * np.uint64(0x9E3779B97F4A7C15), ranges), part)
            order = np.argsort(part, kind="stable")
            columns, part = (h[order], w[order], n[order]), part[order]
        else:
            (w,), (n,) = _summed((np.concatenate(held),), (np.ones(sum(map(len, held)), dtype=np.uint32),))
            columns, part = (w, n), _range_of(w, ranges)
        names = schema.split(", ")
        rows = [(k, *_pack(*(c[s] for c in columns))) for k, s in _ranges_of_rows(part, ranges)]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, len(names)))], names=[x.split()[0] for x in names])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(word_hashes(text))
                size += len(held[-1])
                if size >= CHUNK_TOKENS:
                    yield sent(held)
                    held, size = [], 0
        if held:
            yield sent(held)

    return texts.mapInArrow(run, schema)


def _files(root: str):
    """The file system of the shared folder and the folder's path in it."""
    if "://" not in root:
        root = "file://" + root.removeprefix("file:")
    fs, path = pafs.FileSystem.from_uri(root)
    fs.create_dir(path, recursive=True)
    return fs, path


def _store(root: str, name: str, columns: list[np.ndarray]) -> None:
    """Writes a part of the model; a task that runs again puts the same file in place."""
    fs, path = _files(root)
    own = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        f.write(np.array([len(columns[0])], dtype=np.int64).tobytes())
        for c in columns:
            f.write(c.tobytes())
    fs.move(own, f"{path}/{name}")


def _mapped(root: str, name: str, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """The columns of a part of the model, mapped into memory. From a folder
    that is not mounted here the file is fetched first, and goes when closed."""
    fs, path = _files(root)
    file, fetched = f"{path}/{name}", None
    if not isinstance(fs, pafs.LocalFileSystem):
        import tempfile

        fetched = tempfile.NamedTemporaryFile(delete=False)
        with fs.open_input_stream(file) as f:
            while block := f.read(1 << 24):
                fetched.write(block)
        fetched.close()
        file = fetched.name
    raw = np.memmap(file, dtype=np.uint8, mode="r")
    if fetched:
        os.unlink(file)
    n, at, out = int(raw[:8].view(np.int64)[0]), 8, []
    for kind in kinds:
        end = at + n * np.dtype(kind).itemsize
        out.append(raw[at:end].view(kind))
        at = end
    return out


def _merged(rows: DataFrame, root: str, name: str, types: dict[str, str], fn, schema: str) -> DataFrame:
    """Each range merged by ``fn(part, arrays)``, which stores it and gives rows of ``schema``."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(key, group):
        out = fn(key[0].as_py(), _unpack(group, types))
        arrow = pa.schema([(x.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in schema.split(", ")])
        return pa.Table.from_pydict({c: [r[i] for r in out] for i, c in enumerate(names)}, schema=arrow)

    return rows.groupBy("part").applyInArrow(run, schema)


class Model:
    """What workers need to look up: where the parts are, and a few numbers."""

    def __init__(self, root: str, word_ranges: int, ranges: int, tokens: int, words: int, bigrams: int, discounts: list[float], hot: list[int], texts: int,
                 parts: list[str]):
        self.root, self.word_ranges, self.ranges = root, word_ranges, ranges
        self.tokens, self.words, self.bigrams, self.discounts, self.texts = tokens, words, bigrams, discounts, texts
        self.hot = np.sort(np.array(hot, dtype=np.uint64))
        self.parts = frozenset(parts)  # those that were stored: any of them that cannot be read is an error
        self._open: dict[str, list[np.ndarray]] = {}

    def _part(self, name: str, kinds: tuple[str, ...]) -> list[np.ndarray]:
        if name not in self._open:
            self._open[name] = _mapped(self.root, name, kinds)
        return self._open[name]

    def _look(self, kind: str, part: np.ndarray, key: np.ndarray, kinds: tuple[str, ...]) -> list[np.ndarray]:
        """Values of sorted different keys, 0 where there is none; ``part`` is their range."""
        out = [np.zeros(len(key), dtype=k) for k in kinds[1:]]
        order = np.argsort(part, kind="stable")
        for k, s in _ranges_of_rows(part[order], self.word_ranges if kind == "words" else self.ranges):
            if f"{kind}-{k}" not in self.parts:  # no training text has a key of this range
                continue
            hashes, *values = self._part(f"{kind}-{k}", kinds)
            if not len(hashes):
                continue
            rows = order[s]
            at = np.minimum(np.searchsorted(hashes, key[rows]), len(hashes) - 1)
            found = hashes[at] == key[rows]
            for o, v in zip(out, values):
                o[rows[found]] = v[at[found]]
        return out

    def word_values(self, words: np.ndarray) -> list[np.ndarray]:
        """Tokens, continuations, and as a history: tokens, and following words seen once, twice, more."""
        return self._look("words", _range_of(words, self.word_ranges), words, WORD_KINDS)

    def scores(self, texts: list[np.ndarray]) -> list[tuple[int, int, float, float]]:
        """For each text: tokens, known tokens, base score and log10 probability."""
        w = np.concatenate(texts)
        h = np.concatenate([histories(t) for t in texts])
        size = np.array([len(t) for t in texts])
        vocabulary, at_word = np.unique(np.concatenate([w, [START]]), return_inverse=True)
        count, follows, n1, n2, n3, _ = self.word_values(vocabulary)
        # as a history a word stands as often as a token; the start state, once in each text
        total = count.astype(np.float64)
        start = int(at_word[-1])
        at_word = at_word[:-1]
        at_history = np.concatenate([[start], at_word[:-1]])
        at_history[np.concatenate([[0], np.cumsum(size)[:-1]])] = start
        d1, d2, d3, dc1, dc2, dc3, total_follow, c1, c2, c3 = self.discounts
        # the lower order, over continuations, and what it leaves for unseen words
        f = follows.astype(np.float64)
        rest = (dc1 * c1 + dc2 * c2 + dc3 * c3) / max(total_follow, 1.0) if total_follow else 1.0
        lower = np.maximum(f - np.where(f == 0, 0, np.where(f == 1, dc1, np.where(f == 2, dc2, dc3))), 0) / max(total_follow, 1.0) + rest / (self.words + 1)
        key, at_pair, first = _pairs(h, w)
        part = _pair_ranges(h[first], w[first], self.ranges, self.hot)
        pair = self._look("pairs", part, key, PAIR_KINDS)[0].astype(np.float64)
        c = pair[at_pair]
        total[start] = self.texts
        t = total[at_history]
        seen = t > 0
        left = (d1 * n1 + d2 * n2 + d3 * n3)[at_history] / np.where(seen, t, 1.0)
        cut = np.where(c == 0, 0.0, np.where(c == 1, d1, np.where(c == 2, d2, d3)))
        p = np.where(seen, np.maximum(c - cut, 0) / np.where(seen, t, 1.0) + left * lower[at_word], lower[at_word])
        base = np.log10((count[at_word] + 0.1) / (self.tokens + 0.1 * (self.words + 1)))
        known = (count > 0)[at_word]
        at = np.concatenate([[0], np.cumsum(size)[:-1]])
        return list(zip(size.tolist(), np.add.reduceat(known.astype(np.int64), at).tolist(), np.add.reduceat(base, at).tolist(), np.add.reduceat(np.log10(p), at).tolist()))


WORD_KINDS = ("u8", "i8", "i8", "i8", "i8", "i8", "i8")  # hash; tokens, continuations, following seen once, twice, more; spare
PAIR_KINDS = ("u8", "u4")


def _pairs(h: np.ndarray, w: np.ndarray):
    key, first, at = np.unique(mixed(h, w), return_index=True, return_inverse=True)
    return key, at, first


def _pair_ranges(h: np.ndarray, w: np.ndarray, ranges: int, hot: np.ndarray) -> np.ndarray:
    part = _range_of(h, ranges)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
        part = np.where(hot[at] == h, _range_of(w * np.uint64(0x9E3779B97F4A7C15), ranges), part)
    return part


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and more, from the numbers
    of grams seen once to four times; 0.5, 1 and 1.5 where these are too few."""
    n1, n2, n3, n4 = n
    if min(n1, n2, n3) == 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    out = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(d, 0.05), k + 0.9) for k, d in enumerate(out))


def train(texts: DataFrame, text_col: str = "text", range_tokens: int = RANGE_TOKENS) -> Model:
    """The model of all texts of the table."""
    spark = texts.sparkSession
    python_workers(spark)
    texts = texts.select(F.col(f"`{text_col}`").cast("binary").alias("b"))
    # a token takes two bytes at least, so the number of ranges follows the input before any token is counted
    n_texts, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("b")), F.lit(0))).first()
    ranges = max(1, -(-(int(size) // 6 + n_texts) // range_tokens))
    word_ranges = max(1, -(-ranges // 2))
    root = scratch_path(spark, "kneser-ney")

    def words_merged(part, columns):
        (w,), (n,) = _summed((columns[0],), (columns[1].astype(np.int64),))
        hot = np.argsort(-n, kind="stable")[:HOT]
        return [(part, int(n.sum()), len(w), w[hot].tobytes(), n[hot].tobytes(), w.tobytes(), n.tobytes())]

    counted = saved(_merged(_counted(texts, word_ranges, None), root, "words", {"w": "u8", "n": "u4"}, words_merged,
                            "part int, tokens long, words long, hot_w binary, hot_n binary, w binary, n binary"), "kn-words")
    tokens, words = (int(x or 0) for x in counted.agg(F.sum("tokens"), F.sum("words")).first())

    def hot_of_ranges(batches):
        for batch in batches:
            w, n = (np.concatenate([np.frombuffer(b.as_buffer(), kind) for b in c] or [np.zeros(0, kind)]) for c, kind in zip(batch.columns, ("u8", "i8")))
            yield pa.RecordBatch.from_arrays([pa.array(w[n * HOT > tokens].view(np.int64))], names=["w"])

    # fewer than HOT words in all
    hot = [r["w"] & ((1 << 64) - 1) for r in counted.select("hot_w", "hot_n").mapInArrow(hot_of_ranges, "w long").collect()]
    hot = [*hot, int(START)] if n_texts * HOT > tokens else hot

    def pairs_merged(part, columns):
        (h, w), (n,) = _summed((columns[0], columns[1]), (columns[2].astype(np.uint32),))
        key = mixed(h, w)
        order = np.argsort(key)
        _store(root, f"pairs-{part}", [key[order], n[order].astype(np.uint32)])
        ones = [(n == k).astype(np.int64) for k in (1, 2)] + [(n > 2).astype(np.int64)]
        (hh,), followed = _summed((h,), tuple(ones))
        (ww,), (before,) = _summed((w,), (np.ones(len(w), dtype=np.int64),))
        # what words of each word range have: as a history and as a continuation
        zero = lambda x: np.zeros(len(x), dtype=np.int64)
        (k,), values = _summed((np.concatenate([hh, ww]),), tuple(np.concatenate(x) for x in (
            [zero(hh), before], [followed[0], zero(ww)], [followed[1], zero(ww)], [followed[2], zero(ww)])))
        levels = [int((n == c).sum()) for c in range(1, _LEVELS + 1)]
        out = [(p, *_pack(k[s], *(v[s].astype(np.uint32) for v in values)), 0, 0, 0, 0, 0) for p, s in _ranges_of_rows(_range_of(k, word_ranges), word_ranges)]
        return [*out, (-1 - part, b"", b"", b"", b"", b"", len(n), *levels)]

    stats = saved(_merged(_counted(texts, ranges, hot), root, "pairs", {"h": "u8", "w": "u8", "n": "u4"}, pairs_merged,
                          "part int, k binary, follows binary, n1 binary, n2 binary, n3 binary, pairs long, l1 long, l2 long, l3 long, l4 long"), "kn-pairs")
    # a row with a negative part is that of a stored range of bigrams
    parts = [f"pairs-{-1 - r['part']}" for r in stats.where("part < 0").select("part").collect()]
    level = [int(x or 0) for x in stats.where("part < 0").agg(*[F.sum(c) for c in ("pairs", "l1", "l2", "l3", "l4")]).first()]

    both = (stats.where("part >= 0").select("part", "k", "follows", "n1", "n2", "n3", F.lit(b"").alias("w"), F.lit(b"").alias("n"))
            .unionByName(counted.select("part", F.lit(b"").alias("k"), *[F.lit(b"").alias(c) for c in ("follows", "n1", "n2", "n3")], "w", "n")))

    def stored(part, columns):
        k, follows, n1, n2, n3, w, n = columns
        zero = lambda x: np.zeros(len(x), dtype=np.int64)
        (key,), values = _summed((np.concatenate([w, k]),), tuple(
            np.concatenate(x) for x in ([n, zero(k)], *([zero(w), v.astype(np.int64)] for v in (follows, n1, n2, n3)))))
        _store(root, f"words-{part}", [key, *values, zero(key)])
        f = values[1]
        at = np.flatnonzero(key == START)
        return [(part, int(f.sum()), *(int((f == c).sum()) for c in range(1, _LEVELS + 1)), int((f > 2).sum()))]

    last = saved(_merged(both, root, "words", {"k": "u8", "follows": "u4", "n1": "u4", "n2": "u4", "n3": "u4", "w": "u8", "n": "i8"}, stored,
                         "part int, total long, f1 long, f2 long, f3 long, f4 long, more long"), "kn-last")
    total, f1, f2, f3, f4, more = (int(x or 0) for x in last.agg(*[F.sum(c) for c in ("total", "f1", "f2", "f3", "f4", "more")]).first())
    parts += [f"words-{r['part']}" for r in last.select("part").collect()]
    model = Model(root, word_ranges, ranges, tokens, words, level[0], [*discounts(level[1:]), *discounts([f1, f2, f3, f4]), total, f1, f2, more], hot, n_texts, parts)
    return model


_models: dict[str, Model] = {}


def with_score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row: the id, n_tokens, n_known, base_score, score (log10
    probabilities) and perplexity."""
    python_workers(docs.sparkSession)
    key = uuid.uuid4().hex
    schema = docs.select(id_col).schema.add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double").add("perplexity", "double")

    def run(batches):
        if key not in _models:  # once for each worker
            _models.clear()
            _models[key] = model
        own = _models[key]
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = own.scores([word_hashes(t) for t in batch.column(1).to_pylist()])
            n, known, base, score = (pa.array(c) for c in zip(*rows))
            ppl = pa.array([10 ** min(300.0, -r[3] / r[0]) for r in rows])
            yield pa.RecordBatch.from_arrays([batch.column(0), n, known, base, score, ppl], names=schema.names)

    return docs.select(id_col, F.col(f"`{text_col}`").cast("binary").alias("text_bytes")).mapInArrow(run, schema)
