"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The test strings are windows of ``window`` consecutive words of each benchmark
item (a shorter item is one window). Symbols are words: the shift table is
keyed by blocks of two adjacent words, and tells how far the search may move
on; a block with shift 0 ends some test strings, which its suffix bucket
holds; comparison with all words of these confirms an occurrence. Test strings
of different lengths have tables of their own, so that a short item does not
shrink the shifts of the long ones.

Null texts have no words. Repeated items and texts count each on their own;
an item without words has no window. Item ids that are null are written "null".
"""

from __future__ import annotations

import hashlib
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import python_workers

WINDOW = 10
#: Bytes of benchmark text whose tables a worker holds at once: they take some
#: sixty-five times as much memory. A larger benchmark is searched for in several
#: blocks, one pass over the documents each.
BLOCK_BYTES = 4 << 20

_RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hits binary, items array<string>"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class WordSearch:
    """Tables of the test strings of one length."""

    def __init__(self, length: int):
        self.length, self.reach = length, max(1, length - 1)
        self.shift: dict[bytes, int] = {}
        #: By block, the test strings that end in it, and the items of each (a set if it has several).
        self.ending: dict[bytes, dict[bytes, str | set[str]]] = {}

    def add(self, text: list[bytes], item: str) -> None:
        """Every window of ``text``."""
        n = self.length
        for end in range(min(1, n - 1), len(text)):
            block = b" ".join(text[max(0, end - 1):end + 1])
            # of the windows that hold this block, the one that ends first is that many words on
            self.shift[block] = min(self.shift.get(block, self.reach), max(0, n - 1 - end))
            if end < n - 1:
                continue
            bucket = self.ending.setdefault(block, {})
            string = b" ".join(text[end - n + 1:end + 1])
            items = bucket.setdefault(string, item)
            if isinstance(items, set):
                items.add(item)
            elif items != item:
                bucket[string] = {items, item}

    def mark(self, text: list[bytes], hits: bytearray, found: set[str]) -> None:
        n, shift, reach = self.length, self.shift.get, self.reach
        i, last = n - 1, len(text)
        while i < last:
            block = text[i - 1] + b" " + text[i] if n > 1 else text[i]
            step = shift(block, reach)
            if step:
                i += step
                continue
            start = i - n + 1
            items = self.ending[block].get(b" ".join(text[start:i + 1]))
            if items is not None:
                hits[start:i + 1] = b"\1" * n
                found.update(items if isinstance(items, set) else (items,))
            i += 1


def tables(items: list[tuple[str, str]], window: int) -> list[WordSearch]:
    by_length: dict[int, WordSearch] = {}
    for item, text in items:
        w = words(text)
        if w:
            n = min(window, len(w))
            by_length.setdefault(n, WordSearch(n)).add(w, item)
    return [search for _, search in sorted(by_length.items())]


_built: dict[str, list[WordSearch]] = {}


def _scan(block, window: int, text: Column, before: Column | None) -> Column:
    key = uuid.uuid4().hex

    def result(texts: pd.Series, states) -> pd.DataFrame:
        if key not in _built:  # once for each worker and block
            _built.clear()
            _built[key] = tables(block.value, window)
        rows = []
        for text, (hits, items) in zip(texts, states):
            w = words(text)
            hits, found = bytearray(hits or bytes(len(w))), set(items)
            for search in _built[key]:
                search.mark(w, hits, found)
            names, n_hit = sorted(found), sum(hits)
            rows.append((len(w), n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(),
                         n_hit > 0, bytes(hits) if n_hit else None, names))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _RESULT.split(", ")])

    if before is None:
        @F.pandas_udf(_RESULT)
        def first(texts: pd.Series) -> pd.DataFrame:
            return result(texts, ((None, ()) for _ in range(len(texts))))
        return first(text)

    @F.pandas_udf(_RESULT)
    def later(texts: pd.Series, state: pd.DataFrame) -> pd.DataFrame:
        return result(texts, zip(state["hits"], state["items"]))
    return later(text, before)


def _parts(text: str, limit: int, window: int):
    """An item's text, a very long one in parts that share all but one word of
    a window, so that every window stands in one of them."""
    if len(text) <= limit:
        yield text
        return
    w, step = words(text), max(1, limit // 8)
    for i in range(0, max(1, len(w) - window + 1), step):
        yield b" ".join(w[i:i + step + window - 1]).decode("utf-8", "surrogatepass")


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int, window: int):
    """The benchmark's items in lists of at most about ``limit`` characters of text."""
    block, size = [], 0
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")), F.coalesce(F.col(text_col), F.lit("")))
    for item, whole in rows.toLocalIterator():
        for text in _parts(whole, limit, window):
            if block and size + len(text) > limit:
                yield block
                block, size = [], 0
            block.append((item, text))
            size += len(text)
    yield block


def with_overlap(docs: DataFrame, benchmark: DataFrame, out_col: str, text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct column ``out_col``: what of each text occurs in ``benchmark``.

    n_words, n_hit (words inside an occurrence of a window), n_items (items
    with an occurring window), items_sha256 (their ids, sorted as strings,
    comma-joined), contaminated (n_hit > 0), hits (a byte per word, null if
    none) and items. No shuffle: each block of the benchmark is one pass.
    """
    from chatlake.llm.common import saved

    spark = docs.sparkSession
    python_workers(spark)
    out, state = docs, None
    for k, block in enumerate(_blocks(benchmark, item_col, item_text_col, block_bytes, window)):
        if k:  # the tables of one block only are in memory at a time
            out, state = saved(out, "overlap"), F.col(f"`{out_col}`")
        out = out.withColumn(out_col, _scan(spark.sparkContext.broadcast(block), window, F.col(f"`{text_col}`"), state))
    return out
