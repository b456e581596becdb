"""Substring dedup: words of passages that an earlier document, or an earlier place, has too.

Repeated passages are found by suffix automata. A corpus has too many words
for one, and most stand nowhere else, so references are chosen first: of every
``least`` consecutive words the 8-gram of least hash is marked, a repeated
passage has its marks repeated, and the text around the first place of each
repeated mark is a reference. References are dealt into shards of bounded
size; the automaton of a shard is built by each task that needs it, and the
text around the other places of its marks is streamed past it in bounded
groups, however many they are. Matching statistics of ``least`` or more whose
first place is earlier are repeats. Windows with a repeated mark that have no
match where their mark is first go through a second round, in which a window
marks itself: a mark may stand first in another passage. Copies of a text are told by its SHA-256 before all this.

Hashes choose references and routes; what is removed is decided by automata
over 64-bit hashes of words.

A null id is the least, a null text has no words and nothing removed, like an
empty one. Rows that share id and text are one document and have the same
result; rows that share an id alone are ordered by the digest of their text.
Very long texts are read whole, and their references cut into blocks of 4096
words. An empty table gives no row. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.llm.automaton import SuffixAutomaton
from chatlake.llm.common import python_workers, saved
from chatlake.llm.hashing import range_hashes, window_hashes
from chatlake.llm.ranks import ranked

LEAST = 20
#: Words of a mark.
GRAM = 8
#: A place as one number: document << 27 | word. Places of 4096 words share a shard.
PLACE, BLOCK = 27, 12
#: Words of a shard's references, and words streamed past it by a task, about.
SHARD_WORDS, STREAM_WORDS = 40_000, 160_000
#: Rows up to which a table of numbers is broadcast; larger ones are joined by shuffle.
FEW = 1_000_000
_SPAN = T.StructType().add("start", "integer").add("end", "integer")
_SPANS = "array<struct<start:int,end:int>>"


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW else df


_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


class Words:
    """The words of a column of texts: ``data`` has their bytes, ``starts`` and ``ends`` the places of each word
    there, ``edges`` each text's first word, ``sizes`` their numbers. What stands between white space of ASCII is a word."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
        edges = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
        body = column.buffers()[2]
        self.data = np.frombuffer(body, dtype=np.uint8)[edges[0]:edges[-1]] if body else np.zeros(0, np.uint8)
        edges = edges - edges[0]
        letter = np.append(~_SPACE[self.data], False)
        before = np.append(False, letter[:-1])
        before[edges] = False  # texts stand one after the other: each begins a word
        self.starts = np.flatnonzero(letter & ~before)
        after = np.append(letter[1:], False)
        after[edges[1:] - 1] = False
        self.ends = np.flatnonzero(letter & ~after) + 1
        self.edges = np.searchsorted(self.starts, edges)
        self.sizes = np.diff(self.edges)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return range_hashes(self.data, self.starts, self.ends)

    def joined(self, stays: np.ndarray) -> pa.Array:
        """The words that stay, joined by one space, of each text."""
        starts, ends = self.starts[stays], self.ends[stays]
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)[stays]
        mark = np.zeros(len(self.data) + 1, dtype=np.int8)
        mark[starts] += 1
        mark[ends] -= 1
        inside = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
        spaces = ends[:-1][doc[1:] == doc[:-1]]  # what ends a word that another one of the text follows
        inside[spaces] = True
        data = self.data.copy()
        data[spaces] = 32
        length = np.bincount(doc, weights=ends - starts + 1, minlength=len(self.sizes)).astype(np.int64)
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.maximum(length - 1, 0))])
        return pa.LargeStringArray.from_buffers(len(length), pa.py_buffer(offsets), pa.py_buffer(data[inside])).cast(pa.string())


def _sliding(f, a: np.ndarray, width: int) -> np.ndarray:
    """``f`` (minimum or maximum) of every ``width`` consecutive values."""
    out, have = a, 1
    while have < width:
        step = min(have, width - have)
        out = f(out[:len(out) - step], out[step:])
        have += step
    return out


def marks(words: np.ndarray, inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the 8-grams that are the least of some ``least`` consecutive words.

    ``inside``: for each such window whether it counts (lies in one document)."""
    span = least - GRAM + 1
    grams = window_hashes(words, GRAM) | np.uint64(1)
    if len(grams) < span:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    lowest = np.where(inside, _sliding(np.minimum, grams, span), np.uint64(0))
    edge = np.zeros(span - 1, dtype=np.uint64)
    at = np.flatnonzero(_sliding(np.maximum, np.concatenate([edge, lowest, edge]), span) == grams)
    return at, grams[at]


def _lists(values: np.ndarray, sizes: np.ndarray, kind) -> pa.ListArray:
    offsets = np.concatenate([np.zeros(1, np.int32), np.cumsum(sizes, dtype=np.int32)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _scan(docs: DataFrame, least: int) -> DataFrame:
    """id, digest, n_words and the marks (hashes and places) of each document."""
    def run(batches):
        for batch in batches:
            found = Words(batch.column(2))
            sizes, begin, words = found.sizes, found.edges[:-1], found.hashes()
            doc = np.repeat(np.arange(len(sizes)), sizes)
            at, h = marks(words, doc[:len(words) - least + 1] == doc[least - 1:] if len(words) >= least else np.zeros(0, bool), least)
            n = np.bincount(doc[at], minlength=len(sizes))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(sizes), _lists(h.view(np.int64), n, pa.int64()),
                _lists((at - begin[doc[at]]).astype(np.int32), n, pa.int32())], names=["id", "digest", "n_words", "marks", "at"])

    schema = docs.select("id", "digest").schema.add("n_words", "long").add("marks", T.ArrayType(T.LongType())).add("at", T.ArrayType(T.IntegerType()))
    return docs.select("id", "digest", "text").mapInArrow(run, schema)


def _homes(places: DataFrame) -> DataFrame:
    """mark, home: the first place of every mark that stands at several."""
    found = places.groupBy("mark").agg(F.min("place").alias("home"), F.max("place").alias("last"))
    return saved(found.where(F.col("home") < F.col("last")).drop("last"), "homes")


def _cuts(number: int, begin: int, words: np.ndarray, at: np.ndarray, route: np.ndarray, ahead: int, least: int):
    """(route, is reference, first word's place, words, the places in it) of the stretches of ``words`` around
    each routed place. Those of one route that touch are one, but not beyond two blocks."""
    mine = (at >= begin) & (at < begin + len(words))
    at, route = at[mine], route[mine]
    if not len(at):
        return
    order = np.lexsort((at, route))
    at, route = at[order], route[order]
    new = (np.diff(route) != 0) | (np.diff(at) > ahead + least) | (np.diff(at >> BLOCK + 1) != 0)
    heads = np.flatnonzero(np.append(True, new))
    own = np.logical_or.reduceat((number << PLACE | at) >> BLOCK == route, heads)
    lo = np.maximum(at[heads] - ahead, begin)
    hi = np.minimum(at[np.append(heads[1:], len(at)) - 1] + least, begin + len(words))
    marks_ = np.split(at, heads[1:])
    for r, o, a, b, m in zip(route[heads].tolist(), own.tolist(), lo.tolist(), hi.tolist(), marks_):
        yield r, o, a, words[a - begin:b - begin], (m - a).astype(np.int32)


def _covered(ends: np.ndarray, least: int) -> list[dict]:
    """The maximal stretches of words under windows that end at ``ends`` (ascending)."""
    if not len(ends):
        return []
    gap = np.flatnonzero(np.diff(ends) > least)
    lo, hi = np.concatenate([ends[:1], ends[gap + 1]]) - least + 1, np.concatenate([ends[gap], ends[-1:]]) + 1
    return [{"start": int(a), "end": int(b)} for a, b in zip(lo, hi)]


def _claimed(words: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """By window: whether its mark is one of those at the places ``at``."""
    span, grams = least - GRAM + 1, window_hashes(words, GRAM) | np.uint64(1)
    own = np.full(len(grams), np.uint64(2**64 - 1))
    own[at] = grams[at]
    return _sliding(np.minimum, own, span) == _sliding(np.minimum, grams, span)


def _streamed(least: int, claim: bool):
    """Of one group (a shard's references, and stretches to stream): the repeated spans, and with ``claim`` as
    rows of their own the words under windows that may still repeat elsewhere.

    A window whose first place among the references is earlier is a repeat; if that place is later, the window there
    is one. Every window with the same mark comes to the same shard. So one that is the first place itself is settled
    here, and what is left are windows found later or not at all, in the shard of their mark."""
    def run(group: pa.Table) -> pa.Table:
        number, begin = group["number"].to_numpy(), group["begin"].to_numpy()
        own, raw = group["own"].to_numpy(zero_copy_only=False), [np.frombuffer(w, dtype=np.uint64) for w in group["words"].to_pylist()]
        places = [np.frombuffer(m, dtype=np.int32) for m in group["places"].to_pylist()]
        refs = sorted(np.flatnonzero(own).tolist(), key=lambda k: (number[k], begin[k]))
        out = {"number": [], "begin": [], "words": [], "spans": []}

        def say(of, at=None, words=None, spans=None):
            for name, value in zip(out, (of, at, words, spans)):
                out[name].append(value)

        if refs:
            alphabet, codes = np.unique(np.concatenate([raw[k] for k in refs]), return_inverse=True)
            sizes = np.array([len(raw[k]) for k in refs])
            # by place in the automaton's text, which has one more after each sequence
            of = np.repeat(number[refs], sizes + 1)
            at = np.concatenate([begin[k] + np.arange(len(raw[k]) + 1) for k in refs])
            automaton = SuffixAutomaton(np.split(codes, np.cumsum(sizes)[:-1]))
            earliest = automaton.earliest(least)
            every = np.concatenate(raw)
            coded = np.minimum(np.searchsorted(alphabet, every), len(alphabet) - 1)
            coded = np.split(np.where(alphabet[coded] == every, coded, -1), np.cumsum([len(w) for w in raw])[:-1])
            for k, words in enumerate(raw):
                first = automaton.matches(coded[k], least, earliest)[least - 1:]
                end = begin[k] + least - 1 + np.arange(len(first))
                seen = np.maximum(first, 0)
                before = (of[seen] < number[k]) | ((of[seen] == number[k]) & (at[seen] < end))
                itself = (of[seen] == number[k]) & (at[seen] == end)
                hit = (first >= 0) & before
                if hit.any():
                    say(number[k], spans=_covered(end[hit], least))
                later = np.flatnonzero((first >= 0) & ~before & ~itself)
                for other in np.unique(of[first[later]]):
                    say(other, spans=_covered(np.unique(at[first[later][of[first[later]] == other]]), least))
                if claim:
                    left = ~hit & ~((first >= 0) & itself) & _claimed(words, places[k], least)
                    for s in _covered(end[left], least):
                        say(number[k], s["start"], words[s["start"] - begin[k]:s["end"] - begin[k]].tobytes())
        return pa.table(out, schema=_STREAMED)

    return run


_STREAMED = pa.schema([("number", pa.int64()), ("begin", pa.int64()), ("words", pa.binary()),
                       ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def _round(places: DataFrame, homes: DataFrame, source, least: int, step: int, claim: bool) -> DataFrame:
    """number, begin, words, spans: what ``_streamed`` finds when the stretches around ``places`` of repeated
    marks go to the shards of their marks. ``source`` gives the stretches of (number, routes)."""
    n = homes.count()
    shards = max(1, -(-n * step // SHARD_WORDS))
    homes = homes.select("mark", F.shiftright("home", BLOCK).alias("route"))
    routed = places.join(F.broadcast(homes) if n <= FEW else homes, "mark").select("number", "at", "route")
    routed = saved(routed, "routed")
    shard = F.pmod(F.xxhash64("route"), F.lit(shards)).alias("shard")
    load = routed.groupBy(shard).agg(F.ceil(F.count(F.lit(1)) * step / STREAM_WORDS).alias("parts"))
    cut = source(routed.groupBy("number").agg(F.collect_list(F.struct("at", "route")).alias("routes")))
    cut = cut.select(shard, "own", "number", "begin", "words", "places").join(_few(saved(load, "load")), "shard")
    # references go to all parts of their shard, other stretches to one
    part = F.when(F.col("own"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("number", "begin"), F.col("parts"))))
    cut = cut.select("shard", F.explode(part).alias("part"), "own", "number", "begin", "words", "places")
    return saved(cut.groupBy("shard", "part").applyInArrow(_streamed(least, claim), "number long, begin long, words binary, spans " + _SPANS), "streamed")


_CUT = "route long, own boolean, number long, begin long, words binary, places binary"


def _cut_batches(rows, ahead: int, least: int):
    """Record batches of stretches from (number, begin, words, places and routes)."""
    part = []
    for number, begin, words, at, route in rows:
        part += [(r, own, number, lo, w.tobytes(), m.tobytes()) for r, own, lo, w, m in _cuts(number, begin, words, at, route, ahead, least)]
        if len(part) > 2000:
            yield _batch(part)
            part = []
    yield _batch(part)


def _each(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column, as arrays of numbers."""
    flat, edges = column.values.to_numpy().astype(np.int64), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(edges[:-1], edges[1:])]


def _batch(part: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in part], t) for k, t in enumerate(kinds)],
                                      names=["route", "own", "number", "begin", "words", "places"])


def _from_texts(docs: DataFrame, numbers: DataFrame, least: int):
    """Stretches of the texts of the documents that have routes."""
    ahead = least - GRAM

    def run(batches):
        for b in batches:
            found = Words(b.column(1))
            texts = np.split(found.hashes(), found.edges[1:-1])
            yield from _cut_batches(zip(b.column(0).to_pylist(), [0] * len(texts), texts, _each(b.column(2)), _each(b.column(3))), ahead, least)

    def source(routes: DataFrame) -> DataFrame:
        wanted = routes.join(_few(numbers), "number").select("number", "id", "digest", "routes")
        return docs.join(wanted, [docs["digest"] == wanted["digest"], docs["id"].eqNullSafe(wanted["id"])]).select(
            "number", "text", "routes.at", "routes.route").mapInArrow(run, _CUT)

    return source


def _from_stretches(stretches: DataFrame, least: int):
    """Stretches of the words that the first round left open."""
    def run(batches):
        for b in batches:
            words = [np.frombuffer(w, dtype=np.uint64) for w in b.column(2).to_pylist()]
            yield from _cut_batches(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), words, _each(b.column(3)), _each(b.column(4))), 0, least)

    return lambda routes: stretches.join(routes, "number").select("number", "begin", "words", "routes.at", "routes.route").mapInArrow(run, _CUT)


def _window_marks(stretches: DataFrame, least: int) -> DataFrame:
    """Every window of the stretches as a mark: mark, number, at, place."""
    def run(batches):
        for b in batches:
            found = [window_hashes(np.frombuffer(w, dtype=np.uint64), least) for w in b.column(2).to_pylist()]
            n = np.array([len(f) for f in found], dtype=np.int64)
            at = np.concatenate([np.arange(k) + s for k, s in zip(n, b.column(1).to_pylist())]) if len(n) else np.zeros(0)
            flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(b.column(0).to_numpy(), n)), pa.array(at.astype(np.int64))],
                                             names=["mark", "number", "at"])

    out = stretches.select("number", "begin", "words").mapInArrow(run, "mark long, number long, at long")
    return out.withColumn("place", F.shiftleft("number", PLACE).bitwiseOR(F.col("at")))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """id, digest (SHA-256 of the text), spans: the word ranges of each document under a window of ``least``
    words that also starts earlier. Documents without one are left out."""
    if least < GRAM:
        raise ValueError(f"least must be {GRAM} or more")
    python_workers(docs.sparkSession)
    docs = _keyed(docs, id_col, text_col)
    scan = saved(_scan(docs, least), "marks")
    numbers = saved(ranked(scan.select("id", "digest").distinct(), [], ["id", "digest"], "number").drop("size"), "numbers")
    firsts = numbers.groupBy("digest").agg(F.min("number").alias("number")).select("number", F.lit(True).alias("first"))
    numbers = saved(numbers.join(firsts, "number", "left"), "numbers")

    # copies of an earlier text go whole, if they have a window at all
    copies = numbers.where(F.col("first").isNull()).join(
        scan.where(F.col("n_words") >= least).groupBy("id", "digest").agg(F.max("n_words").alias("n")).withColumnsRenamed({"id": "id2", "digest": "digest2"}),
        [F.col("digest") == F.col("digest2"), F.col("id").eqNullSafe(F.col("id2"))])
    copies = copies.select("number", F.array(F.struct(F.lit(0).alias("start"), F.col("n").cast("int").alias("end"))).cast(_SPANS).alias("spans"))

    own = _few(numbers.where("first").select("number", F.col("id").alias("id2"), F.col("digest").alias("digest2")))
    marked = scan.join(own, [F.col("digest") == F.col("digest2"), F.col("id").eqNullSafe(F.col("id2"))])
    places = marked.select("number", F.explode(F.arrays_zip("marks", "at")).alias("m")).select(
        F.col("m.marks").alias("mark"), "number", F.col("m.at").cast("long").alias("at"))
    places = places.withColumn("place", F.shiftleft("number", PLACE).bitwiseOR(F.col("at")))
    found = _round(places, _homes(places), _from_texts(docs, numbers, least), least, GRAM, True)
    left = found.where("words is not null")
    again = _window_marks(left, least)
    more = _round(again, _homes(again), _from_stretches(left, least), least, 1, False)
    spans = copies.unionByName(found.where("spans is not null").select("number", "spans")).unionByName(
        more.where("spans is not null").select("number", "spans"))
    spans = spans.groupBy("number").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return saved(numbers.join(spans, "number").select("id", "digest", _merged("spans").alias("spans")), "spans")


def _merged(spans: str):
    """Spans in order, those that touch as one."""
    empty = F.array().cast(_SPANS)

    def add(out, s):
        last = F.element_at(out, -1)
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(out) > 0) & (s["start"] <= F.try_element_at(out, F.lit(-1))["end"]), joined).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(F.array_sort(spans), empty, add)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("digest"), text.alias("text"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """A row for each document: ``id_col``, n_words, n_removed, spans (the word ranges removed) and
    kept (the words that stay, joined by one space)."""
    spans = repeated_spans(docs, id_col, text_col, least).withColumnsRenamed({"id": "id2", "digest": "digest2"})
    keyed = _keyed(docs, id_col, text_col)
    rows = keyed.join(_few(spans), [keyed["digest"] == F.col("digest2"), keyed["id"].eqNullSafe(F.col("id2"))], "left")

    def run(batches):
        for batch in batches:
            found = Words(batch.column(1))
            stays = np.ones(len(found.starts), dtype=bool)
            for begin, cuts in zip(found.edges, batch.column(2).to_pylist()):
                for c in cuts or ():
                    stays[begin + c["start"]:begin + c["end"]] = False
            gone = np.diff(np.concatenate([[0], np.cumsum(~stays)])[found.edges])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.sizes), pa.array(gone), batch.column(2), found.joined(stays)],
                                             names=[id_col, "n_words", "n_removed", "spans", "kept"])

    schema = docs.select(id_col).schema.add("n_words", "long").add("n_removed", "long").add("spans", T.ArrayType(_SPAN)).add("kept", "string")
    return rows.select("id", "text", "spans").mapInArrow(run, schema)
