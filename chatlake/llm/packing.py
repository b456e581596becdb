"""Vector best-fit packing of tokenised documents into training sequences.

Each piece of a document asks for a vector of capacities: tokens, one
document, and attention cost (the square of its length, as attention stays
within a document). Pieces are dealt into groups of a bounded size by a hash,
and in each group the longest goes first. Of the open sequences that satisfy
every constraint, a piece takes the one with the least weighted norm of what
would remain, or the one whose residual has the largest weighted dot product
with the piece. A group leaves at most its last few sequences short of full.

A null or empty text has the end id alone. Repeated rows are packed each on
its own; null ids are packed like others.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import saved, python_workers
from chatlake.llm.hashing import range_hashes

MAX_TOKENS = 2048
#: Pieces that one task packs together.
GROUP_PIECES = 8000
#: Words that are given to the tokenizer whole, and parts of words, whose ids a worker remembers.
MAX_WORDS, MAX_PARTS = 600_000, 1_500_000
#: Characters that are encoded together: the arrays beside them take some hundred bytes for each. A longer text goes by itself.
SLICE_CHARS = 1 << 18
END = b"\0\0\0\0"

# Fixed value: how the tokenizer of this vocabulary splits a lower-cased word.
_PARTS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_GAP, _LETTER, _NUMBER, _SIGN, _ODD = range(5)
_PLAIN = 0x250


def _kind(c: str) -> int:
    """How a printable Latin character splits a word. The others, and one whose lower case is two
    characters, make a word odd: it is given to the tokenizer whole."""
    if c in " \n":
        return _GAP
    if not c.isprintable() or len(c.lower()) != 1 or c.lower() >= chr(_PLAIN):
        return _ODD
    return {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(c)[0], _SIGN)


_KIND = np.array([*[_kind(chr(i)) for i in range(_PLAIN)], _ODD], dtype=np.uint8)
_LOWER = np.array([ord(chr(i).lower()) if _KIND[i] != _ODD else i for i in range(_PLAIN)] + [0], dtype=np.uint32)
_ONE, _TWO = [ord(c) for c in "stmd"], [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]


class _Encoder:
    """The ids of words' parts, each asked of the tokenizer once and kept by a hash."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            splits = [x.get("pattern", {}).get("Regex") for x in (json.load(f).get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.tokenizer, self.splits = Tokenizer.from_file(path), _PARTS in splits
        # a digit is a part by itself, so its id parts the ids of other parts in one long text
        self.between = self._ids(["0"])[0]
        self.splits &= len(self.between) == 1
        self.forget()

    def forget(self) -> None:
        # in the order of the hashes: these, and the entries they have below
        self.hashes, self.entries = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.whole = 0
        self.sizes, self.begins, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for i in range(0, len(texts), 4096)
                for e in self.tokenizer.encode_batch_fast(texts[i:i + 4096], add_special_tokens=False)]

    def learn(self, hashes: np.ndarray, ids: list[np.ndarray], sizes: list[np.ndarray]) -> None:
        sizes = np.concatenate(sizes).astype(np.int64)
        place, n = np.searchsorted(self.hashes, hashes), len(self.hashes)
        self.hashes = np.insert(self.hashes, place, hashes)
        self.entries = np.insert(self.entries, place, np.arange(n, n + len(hashes), dtype=np.int32))
        self.begins = np.append(self.begins, len(self.pool) + np.cumsum(sizes) - sizes)
        self.sizes = np.append(self.sizes, sizes)
        self.pool = np.concatenate([self.pool, *ids])

    def learn_plain(self, hashes: np.ndarray, parts: list[str]) -> None:
        """Parts without a digit: many in one text, told apart by the id of a digit between."""
        for i in range(0, len(parts), 4096):
            ids, = self._ids([" 0 ".join(parts[i:i + 4096])])
            between = ids == self.between[0]
            edges = np.concatenate([[-1], np.flatnonzero(between), [len(ids)]])
            self.learn(hashes[i:i + 4096], [ids[~between]], [np.diff(edges) - 1])

    def learn_whole(self, hashes: np.ndarray, words: list[str]) -> None:
        """Words as they are, and digits."""
        if words:
            ids = self._ids(words)
            self.learn(hashes, ids, [np.array([len(x) for x in ids])])
            self.whole += len(words)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by 0; where each text's begin and the last one's end)."""
        text = "\n".join(t or "" for t in texts)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        low = np.minimum(codes, _PLAIN)
        kind, lower = _KIND[low], _LOWER[low]
        gap = kind == _GAP
        odd = kind == _ODD
        odd[:-1] |= (codes[:-1] == ord("<")) & (codes[1:] == ord("|"))
        if not self.splits:
            odd = ~gap
        begin, end = _parts(kind, lower)
        hashes = range_hashes(lower, begin, end)
        n_parts = len(begin)
        if odd.any():
            word = np.cumsum(gap)
            strange = np.zeros(int(word[-1]) + 1, dtype=bool)
            strange[word[odd]] = True
            inside = np.append(strange[word] & ~gap, False)
            a, b = (np.flatnonzero(inside & ~np.append(False, inside[:-1])), np.flatnonzero(~inside & np.append(False, inside[:-1])))
            stays = ~strange[word[begin]]
            n_parts = int(stays.sum())
            begin, end = np.concatenate([begin[stays], a]), np.concatenate([end[stays], b])
            # not the hash of a part with the same characters
            hashes = np.concatenate([hashes[stays], ~range_hashes(codes, a, b)])
        uniq, first, at = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > MAX_PARTS or self.whole > MAX_WORDS:
            self.forget()
        place = np.searchsorted(self.hashes, uniq)
        of = np.flatnonzero((place == len(self.hashes)) | (np.append(self.hashes, np.uint64(0))[place] != uniq))
        if len(of):
            lowered = lower.tobytes().decode("utf-32-le")
            where = first[of]
            plain = (where < n_parts) & (kind[begin[where]] != _NUMBER)
            self.learn_plain(uniq[of[plain]], [lowered[a:b] for a, b in zip(begin[where[plain]].tolist(), end[where[plain]].tolist())])
            self.learn_whole(uniq[of[~plain]], [(lowered if f < n_parts else text)[begin[f]:end[f]] for f in where[~plain].tolist()])
            place = np.searchsorted(self.hashes, uniq)
        entry = self.entries[place][at]
        if len(begin) > n_parts:
            order = np.argsort(begin, kind="stable")
            begin, entry = begin[order], entry[order]
        stops = np.cumsum([len(t or "") + 1 for t in texts])
        doc = np.searchsorted(stops, begin, side="right")
        size = self.sizes[entry]
        total = int(size.sum())
        # the k-th id of a part is the k-th after the part's first in the pool
        source = np.arange(total) + np.repeat(self.begins[entry] - (np.cumsum(size) - size), size)
        out = np.zeros(total + len(texts), dtype="<u4")
        out[np.arange(total) + np.repeat(doc, size)] = self.pool[source]
        edges = np.concatenate([[0], np.cumsum(np.bincount(doc, weights=size, minlength=len(texts)).astype(np.int64) + 1)])
        return out, edges


def _parts(kind: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the parts of words begin and end: runs of letters or of signs, single numbers, and what an
    apostrophe that begins a run of signs contracts."""
    n = len(kind)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    there = kind != _GAP
    head = there & (np.append(True, kind[1:] != kind[:-1]) | (kind == _NUMBER))
    at = np.flatnonzero(head & (lower == ord("'")) & (kind == _SIGN))
    after = np.append(lower, [0, 0, 0])
    one = np.isin(after[at + 1], _ONE)
    two = np.zeros(len(at), dtype=bool)
    for a, b in _TWO:
        two |= (after[at + 1] == a) & (after[at + 2] == b)
    head[at[one | two] + 1] = False
    beyond = np.concatenate([at[one] + 2, at[two] + 3])
    beyond = beyond[beyond < n]
    head[beyond] |= there[beyond]
    stop = np.append(there, False) & np.append(~there[1:] | head[1:], [True, True])[:n + 1]
    return np.flatnonzero(head), np.flatnonzero(stop) + 1


_known: dict[str, _Encoder] = {}


def _encoder(path: str) -> _Encoder:
    """One for each worker and path."""
    if path not in _known:
        _known[path] = _Encoder(path)
    return _known[path]


def encode(texts: list[str | None], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers.

    The tokenizer never joins characters across a space or line end, nor
    across the parts of a word, so the ids of a text are those of these, which
    repeat. Words that are not plain are given to it whole.
    """
    ids, edges = _encoder(path).encode(texts)
    return [ids[a:b - 1].tobytes() for a, b in zip(edges[:-1], edges[1:])]


def _slices(texts: list[str | None]) -> list[tuple[int, int]]:
    """Ranges of consecutive texts of at most SLICE_CHARS characters, or of one text."""
    out, begin, chars = [], 0, 0
    for i, t in enumerate(texts):
        chars += len(t or "") + 1
        if chars > SLICE_CHARS and i > begin:
            out.append((begin, i))
            begin, chars = i, len(t or "") + 1
    return [*out, (begin, len(texts))] if texts else out


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           max_tokens: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32, and with
    ``with_ids`` the ids themselves. Only longer documents are cut."""
    python_workers(docs.sparkSession)
    schema = docs.select(id_col).schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    if with_ids:
        schema = schema.add("ids", "binary")

    def run(batches):
        size = 4 * max_tokens
        for batch in batches:
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            texts = batch.column(1).to_pylist()
            for first, last in _slices(texts):
                flat, edges = _encoder(tokenizer_path).encode(texts[first:last])
                for row, (a, b) in enumerate(zip(edges[:-1], edges[1:]), first):
                    raw = flat[a:b].tobytes()  # ends with END
                    for k, i in enumerate(range(0, len(raw), size)):
                        cut = raw[i:i + size]
                        at.append(row), piece.append(k), start.append(i // 4), length.append(len(cut) // 4), crc.append(zlib.crc32(cut))
                        if with_ids:
                            ids.append(cut)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())] if with_ids else columns, names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, max_tokens: int, max_docs: int, max_attention: int, weights: tuple[float, float, float],
             rule: str = "norm") -> np.ndarray:
    """The sequence of each piece; ``lengths`` are descending."""
    n = len(lengths)
    capacity = np.array([max_tokens, max_docs, max_attention], dtype=np.float64)
    left = np.zeros((3, n + 1))  # of the open sequences: tokens, documents, attention
    name = np.zeros(n + 1, dtype=np.int64)
    w = np.asarray(weights, dtype=np.float64) / (capacity if rule == "dot" else 1) / capacity ** (2 if rule == "norm" else 1)
    out, opened, made = np.empty(n, dtype=np.int64), 0, 0
    least = float(lengths[-1]) if n else 0.0
    for i, length in enumerate(lengths.tolist()):
        t, d, a = left[0, :opened], left[1, :opened], left[2, :opened]
        cost = float(length) * length
        fits = (t >= length) & (d >= 1) & (a >= cost)
        if fits.any():
            if rule == "norm":
                score = w[0] * (t - length) ** 2 + w[1] * (d - 1) ** 2 + w[2] * (a - cost) ** 2
            else:
                score = -(w[0] * length * t + w[1] * d + w[2] * cost * a)
            at = int(np.argmin(np.where(fits, score, np.inf)))
        else:
            at, opened = opened, opened + 1
            left[:, at], name[at] = capacity, made
            made += 1
        left[0, at] -= length
        left[1, at] -= 1
        left[2, at] -= cost
        out[i] = name[at]
        if left[0, at] < least or left[1, at] < 1 or left[2, at] < least * least:  # full: the last open one takes its place
            opened -= 1
            left[:, at], name[at] = left[:, opened], name[opened]
    return out


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS,
         max_docs: int = MAX_TOKENS, max_attention: int = MAX_TOKENS**2, weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
         rule: str = "norm", group_pieces: int = GROUP_PIECES, with_ids: bool = False) -> DataFrame:
    """A row for each piece: what ``pieces`` gives, sequence_id and offset (its
    place in the sequence). A piece by itself must satisfy every constraint."""
    if max_docs < 1 or max_attention < max_tokens**2 or rule not in ("norm", "dot"):
        raise ValueError("a piece of max_tokens must fit into an empty sequence, and the rule be norm or dot")
    cut = saved(pieces(docs, tokenizer_path, id_col, text_col, max_tokens, with_ids), "pieces")
    groups = max(1, -(-cut.count() // group_pieces))
    # rows that are alike are dealt apart by their place in the written table
    dealt = cut.withColumn("grp", F.pmod(F.xxhash64(F.col(id_col), "piece", F.monotonically_increasing_id()), F.lit(groups)))
    schema = cut.schema.add("sequence_id", "long").add("offset", "long")

    def one(group: pa.Table) -> pa.Table:
        # the ids stay where they are: rows are placed by the order of the narrow columns
        rows = pc.sort_indices(group.select(list(dict.fromkeys(("length", id_col, "piece", "ids_crc32")))), sort_keys=[
            ("length", "descending"), (id_col, "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]).to_numpy()
        lengths = group["length"].to_numpy()[rows]
        local = best_fit(lengths, max_tokens, max_docs, max_attention, weights, rule)
        order = np.argsort(local, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        first = np.r_[True, np.diff(local[order]) != 0]
        offset, sequence = np.empty(len(local), dtype=np.int64), np.empty(len(local), dtype=np.int64)
        offset[rows[order]] = before - np.maximum.accumulate(np.where(first, before, 0))
        sequence[rows] = local
        sequence += group["grp"].to_numpy().astype(np.int64) * (1 << 32)
        return group.drop_columns(["grp"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return dealt.groupBy("grp").applyInArrow(one, schema)
