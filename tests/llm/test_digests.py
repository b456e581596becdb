"""The digests of the queries against plain Python over the whole sf0.001 tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from chatlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return texts(SF)


def texts(sf):
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}


def rows(spark, number, sf=SF):
    name = next(k for k in QUERIES if k.startswith(f"op{number}_"))
    return {r["doc_id"]: r for r in QUERIES[name](spark, sf).collect()}


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_op2(spark, docs):
    got = rows(spark, 2)
    fp = {d: plain_fingerprint(t) for d, t in docs.items()}
    assert {d: r["fingerprint"] for d, r in got.items()} == {d: f"{x:016x}" for d, x in fp.items()}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if (fp[a] ^ fp[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {d: r["component_id"] for d, r in got.items()} == {d: find(d) for d in ids}


def test_op4(spark, docs):
    got = QUERIES["op4_external_shuffle"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    by = defaultdict(list)
    for r in got:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "rows")
        by[r["shard"]].append(r["slot"])
    assert sorted(by) == list(range(16)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_op5(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = QUERIES["op5_vector_packing"](spark, SF).collect()
    by, used = defaultdict(dict), defaultdict(list)
    for r in got:
        by[r["doc_id"]][r["piece"]] = r
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by) == set(docs)
    total = 0
    for d, t in docs.items():
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [0], dtype="<u4")
        total += len(ids)
        for k in range(0, -(-len(ids) // 2048)):
            cut = ids[k * 2048:(k + 1) * 2048]
            r = by[d].pop(k)
            assert (r["start"], r["length"], r["ids_crc32"]) == (k * 2048, len(cut), zlib.crc32(cut.tobytes()))
        assert not by[d]
    for spans in used.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(used) <= 1.05 * total / 2048 + 1


BASE = (("assign", r"""((?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6),
        ("access", r"(AKIA[A-Z0-9]+)", 1, 20), ("hex", r"([0-9a-f]+)", 1, 24))


def test_op8(spark):
    sf = "/root/testdata/sf0.01"  # the smallest tables hold no secrets
    docs, got = texts(sf), rows(spark, 8, sf)
    assert any(r["n_assign"] for r in got.values())
    for d, t in docs.items():
        spans = sorted((m.start(1), k, m.end(1)) for k, (_, p, g, least) in enumerate(BASE) for m in re.finditer(p, t) if len(m[g]) >= least)
        n = Counter(k for _, k, _ in spans)
        base = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in spans)
        r = got[d]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (n[0], n[1], n[2])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if x and not x.startswith("markov")] == [x for x in base.split(",") if x]


def test_op9(spark, docs):
    got = rows(spark, 9)
    for d, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        at = defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i:i + 3])].append(i)
        again = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(again))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_op10(spark, docs):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))

    windows = defaultdict(set)
    for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist():
        w = words(r["text"])
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i:i + 10])].add(str(r["item_id"]))
    got, some = rows(spark, 10), 0
    for d, t in docs.items():
        w, hit, items = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    items |= windows[tuple(w[i:i + n])]
        r, some = got[d], some + bool(hit)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(items), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    assert some
