"""Operators 11 to 13 against plain Python, on small fixtures with every edge case."""

import hashlib
import random
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatlake.llm import merkle, repeats, spelling
from chatlake.llm.automaton import SuffixAutomaton
from chatlake.llm.ranks import ranked

DOCS = "doc_id long, text string, lang string, source string, n_chars int, spans string, number long, `digest` string"


def table(spark, rows):
    """Documents of (doc_id, text, lang), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, g, "s", None if t is None else len(t), "x", 7, "y") for i, t, g in rows], DOCS)


# ---------------------------------------------------------------- ranks
def test_ranked(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, 1, 2, 3, 4]), k) for k in range(500)] + [("hot", 9, 9)] * 300
    got = ranked(spark.createDataFrame(rows, "g string, o int, k int"), ["g"], ["o", "k"]).collect()
    for g in (None, "a", "b", "hot"):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.position)
        want = sorted(((o, k) for h, o, k in rows if h == g), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        assert [r.position for r in mine] == list(range(len(want)))
        assert [(r.o, r.k) for r in mine] == want
        assert {r["size"] for r in mine} == {len(want)}
    assert ranked(spark.createDataFrame([], "g string, o int"), ["g"], ["o"]).count() == 0


# ---------------------------------------------------------------- 11
def test_automaton_matching_statistics():
    rng = random.Random(2)
    for least in (1, 3, 5):
        for _ in range(60):
            seqs = [np.array([rng.randrange(3) for _ in range(rng.randrange(1, 30))]) for _ in range(rng.randrange(1, 5))]
            a = SuffixAutomaton(seqs)
            text, query = a.text.tolist(), np.array([rng.randrange(-1, 3) for _ in range(40)] + text_piece(rng, seqs))
            got = a.matches(query, least, a.earliest(least))
            for i in range(len(query)):
                run = query[i - least + 1:i + 1].tolist() if i >= least - 1 else None
                ends = [e for e in range(least - 1, len(text)) if run and text[e - least + 1:e + 1] == run]
                assert got[i] == (ends[0] if ends else -1)


def text_piece(rng, seqs):
    s = rng.choice(seqs).tolist()
    return s + s[:len(s) // 2]


def plain_removal(rows, least=20):
    """(kept words, removed) by (doc_id, text), rows that share both being one."""
    seen, out = set(), {}
    order = {(i, t or "") for i, t, _ in rows}
    for i, t in sorted(order, key=lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256(x[1].encode()).hexdigest())):
        words = t.encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - least + 1):
            w = tuple(words[k:k + least])
            if w in seen:
                gone[k:k + least] = [True] * least
            seen.add(w)
        out[i, t] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode())
    return out


def repeated_docs(hot=120):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices(string.ascii_letters + "äß€", k=rng.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, long = text(25), text(9000)
    rows = [(i, text(rng.randrange(0, 80)), "en") for i in range(60)]
    rows += [(100 + i, f"{text(15)}\n{shared}\t{text(15)}", "en") for i in range(hot)]       # a hot passage, other words around
    rows += [(300 + i, rows[0][1] + " " + shared, "de") for i in range(40)]                   # copies
    near = text(200).split()
    for i in range(30):                                                                       # near copies
        w = list(near)
        w[rng.randrange(200)] = word()
        rows.append((400 + i, " ".join(w), None))
    rows += [(500, None, None), (501, "", "x"), (502, " \t\n", "x"), (503, "a " * 300, "x"), (504, "a b " * 200, "x"), (505, text(20), "x"), (505, text(30), "x")]
    rows += [(506, shared, "x"), (506, shared, "x"), (None, shared, None), (507, shared.upper(), "x"), (508, long, "x"), (509, f"{text(3)} {long} {long}", "x")]
    rows += [(510, "x" * 5000 + " " + shared + " " + "y" * 5000, "x"), (511, "x" * 5000 + " " + shared + " " + "y" * 4999 + "z", "x")]
    rng.shuffle(rows)
    return rows


def test_substring_dedup(spark):
    rows = repeated_docs()
    want = plain_removal(rows)
    got = repeats.without_repeats(table(spark, rows).repartition(5))
    assert got.columns == ["doc_id", "n_words", "n_removed", "spans", "kept"]
    have = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect())
    assert have == Counter((i, *want[i, t or ""]) for i, t, _ in rows)
    assert sum(v[1] for v in want.values()) > 20_000


def test_substring_dedup_many_shards(spark, monkeypatch):
    """The same result whatever the size of shards and streams, and with tables that are not broadcast."""
    monkeypatch.setattr(repeats, "SHARD_WORDS", 200)
    monkeypatch.setattr(repeats, "STREAM_WORDS", 300)
    monkeypatch.setattr(repeats, "FEW", 0)
    rows = repeated_docs(40)
    want = plain_removal(rows)
    have = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in repeats.without_repeats(table(spark, rows)).collect())
    assert have == Counter((i, *want[i, t or ""]) for i, t, _ in rows)


def test_substring_dedup_empty(spark):
    assert repeats.without_repeats(table(spark, [])).collect() == []
    with pytest.raises(ValueError):
        repeats.repeated_spans(table(spark, []), least=3)


def test_words_of_a_column():
    texts = ["", None, " a  bb\n", "ccc", "", "dd\x0be ü", "  ", "z" * 300]
    found = repeats.Words(pa.array([None, *texts])[1:])
    assert [found.data[a:b].tobytes().decode() for a, b in zip(found.starts, found.ends)] == " ".join(t or "" for t in texts).split()
    assert found.sizes.tolist() == [len((t or "").split()) for t in texts]
    assert len(set(found.hashes().tolist())) == len(found.starts)
    assert found.joined(np.ones(len(found.starts), bool)).to_pylist() == [" ".join((t or "").split()) for t in texts]
    assert found.joined(np.arange(len(found.starts)) % 2 == 1).to_pylist() == ["", "", "bb", "", "", "dd ü", "", ""]


# ---------------------------------------------------------------- 12
def plain_words(rows):
    import re
    n, low = Counter(), str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            n[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    return {w: c for w, c in n.items() if c >= 5 and len(w) >= 6}


def plain_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def test_spelling_variants(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 40)
    monkeypatch.setattr(spelling, "CHUNK", 3)
    rng = random.Random(4)
    stems = ["".join(rng.choices("abeiorsté÷×ü", k=rng.randrange(5, 10))) for _ in range(14)]
    rows, k = [], 0
    for s in stems:
        for edit in range(9):
            w, p = s, rng.randrange(len(s))
            if edit:
                w = rng.choice([s[:p] + s[p + 1:], s[:p] + rng.choice("aexÀ") + s[p:], s[:p] + rng.choice("aexz") + s[p + 1:]])
            for _ in range(rng.choice([3, 5, 6, 30]) if edit else rng.choice([40, 200])):
                k += 1
                rows.append((k, f"{rng.choice([w, w.upper() if w.isascii() else w])} Ł{w}ő 1", "x"))
    rows += [(None, "colour color colour " * 40, None), (9001, None, "x"), (9002, "", "x"), (9003, ("q" * 70 + " ") * 6, "x"), (9003, "colour", "x"),
             (9004, "abcdef " * 30 + "abcdeg " * 30 + "abcdeh " * 6, "x")]
    rng.shuffle(rows)
    n = plain_words(rows)
    near = defaultdict(set)
    for a in n:
        for b in n:
            if a != b and plain_near(a, b):
                near[a].add(b)
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 5 * n[w]:
                form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    want = {w: (form.get(w), root(w), c, len(near[w]), n.get(form.get(w))) for w, c in n.items()}
    got = spelling.variants(table(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert {r.word: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    assert sum(f in form for f in form.values()) or len(form) > 5


def test_spelling_empty(spark):
    assert spelling.variants(table(spark, [])).collect() == []
    assert spelling.variants(table(spark, [(1, "one two", "x")])).collect() == []


def test_roots_of_long_chains(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(20)] + [("x", "w7")], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(forms).collect()} == {**{f"w{k}": "w20" for k in range(20)}, "x": "w20"}


def test_near_blocks_against_all_pairs():
    rng = random.Random(5)
    words = {n: sorted({"".join(rng.choices("abcè", k=n)) for _ in range(80)}) for n in (3, 4)}
    for a, b, same in ((words[3], words[3], True), (words[3], words[4], False), (words[4], words[4], True)):
        i, j = spelling.near(a, b, same)
        want = {(x, y) for x in range(len(a)) for y in range(len(b)) if plain_near(a[x], b[y]) and (not same or x < y)}
        assert set(zip(i.tolist(), j.tolist())) == want


# ---------------------------------------------------------------- 13
def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(paths):
            k, s = at[i], at[i] // 8 * 8
            p.append(("".join(nodes[s:k]), "".join(nodes[k + 1:s + 8])))
            at[i] = k // 8
        nodes = [H(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 8, "b": 9, None: 1}, {"a": 65, "": 512, "b": 513, "é": 64, "z": 2}, {"hot": 4700, **{f"g{k}": 1 for k in range(9)}}])
def test_manifest(spark, sizes):
    rows = [(i if i % 11 else None, f"text {i}" if i % 7 else None, g) for g, n in sizes.items() for i in range(n)]
    rows += [rows[0]] * 3
    fields = ["doc_id", "text", "lang"]
    df = table(spark, rows).select("doc_id", "lang", merkle.leaf(*fields).alias("node"), F.col("text").alias("kept"))
    got = merkle.manifest(df, "lang", ["doc_id"], "node", ["doc_id", "kept"])
    got = got.withColumn("folded", merkle.fold("node", "path")).collect()
    mark = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for i, t, g in rows:
        groups[g].append((i is not None, i or 0, H(mark(i), mark(t), mark(g)), i, t))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (sorted(groups[g], key=lambda x: x[:3]), *plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])])) for g in names}
    root, tops = plain_tree([trees[g][1] for g in names])
    want = Counter()
    for g, top in zip(names, tops):
        leaves, sub, paths = trees[g]
        want.update((i, t, h, sub, root, tuple(p + top)) for (_, _, h, i, t), p in zip(leaves, paths))
    assert Counter((r.doc_id, r.kept, r.node, r.subroot, r.root, tuple((s.left, s.right) for s in r.path)) for r in got) == want
    assert all(r.folded == root for r in got)


def test_manifest_tells_changes(spark):
    rows = [(i, f"Text {i}", "a") for i in range(20)]
    df = table(spark, rows).select("doc_id", "lang", merkle.leaf("doc_id", "text").alias("leaf"), merkle.leaf("doc_id", F.lower("text")).alias("bad"))
    out = merkle.manifest(df, "lang", ["doc_id"], "leaf", ["doc_id", "bad"])
    assert out.where(merkle.fold("bad", "path") == F.col("root")).count() == 0
    assert out.where(merkle.fold("leaf", "path") != F.col("root")).count() == 0
    assert out.select(merkle.path_digest("path")).distinct().count() == 20


def test_manifest_empty(spark):
    df = table(spark, []).select("doc_id", "lang", merkle.leaf("doc_id").alias("leaf"))
    assert merkle.manifest(df, "lang", ["doc_id"], "leaf", ["doc_id"]).collect() == []
