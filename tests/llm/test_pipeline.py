"""The rows of the whole pipeline against plain Python, stage by stage, on sf0.001."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

import corpus_pipeline
from chatlake.llm import quality, secrets
from chatlake.llm.common import table
from test_digests import BASE, SF, plain_fingerprint

MARK = "[SECRET]"


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))


def classified(spark, docs):
    model = quality.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    return [d for d in docs if quality.scores(model, quality._views([d["text"]], [d["lang"]], [d["source"]], [d["n_chars"]]))[0, 0] >= quality.KEEP]


def deduplicated(docs):
    docs = sorted(docs, key=lambda d: d["doc_id"])
    fp, stay = [plain_fingerprint(d["text"]) for d in docs], list(range(len(docs)))
    for _ in docs:  # the least document reachable, until nothing changes
        now = [min(stay[j] for j in range(len(docs)) if (fp[i] ^ fp[j]).bit_count() <= 2) for i in range(len(docs))]
        if now == stay:
            break
        stay = now
    return [d for i, d in enumerate(docs) if stay[i] == i]


def decontaminated(docs):
    strings = defaultdict(set)
    for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist():
        w = plain_words(r["text"])
        for i in range(max(1, len(w) - 9) if w else 0):
            strings[len(w[i:i + 10])].add(tuple(w[i:i + 10]))
    hit = lambda w: any(tuple(w[i:i + n]) in s for n, s in strings.items() for i in range(len(w) - n + 1))
    return [d for d in docs if not hit(plain_words(d["text"]))]


def without_secrets(spark, docs):
    model = [float(f"{x:.6g}") for x in secrets.train(spark.createDataFrame([(d["text"],) for d in docs], "text string"))]
    out = []
    for d in docs:
        t = d["text"]
        spans = [(m.start(1), m.end(1)) for _, p, g, least in BASE for m in re.finditer(p, t) if len(m[g]) >= least]
        for m in re.finditer(secrets.CANDIDATE, t):
            ratio = sum(model[ord(a) * 128 + ord(b)] for a, b in zip(m[0], m[0][1:]))
            if ratio >= max(secrets.RATIO_SUM, secrets.RATIO * (len(m[0]) - 1)) and not any(a < m.end() and m.start() < b for a, b in spans[:]):
                spans.append(m.span())
        text, at = "", 0
        for a, b in sorted(spans):
            text, at = text + (t[at:a] + MARK if a >= at else ""), max(at, b)
        out.append({**d, "text": text + t[at:]})
    return out


def test_pipeline(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    kept = classified(spark, docs)
    unique = deduplicated(kept)
    clean = decontaminated(unique)
    final = without_secrets(spark, clean)
    assert len(docs) > len(kept) > len(unique) > len(clean) > 0

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for d in final:
        ids = np.array(tokenizer.encode(d["text"], add_special_tokens=False).ids + [0], dtype="<u4")
        for k in range(-(-len(ids) // 2048)):
            want[d["doc_id"], k] = ids[k * 2048:(k + 1) * 2048].tobytes()
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["piece"]) for r in got) == Counter(dict.fromkeys(want, 1))
    used = defaultdict(list)
    for r in got:
        raw = want[r["doc_id"], r["piece"]]
        assert (bytes(r["ids"]), r["start"], r["length"], r["ids_crc32"]) == (raw, r["piece"] * 2048, len(raw) // 4, zlib.crc32(raw))
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in used.values():
        ends = np.cumsum([0] + [n for _, n in sorted(spans)])
        assert [o for o, _ in sorted(spans)] == ends[:-1].tolist() and ends[-1] <= 2048
    assert len(used) <= 1.05 * sum(map(len, want.values())) / 4 / 2048 + 1
