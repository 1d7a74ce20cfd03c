"""The pipeline against brute-force versions of its stages, one after the other."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import sentencepiece

import __spark_entry__ as driver
import corpus_pipeline
from cropwind.llm import mixing, pieces
from tests.llm.test_jaccard_join import brute as components
from tests.llm.test_quality_rules import brute as quality

SF = "/root/testdata/sf0.001"


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def without_repeats(texts, length=400, n=51):
    """(what is left, whether something went): without strings of 400 bytes and passages of 51 words that repeat."""
    words = [list(WORD.finditer(t.encode())) for t in texts]
    passages = Counter(tuple(m[0] for m in w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    data, seen = [t.encode() for t in texts], {}
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    for d, w in zip(data, words):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        for i in range(len(w) - n + 1):
            if passages[tuple(m[0] for m in w[i : i + n])] > 1:
                gone[w[i].start() : w[i + n - 1].end()] = b"\1" * (w[i + n - 1].end() - w[i].start())
        yield bytes(b for b, g in zip(d, gone) if not g).decode(errors="ignore"), any(gone)


def mixed(rows):
    """(doc_id, copies) by filling the targets level by level."""
    sizes, weights = {}, {}
    count = lambda t: len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t)])
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + count(text)
    for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode()))):
        weights[s] = mixing.WEIGHTS[i % 3]
    capped = set()
    while True:
        level = (1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)) / sum(weights[s] for s in sizes if s not in capped)
        more = {s for s in sizes if 2 * sizes[s] < level * weights[s]} | capped
        if more == capped:
            break
        capped = more
    for i, _, source in rows:
        rate = min(2.0 * sizes[source], level * weights[source]) / sizes[source] if sizes[source] else 0.0
        draw = int(hashlib.md5(f"mix|{i}".encode()).hexdigest()[:13], 16) / 16**13
        yield int(rate) + (draw < rate - int(rate))


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    kept = {b[0] for b in quality([(r.doc_id, r.text, r.lang) for r in docs]) if b[-1]}
    docs = [r for r in docs if r.doc_id in kept]
    heads = {i: c for i, _, c in components([(r.doc_id, r.text) for r in docs])}
    docs = [r for r in docs if heads[r.doc_id] == r.doc_id]
    texts = [(r, t) for r, (t, cut) in zip(docs, without_repeats([r.text for r in docs])) if not cut or WORD.search(t.encode())]
    copies = mixed([(r.doc_id, t, r.source) for r, t in texts])
    own = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    want = [(r.doc_id, len(ids), ids) for (r, t), n in zip(texts, copies) for ids in [own.encode(t)] for _ in range(n)]
    out = driver.queries()["pipeline"](spark, SF)
    assert out.columns == ["doc_id", "n_pieces", "ids"]
    assert sorted(map(tuple, out.collect())) == sorted(want) and 0 < len(docs) < 200


def test_stages_take_hard_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "word " * 30000, "en", None, 0), (3, "a b c " * 40 + "x", "xx", "s", 1), (3, "a b c " * 40 + "x", "xx", "s", 1), (4, " ".join(f"w{i}" for i in range(99)), None, "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for data in (rows, []):
        df = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, SF)
            assert out.columns == df.columns
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, df, SF).count() == len(data)
