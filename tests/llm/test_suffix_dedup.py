from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from cropwind.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string"


def brute(texts, length):
    seen, out = {}, []
    data = [(t or "").encode() for t in texts]
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def made(seed, n=60, length=40):
    """Texts of parts that are shared by chance, over few letters, with edits."""
    r = random.Random(seed)
    letters = "ab" if seed % 3 == 0 else "abcdé"
    parts = ["".join(r.choice(letters) for _ in range(r.randint(5, 3 * length))) for _ in range(12)]
    texts = []
    for _ in range(n):
        t = "".join(r.choice(parts) if r.random() < 0.6 else "".join(r.choice(letters) for _ in range(r.randint(1, 2 * length))) for _ in range(r.randint(0, 6)))
        if t and r.random() < 0.3:
            i = r.randrange(len(t))
            t = t[:i] + "z" + t[i + 1 :]
        texts.append(t)
    return [*texts, None, "", "a" * 5 * length, texts[0], "a" * 5 * length]


def got(spark, texts, length, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    rows = sd.deduplicate(df, length, **options).collect()
    assert len(rows) == len(texts)
    return [(len(r.kept) + sum(s.end - s.first for s in r.spans), sum(s.end - s.first for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in sorted(rows, key=lambda r: r.doc_id)]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_equals_brute_force(spark, seed):
    texts = made(seed)
    assert got(spark, texts, 40, anchor_bytes=12) == brute(texts, 40)


@pytest.mark.parametrize("limit", [1, 2, 7])
def test_large_groups_are_split_with_the_same_result(spark, limit):
    texts = made(5)
    assert got(spark, texts, 40, anchor_bytes=12, group_limit=limit) == brute(texts, 40)


def passages(texts, n):
    """(words in repeated passages, words kept) of each text, from the words alone."""
    data = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(d[i : i + n]) for d in data for i in range(len(d) - n + 1))
    for d in data:
        gone = {k for i in range(len(d) - n + 1) if seen[tuple(d[i : i + n])] > 1 for k in range(i, i + n)}
        yield len(gone), [w for i, w in enumerate(d) if i not in gone]


@pytest.mark.parametrize("options", [{}, {"group_limit": 2}])
def test_passages_equal_brute_force(spark, options):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(1, 4)))
    parts = [[word() for _ in range(r.randint(4, 30))] for _ in range(10)]
    texts = []
    for _ in range(80):
        t = [w for _ in range(r.randint(0, 5)) for w in (r.choice(parts) if r.random() < 0.6 else [word() for _ in range(12)])]
        texts.append("".join(w + r.choice([" ", "\n", " \t", "\r\n\n"]) for w in t))
    texts += [None, "", "  ", texts[3], "a " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    want = list(passages(texts, 12))
    out = sorted(sd.deduplicate(df, 10_000, 12, **options).collect())
    assert [sum(p.end - p.first for p in r.passages) for r in out] == [n for n, _ in want] and any(n for n, _ in want)
    kept = {r.doc_id: r.text.split() for r in sd.stage(df, 10_000, 12, **options).collect()}
    assert kept == {i: w for i, (n, w) in enumerate(want) if w or not n}


def test_very_long_texts(spark):
    r = random.Random(4)
    long = "".join(r.choice("abcdefgh ") for _ in range(1_500_000))
    texts = [long, "x" + long[700_000:700_900] + "y", "other " + long[100:499] + " end", "z" * 1_200_000]
    out = sorted(sd.deduplicate(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect())
    assert [[(s.first, s.end) for s in r.spans] for r in out] == [[(700_000, 700_900)], [(1, 901)], [], [(0, 1_200_000)]]


def test_deep_shallow_orders_like_sorted():
    r = random.Random(3)
    for letters in (b"a", b"ab", b"abc"):
        strings = [bytes(r.choice(letters) for _ in range(r.randint(0, 120))) for _ in range(200)]
        strings += [strings[0][:50], strings[1] + b"a", b"", b"a" * 300, b"a" * 301]
        order = sd.deep_shallow(strings, 16)
        assert [strings[i] for i in order] == sorted(strings) and sorted(order) == list(range(len(strings)))


def test_repeated_rows_null_ids_and_other_columns(spark):
    rows = [(1, "x" + "ab" * 250, 1), (1, "x" + "ab" * 250, 1), (None, None, 2), (None, "short", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k1 int")
    out = sd.deduplicate(df)
    assert out.columns == ["doc_id", "k1", "kept", "spans", "passages"]
    assert sorted((r.k1, r.kept) for r in out.collect()) == [(1, b""), (1, b""), (2, b""), (3, b"short")]
    assert sd.digest(df.where("false")).count() == 0


def test_stage_keeps_columns_and_drops_emptied_documents(spark):
    same = "".join(random.Random(1).choice("abcdefgh") for _ in range(500))
    rows = [(1, same, "en", "s", 500), (2, "own " + same, "en", "s", 504), (3, "clean", None, None, 5), (4, "", "en", "s", 0)]
    out = sd.stage(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(map(tuple, out.collect()), key=str) == [(2, "own ", "en", "s", 4), (3, "clean", None, None, 5), (4, "", "en", "s", 0)]


def test_stage_takes_54_shared_words_and_no_fewer_than_51(spark):
    r = random.Random(2)
    words = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7))) for _ in range(n))
    shared, short, own = words(54), words(50), [words(80) for _ in range(3)]
    assert len(shared) < sd.LENGTH
    rows = [(i, f"{t} {shared} {t[::-1]}" if i else f"{t} {short}", None, None, 0) for i, t in enumerate(own)] + [(3, short, None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    texts = [x.text for x in sorted(sd.stage(df).collect())]
    assert texts == [rows[0][1], *(f"{t}  {t[::-1]}" for t in own[1:]), short]
    assert [x.text for x in sorted(sd.stage(df, passage_words=None).collect())] == [x[1] for x in rows]


def test_stage_with_clashing_columns(spark):
    rows = [(1, "a", 5, "x", "y", "z", 3), (2, None, 6, "x", "y", "z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int, kept string, passages string, new string, k1 int")
    out = sd.stage(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect()))[0] == rows[0]


def test_query_over_the_whole_table(spark):
    from cropwind.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = queries.table(spark, sf, "documents").orderBy("doc_id").collect()
    want = brute([d.text for d in docs], 400)
    out = sorted(queries.op2_suffix_dedup(spark, sf).collect())
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out] == want
    assert [r.doc_id for r in out] == [d.doc_id for d in docs] and any(w[1] for w in want)
    assert [r.n_passage_words for r in out] == [n for n, _ in passages([d.text for d in docs], sd.PASSAGE_WORDS)]
