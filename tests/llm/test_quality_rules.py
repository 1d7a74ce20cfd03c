from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from cropwind.llm import quality_rules as q
from cropwind.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed


def histograms(text, lang):
    text = text or ""
    words = WORD.findall(text)
    known = [sum(c.isupper() for c in text), sum(c.isdigit() for c in text), len(re.findall(r"[.,;:!?'\"()\-]", text)), len(re.findall(r"[#*$%&|<>]", text)), len(text) - sum(map(len, words))]
    common = q.COMMON_WORDS.get(lang)
    counts = Counter(w.lower() for w in words)
    return [*known, max(0, len(text) - sum(known))], [*(counts[w] for w in common), len(words) - sum(counts[w] for w in common)] if common else None


def js(a, b):
    if not a or not b or not sum(a) or not sum(b):
        return None
    p, r = [x / sum(a) for x in a], [x / sum(b) for x in b]
    part = lambda x, y: x * math.log2(2 * x / (x + y)) if x > 0 else 0.0
    return math.sqrt(max(0.0, sum(part(x, y) + part(y, x) for x, y in zip(p, r)) / 2))


def brute(rows):
    """(doc_id, base..., kept) of (doc_id, text, lang) rows."""
    sums = {}
    for _, text, lang in rows:
        b = base(text)
        if not b[5]:
            total = sums.setdefault(lang, [0, None, None])
            total[0] += b[0]
            for k, h in enumerate(histograms(text, lang), 1):
                if h:
                    total[k] = [x + y for x, y in zip(total[k] or [0] * len(h), h)]
    out = []
    for i, text, lang in rows:
        b, (chars, words), ref = base(text), histograms(text, lang), sums.get(lang)
        ref = ref if ref and ref[0] >= q.MIN_REFERENCE_WORDS else [0, None, None]
        scatter = 1 / b[0] if b[0] else 0
        far = (js(chars, ref[1]) or 0) > q.MAX_CHARACTER_DISTANCE + q.CHARACTER_ALLOWANCE * scatter
        far |= b[0] >= q.MIN_WORDS_FOR_HISTOGRAM and (js(words, ref[2]) or 0) > q.MAX_WORD_DISTANCE + q.WORD_ALLOWANCE * scatter
        out.append((i, *b, not b[5] and not far))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang) for r in queries.table(spark, sf, "documents").collect()]
    out = queries.op1_quality_rules(spark, sf).select(*COLUMNS).collect()
    assert sorted(map(tuple, out), key=str) == brute(rows)
    assert {r.kept for r in out if not r.base_failed} == {True, False}


@pytest.fixture
def rows():
    r = random.Random(2)
    prose = lambda n: " ".join(r.choice(["the", "of", "and", "to", "thing", "house", "river", "stone", "Line."]) + str(i % 7) * (i % 3 == 0) for i in range(n))
    texts = [prose(400) for _ in range(12)]
    texts += ["word " * 60, "a b c d e f " * 20, "\n".join(["same line here"] * 30), None, "", " \n\t", "x" * 5000, "| # $ % " * 50 + texts[0], texts[0]]
    texts += [" ".join(f"w{i}" for i in range(60)) + " w0 w1 w2 w3"]
    return [(i if i != 3 else None, t, "en" if i % 5 else None) for i, t in enumerate(texts)]


def test_cases_against_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumnRenamed("doc_id", "doc_id")
    assert sorted(map(tuple, q.digest(df).select(*COLUMNS).collect()), key=str) == brute(rows)
    assert q.digest(df.where("false")).count() == 0


def test_stage_returns_the_kept_rows_and_their_columns(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "n_words long, text string, lang string").withColumn("kept", F.lit("x"))
    out = q.stage(df)
    assert out.columns == df.columns
    want = [(i, t, l, "x") for (i, t, l), b in zip(sorted(rows, key=str), brute(rows)) if b[-1]]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
