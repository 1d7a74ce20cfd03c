from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cropwind.llm import fill_middle as fim
WHOLE = "/root/testdata/sf0.001"


def by_hand(doc_id: int | None, text: str | None) -> tuple:
    text = text or ""
    units = re.findall("[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, len(units))))
    if not text or re.search("<[PSM]>", text):
        return len(units), "plain", None, None, text
    form = "spm" if h[3] % 100 < 50 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return len(units), form, len(prefix), len(middle), out


def test_whole_table(spark):
    docs = spark.read.parquet(f"{WHOLE}/documents.parquet")
    out = {r.doc_id: r for r in fim.transform(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(out) == len(rows) and {r.form for r in out.values()} >= {"psm", "spm"}
    for row in rows:
        r = out[row.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == by_hand(row.doc_id, row.text)
    for row in fim.digest(docs).join(docs, "doc_id").collect():
        assert row.restored_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()


def test_null_empty_long_repeated_and_clashing_rows(spark):
    texts = [None, "", "\n", "\n\n", "a", "no line feed at the end\nx", "holds <S> a marker\nb", "<", "<\nP>\n<S", "é\n漢字\n🙂🙂\n", "x\r\ny\r\n", "line\n" * 300_000, "ü" * 700_000, "a\n" * 3 + "b" * 40_000 + "\n"]
    rows = [(i, t, "own", -1) for i, t in enumerate(texts)] + [(5, texts[5], "again", -1), (None, "null\nid\n", "x", -1), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n long")
    found = sorted((r.doc_id is None, r.doc_id or 0, r.output, r.n, r.form, r.prefix_chars, r.middle_chars) for r in fim.transform(docs).collect())
    want = sorted((i is None, i or 0, by_hand(i, t)[4], *by_hand(i, t)[:4]) for i, t, _, _ in rows)
    assert found == want
    plain = {r.doc_id: r.form for r in fim.transform(docs).collect()}
    assert plain[0] == plain[1] == plain[6] == "plain"
    again = fim.transform(docs).withColumn("text", fim.restored(F.col("output"), F.col("form")))
    assert sorted(r.text for r in again.collect()) == sorted(t or "" for _, t, _, _ in rows)
    assert fim.digest(docs.where("false")).count() == 0


def test_shares(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc").alias("text"))
    forms = lambda **o: {r.form: r["count"] for r in fim.transform(docs, **o).groupBy("form").count().collect()}
    assert forms(rate=0) == {"plain": 400} and set(forms(suffix_first=100)) == {"spm"} and set(forms(suffix_first=0)) == {"psm"}
    assert 60 < forms(rate=25)["plain"] - 200 < 140 and fim.transform(docs, seed=8).exceptAll(fim.transform(docs)).count() > 0


@settings(deadline=None, max_examples=200)
@given(st.binary(min_size=0, max_size=60), st.data())
def test_rank_and_select(data, more):
    raw = np.frombuffer(data.replace(b"\x0b", b"\n"), np.uint8)
    words = fim.as_words(raw)
    for marks, wanted in ((fim.line_feeds(words), raw == 10), (fim.continuations(words), (raw & 0xC0) == 0x80)):
        m = fim.Marks(marks)
        places = np.arange(len(raw) + 1)
        assert m.rank(places).tolist() == np.concatenate(([0], np.cumsum(wanted))).tolist()
        at = np.flatnonzero(wanted)
        assert m.select(np.arange(len(at))).tolist() == at.tolist()


@pytest.mark.parametrize("byte", range(256))
def test_no_carry_between_bytes(byte):
    raw = np.array([byte, 10, byte, 10 ^ 1, byte, 10 ^ 128, 10, byte], np.uint8)
    marks = fim.line_feeds(fim.as_words(raw))
    assert marks.view(np.uint8).tolist() == [0x80 if b == 10 else 0 for b in raw]
