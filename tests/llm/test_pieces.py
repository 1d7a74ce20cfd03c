from __future__ import annotations

import hashlib
import struct

import pytest
import pyarrow as pa
import sentencepiece

from cropwind.llm import pieces as p
from cropwind.llm import queries

SF = "/root/testdata/sf0.001"
EDGE = ["", " ", "  a  b ", "\n", "a\n\nb", "\t tab", "日本語テキスト", "🙂🙃 emoji", "a b", "x" * 5000, "<s> hi </s> <unk>", "<0x41>", "▁ mark", "é", "\x00ctrl", " lead", "trail ", "a  ▁▁ b", "ﬁ", "word " * 3000]


def field(number, value):
    key = lambda wire: bytes([number << 3 | wire]) if number < 16 else bytes([(number << 3 | wire) & 0x7F | 0x80, number >> 4])
    if isinstance(value, float):
        return key(5) + struct.pack("<f", value)
    if isinstance(value, int):
        return key(0) + (bytes([value]) if value < 128 else bytes([value & 0x7F | 0x80, value >> 7]))
    return key(2) + (bytes([len(value)]) if len(value) < 128 else bytes([len(value) & 0x7F | 0x80, len(value) >> 7])) + value


def unigram(clean):
    """A small hand-made unigram model with byte fallback; nothing is trained."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    pieces += [("▁", -3.0, 1), ("a", -4.0, 1), ("b", -4.5, 1), ("ab", -5.0, 1), ("▁a", -4.2, 1), ("▁ab", -6.5, 1), ("ba", -6.0, 1), ("é", -7.0, 1), ("▁b▁a", -5.5, 1)]
    out = b"".join(field(1, field(1, t.encode()) + field(2, s) + field(3, k)) for t, s, k in pieces)
    return out + field(2, field(3, 1) + field(35, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, int(clean)) + field(5, 1))


@pytest.mark.parametrize("data", [p.model_bytes(), unigram(True), unigram(False)], ids=["bpe", "unigram-clean", "unigram"])
def test_ids_and_decoding_equal_the_other_library(data):
    own, encoder = sentencepiece.SentencePieceProcessor(model_proto=data), p.Encoder(data)
    texts = [*EDGE, "ab ba  b a ab", " a", "éa zab", "b a b a"]
    want = own.encode(texts)
    assert encoder.encode(texts) == want
    plain = [(t, i) for t, i in zip(texts, want) if "▁" not in t]
    assert encoder.decode([i for _, i in plain]) == own.decode([i for _, i in plain])


def test_parity_over_the_whole_table_and_edge_cases(spark):
    data = p.model_bytes()
    docs = queries.table(spark, SF, "documents").select("doc_id", "text")
    edge = spark.createDataFrame([(i, t) for i, t in enumerate([*EDGE, None])], "doc_id long, text string")
    assert p.parity(docs.unionByName(edge), data).where("NOT same").isEmpty()


@pytest.mark.parametrize("data", [p.model_bytes(), unigram(True), unigram(False)], ids=["bpe", "unigram-clean", "unigram"])
def test_parity_is_settled_by_segments_or_whole_texts(data):
    own = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = [*EDGE, "ab ba  b a ab", " a", "b a b a"]
    encoder, asked = p.Encoder(data, own), []
    first = encoder.run(texts, decode=True, verify=True)
    assert all(first.same) and first.lists() == own.encode(texts) and first.decoded == encoder.decode(first.lists())

    class Other:
        """The other library with another opinion on one segment."""

        def encode(self, batch, **_):
            asked.append(batch)
            return [[7] if t == "trail" or t == "trail " else i for t, i in zip(batch, own.encode(batch))]

        def normalize(self, batch, **_):
            return own.normalize(batch)

    encoder = p.Encoder(data, Other())
    found = encoder.run(texts, verify=True)
    assert [t for t, s in zip(texts, found.same) if not s] == ["trail "]
    if encoder.segmented:
        assert len(asked[1]) < len(texts)


def test_query_gives_back_every_text(spark):
    texts = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    own = sentencepiece.SentencePieceProcessor(model_file=p.MODEL_FILE)
    out = queries.op3_pieces(spark, SF).collect()
    assert len(out) == len(texts)
    for r in out:
        assert r.ids == own.encode(texts[r.doc_id]) and r.n_pieces == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_query_verifies_parity(spark, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EDGE)], "doc_id long, text string")
    assert queries.op3_pieces(spark, SF).where("same IS NOT TRUE").isEmpty() and p.digest(df).where("same IS NOT TRUE").isEmpty()
    data = p.model_bytes()

    class Off:
        def encode(self, texts, **_):
            return [[1]] * len(texts)

        def normalize(self, texts, **_):
            return texts

    monkeypatch.setattr(p, "_library", lambda data: Off())
    # In this process, as tasks import a module of their own.
    run = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: run.append(f) or df)
    p.encode(df, data, verify=True)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["one two three", "four"]})
    assert [x for out in run[0](iter([batch])) for x in out.column("same").to_pylist()] == [False, False]


def test_null_repeated_and_clashing_rows(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "a", 2), (1, "a", 2)], "doc_id long, text string, ids int")
    assert sorted((r.n_pieces, r.doc_id or 0) for r in p.digest(df).collect()) == [(0, 0), (1, 1), (1, 1)]
    assert p.digest(df.where("false")).count() == 0 and p.stage(df).columns == ["doc_id", "n_pieces", "ids"]
