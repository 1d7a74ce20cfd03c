"""SentencePiece encoding and decoding with the tokenizers library as backend.

The model file is a protobuf message; its few fields that matter are read here: pieces with scores and
types, the model type, byte fallback, and the normaliser. From them a tokenizer is rebuilt: the
normaliser (precompiled character map, white space clean-up, marker in front), the metaspace marker in
place of spaces, unigram scores or merges ranked by score, and byte fallback for unknown characters
(by the backend for merges; for unigram models its unknown characters are put into bytes here).
Batches are encoded by the library's threads, as many as a task has cores.

If no piece holds a marker after another character, no piece crosses from a word into the next marker.
Normalised texts are then split there, and only segments that a task has not met are encoded and decoded:
the ids are the same, and the words that make up most of any text are encoded once.

Parity with the SentencePiece library is verified for every row. Neither library lets a piece cross a
split, so equal normalised texts and equal ids of all segments mean equal ids: each text is normalised by
both libraries, and each segment that a task has not met is encoded by both. Rows for which that does not
settle it (a segment that differs, holds unknown pieces or cannot be given to the other library alone) are
encoded whole by both.

Defined results: a null text counts as empty and has no pieces; decoding gives back the normalised
text; rows are independent, so repeats get equal ids; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, normalizers

MARK = "▁"
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: Types of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Fixed value: what an unknown piece decodes to.
UNKNOWN_TEXT = " \u2047 "
#: Characters encoded in one call; a longer text is encoded alone.
CALL_CHARS = 1 << 20
#: Characters of segments whose ids a task remembers; beyond it the memory starts anew.
KNOWN_CHARS = 4 << 20
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    add_prefix: bool = True
    clean_spaces: bool = True
    escape: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of each field of a protobuf message."""
    at, n = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < n:
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, wire, varint()
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            yield number, wire, data[at : at + size]
            at += size
        elif wire == 2:
            size = varint()
            yield number, wire, data[at : at + size]
            at += size
        else:
            raise ValueError(f"wire type {wire} in a model file")


def parse_model(data: bytes) -> PieceModel:
    model = PieceModel()
    for number, _, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, _, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for n, _, v in _fields(value):
                if n == 3:
                    model.kind = v
                elif n == 35:
                    model.byte_fallback = bool(v)
                elif n == 40:
                    model.unk_id = v
        elif number == 3:
            for n, _, v in _fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.add_prefix = bool(v)
                elif n == 4:
                    model.clean_spaces = bool(v)
                elif n == 5:
                    model.escape = bool(v)
    model.unk_id = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), model.unk_id)
    return model


def _merges(model: PieceModel) -> list[tuple[str, str]]:
    """All splits of a piece into two pieces; the piece with the better score merges first."""
    usable = {p for p, _, kind in model.pieces if kind in (NORMAL, USER, UNUSED)}
    ids = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    found = []
    for i, (piece, score, kind) in enumerate(model.pieces):
        if kind == NORMAL:
            for k in range(1, len(piece)):
                left, right = piece[:k], piece[k:]
                if left in usable and right in usable:
                    found.append((-score, i, ids[left], ids[right], left, right))
    return [(f[4], f[5]) for f in sorted(found)]


def backend(data: bytes):
    """A tokenizer of the tokenizers library that gives the model's ids."""
    model = parse_model(data)
    if model.kind == UNIGRAM:
        # Texts must not match pieces that stand for no text, so those get names that no text has.
        named = [p if kind in (NORMAL, USER) else f"\U0010ffff{i}\U0010ffff" for i, (p, _, kind) in enumerate(model.pieces)]
        core = models.Unigram([(n, s) for n, (_, s, _) in zip(named, model.pieces, strict=True)], model.unk_id, False)
    elif model.kind == BPE:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, _merges(model), unk_token=model.pieces[model.unk_id][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} is neither unigram nor BPE")
    out = Tokenizer(core)
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.clean_spaces:
        steps += [normalizers.Replace(Regex(r"^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape else " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        out.normalizer = normalizers.Sequence(steps)
    return out


@dataclass
class Encoded:
    """A batch: ids as 32-bit numbers one after the other, their number for each text, and what was asked for."""

    ids: np.ndarray
    sizes: list[int]
    decoded: list[str] | None = None
    same: list[bool] | None = None

    def lists(self) -> list[list[int]]:
        ends = np.cumsum([0, *self.sizes]).tolist()
        flat = self.ids.tolist()
        return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]


class Encoder:
    """Ids of texts, segment by segment where the model allows it; ``own`` is the other library's processor."""

    def __init__(self, data: bytes, own=None):
        self.backend = backend(data)
        self.own = own
        model = parse_model(data)
        self.segmented = model.escape and not any(MARK in p.lstrip(MARK) for p, _, kind in model.pieces if kind in (NORMAL, USER))
        self.segments = Tokenizer(self.backend.model)
        #: Of each segment: its ids as bytes, and what they decode to (with markers) where that is not the segment.
        self.known: dict[str, bytes] = {}
        self.changed: dict[str, str] = {}
        #: Segments that do not settle parity.
        self.doubtful: set[str] = set()
        self.chars = 0
        self.texts = [p for p, _, _ in model.pieces]
        self.special = {i for i, (_, _, kind) in enumerate(model.pieces) if kind != NORMAL}
        self.model = model
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.expands = model.kind == UNIGRAM and model.byte_fallback and len(self.bytes) == 256

    def _batch(self, tokenizer: Tokenizer, texts: list[str]) -> list:
        """Encodings of a batch by the library's threads; the fast form lacks the characters that ``_ids`` needs."""
        encode = tokenizer.encode_batch if self.expands else tokenizer.encode_batch_fast
        return encode(texts, add_special_tokens=False)

    def _ids(self, encoding) -> list[int]:
        """The ids; for unigram models, an unknown character is put into its bytes here."""
        ids, unk = encoding.ids, self.model.unk_id
        if not self.expands or unk not in ids:
            return ids
        return [x for i, t in zip(ids, encoding.tokens, strict=True) for x in ([self.bytes[b] for b in t.encode()] if i == unk else [i])]

    def normal(self, text: str) -> str:
        """The normalised text. Without a character map and clean-up it takes no library."""
        model = self.model
        if model.charsmap or model.clean_spaces:
            return self.backend.normalizer.normalize_str(text)
        if model.add_prefix and text:
            text = " " + text
        return text.replace(" ", MARK) if model.escape else text

    def _learn(self, new: list[str], threads: int) -> None:
        """Ids and surfaces of segments, and whether the other library agrees."""
        found = [self._ids(e) for e in self._batch(self.segments, new)]
        self.chars += sum(map(len, new))
        self.known.update(zip(new, (pack(f"<{len(i)}i", *i) for i in found), strict=True))
        self.changed.update((s, m) for s, m in zip(new, map(self._marked, found), strict=True) if s != m)
        if self.own is not None:
            # What gives the segment when it is normalised by itself.
            alone = [(s[1:] if self.model.add_prefix else s).replace(MARK, " ") for s in new]
            wanted, again, unk = self.own.encode(alone, num_threads=threads), self.own.normalize(alone), self.model.unk_id
            self.doubtful.update(s for s, i, w, n in zip(new, found, wanted, again, strict=True) if i != w or n != s or unk in i)

    def run(self, texts: list[str], decode: bool = False, verify: bool = False, threads: int = 1) -> Encoded:
        if not self.segmented:
            lists = [self._ids(e) for e in self._batch(self.backend, texts)]
            same = [a == b for a, b in zip(lists, self.own.encode(texts, num_threads=threads), strict=True)] if verify else None
            return Encoded(np.array(list(chain.from_iterable(lists)), np.int32), list(map(len, lists)), self.decode(lists) if decode else None, same)
        if self.chars > KNOWN_CHARS:
            self.known, self.changed, self.doubtful, self.chars = {}, {}, set(), 0
        normal = list(map(self.normal, texts))
        parts = list(map(_SEGMENT.findall, normal))
        self._learn(list(set(chain.from_iterable(parts)).difference(self.known)), threads)
        packed = [b"".join(map(self.known.__getitem__, p)) for p in parts]
        out = Encoded(np.frombuffer(b"".join(packed), np.int32), [len(x) // 4 for x in packed])
        if decode:
            same = self.changed.keys().isdisjoint
            out.decoded = [self._text(n if same(p) else "".join(self.changed.get(s, s) for s in p)) for n, p in zip(normal, parts, strict=True)]
        if verify:
            out.same = [a == b and (not self.doubtful or self.doubtful.isdisjoint(p)) for a, b, p in zip(normal, self.own.normalize(texts), parts, strict=True)]
            open_ = [k for k, settled in enumerate(out.same) if not settled]
            for k, want in zip(open_, self.own.encode([texts[k] for k in open_], num_threads=threads) if open_ else [], strict=True):
                out.same[k] = packed[k] == pack(f"<{len(want)}i", *want)
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.run(texts).lists()

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of ids: bytes are put together, control pieces give nothing, unknown ones a mark."""
        return [self._text(self._marked(one)) for one in ids]

    def _marked(self, ids: list[int]) -> str:
        if self.special.isdisjoint(ids):
            return "".join(map(self.texts.__getitem__, ids))
        return b"".join(map(self._surface, ids)).decode(errors="replace")

    def _text(self, marked: str) -> str:
        text = marked.replace(MARK, " ")
        return text[1:] if self.model.add_prefix and text[:1] == " " else text

    def _surface(self, i: int) -> bytes:
        piece, _, kind = self.model.pieces[i]
        if kind == BYTE:
            return bytes([self.byte_of[i]])
        return b"" if kind == CONTROL else UNKNOWN_TEXT.encode() if kind == UNKNOWN else piece.encode()


def _threads(n: int) -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if n > 1 else "false"
    os.environ["RAYON_NUM_THREADS"] = str(n)


def in_calls(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CALL_CHARS`` characters."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > CALL_CHARS:
            yield first, i
            first, size = i, 0
        size += len(t)
    if len(texts) > first:
        yield first, len(texts)


def encode(docs: DataFrame, data: bytes, threads: int | None = None, decode: bool = False, verify: bool = False) -> DataFrame:
    """``doc_id, ids`` of every row; if asked for ``decoded`` (the text that the ids give back) and ``same``.

    ``same`` tells whether the SentencePiece library gives the same ids.

    ``data`` is the model file's content; it goes to the tasks once, as a broadcast of fixed size.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(data)
    cores = threads or int(spark.conf.get("spark.task.cpus", "1"))
    schema = "doc_id long, ids array<int>" + (", decoded string" if decode else "") + (", same boolean" if verify else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _threads(cores)
        encoder = _encoder(sent.value, verify)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for first, end in in_calls(texts):
                found = encoder.run(texts[first:end], decode, verify, cores)
                ends = np.cumsum([0, *found.sizes], dtype=np.int32)
                columns = {"doc_id": batch.column("doc_id").slice(first, end - first), "ids": pa.ListArray.from_arrays(ends, pa.array(found.ids, pa.int32()))}
                if decode:
                    columns["decoded"] = pa.array(found.decoded, pa.string())
                if verify:
                    columns["same"] = pa.array(found.same, pa.bool_())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


@cache
def _encoder(data: bytes, verify: bool) -> Encoder:
    return Encoder(data, _library(data) if verify else None)


def _library(data: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data)


def parity(docs: DataFrame, data: bytes) -> DataFrame:
    """``doc_id, same``: whether the SentencePiece library gives the same ids."""
    return encode(docs, data, verify=True).select("doc_id", "same")


def model_bytes(path: str = MODEL_FILE) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def stage(docs: DataFrame, path: str = MODEL_FILE) -> DataFrame:
    """``doc_id, n_pieces, ids`` of every document."""
    return encode(docs, model_bytes(path)).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids")


def digest(docs: DataFrame, path: str = MODEL_FILE) -> DataFrame:
    """``doc_id, n_pieces, ids, decoded_sha256, same``: what the ids decode to as a digest, and whether they have parity."""
    out = encode(docs, model_bytes(path), decode=True, verify=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "same")
