"""Removal of byte strings that occur more than once, by suffix sorting of sampled positions.

A string of ``length`` bytes is found through its anchor: the start of the k-byte string in it with
the smallest hash (the leftmost one). Equal strings have their anchors at the same place, so two
equal strings share a k-byte string at their anchors, and only suffixes that start at anchors need
sorting: about two in ``length - k`` positions instead of all.

1. One scan writes the anchors with the windows that each serves. A window block whose whole text
   (``block``) occurs twice is settled by counting alone; copies of a document, of which there may
   be any number, end here.
2. Anchors whose k bytes occur in different blocks form groups. Each group is put into suffix order
   by deep-shallow sorting: multikey quicksort on words of eight bytes down to a shallow depth, then
   a blind trie for each group that still shares its prefix. The same is done to the left of the
   anchor. Clusters of anchors with a common left context are merged from the deepest on, the
   smaller into the larger, and the neighbours in suffix order give the longest match on the right.
   A match of at least ``length`` bytes in all covers its bytes.
3. A group of more than ``group_limit`` different blocks is split before it is sorted. Its windows begin
   between 0 and ``length - k`` bytes before the anchor; each half of that range has bytes on either side
   that all its windows hold, and anchors that differ in them cannot share such a window. So a member goes
   to one sub-group for each half, by the hash of these bytes, and what is still too large is halved again.

Passages are found in the same passes in a second form of the text, one 32-bit hash for each word: a
passage of ``PASSAGE_WORDS`` words, whatever white space lies between them, is a string of four times as
many bytes there.

Defined results: a null text counts as empty; a text below ``length`` bytes loses nothing; repeated
rows are copies of each other; null ids are allowed; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropwind.llm.grams import Hashed, mixed, slices, words
from cropwind.sources.paths import written

LENGTH = 400
#: Words of a passage that is reported, and removed by ``stage``, besides strings of ``LENGTH`` bytes.
PASSAGE_WORDS = 51
#: Bytes of the string that picks an anchor. Longer: fewer chance groups, more anchors.
ANCHOR_BYTES = 128
ANCHOR_WORDS = 16
#: Bytes of a word's hash in the second form of a text.
UNIT = 4
#: The two forms of a text: its own bytes, and its words' hashes.
BYTES, WORDS = 0, 1
#: Different blocks of one anchor string that one task sorts at once; beyond it the group is split.
GROUP_LIMIT = 20_000
#: Depth in bytes at which multikey quicksort hands over to blind tries.
SHALLOW = 48
WORD = 8

KEYS = ("k1", "k2")
_ANCHORS = "kind int, k1 long, k2 long, at long, gram long, block long, before int, reach int"


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with two hashes that stand for the pair; equal rows share them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.cast("binary").alias("text"), F.xxhash64(text, "doc_id").alias("k1"), F.xxhash64(F.lit(1), "doc_id", text).alias("k2"))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Row, first window, last window, anchor, anchor hash and block hash of each anchor."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    hashed = Hashed(data)
    grams = mixed(hashed.rolling(k))
    place = np.arange(len(grams), dtype=np.uint64)
    best = _sliding_min((grams & np.uint64(0xFFFFFFFF00000000)) | place, length - k + 1)
    anchor = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(offsets)
    rows = np.flatnonzero(sizes >= length)
    counts = sizes[rows] - length + 1
    ends = np.cumsum(counts)
    window = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(offsets[rows], counts)
    row = np.repeat(rows, counts)
    if not len(window):
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    at = anchor[window]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (row[1:] != row[:-1]))))
    last = np.concatenate((new[1:], [len(window)])) - 1
    low, high, at, row = window[new], window[last], at[new], row[new]
    shape = ((at - low).astype(np.uint64) << np.uint64(32)) | (high - low).astype(np.uint64)
    block = mixed(hashed.of(low, high + length) ^ mixed(shape))
    return row, low - offsets[row], high - offsets[row], at - offsets[row], grams[at], block


def as_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The second form of texts: ``UNIT`` bytes for each word, and where each text begins in them."""
    start, end, first = words(data, offsets)
    hashes = mixed(Hashed(data).of(start, end) + (end - start).astype(np.uint64)) if len(start) else np.zeros(0, np.uint64)
    return hashes.astype(np.uint32).view(np.uint8), first * UNIT


def _scan(lengths: dict[int, tuple[int, int]]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy() for c in KEYS)
            for start, _, raw, places in slices(batch.column("text")):
                for kind, (length, k) in lengths.items():
                    data, offsets = (raw, places) if kind == BYTES else as_units(raw, places)
                    row, low, high, at, gram, block = _anchors(data, offsets, length, k)
                    row = row + start
                    # Each form has anchor strings of its own.
                    gram = mixed(gram + np.uint64(kind))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (np.full(len(row), kind, np.int32), k1[row], k2[row], at, gram.view(np.int64), block.view(np.int64), (at - low).astype(np.int32), (high + length - at).astype(np.int32))],
                        names=[c.split()[0] for c in _ANCHORS.split(", ")],
                    )

    return scan


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def _blind_trie(strings: list[bytes], members: list[int]) -> list[int]:
    """Order of strings by a trie whose nodes keep a depth and one branching byte a child.

    A node is ``[depth, children]``, a leaf a list of equal strings' numbers. Insertion goes down
    looking at branching bytes only, compares once with the leaf it meets, and splits the edge where
    the first difference lies. A string's end sorts before every byte.
    """
    def branch(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    root: list | None = None
    for m in members:
        s = strings[m]
        if root is None:
            root = [None, [m]]
            continue
        path, node = [], root
        while node[0] is not None:
            path.append(node)
            child = node[1].get(branch(s, node[0]))
            node = child if child is not None else next(iter(node[1].values()))
        other = strings[node[1][0]]
        if s == other:
            node[1].append(m)
            continue
        depth = common(s, other)
        above = None
        for step in path:
            if step[0] > depth:
                below = step
                break
            above = step
        else:
            below = node
        if above is not None and above[0] == depth:
            above[1][branch(s, depth)] = [None, [m]]
            continue
        split = [depth, {branch(other, depth): below, branch(s, depth): [None, [m]]}]
        if above is None:
            root = split
        else:
            above[1][branch(s, above[0])] = split
    out: list[int] = []
    stack = [root] if root else []
    while stack:
        node = stack.pop()
        if node[0] is None:
            out.extend(node[1])
        else:
            stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
    return out


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Numbers of the strings in byte order: multikey quicksort, then blind tries."""
    out: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while stack:
        members, depth = stack.pop()
        if len(members) < 2:
            out.extend(members)
        elif depth >= shallow:
            out.extend(_blind_trie(strings, members))
        else:
            words = [strings[m][depth : depth + WORD] for m in members]
            pivot = sorted((words[0], words[len(words) // 2], words[-1]))[1]
            less, same, more = [], [], []
            for m, w in zip(members, words, strict=True):
                (less if w < pivot else more if w > pivot else same).append(m)
            stack.append((more, depth))
            stack.append((same, depth + WORD if len(pivot) == WORD else shallow))
            stack.append((less, depth))
    return out


def matches(left: list[bytes], right: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each anchor the spans (bytes before, bytes after) that it shares with another one.

    ``left`` holds the context before the anchor, reversed. Spans that lie inside others of the same
    anchor may be left out.
    """
    n = len(right)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if n == 2:
        before, after = common(left[0], left[1]), common(right[0], right[1])
        if before + after >= length:
            spans[0].append((before, after))
            spans[1].append((before, after))
        return spans
    order = deep_shallow(right)
    rank = {m: i for i, m in enumerate(order)}
    by_left = deep_shallow(left)
    joins = sorted(((common(left[a], left[b]), i) for i, (a, b) in enumerate(zip(by_left, by_left[1:], strict=False))), reverse=True)
    head = list(range(n))
    cluster: list[list[int] | None] = [[rank[m]] for m in by_left]

    def find(i: int) -> int:
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    for before, i in joins:
        a, b = find(i), find(i + 1)
        if len(cluster[a]) < len(cluster[b]):
            a, b = b, a
        large, small = cluster[a], cluster[b]
        for r in small:
            x = order[r]
            spot = bisect_left(large, r)
            for near in large[max(0, spot - 1) : spot + 1]:
                y = order[near]
                after = common(right[x], right[y])
                if before + after >= length:
                    spans[x].append((before, after))
                    spans[y].append((before, after))
        if len(small) < 16:
            for r in small:
                insort(large, r)
        else:
            large.extend(small)
            large.sort()
        cluster[b], head[b] = None, a
    return spans


_SPANS = "kind int, k1 long, k2 long, first long, end long"
_CONTEXTS = "kind int, gram long, block long, k1 long, k2 long, at long, before int, left binary, right binary, copies long"
#: A context that waits to be sorted, with the range of starts (bytes before the anchor) that its group stands for.
_OPEN = "kind int, gram long, k1 long, k2 long, at long, left binary, right binary, copies long, low int, high int"


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], names=[name for name, _ in fields])


def _rows(batch: pa.RecordBatch, schema: str) -> Iterator[tuple]:
    return zip(*(batch.column(c.split()[0]).to_pylist() for c in schema.split(", ")), strict=True)


def _solve(lengths: dict[int, tuple[int, int]]):
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group, so a group is a run that may cross batches."""
        group: list[tuple] = []

        def out() -> Iterator[pa.RecordBatch]:
            found = matches([g[5] for g in group], [g[6] for g in group], lengths[group[0][0]][0]) if len(group) > 1 else []
            rows = [(g[0], g[2], g[3], g[4] - b, g[4] + a) for g, spans in zip(group, found, strict=False) if g[7] == 1 for b, a in set(spans)]
            if rows:
                yield _batch(_SPANS, rows)

        for batch in batches:
            for row in _rows(batch, _OPEN):
                if group and group[0][1] != row[1]:
                    yield from out()
                    group = []
                group.append(row)
        yield from out()

    return solve


def _halved(lengths: dict[int, tuple[int, int]]):
    def halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each context once for each half of its range of starts, in a group by the bytes that all windows of the half hold."""
        for batch in batches:
            rows = []
            for kind, gram, k1, k2, at, left, right, copies, low, high in _rows(batch, _OPEN):
                length, middle = lengths[kind][0], (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    if a <= b and len(left) >= a and len(right) >= length - b:
                        shared = blake2b(left[:a] + right[: length - b], digest_size=8, key=struct.pack("<qii", gram, a, b)).digest()
                        rows.append((kind, struct.unpack("<q", shared)[0], k1, k2, at, left, right, copies, a, b))
            if rows:
                yield _batch(_OPEN, rows)

    return halved


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text around each anchor; the left side is reversed."""
    for batch in batches:
        for text, anchors in zip(batch.column("text"), batch.column("anchors"), strict=True):
            raw, units, out = text.as_py(), None, []
            for a in anchors.as_py():
                if a["kind"] == WORDS and units is None:
                    units = as_units(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tobytes()
                data, at = raw if a["kind"] == BYTES else units, a["at"]
                out.append((a["kind"], a["gram"], a["block"], a["k1"], a["k2"], at, a["before"], data[at - a["before"] : at][::-1], data[at : at + a["reach"]], a["copies"]))
            yield _batch(_CONTEXTS, out)


def repeated_spans(rows: DataFrame, length: int = LENGTH, anchor_bytes: int = ANCHOR_BYTES, group_limit: int = GROUP_LIMIT, passage_words: int | None = None) -> DataFrame:
    """``kind, k1, k2, first, end`` of ranges covered by strings that also start elsewhere.

    Ranges may overlap; those of kind ``WORDS`` (only with ``passage_words``) count in the second form of
    the text. ``rows`` is the result of ``keyed``.
    """
    lengths = {BYTES: (length, min(anchor_bytes, length))}
    if passage_words:
        lengths[WORDS] = (UNIT * passage_words, UNIT * min(ANCHOR_WORDS, passage_words))
    anchors = written(rows.select("text", *KEYS).mapInArrow(_scan(lengths), _ANCHORS), "suffix-anchors")
    seen = anchors.groupBy("gram").agg(F.count("*").alias("n"), F.min("block").alias("low"), F.max("block").alias("high"))
    # Written, so that a hot anchor string meets one row and its side of the join can be split.
    shared = written(seen.where("n > 1").select("gram", (F.col("low") != F.col("high")).alias("mixed")), "suffix-strings")
    found = written(anchors.join(shared, "gram"), "suffix-shared")
    blocks = found.groupBy("gram", "block").agg(F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("kind", "k1", "k2", "at", "before", "reach", "mixed")))
    blocks = written(blocks, "suffix-blocks")
    whole = found.join(blocks.where("copies > 1").select("gram", "block"), ["gram", "block"])
    whole = whole.select("kind", *KEYS, (F.col("at") - F.col("before")).alias("first"), (F.col("at") + F.col("reach")).alias("end"))

    members = blocks.where("mixed").select("kind", "gram", "block", *KEYS, "at", "before", "reach", "copies")
    wanted = members.groupBy(*KEYS).agg(F.collect_list(F.struct(*members.columns)).alias("anchors"))
    texts = rows.select("text", *KEYS).join(wanted, list(KEYS)).dropDuplicates(list(KEYS)).select("text", *KEYS, "anchors")
    contexts = written(texts.mapInArrow(_cut, _CONTEXTS), "suffix-contexts")
    # A group stands for all starts from the anchor itself to where the string ends with the anchor's bytes.
    most = F.create_map(*(F.lit(x) for kind, (n, k) in lengths.items() for x in (kind, n - k)))
    names = [c.split()[0] for c in _OPEN.split(", ")]
    waiting = contexts.withColumns({"low": F.lit(0), "high": most[F.col("kind")]}).select(*names)
    out = [whole]
    while True:
        sizes = waiting.groupBy("gram").count()
        large = written(sizes.where(F.col("count") > group_limit).select("gram"), "suffix-large")
        usual = waiting.join(large, "gram", "left_anti").select(*names)
        out.append(usual.repartition("gram").sortWithinPartitions("gram").mapInArrow(_solve(lengths), _SPANS))
        if large.isEmpty():
            break
        rest = written(waiting.join(large, "gram", "left_semi").select(*names), "suffix-rest")
        # A range of one start: all members of the group hold one window.
        single = rest.where("low = high")
        size = F.create_map(*(F.lit(x) for kind, (n, _) in lengths.items() for x in (kind, n)))[F.col("kind")]
        out.append(single.where("copies = 1").select("kind", *KEYS, (F.col("at") - F.col("low")).alias("first"), (F.col("at") - F.col("low") + size).alias("end")))
        waiting = written(rest.where("low < high").mapInArrow(_halved(lengths), _OPEN), "suffix-halves")
    return reduce(DataFrame.unionByName, out)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [tuple(s) for s in out]


def _of_kind(found: list[dict], kind: int) -> list[tuple[int, int]]:
    return _merged([(s["first"], s["end"]) for s in found if s["kind"] == kind])


def _in_words(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word numbers of ranges of the second form. A hash that is met by chance is no word's part."""
    return [(-(-first // UNIT), end // UNIT) for first, end in spans]


def _removal(remove_passages: bool):
    def removal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            others = [c for c in batch.schema.names if c not in ("text", "found")]
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                kept, spans, passages = [], [], []
                for data, found in zip(part.column("text").to_pylist(), part.column("found").to_pylist(), strict=True):
                    runs, repeated = _of_kind(found or [], BYTES), _in_words(_of_kind(found or [], WORDS))
                    if remove_passages and repeated:
                        start, end, _ = words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
                        runs = _merged(runs + [(int(start[a]), int(end[b - 1])) for a, b in repeated])
                    at, pieces = 0, []
                    for first, end in runs:
                        pieces.append(data[at:first])
                        at = end
                    pieces.append(data[at:])
                    kept.append(b"".join(pieces))
                    spans.append([{"first": a, "end": b} for a, b in runs])
                    passages.append([{"first": a, "end": b} for a, b in repeated])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(kept, pa.binary()), pa.array(spans, ranges), pa.array(passages, ranges)], names=[*others, "kept", "spans", "passages"])

    return removal


def deduplicate(docs: DataFrame, length: int = LENGTH, passage_words: int | None = None, remove_passages: bool = False, **options: int) -> DataFrame:
    """``docs`` with ``kept`` (the remaining bytes), ``spans`` (maximal removed runs, in bytes) and ``passages``
    (maximal runs of words that lie in repeated passages of ``passage_words`` words) in place of ``text``.

    Passages are removed too if asked for: from the first byte of their first word to the last of their last.
    """
    ranges = "array<struct<first: long, end: long>>"
    found = repeated_spans(keyed(docs), length, passage_words=passage_words, **options)
    # A document's ranges are no more than its anchors and their partners' splits, so one row holds them.
    found = written(found.distinct().groupBy(*KEYS).agg(F.collect_list(F.struct("kind", "first", "end")).alias("found")), "suffix-spans")
    others = [c for c in docs.columns if c != "text"]
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(*(F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(others)), text.cast("binary").alias("text"), F.xxhash64(text, "doc_id").alias("k1"), F.xxhash64(F.lit(1), "doc_id", text).alias("k2"))
    joined = own.join(found, list(KEYS), "left").drop(*KEYS)
    schema = ", ".join([*(f"own_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(others)), "kept binary", f"spans {ranges}", f"passages {ranges}"])
    out = joined.mapInArrow(_removal(remove_passages), schema)
    return out.select(*(F.col(f"own_{i}").alias(c) for i, c in enumerate(others)), "kept", "spans", "passages")


def _total(ranges: str) -> Column:
    return F.aggregate(ranges, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words`` of every document.

    The last column counts the words that lie in passages of ``PASSAGE_WORDS`` words that also stand
    elsewhere; such passages may be shorter than ``LENGTH`` bytes and are not removed here.
    """
    out = deduplicate(docs.select("doc_id", "text"), passage_words=PASSAGE_WORDS)
    return out.select(
        "doc_id",
        (F.octet_length("kept") + _total("spans")).cast("long").alias("n_bytes"),
        _total("spans").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        _total("passages").alias("n_passage_words"),
    )


def stage(docs: DataFrame, length: int = LENGTH, passage_words: int | None = PASSAGE_WORDS, **options: int) -> DataFrame:
    """Documents without repeated strings of ``length`` bytes and without repeated passages of ``passage_words`` words.

    A document that loses all its words goes. A character that a cut splits is dropped with the cut, as are
    replacement characters of a text that is cut. ``n_chars`` follows the new text.
    """
    named = docs.select(*(F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"in_{i}") for i, c in enumerate(docs.columns)))
    out = deduplicate(named, length, passage_words, True, **options)
    whole = F.col("kept").cast("string")
    text = F.when(F.size("spans") > 0, F.replace(F.make_valid_utf8(whole), F.lit("\ufffd"), F.lit(""))).otherwise(whole)
    kept = out.withColumn("new", text).where((F.size("spans") == 0) | F.col("new").rlike(r"[^\x20\x09-\x0D]"))
    columns = {"text": F.col("new"), "n_chars": F.char_length("new").cast("long"), "doc_id": F.col("doc_id")}
    return kept.select(*(columns.get(c, F.col(f"in_{i}")).alias(c) for i, c in enumerate(docs.columns)))
