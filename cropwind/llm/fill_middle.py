"""Fill-in-middle transformation of texts, cut between lines that are found in SWAR words.

A text's units are its lines, each with its line feed. The UTF-8 bytes of a run of texts are viewed as
unsigned 64-bit words; arithmetic on whole words marks each line feed, and likewise each byte that
continues a character. Marks are counted a word at a time and summed up, so that a rank (marks before a
byte) is one lookup and a partial word, and a select (place of the k-th mark) is a binary search over
the sums for the word and a walk over that word's marks. Nothing is done byte by byte, and cuts and
character counts of all texts of a run come from the same few arrays.

Two cuts of each text, from hashes of the seed and the id, part it into prefix, middle and suffix. They
are put together as prefix, suffix, middle (psm) or suffix, prefix, middle (spm) behind markers; a text
that is empty, holds a marker or is not drawn stays as it is (plain).

Defined results: a null text counts as empty (plain, 0 units); a null id is hashed as an empty number, so
rows with one id are cut by the same draws; rows are independent, so repeats give equal results; a text
of any length is cut as a whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropwind.llm.grams import slices

SEED = 7
#: Shares in percent: texts that are transformed, and of these the ones with the suffix first.
RATE = 100
SUFFIX_FIRST = 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = "<[PSM]>"
DRAWS = ("h1", "h2", "h3", "h4")

_ONES = np.uint64(0x0101010101010101)
_LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
_FEEDS = np.uint64(0x0A) * _ONES
_SEVEN, _SIX = np.uint64(7), np.uint64(6)


def as_words(data: np.ndarray) -> np.ndarray:
    """Bytes as little-endian 64-bit words, the last one filled up with zeros."""
    padded = np.zeros(-(-len(data) // 8) * 8, np.uint8)
    padded[: len(data)] = data
    return padded.view("<u8")


def line_feeds(words: np.ndarray) -> np.ndarray:
    """Bit 7 of each byte that is a line feed: a byte is zero after the exclusive or, and no carry leaves a byte."""
    apart = words ^ _FEEDS
    return ~(((apart & _LOW) + _LOW) | apart | _LOW)


def continuations(words: np.ndarray) -> np.ndarray:
    """Bit 0 of each byte ``10xxxxxx``, which does not begin a character."""
    return (words >> _SEVEN) & ~(words >> _SIX) & _ONES


class Marks:
    """Rank and select over marked bytes, one mark bit a byte."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.sums = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(np.bitwise_count(marks), out=self.sums[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks in the bytes before each place."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        below = (np.uint64(1) << (byte << np.uint64(3))) - np.uint64(1)
        partial = np.append(self.marks, np.uint64(0))[word] & below
        return self.sums[word] + np.bitwise_count(partial)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte of the k-th mark, counted from 0."""
        word = np.searchsorted(self.sums, k, side="right") - 1
        left, rest = k - self.sums[word], self.marks[word]
        for _ in range(7):
            # The lowest mark of a word goes while there are marks to pass.
            rest = np.where(left > 0, rest & (rest - np.uint64(1)), rest)
            left = left - 1
        lowest = rest & (~rest + np.uint64(1))
        return (word << 3) + (np.bitwise_count(lowest - np.uint64(1)) >> 3)


def cut(data: np.ndarray, offsets: np.ndarray, draws: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Units of each text, the bytes at which its prefix and its middle end, and the characters of the two."""
    start, end = offsets[:-1], offsets[1:]
    words = as_words(data)
    feeds = Marks(line_feeds(words))
    before = feeds.rank(start)
    found = feeds.rank(end) - before
    open_end = (end > start) & (data[np.maximum(end - 1, 0)] != 10) if len(data) else np.zeros(len(start), bool)
    n = found + open_end
    low, high = (np.sort(np.stack([(h % (n + 1).astype(np.uint64)).astype(np.int64) for h in draws]), axis=0))

    def ends(units: np.ndarray) -> np.ndarray:
        """The byte after so many units; a last unit without a line feed ends with the text."""
        out = np.where(units > 0, end, start)
        inside = (units > 0) & (units <= found)
        out[inside] = feeds.select((before + units - 1)[inside]) + 1
        return out

    first, second = ends(low), ends(high)
    rest = Marks(continuations(words))
    counts = [rest.rank(x) for x in (start, first, second)]
    return n, first, second, first - start - (counts[1] - counts[0]), second - first - (counts[2] - counts[1])


def _drawn(seed: int) -> list[Column]:
    """Four 32-bit numbers from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(h) for i, h in enumerate(DRAWS)]


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row.

    ``rate`` and ``suffix_first`` are shares in percent; the two lengths are null for plain texts.
    """
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    psm, spm = ([m.encode() for m in order] for order in ((PREFIX, SUFFIX, MIDDLE), (SUFFIX, PREFIX, MIDDLE)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            held = pc.match_substring_regex(texts, MARKERS).to_numpy(zero_copy_only=False)
            h1, h2, h3, h4 = (batch.column(h).to_numpy().astype(np.uint64) for h in DRAWS)
            for lo, hi, data, offsets in slices(texts):
                n, first, second, prefix, middle = cut(data, offsets, (h1[lo:hi], h2[lo:hi]))
                plain = (np.diff(offsets) == 0) | held[lo:hi] | (h3[lo:hi] % 100 >= rate)
                spm_form = h4[lo:hi] % 100 < suffix_first
                raw, out = data.tobytes(), []
                for a, b, c, d, same, turned in zip(offsets.tolist(), first.tolist(), second.tolist(), offsets[1:].tolist(), plain.tolist(), spm_form.tolist(), strict=False):
                    if same:
                        out.append(raw[a:d])
                    elif turned:
                        out.append(b"".join((spm[0], raw[c:d], spm[1], raw[a:b], spm[2], raw[b:c])))
                    else:
                        out.append(b"".join((psm[0], raw[a:b], psm[1], raw[c:d], psm[2], raw[b:c])))
                form = np.where(plain, "plain", np.where(spm_form, "spm", "psm"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
                    names=[c.split()[0] for c in schema.split(", ")],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.select("doc_id", "text", *_drawn(seed)).mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text again, from what was written and its form alone: no transformed text holds a marker of its own."""
    parts = F.split(output, MARKERS, -1)
    one, two, three = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(output)


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` of every document."""
    out = transform(docs)
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    again = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(again).alias("restored_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS hash
  FROM documents
), drawn AS (
  SELECT *, len(units) AS n, ('0x' || hash[1:8])::BIGINT % (len(units) + 1) AS a, ('0x' || hash[9:16])::BIGINT % (len(units) + 1) AS b,
         CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR ('0x' || hash[17:24])::BIGINT % 100 >= 100 THEN 'plain'
              WHEN ('0x' || hash[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM lines
), parts AS (
  SELECT *, coalesce(array_to_string(units[:least(a, b)], ''), '') AS prefix,
         coalesce(array_to_string(units[least(a, b) + 1:greatest(a, b)], ''), '') AS middle,
         coalesce(array_to_string(units[greatest(a, b) + 1:], ''), '') AS suffix
  FROM drawn
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
