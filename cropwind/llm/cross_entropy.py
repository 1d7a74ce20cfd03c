"""Cross-entropy difference of documents under a target and a background n-gram model.

Tokens are the characters of a text. Both models are interpolated trigram models over one vocabulary,
all characters of the background, with equal weights and counts from all target documents and all
documents. A document's score is the mean over its tokens of the loss under the target less the loss
under the background: below 0 for text that is closer to the target.

Counting: each task sums the trigrams of its texts, so what is shuffled is one row a distinct trigram
and task. A trigram's two lower orders are sums over its neighbours, found by equi-joins. Scoring:
documents are cut into blocks where the join with the labels has put them; a block asks only for its own distinct trigrams, gets their
loss differences by one join, and scores its documents with them. Nothing is broadcast, and no table
is held whole anywhere.

Defined results: a null or empty text has no tokens and a null score; documents without a label are
scored like others; without target documents every score is null; a null id is kept; repeated rows
count and are scored each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropwind.sources.paths import written

#: Weights of the trigram, bigram, unigram and uniform estimates.
MIX = (0.6, 0.25, 0.13, 0.02)
#: Bits of a code point; three of them make a key.
BITS = 21
#: Characters of text that make one block.
BLOCK_CHARS = 4_000_000
START = 0x10FFFF + 1


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens with the two before them, and the end of each text in them.

    A text begins with two start marks, so it has as many trigrams as characters.
    """
    joined = "".join(t or "" for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ends = np.cumsum([len(t or "") for t in texts])
    one, two = np.full(len(codes), START), np.full(len(codes), START)
    one[1:], two[2:] = codes[:-1], codes[:-2]
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
    first = starts[starts < ends]
    one[first] = START
    two[first] = START
    second = first + 1
    two[second[second < len(codes)]] = START
    return (two << (2 * BITS)) | (one << BITS) | codes, ends


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of a task's batches, in all texts and in target texts."""
    keys, alls, targets = [], [], []
    size = 0

    def summed():
        k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        n = len(k)
        return k, np.bincount(inverse, np.concatenate(alls), n).astype(np.int64), np.bincount(inverse, np.concatenate(targets), n).astype(np.int64)

    for batch in batches:
        for lo in range(0, len(batch), 500):
            part = batch.slice(lo, 500)
            key, ends = trigrams(part.column("text").to_pylist())
            wanted = np.repeat(np.asarray(part.column("target").to_pylist(), bool), np.diff(ends, prepend=0))
            k, inverse = np.unique(key, return_inverse=True)
            keys.append(k)
            alls.append(np.bincount(inverse, minlength=len(k)))
            targets.append(np.bincount(inverse, wanted, len(k)))
            size += len(k)
            if size > 2_000_000:
                k, a, t = summed()
                keys, alls, targets, size = [k], [a], [t], 0
    if keys:
        k, a, t = summed()
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(a), pa.array(t)], names=["gram", "background", "target"])


def model(docs: DataFrame) -> DataFrame:
    """``gram, difference``: loss of its last token under the target less that under the background.

    ``docs`` has ``text`` and a boolean ``target``.
    """
    counted = docs.select("text", F.coalesce("target", F.lit(False)).alias("target")).mapInArrow(_count, "gram long, background long, target long")
    three = written(counted.groupBy("gram").agg(F.sum("background").alias("background"), F.sum("target").alias("target")), "entropy-trigrams")
    mask, pair = (1 << BITS) - 1, (1 << (2 * BITS)) - 1

    def sums(keys: dict[str, Column], name: str) -> DataFrame:
        out = three.groupBy(*(c.alias(n) for n, c in keys.items())).agg(F.sum("background").alias(f"b_{name}"), F.sum("target").alias(f"t_{name}"))
        return written(out, f"entropy-{name}")

    gram = F.col("gram")
    last_two, last = gram.bitwiseAND(F.lit(pair)), gram.bitwiseAND(F.lit(mask))
    middle = F.shiftright(last_two, BITS)
    context = sums({"before": F.shiftright(gram, BITS)}, "context")
    bigram = sums({"last_two": last_two}, "bigram")
    single = sums({"middle": middle}, "middle")
    unigram = sums({"last": last}, "unigram")
    # One row: the two corpora's sizes and the shared vocabulary's.
    total = unigram.agg(F.sum("b_unigram"), F.sum("t_unigram"), F.count("*")).first()
    n_b, n_t, vocabulary = (total[0] or 0, total[1] or 0, total[2])
    rows = three.select("gram", "background", "target", F.shiftright(gram, BITS).alias("before"), last_two.alias("last_two"), middle.alias("middle"), last.alias("last"))
    rows = rows.join(context, "before").join(bigram, "last_two").join(single, "middle").join(unigram, "last")

    def loss(three: str, x: str, n: int) -> Column:
        ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
        p = MIX[0] * ratio(three, f"{x}_context") + MIX[1] * ratio(f"{x}_bigram", f"{x}_middle") + MIX[2] * F.col(f"{x}_unigram") / F.lit(float(max(n, 1))) + MIX[3] / max(vocabulary, 1)
        return -F.log2(p)

    difference = loss("target", "t", n_t) - loss("background", "b", n_b) if n_t else F.lit(None).cast("double")
    return written(rows.select("gram", difference.alias("difference")), "entropy-model")


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows with the number of their block; the result is stored at once, so the numbers hold."""
    block, chars = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        sizes = pc.utf8_length(batch.column("text")).to_numpy()
        place = chars + np.cumsum(sizes)
        chars = int(place[-1]) if len(place) else chars
        yield pa.RecordBatch.from_arrays([pa.array(block + place // BLOCK_CHARS), *batch.columns], names=["block", *batch.schema.names])


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct trigrams of each block; a block's rows may come in several runs."""
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        texts = batch.column("text").to_pylist()
        cuts = np.flatnonzero(np.diff(blocks)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True):
            if hi > lo:
                key = np.unique(trigrams(texts[lo:hi])[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), blocks[lo])), pa.array(key)], names=["block", "gram"])


def _score(key, docs: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame({"doc_id": docs["doc_id"].astype("Int64"), "n_tokens": pd.Series(0, docs.index, dtype="int64"), "score": pd.Series(np.nan, docs.index)})
    if not len(docs):
        return out
    grams = table["gram"].to_numpy()
    order = np.argsort(grams)
    grams, difference = grams[order], table["difference"].to_numpy(dtype=float, na_value=np.nan)[order]
    sums, counts = [], []
    texts = docs["text"].tolist()
    for lo in range(0, len(texts), 500):
        keys, ends = trigrams(texts[lo : lo + 500])
        found = difference[np.searchsorted(grams, keys)] if len(keys) else np.zeros(0)
        at = 0
        for end in ends.tolist():
            sums.append(math.fsum(found[at:end]) if end > at and not np.isnan(found[at]) else math.nan)
            counts.append(end - at)
            at = end
    counts = np.array(counts, np.int64)
    out["n_tokens"] = counts
    out["score"] = np.array(sums) / np.maximum(counts, 1)
    return out


def score(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, score`` of every document; ``target`` has the ``doc_id`` of target documents."""
    chosen = target.select(F.col("doc_id").alias("target_id")).where("target_id IS NOT NULL").distinct()
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # The same join at every size: texts move once here, and once to meet their block's trigrams.
    marked = marked.join(chosen.hint("merge"), F.col("doc_id") == F.col("target_id"), "left")
    marked = marked.select("doc_id", "text", F.col("target_id").isNotNull().alias("target"))
    dealt = written(marked.mapInArrow(_deal, "block long, doc_id long, text string, target boolean"), "entropy-documents")
    differences = model(dealt)
    asked = dealt.select("block", "text").mapInArrow(_distinct, "block long, gram long").distinct()
    known = asked.join(differences, "gram").select("block", "gram", "difference")
    texts = dealt.select("block", "doc_id", "text")
    out = texts.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(_score, "doc_id long, n_tokens long, score double")
    return out.select("doc_id", "n_tokens", F.when(~F.isnan("score") & (F.col("n_tokens") > 0), F.col("score")).alias("score"))
