"""Exact Jaccard join of word-shingle sets, with set-relation skipping.

Sets are the distinct 3-word shingles of a text. Two sets link when
``100 * |intersection| >= threshold * |union|``, which equals a bound on the number of differing
elements: ``(100 + t) * |difference| <= (100 - t) * (|x| + |y|)``.

* Equal sets are one class from the start, however many copies there are.
* Elements are ordered by part of their hash range, and within the first part from rare to common (a
  fixed-size count sketch over all documents gives the order; any order is right, a rare one is fast). Sets that link share an element of their prefixes.
* *Answers from related sets*: every prefix list compares its members with one leader only, the one
  at the earliest position: an original, as its edited copies have elements of their own first. A member that links takes over the leader's component, and with it all
  links inside the component; only members of lists that still hold several components go on. Their answers
  are derived from the leader's: the exact differences x and y from the leader are known, so two members
  differ by |x - y| at least and x + y at most. Pairs that this rules out are skipped, pairs that it
  settles link without a comparison, and only what lies between is compared.
* *Block skipping*: those lists are kept in blocks of equal position. For the first element that two
  sets share, the positions add up to no more than their difference, so a set at position i skips
  every block beyond its bound. Size and a 1,024-bit parity signature, whose distance never exceeds the
  difference, drop the rest; what is left is compared exactly.
* A list of more than ``list_limit`` sets is dealt to tasks as pairs of chunks, so no task holds more
  than two chunks. Nothing is capped.

Defined results: a text without words, or a null, has size 0, links with nothing and is its own
component; with fewer than three words the whole sequence is the one shingle. Rows with one id keep
one row each. A null id takes part in links; a component's id is the smallest one that is not null.
Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropwind.llm.graph import components
from cropwind.llm.grams import mixed, shingle_sets
from cropwind.sources.paths import written

SHINGLE_WORDS = 3
THRESHOLD = 90
#: Elements are ordered by their top bits first, so that prefixes lie almost wholly in the first part
#: (an eighth of all elements), and only there by rarity: only that part is counted.
PART_BITS = 3
#: Cells of the count sketch that orders the first part: a fixed size at any scale.
SKETCH_BITS = 20
FIRST_PART = np.uint64(1 << (64 - PART_BITS))
#: Sets of one prefix list that a task holds in one chunk.
LIST_LIMIT = 4000
#: 64-bit words of a set's parity signature. A larger set has a wide one besides, doubled until
#: there are no more than so many elements for each 16 words.
SIGNATURE_WORDS = 16
SIGNATURE_ELEMENTS = 1000
#: A list of documents up to this size is sent to every executor; a larger one is joined by shuffle.
BROADCAST_BYTES = 8 << 20
PLACE_BYTES = 64


def _cell(elements: np.ndarray) -> np.ndarray:
    return (elements >> np.uint64(64 - PART_BITS - SKETCH_BITS)).astype(np.int64)


def _count_cells(words: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for s in shingle_sets(batch.column("text"), words):
                np.add.at(cells, _cell(s[: np.searchsorted(s, FIRST_PART)]), 1)
        used = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(cells[used])], names=["cell", "n"])

    return count


def rarity(docs: DataFrame, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Level of each sketch cell, 0 for the most: one byte a cell, 1 MB whatever the input."""
    counts = docs.select("text").mapInArrow(_count_cells(words), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    level = np.zeros(1 << SKETCH_BITS, np.uint64)
    # Columns as they are, five bytes a cell: no Python object for each of a million rows.
    rows = counts.select(F.col("cell").cast("int").alias("cell"), F.floor(F.log2("n") * 2).cast("byte").alias("level")).toArrow()
    level[rows.column("cell").to_numpy()] = rows.column("level").to_numpy()
    return level


def _signature(elements: np.ndarray) -> np.ndarray:
    """Parity of the elements on each bit. Halves put together by exclusive or give the narrower signature."""
    words = SIGNATURE_WORDS
    while words * SIGNATURE_ELEMENTS < len(elements) * SIGNATURE_WORDS:
        words *= 2
    bits = np.bincount((elements & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _prefixes(words: int, threshold: int, level: np.ndarray):
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sid, heads, signs, wides = [], [], [], [], []
            for s in shingle_sets(batch.column("text"), words):
                n.append(len(s))
                sid.append(int(mixed(np.array([np.add.reduce(s) ^ np.uint64(len(s))], np.uint64)).view(np.int64)[0]))
                need = -(-threshold * len(s) // 100)
                # The elements are sorted, so a stable sort by level orders the first part; the rest stays.
                first = int(np.searchsorted(s, FIRST_PART))
                order = np.concatenate((np.argsort(level[_cell(s[:first])], kind="stable"), np.arange(first, len(s))))
                heads.append(s[order[: len(s) - need + 1 if len(s) else 0]].view(np.int64))
                wide = _signature(s)
                wides.append(wide if len(wide) > SIGNATURE_WORDS else wide[:0])
                signs.append(np.bitwise_xor.reduce(wide.reshape(-1, SIGNATURE_WORDS), axis=0))
            at = np.concatenate(([0], np.cumsum([len(h) for h in heads]))).astype(np.int32)
            flat = np.concatenate(heads) if heads else np.zeros(0, np.int64)
            sign = np.concatenate(signs) if signs else np.zeros(0, np.int64)
            ends = np.arange(0, len(sign) + 1, SIGNATURE_WORDS, dtype=np.int32)
            wide_at = np.concatenate(([0], np.cumsum([len(w) for w in wides]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("copy"), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.ListArray.from_arrays(at, flat), pa.ListArray.from_arrays(ends, sign), pa.ListArray.from_arrays(wide_at, np.concatenate(wides or [flat[:0]]))],
                names=["doc_id", "copy", "n", "sid", "head", "sign", "wide"],
            )

    return prefixes


def _sets(words: int, others: tuple[str, ...]):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                found = [s.view(np.int64) for s in shingle_sets(part.column("text"), words)]
                at = np.concatenate(([0], np.cumsum([len(s) for s in found]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.ListArray.from_arrays(at, np.concatenate(found))], names=[*others, "elements"])

    return sets


def _linked(threshold: int):
    """Condition on ``n_a``, ``n_b`` and a lower bound of the difference."""
    return lambda difference: (100 + threshold) * difference <= (100 - threshold) * (F.col("n_a") + F.col("n_b"))


def _compared(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, threshold: int) -> DataFrame:
    """``a, b, apart, linked`` of the pairs of classes that no bound excludes: the exact difference of their sets."""
    # Sets that may link differ by a factor of two at most in the width of their signatures.
    whole = F.when(F.size("wide") > 0, F.col("wide")).otherwise(F.col("sign"))
    left, right = (classes.select(F.col("sid").alias(x), F.col("n").alias(f"n_{x}"), F.col("sign").alias(f"sign_{x}"), whole.alias(f"wide_{x}")) for x in "ab")
    close = pairs.join(left, "a").join(right, "b")
    apart = sum(F.bit_count(F.col("sign_a")[i].bitwiseXOR(F.col("sign_b")[i])) for i in range(SIGNATURE_WORDS))
    fits = _linked(threshold)
    width = F.least(F.size("wide_a"), F.size("wide_b"))

    def narrowed(x: str) -> Column:
        halves = F.zip_with(F.slice(x, 1, width), F.slice(x, width + 1, width), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > width, halves).otherwise(F.col(x))

    # After the size and the narrow signature have dropped most pairs.
    close = close.where(fits(F.abs(F.col("n_a") - F.col("n_b"))) & fits(apart)).withColumns({"x": narrowed("wide_a"), "y": narrowed("wide_b")})
    bits = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, c: s + c)
    close = written(close.where(fits(bits)).select("a", "b", "n_a", "n_b"), "jaccard-close")
    # The text of one document of each class gives its set; each pair's smaller side moves once, to its leader.
    places = classes.select("sid", "copy", "doc_id")
    texts = docs.select("text", F.xxhash64("text").alias("copy"), "doc_id")

    def elements(wanted: DataFrame, *others: str) -> DataFrame:
        wanted = written(wanted, "jaccard-wanted")
        small = F.broadcast(wanted) if wanted.count() * PLACE_BYTES <= BROADCAST_BYTES else wanted
        rows = texts.join(small, (texts["copy"] == small["copy"]) & texts["doc_id"].eqNullSafe(small["doc_id"])).select(*others, "text")
        return rows.mapInArrow(_sets(words, others), ", ".join(f"{c} long" for c in others) + ", elements array<long>")

    y = elements(close.join(places, close["b"] == places["sid"]).drop("sid"), "a", "b", "n_a", "n_b").withColumnRenamed("elements", "y")
    x = elements(close.select(F.col("a").alias("sid")).distinct().join(places, "sid"), "sid").withColumnsRenamed({"sid": "a", "elements": "x"})
    shared = F.size(F.array_intersect("x", "y"))
    rows = y.join(x, "a").withColumn("apart", F.col("n_a") + F.col("n_b") - 2 * shared)
    return rows.select("a", "b", "apart", fits(F.col("apart")).alias("linked")).distinct()


def _pairs_of(unit: dict[str, np.ndarray], threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of one unit (list, chunk, chunk) that the bounds do not exclude, and whether they settle that a pair links."""
    order = np.argsort(unit["position"], kind="stable")
    position, n, sid, component, lead, chunk, known = (unit[c][order] for c in ("position", "n", "sid", "component", "lead", "chunk", "known"))
    sign = unit["sign"][order]
    two_chunks = chunk.min() != chunk.max()
    starts = np.flatnonzero(np.concatenate(([True], position[1:] != position[:-1])))
    ends = np.concatenate((starts[1:], [len(position)]))
    most = n.max()
    out_a, out_b, out_sure = [], [], []
    for first, end in zip(starts.tolist(), ends.tolist(), strict=True):
        here = int(position[first])
        for i in range(first, end):
            room = (100 - threshold) * (n[i] + most) // (100 + threshold) - here
            stop = np.searchsorted(position, room, side="right")
            j = np.arange(i + 1, stop)
            if not len(j):
                continue
            bound = (100 - threshold) * (n[i] + n[j])
            keep = (component[j] != component[i]) & (sid[j] != lead[i]) & (sid[i] != lead[i])
            keep &= (100 + threshold) * np.maximum(here + position[j], np.abs(n[i] - n[j])) <= bound
            if two_chunks:
                keep &= chunk[j] != chunk[i]
            # From the leader's differences: -1 where they are not known.
            derived = (known[j] >= 0) & (known[i] >= 0)
            keep &= ~derived | ((100 + threshold) * np.abs(known[j] - known[i]) <= bound)
            sure = derived & ((100 + threshold) * (known[j] + known[i]) <= bound)
            j, bound, sure = j[keep], bound[keep], sure[keep]
            apart = np.bitwise_count(sign[j] ^ sign[i]).sum(axis=1, dtype=np.int64)
            near = (100 + threshold) * apart <= bound
            j = j[near]
            out_sure.append(sure[near])
            out_a.append(np.minimum(sid[i], sid[j]))
            out_b.append(np.maximum(sid[i], sid[j]))
    none = np.zeros(0, np.int64)
    return np.concatenate(out_a or [none]), np.concatenate(out_b or [none]), np.concatenate(out_sure or [none.astype(bool)])


def _skip_blocks(threshold: int):
    """The pairs of each unit, of which one or several come in a batch."""
    def skip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "unit", "position", "n", "sid", "component", "lead", "chunk", "known", "sign"]
        rest: pa.Table | None = None

        def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
            columns = {c: table.column(c).to_numpy() for c in names[:-1]}
            signs = table.column("sign").combine_chunks()
            # Unsigned, as numpy counts the bits of an absolute value.
            signs = np.asarray(signs.flatten()).view(np.uint64).reshape(-1, SIGNATURE_WORDS)
            change = (columns["token"][1:] != columns["token"][:-1]) | (columns["unit"][1:] != columns["unit"][:-1])
            cuts = np.concatenate(([0], np.flatnonzero(change) + 1, [len(change) + 1]))
            for first, end in zip(cuts[:-1], cuts[1:], strict=True):
                if end - first > 1:
                    found = _pairs_of({c: v[first:end] for c, v in columns.items()} | {"sign": signs[first:end]}, threshold)
                    if len(found[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["a", "b", "sure"])

        for batch in batches:
            if not len(batch):
                continue
            now = pa.Table.from_batches([batch])
            table = now if rest is None else pa.concat_tables([rest, now])
            token, unit = table.column("token").to_numpy(), table.column("unit").to_numpy()
            cut = int(np.flatnonzero((token != token[-1]) | (unit != unit[-1]))[-1]) + 1 if token[0] != token[-1] or unit[0] != unit[-1] else 0
            if cut:
                yield from solve(table.slice(0, cut))
            rest = table.slice(cut)
        if rest is not None:
            yield from solve(rest)

    return skip


def set_components(docs: DataFrame, words: int = SHINGLE_WORDS, threshold: int = THRESHOLD, list_limit: int = LIST_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(documents with their set, ``sid, component`` of the linked sets).

    The first has ``doc_id, copy, n, sid``: a hash of the text, the set's size and the set's number.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    level = rarity(docs, words)
    scan = docs.select("doc_id", F.xxhash64("text").alias("copy"), "text").mapInArrow(
        _prefixes(words, threshold, level.astype(np.uint8)), "doc_id long, copy long, n long, sid long, head array<long>, sign array<long>, wide array<long>"
    )
    own = written(scan, "jaccard-documents")
    classes = own.where("n > 0").groupBy("sid").agg(*(F.first(c).alias(c) for c in ("n", "copy", "doc_id", "head", "sign", "wide")))
    classes = written(classes, "jaccard-classes")
    postings = classes.select("sid", F.col("n").cast("int").alias("n"), F.posexplode("head").alias("position", "token"))
    # Written, so that a hot list meets one row and its side of the join can be split.
    common = written(postings.groupBy("token").count().where("count > 1").select("token"), "jaccard-tokens")
    found = written(postings.join(common, "token"), "jaccard-found")
    # The earliest position: an edited copy has its own elements before those that it shares.
    leads = found.groupBy("token").agg(F.min(F.struct("position", "sid", "n")).alias("best"), F.count("*").alias("members"))
    lists = written(leads.select("token", F.col("best.sid").alias("lead"), F.col("best.position").alias("lead_position"), F.col("best.n").alias("lead_n"), "members"), "jaccard-lists")
    shared = written(found.join(lists, "token"), "jaccard-postings")
    # At the first element that two sets share, their positions and sizes keep the bounds.
    apart = F.greatest(F.col("position") + F.col("lead_position"), F.abs(F.col("n") - F.col("lead_n")))
    near = shared.where((100 + threshold) * apart <= (100 - threshold) * (F.col("n") + F.col("lead_n")))

    led = near.where("sid <> lead").select(F.col("lead").alias("a"), F.col("sid").alias("b")).distinct()
    compared = written(_compared(docs, classes, led, words, threshold), "jaccard-first")
    first = compared.where("linked").select("a", "b")
    labels = components(first, "jaccard-first")

    named = shared.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    # What the leader has not linked may still link among itself.
    open_lists = named.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    chunks = F.ceil(F.col("members") / list_limit).cast("int")
    rest = named.join(open_lists, "token").where("members > 2").withColumn("chunk", F.pmod(F.xxhash64("sid"), chunks).cast("int"))
    rest = rest.join(classes.select("sid", "sign"), "sid").join(compared.select(F.col("a").alias("lead"), F.col("b").alias("sid"), "apart"), ["lead", "sid"], "left")
    rest = rest.withColumn("known", F.when(F.col("sid") == F.col("lead"), 0).otherwise(F.coalesce("apart", F.lit(-1))).cast("long"))
    units = rest.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    units = units.withColumn("unit", F.least("chunk", "other").cast("long") * 1_000_000 + F.greatest("chunk", "other"))
    units = units.select("token", "unit", F.col("position").cast("long").alias("position"), F.col("n").cast("long").alias("n"), "sid", "component", "lead", F.col("chunk").cast("long").alias("chunk"), "known", "sign")
    found = units.repartition("token", "unit").sortWithinPartitions("token", "unit").mapInArrow(_skip_blocks(threshold), "a long, b long, sure boolean")
    # A pair that one list leaves open may be settled by another one's leader.
    found = written(found.groupBy("a", "b").agg(F.max("sure").alias("sure")), "jaccard-rest")
    second = _compared(docs, classes, found.where("NOT sure").select("a", "b"), words, threshold).where("linked").select("a", "b")
    second = written(second.unionByName(found.where("sure").select("a", "b")), "jaccard-second")
    if second.isEmpty():
        return own, labels
    return own, components(first.unionByName(second), "jaccard-all")


def join(docs: DataFrame, words: int = SHINGLE_WORDS, threshold: int = THRESHOLD, list_limit: int = LIST_LIMIT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    own, labels = set_components(docs, words, threshold, list_limit)
    own = own.select("doc_id", "n", "sid")
    smallest = own.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("smallest"))
    smallest = smallest.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    heads = smallest.groupBy("component").agg(F.min("smallest").alias("component_id"))
    ids = written(smallest.join(heads, "component").select("sid", "component_id"), "jaccard-ids")
    alone = own.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return own.where("n > 0").join(ids, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


def stage(docs: DataFrame, words: int = SHINGLE_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each component: the one with the smallest id, one row of it.

    Documents without words are no duplicates and all stay.
    """
    named = docs.select(*(F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"in_{i}") for i, c in enumerate(docs.columns)))
    own, labels = set_components(named, words, threshold)
    sets = own.where("n > 0").join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    best = sets.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy")).alias("best"))
    kept = best.select(F.col("best.doc_id").alias("kept_id"), F.col("best.copy").alias("kept_copy")).distinct()
    kept = written(kept, "jaccard-kept")
    text = F.coalesce(F.col("text"), F.lit(""))
    worded = text.rlike(r"[^\x20\x09-\x0D]")
    rows = named.where(worded).withColumn("copy", F.xxhash64(text))
    rows = rows.join(kept, (F.col("copy") == F.col("kept_copy")) & F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    rows = rows.drop("copy").dropDuplicates(["doc_id", "text"]).unionByName(named.where(~worded))
    return rows.select(*(F.col(n).alias(c) for n, c in zip(named.columns, docs.columns, strict=True)))
