"""Hard negatives of anchors by exact integer inner products, several candidates to a multiplication.

Kronecker packing: the components of a block's candidates are made non-negative by one bias, and
component d of all of them becomes one wide integer with a field for each candidate. An anchor's
component times that integer multiplies every field at once; the sum over the components holds all
inner products, each in its own field. Fields are as wide as the largest sum that an anchor of the block
can give, plus a bias that keeps negative sums from borrowing, so the scores that are unpacked are exact.

Positives come first: an anchor meets the blocks of its own label only. Then it meets the blocks of all
rows, with the score windows of its positives; each block gives the few best rows of each window. Blocks
hold a fixed number of rows, whatever the label; a row is moved once for each ``ANCHOR_BLOCK`` anchors,
with which it is multiplied then.

Defined results: rows with a null id, a null label, a null vector, or a null or non-finite component take
no part; vectors of other dimensions than the anchor's are not compared with it; rows that repeat id, label
and vector count once, rows that share the id alone are rows of their own, and no row of the anchor's own
id is its positive or its negative; components beyond a long are cut to the nearest long, and so are
scores, before they are compared; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cropwind.sources.paths import written

POSITIVES = 5
NEGATIVES = 10
#: A negative's score lies between these percentages of the positive's.
LOW_PERCENT, HIGH_PERCENT = 30, 90
SCALE = 256
LABELS = 10
FLIP_EVERY = 7
ANCHOR_EVERY = 100
#: Candidates of one block, which are packed together, and anchors that meet it at once.
BLOCK_ROWS = 8_192
ANCHOR_BLOCK = 8_192
#: Scores beyond a long become the nearest one, even on either side of 0.
LONG = np.iinfo(np.int64).max


def usable(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, v`` (integer components) of the rows that take part, repeats once."""
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("vector"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    rows = rows.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    flipped = F.when(F.col("vec_id") % FLIP_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return rows.select("vec_id", flipped.alias("label"), F.transform("vector", lambda x: F.floor(scale * x)).alias("v")).distinct()


class Packed:
    """Candidates' components in wide integers; ``scores`` gives all inner products with one anchor."""

    def __init__(self, candidates: np.ndarray, largest_anchor: int):
        """``candidates`` is a matrix, a row each; ``largest_anchor`` bounds the sum of an anchor's absolute components."""
        self.n, dimension = candidates.shape
        self.bias = max(abs(int(candidates.max())), abs(int(candidates.min()))) if candidates.size else 0
        # Sums of biased components lie within this bound on either side of 0.
        self.room = 2 * self.bias * largest_anchor
        bits = (2 * self.room).bit_length()
        self.width = 4 if bits <= 32 else 8 if bits <= 62 else -(-bits // 8)
        self.fields = [self._packed(candidates[:, d]) for d in range(dimension)]
        self.ones = self.room * int.from_bytes((1).to_bytes(self.width, "little") * self.n, "little")

    def _packed(self, column: np.ndarray) -> int:
        if self.width <= 8:
            data = (column + self.bias).astype(f"<u{self.width}").tobytes()
        else:
            data = b"".join((x + self.bias).to_bytes(self.width, "little") for x in column.tolist())
        return int.from_bytes(data, "little")

    def scores(self, anchor: list[int]) -> np.ndarray:
        """Inner products with every candidate."""
        total = sum(map(mul, anchor, self.fields)) + self.ones
        data = total.to_bytes(self.width * self.n, "little")
        shift = self.room + self.bias * sum(anchor)
        if self.width <= 8:
            return np.frombuffer(data, f"<u{self.width}").astype(np.int64) - shift
        wide = (int.from_bytes(data[i : i + self.width], "little") - shift for i in range(0, len(data), self.width))
        return np.fromiter((max(-LONG, min(LONG, x)) for x in wide), np.int64, self.n)


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` by score from the highest, ties by the smaller id."""
    some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) > k else np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return np.asarray(column.flatten(), np.int64).reshape(len(column), -1)


def _limits(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and the greatest whole score within the percentages of ``score``."""
    return -(-low * score // 100), high * score // 100


_POSITIVE = "anchor long, own_label long, a array<long>, score long, positive_id long"
_NEGATIVE = "anchor long, own long, place int, positive_id long, positive_score long, score long, negative_id long"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}


def _in_blocks(solve: Callable[..., Iterator[tuple]], schema: str):
    """Scores every anchor of a group against the group's candidates."""
    fields = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in schema.split(", ")])

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if len(asked) and len(held):
            candidates, ids, labels = _matrix(held.column("v")), held.column("vec_id").to_numpy(), held.column("label").to_numpy()
            anchors = asked.to_pylist()
            packed = Packed(candidates, max(sum(map(abs, a["a"])) for a in anchors))
            for a in anchors:
                rows.extend(solve(a, packed.scores(a["a"]), ids, labels))
        columns = zip(*rows, strict=True) if rows else [()] * len(fields)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    return run


def _positives(k: int):
    def solve(anchor: dict, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> Iterator[tuple]:
        others = np.flatnonzero(ids != anchor["anchor"])
        for j in others[first(scores[others], ids[others], k)].tolist():
            yield anchor["anchor"], anchor["own_label"], anchor["a"], int(scores[j]), int(ids[j])

    return solve


def _negatives(k: int, low: int, high: int):
    def solve(anchor: dict, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> Iterator[tuple]:
        windows = [(p, *_limits(p["score"], low, high)) for p in anchor["positives"]]
        windows = [w for w in windows if w[1] <= w[2]]
        if not windows:
            return
        least, most = min(w[1] for w in windows), max(w[2] for w in windows)
        near = np.flatnonzero((labels != anchor["own_label"]) & (ids != anchor["anchor"]) & (scores >= least) & (scores <= most))
        near = near[np.lexsort((ids[near], -scores[near]))]
        falling = -scores[near]
        for p, lowest, highest in windows:
            begin, end = np.searchsorted(falling, -highest), np.searchsorted(falling, -lowest, side="right")
            for j in near[begin : min(end, begin + k)].tolist():
                yield anchor["anchor"], anchor["own"], p["place"], p["positive_id"], p["score"], int(scores[j]), int(ids[j])

    return solve


def _meeting(asked: DataFrame, held: DataFrame, keys: list[str]):
    """Both sides by block; they come from one table, so one side's columns are made anew."""
    return asked.toDF(*asked.columns).groupBy(*keys).cogroup(held.groupBy(*keys))


def mine(
    embeddings: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW_PERCENT, high: int = HIGH_PERCENT,
    block_rows: int = BLOCK_ROWS, anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is a condition on ``vec_id`` and ``label``.
    """
    rows = written(usable(embeddings).withColumn("dimension", F.size("v")), "negatives-rows")
    # The anchor's row among those of its id, by hash of what it holds.
    own = F.xxhash64("vec_id", "label", "v")
    anchors = rows.where(is_anchor).select("dimension", F.col("vec_id").alias("anchor"), F.col("label").alias("own_label"), F.col("v").alias("a"), own.alias("own"))
    # A hot label is dealt to as many blocks as its rows need.
    sizes = written(rows.groupBy("dimension", "label").agg(F.count("*").alias("n")), "negatives-labels")
    blocks = F.ceil(F.col("n") / block_rows).cast("int")
    spread = lambda n, *c: F.pmod(F.xxhash64(*c), n).cast("int")
    asking = anchors.groupBy("dimension", F.col("own_label").alias("label")).agg(F.ceil(F.count("*") / anchor_block).cast("int").alias("parts"))
    sizes = sizes.join(asking, ["dimension", "label"]).select("dimension", "label", blocks.alias("blocks"), "parts")
    keys = ["dimension", "label", "block", "part"]
    held = rows.join(sizes, ["dimension", "label"]).withColumn("block", spread(F.col("blocks"), "vec_id", "v"))
    held = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*keys, "vec_id", "v")
    asked = anchors.join(sizes.withColumnRenamed("label", "own_label"), ["dimension", "own_label"]).withColumn("part", spread(F.col("parts"), "own"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("label", F.col("own_label")).select(*keys, "anchor", "own_label", "a")
    found = _meeting(asked, held, keys).applyInArrow(_in_blocks(_positives(positives), _POSITIVE), _POSITIVE)
    place = F.row_number().over(Window.partitionBy("anchor", "own_label", "a").orderBy(F.desc("score"), "positive_id"))
    best = found.withColumn("place", place).where(F.col("place") <= positives)
    listed = best.groupBy("anchor", "own_label", "a").agg(F.sort_array(F.collect_list(F.struct("place", "score", "positive_id"))).alias("positives"))
    listed = written(listed.select(F.size("a").alias("dimension"), "anchor", "own_label", "a", F.xxhash64("anchor", "own_label", "a").alias("own"), "positives"), "negatives-positives")

    total, asking = rows.count(), listed.count()
    n_blocks, n_parts = max(1, -(-total // block_rows)), max(1, -(-asking // anchor_block))
    keys = ["dimension", "block", "part"]
    held = rows.withColumn("block", spread(F.lit(n_blocks), "vec_id", "v")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1)))).select(*keys, "vec_id", "label", "v")
    asked = listed.withColumn("part", spread(F.lit(n_parts), "own")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    found = _meeting(asked, held, keys).applyInArrow(_in_blocks(_negatives(negatives, low, high), _NEGATIVE), _NEGATIVE)
    # Each block gave ``negatives`` rows a window at most.
    rank = F.row_number().over(Window.partitionBy("anchor", "own", "place").orderBy(F.desc("score"), "negative_id"))
    ranked = found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= negatives)
    return ranked.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))


SQL = """
WITH rows AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, a.label AS own_label, a.v, b.vec_id AS id, b.label, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, own_label, v, id AS positive_id, score AS positive_score FROM pairs WHERE label = own_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id, own_label, v ORDER BY score DESC, id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.positive_id, n.id AS negative_id, p.positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.own_label, p.v, p.positive_id, p.positive_score ORDER BY n.score DESC, n.id)::INT AS rank
  FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND p.own_label = n.own_label AND p.v = n.v
  WHERE n.label <> n.own_label AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""
