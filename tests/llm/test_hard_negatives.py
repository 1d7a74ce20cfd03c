from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cropwind.llm import hard_negatives as hn
WHOLE = "/root/testdata/sf0.001"


def by_hand(rows: list[tuple], anchor_every: int = 100) -> list[tuple]:
    """All results from Python's integers, row by row."""
    usable = set()
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        usable.add((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, tuple(math.floor(256.0 * x) for x in vector)))
    out = []
    for a in usable:
        if a[0] % anchor_every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2], strict=True)), b[0], b[1]) for b in usable if b[0] != a[0] and len(b[2]) == len(a[2]))
        for ps, pid, _ in [s for s in scored if s[2] == a[1]][:5]:
            near = [s for s in scored if s[2] != a[1] and 30 * -ps <= 100 * -s[0] <= 90 * -ps][:10]
            out.extend((a[0], pid, i + 1, s[1], -ps, -s[0]) for i, s in enumerate(near))
    return sorted(out)


def mined(df, **options) -> list[tuple]:
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in hn.mine(df, F.col("vec_id") % 100 == 0, **options).collect())


@pytest.mark.parametrize("options", [{}, {"block_rows": 40, "anchor_block": 2}])
def test_whole_table(spark, options):
    df = spark.read.parquet(f"{WHOLE}/embeddings.parquet")
    want = by_hand([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    assert want and mined(df, **options) == want


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 3) / 4], int(rng.integers(0, 3)), "x") for i in range(0, 420, 3)]
    rows += rows[:30] + [(100, [0.5, 0.5, 0.5], 1, "second row of an id"), (100, [0.25, 0.5, 0.5], 2, "third"), (200, [0.0, 0.0, 0.0], 1, "zero")]
    rows += [(None, [1.0, 1.0, 1.0], 1, "n"), (400, None, 1, "n"), (401, [1.0, None, 1.0], 1, "n"), (402, [1.0, math.nan, 1.0], 1, "n"), (403, [math.inf, 1.0, 1.0], 1, "n"), (404, [1.0, 1.0, 1.0], None, "n"), (500, [1.0, 1.0], 1, "other dimension"), (501, [1.0, 0.5], 1, ""), (502, [1.0, 0.25], 3, ""), (600, [], 1, ""), (601, [], 1, ""), (602, [], 2, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rank string").withColumn("score", F.lit(1))
    want = by_hand([r[:3] for r in rows])
    assert any(w[0] == 500 for w in want) and any(w[0] == 600 for w in want)
    assert mined(df) == want and mined(df, block_rows=7, anchor_block=1) == want
    assert mined(df.where("false")) == [] and mined(df.where("vec_id % 100 <> 0")) == [] and mined(df.where("label IS NULL")) == []


def test_large_components(spark):
    rows = [(i, [x, y], i % 2) for i, (x, y) in enumerate([(1e5, -3e4), (2e5, 1e5), (9e4, 7e3), (1.5e5, -1e5), (3e4, 2e4), (8e4, 9e3), (7e4, 1e4), (9e4, 0.0)])]
    rows = [(100 if i == 0 else i, v, l) for i, v, l in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert mined(df) == by_hand([r for r in rows])
    # Scores beyond a long become the nearest one.
    huge = spark.createDataFrame([(100, [1e300, 1.0], 1), (1, [1e300, 2.0], 1), (2, [1e-2, 0.0], 2), (3, [-1e300, 0.0], 2)], "vec_id long, embedding array<double>, label int")
    assert mined(huge) == [] and hn.mine(huge, F.col("vec_id") % 100 == 0, high=100).collect()[0].positive_score == hn.LONG


@pytest.mark.parametrize("size", [1, 5, 300, 40_000, 2**31, 2**40])
def test_packed_products_are_exact(size):
    rng = np.random.default_rng(size)
    m, anchors = rng.integers(-size, size + 1, (70, 9)), rng.integers(-size, size + 1, (6, 9))
    m[0], anchors[0] = size, -size
    packed = hn.Packed(m, max(int(abs(a).sum()) for a in anchors))
    for a in anchors.tolist():
        exact = [max(-hn.LONG, min(hn.LONG, sum(x * y for x, y in zip(a, row, strict=True)))) for row in m.tolist()]
        assert packed.scores(a).tolist() == exact


def test_hot_label_is_dealt_to_blocks(spark):
    rows = [(i, [((i * 37) % 101) / 100, ((i * 11) % 89) / 89], 1 if i % 10 else 2) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert mined(df, block_rows=100, anchor_block=4) == by_hand(rows)
