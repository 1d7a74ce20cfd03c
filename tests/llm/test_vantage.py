from __future__ import annotations

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cropwind.llm import queries, vantage

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=20, every=20):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = set()
    for i, q in {(i, tuple(v)) for i, v in good if i % every == 0}:
        found = sorted({(-float(vantage.scores(v[None], np.array(q))[0]), j) for j, v in good if j != i and len(v) == len(q)})[:k]
        out |= {(i, r, j, -s) for r, (s, j) in enumerate(found, 1)}
    return out


def made():
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) * (1 + i % 3) for _ in range(8)]) for i in range(600)]
    rows += [(i, rows[40][1]) for i in range(600, 700)] + [(700, None), (720, [0.0] * 8), (740, [1.0] * 7 + [None]), (760, [float("nan")] * 8), (780, [float("inf")] * 8), (None, [1.0] * 8), (800, [1.0] * 5), (801, [2.0] * 5)]
    return rows


def got(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    return vantage.neighbours(df, F.col("vec_id") % 20 == 0, **options)


def test_factor_one_is_exact_over_several_shards(spark):
    rows = made()
    assert {tuple(r) for r in got(spark, rows, shard_rows=150).collect()} == brute(rows)


def test_trees_of_many_levels_are_exact(spark, monkeypatch):
    monkeypatch.setattr(vantage, "LEAF", 4)
    points = np.random.default_rng(0).normal(size=(500, 6))
    points[100:200] = points[7]
    found, dist = vantage.Tree(points).search(points[:50], 10, 1.0)
    for i in range(50):
        d2 = ((points - points[i]) ** 2).sum(axis=1)
        limit = np.sort(d2)[9]
        assert set(np.flatnonzero(d2 < limit - 1e-9)) <= set(found[i].tolist())


def test_a_larger_factor_skips_and_keeps_recall(monkeypatch):
    monkeypatch.setattr(vantage, "LEAF", 16)
    g = np.random.default_rng(1)
    centres = g.normal(size=(20, 6)) * 4
    points = centres[g.integers(0, 20, 4000)] + g.normal(size=(4000, 6)) * 0.5
    exact, _ = vantage.Tree(points).search(points[:100], 10, 1.0)
    loose, _ = vantage.Tree(points).search(points[:100], 10, 1.5)
    recall = np.mean([len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist())) for a, b in zip(exact, loose)])
    assert recall >= 0.9


def clustered(n=4000, dimension=6):
    g = np.random.default_rng(1)
    centres = g.normal(size=(20, dimension)) * 4
    points = centres[g.integers(0, 20, n)] + g.normal(size=(n, dimension)) * 0.1
    # A third of all rows is one vector.
    points[: n // 3] = points[0]
    return [(i, [float(x) for x in p]) for i, p in enumerate(points / np.linalg.norm(points, axis=1, keepdims=True))]


def test_cells_too_far_away_are_not_asked(spark):
    rows = clustered()
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    index = vantage.Index(df, 20, 100)
    asked = index.queries(F.col("vec_id") % 20 == 0)
    shares = []
    for factor in (1.0, 2.0):
        first = index.search(asked, 20, factor)
        sent = index.others(asked, first, 20, factor)
        assert sent.where("cell = home").isEmpty()
        shares.append(sent.count() / (asked.count() * index.sizes.count()))
    assert shares[1] <= shares[0] < 0.25
    # The third is dealt to shards, as no shard has far more than its rows.
    assert index.held.groupBy("dimension", "cell", "shard").count().agg(F.max("count")).head()[0] < 200
    assert {tuple(r) for r in vantage.neighbours(df, F.col("vec_id") % 20 == 0, shard_rows=100).collect()} == brute(rows)


def test_a_relaxed_search_of_all_cells_has_recall(spark):
    rows = clustered()
    want = {r[:1] + r[2:3] for r in brute(rows)}
    found = {(r.query_id, r.vec_id) for r in got(spark, rows, factor=1.3, shard_rows=100).collect()}
    assert len(found & want) >= 0.95 * len(want)


def test_long_and_short_vectors_and_dimensions_without_a_pivot(spark):
    r = random.Random(8)
    rows = [(i, [float(r.randint(-9, 9)) * 10 ** (i % 4) for _ in range(4)]) for i in range(500)]
    rows += [(i, [float(r.randint(1, 9))] * (1 + i % 7)) for i in range(500, 560)]
    assert {tuple(x) for x in got(spark, rows, shard_rows=60).collect()} == brute(rows)


def test_no_rows_and_few_candidates(spark):
    assert got(spark, []).count() == 0
    assert {tuple(r) for r in got(spark, [(0, [1.0, 2.0]), (1, [0.5, 0.5])]).collect()} == {(0, 1, 1, 1.5)}


@pytest.mark.parametrize("shard_rows", [16_384, 40])
def test_repeated_rows_equal_the_sql_twin(spark, shard_rows):
    """Components are small whole numbers, so that scores are exact and tie."""
    r = random.Random(6)
    whole = lambda: [float(r.randint(-4, 4)) for _ in range(5)] + [1.0]
    rows = [(i, whole()) for i in range(200)]
    near = [9.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    rows += [(301, near)] * 8 + [(302, [8.0, 0.0, 0.0, 0.0, 0.0, 1.0])] * 3
    # 400 has a vector of many ids among 30 of its own, all nearer to it than any other; 420 repeats itself.
    rows += [(400, [9.0 + i, 0.0, 0.0, 0.0, 0.0, 1.0]) for i in range(30)]
    rows += [(420, [0.0, 9.0, 0.0, 0.0, 0.0, 1.0])] * 3 + [(i, near) for i in range(501, 504)]
    rows += [(601, [0.0, 0.0, 9.0, 0.0, 0.0, 1.0])] * 30 + [(603, [0.0, -9.0, 0.0, 0.0, 0.0, 1.0]), (603, [0.0, -8.0, 0.0, 0.0, 0.0, 1.0])] * 2
    duck = duckdb.connect()
    duck.register("embeddings", pa.table({"vec_id": pa.array([i for i, _ in rows], pa.int64()), "embedding": pa.array([v for _, v in rows], pa.list_(pa.float32()))}))
    out = got(spark, rows, shard_rows=shard_rows)
    assert sorted(map(tuple, out.collect())) == sorted(duck.execute(vantage.SQL).fetchall())


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_over_the_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in queries.table(spark, sf, "embeddings").collect()]
    assert {tuple(r) for r in queries.op6_vantage(spark, sf).collect()} == brute(rows)
