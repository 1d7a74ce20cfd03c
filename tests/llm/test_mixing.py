from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from cropwind.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def by_hand(rows):
    """(doc_id, size, source_size, target, taken) of each row, targets filled level by level."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, level = set(), 0.0
    while len(capped) < len(sizes):
        level = (1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in sizes if s not in capped)
        more = {s for s in sizes if 2 * sizes[s] < level * weight[s]}
        if more == capped:
            break
        capped = more
    out = []
    for i, text, source in rows:
        target = min(2.0 * sizes[source], level * weight[source])
        rate = target / sizes[source] if sizes[source] else 0.0
        draw = int(hashlib.md5(f"mix|{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 16**13
        out.append((i, size(text), sizes[source], target, size(text) * (int(rate) + (draw < rate - int(rate)))))
    return out


CASES = {
    "ties": [(i, "a b c d", f"s{i % 6}") for i in range(60)],
    "one source": [(i, "word " * i, "only") for i in range(20)],
    "nulls": [(1, None, None), (None, "a b", None), (2, "", "x"), (3, "x y z", "x"), (None, "a b", None), (4, None, "empty source")],
    "repeats and long": [(7, "a " * 200_000, "big"), (7, "a " * 200_000, "big"), (8, "one", "é"), (9, "two words", "z"), (10, "\t\n\x0b", "z")],
    "equal ratios": [(i, "w " * n, s) for i, (s, n) in enumerate([("a", 50), ("b", 20), ("c", 10), ("d", 50), ("e", 20), ("f", 900)])],
    "no words": [(1, "", "a"), (2, None, "b")],
}


@pytest.mark.parametrize("case", CASES)
def test_against_hand_filled_targets(spark, case):
    rows = CASES[case]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("clash")).repartition(3)
    got = sorted(map(tuple, mixing.digest(df).collect()), key=str)
    want = sorted(by_hand(rows), key=str)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])
    taken = {}
    for i, (d, t, s) in enumerate(rows):
        n = want[[w[0] for w in want].index(d)]
        taken[(d, t, s)] = taken.get((d, t, s), 0) + (by_hand(rows)[i][4] // max(1, n[1]) if n[1] else 0)
    copies = {}
    for r in mixing.stage(df).collect():
        copies[(r.doc_id, r.text, r.source)] = copies.get((r.doc_id, r.text, r.source), 0) + 1
    worded = lambda t: bool(re.search(r"[^\x20\x09-\x0D]", t or ""))
    assert {k: v for k, v in copies.items() if worded(k[1])} == {k: v for k, v in taken.items() if v}


def test_reruns_and_partitions_agree_and_targets_are_met(spark):
    rows = [(i, "w " * (1 + i * 37 % 90), f"s{i * i % 7}") for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA)
    one, two = (sorted(map(tuple, mixing.digest(df.repartition(n)).collect())) for n in (1, 7))
    assert one == two
    by_source = {}
    for (_, _, source), row in zip(sorted(rows), one):
        total = by_source.setdefault(source, [row[3], 0])
        total[1] += row[4]
        assert row[4] <= 2 * row[1]
    assert all(abs(taken - target) <= 0.1 * target for target, taken in by_source.values())


def test_stage_with_clashing_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b", "s", 3, 0.5, "x", 9)], f"{SCHEMA}, mix_copy int, mix_rate double, mix_of string, mix_copies int")
    out = mixing.stage(df)
    assert out.columns == df.columns and {tuple(r) for r in out.collect()} <= {tuple(r) for r in df.collect()}
    assert mixing.stage(df.where("false")).count() == 0 and mixing.digest(df.where("false")).count() == 0
