from __future__ import annotations

import random
import re

import numpy as np
import pytest

from cropwind.llm import jaccard_join as jj
from cropwind.llm import queries


def shingles(text, width=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(rows, threshold=90):
    sets = [shingles(t) for _, t in rows]
    head = list(range(len(rows)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    by_size = sorted(range(len(rows)), key=lambda i: len(sets[i]))
    for x, i in enumerate(by_size):
        for j in by_size[x + 1 :]:
            if not sets[i]:
                break
            if 100 * len(sets[i]) < threshold * len(sets[j]):
                break
            both = len(sets[i] & sets[j])
            if 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                head[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(sets[i]), low.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def made(seed):
    """Families of texts at all distances around the threshold, with chains and a common passage."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 5)))
    common = [word() for _ in range(20)]
    rows = []
    for _ in range(8):
        base = [word() for _ in range(r.randint(3, 150))] + common
        for _ in range(12):
            t = list(base)
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = word()
            if r.random() < 0.2:
                base = t
            rows.append(" ".join(t) if r.random() < 0.8 else "\n".join(t).upper())
    rows += [None, "", " \t", "one", "ONE", "one two", "two one", rows[0], rows[0]]
    r.shuffle(rows)
    return list(enumerate(rows, 5))


def got(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, jj.join(df, **options).collect()), key=str)


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force(spark, seed):
    rows = made(seed)
    assert got(spark, rows) == brute(rows)


def test_signatures_bound_the_difference_at_every_width():
    r = np.random.default_rng(0)
    x = np.unique(r.integers(0, 2**63, 5000, dtype=np.uint64))
    y = np.concatenate((x[200:], r.integers(0, 2**63, 150, dtype=np.uint64)))
    wide, other = jj._signature(x), jj._signature(y)
    assert len(wide) == len(other) == 128 and len(jj._signature(x[:900])) == jj.SIGNATURE_WORDS
    while True:
        apart = int(np.bitwise_count((wide ^ other).view(np.uint64)).sum())
        assert apart <= 350 and (len(wide) < 128 or apart > 300)
        if len(wide) == jj.SIGNATURE_WORDS:
            break
        wide, other = (w[: len(w) // 2] ^ w[len(w) // 2 :] for w in (wide, other))
    assert (wide == np.bitwise_xor.reduce(jj._signature(x).reshape(-1, jj.SIGNATURE_WORDS), axis=0)).all()


def test_lists_in_chunks_give_the_same(spark):
    rows = made(2)
    assert got(spark, rows, list_limit=2) == brute(rows)


def test_null_ids_repeated_rows_and_no_rows(spark):
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (9, "A B C D"), (None, None), (7, "x")]
    assert got(spark, rows) == sorted([(None, 2, 4), (4, 2, 4), (4, 2, 4), (9, 2, 4), (None, 0, None), (7, 1, 7)], key=str)
    assert got(spark, []) == []


def test_stage_keeps_one_of_each_group(spark):
    rows = [(3, "a b c d", "s"), (2, "A b c d", "s"), (2, "A b c d", "s"), (5, "other text here", None), (6, None, "s"), (7, "", "s"), (None, "a b c d", "s")]
    out = jj.stage(spark.createDataFrame(rows, "doc_id long, text string, sid string"))
    assert out.columns == ["doc_id", "text", "sid"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(2, "A b c d", "s"), (5, "other text here", None), (6, None, "s"), (7, "", "s")], key=str)


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    want = brute(rows)
    assert sorted(map(tuple, queries.op4_jaccard_join(spark, sf).collect()), key=str) == want
    assert any(d != c for d, _, c in want)


def test_stage_with_clashing_columns(spark):
    rows = [(1, "a b c d", "x", 1, 2, None), (2, "a b c d", "y", 1, 2, None), (3, None, "z", 1, 2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_copy string, copy int, n int, component string")
    assert sorted(map(tuple, jj.stage(df).select("doc_id", "kept_copy", "copy").collect())) == [(1, "x", 1), (3, "z", 1)]


def test_very_long_texts(spark):
    r = random.Random(6)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(120_000)]
    other = list(words)
    for i in range(0, 110_000, 110):
        other[i] = "edit"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:100_000])), (4, " ".join(words[60_000:])), (5, "z " * 400_000)]
    assert got(spark, rows) == brute(rows)


def test_rarity_comes_to_the_driver_as_columns(spark, monkeypatch):
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(400)),) for _ in range(20)], "text string")
    kind = type(df)
    for name in ("collect", "toPandas"):
        monkeypatch.setattr(kind, name, lambda self: pytest.fail("rows as Python objects"))
    level = jj.rarity(df)
    assert len(level) == 1 << jj.SKETCH_BITS and level.any()


def unit_of(sets, known):
    n = np.array([len(s) for s in sets])
    signs = np.stack([jj._signature(np.array(sorted(s), np.uint64)).view(np.uint64) for s in sets])
    rows = np.arange(len(sets))
    return {"position": np.zeros(len(sets), np.int64), "n": n, "sid": rows, "component": rows, "lead": np.full(len(sets), -1), "chunk": rows * 0, "known": np.array(known), "sign": signs}


def test_answers_derived_from_the_leaders_are_the_compared_ones():
    r = random.Random(4)
    numbers = [r.getrandbits(63) for _ in range(4000)]
    leader, fresh = set(numbers[:500]), iter(numbers[500:])
    sets = []
    for _ in range(60):
        s = set(leader)
        s -= set(r.sample(sorted(s), r.randint(0, 60)))
        sets.append(s | {next(fresh) for _ in range(r.randint(0, 40))})
    links = {(i, j) for i in range(60) for j in range(i + 1, 60) if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])}
    exact = [len(s ^ leader) for s in sets]
    open_a, open_b, open_sure = jj._pairs_of(unit_of(sets, [-1] * 60), 90)
    a, b, sure = jj._pairs_of(unit_of(sets, exact), 90)
    some = set(zip(a.tolist(), b.tolist(), strict=True))
    settled = {p for p, s in zip(zip(a.tolist(), b.tolist(), strict=True), sure.tolist(), strict=True) if s}
    assert not open_sure.any() and settled and settled <= links <= some <= set(zip(open_a.tolist(), open_b.tolist(), strict=True))
    assert all(exact[i] + exact[j] >= len(sets[i] ^ sets[j]) >= abs(exact[i] - exact[j]) for i, j in some)
