import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from factweave.llm import hardneg

SCHEMA = "vec_id long, embedding array<double>, label int, row long, id long, score long, side int, v binary"


def brute(rows, every=2, positives=5, negatives=3, scale=256):
    known = [(i, [int(np.floor(scale * x)) for x in v], label) for i, v, label in rows if label is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    last = lambda i: (i is None, i)
    out = []
    for a, (anchor, v, label) in enumerate(known):
        if anchor is None or anchor % every:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), i, other) for b, (i, w, other) in enumerate(known) if a != b and len(v) == len(w)]
        scored.sort(key=lambda s: (-s[0], last(s[1])))
        for score, positive, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [s for s in scored if s[2] != label and 50 * score <= 100 * s[0] <= 95 * score][:negatives]
            out += [(anchor, positive, rank, i, score, n) for rank, (n, i, _) in enumerate(fit, 1)]
    return sorted(out, key=str)


def mined(spark, rows, every=2):
    frame = spark.createDataFrame([(*r, *[None] * 5) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in hardneg.mine(frame, F.col("vec_id") % every == 0).collect()), key=str)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.sampled_from([3, 1 << 10, 1 << 24]), st.integers(0, 99))
def test_scores_are_exact_integers(d, most, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-most, most + 1, (5, d)), rng.integers(-most, most + 1, (7, d))
    a[0], b[0] = most, -most
    got = np.concatenate([s for _, s in hardneg.Multiplier(a.astype(np.int32)).scores(b.astype(np.int32))])
    assert (got == a.astype(object) @ b.astype(object).T).all()


def test_products_stay_exact_in_float32():
    assert all(hardneg.CHUNK * (p // 2) ** 2 + p < 1 << 24 for p in hardneg.PRIMES) and len(hardneg.PRIMES) == 7
    with pytest.raises(ValueError):
        hardneg.primes_for(1 << 62)


@pytest.mark.parametrize("small", [False, True])
def test_results_are_those_of_brute_force(spark, monkeypatch, small):
    if small:  # many blocks of anchors and parts of rows
        for name, value in (("_BLOCK", 32), ("_PART", 16), ("_PARTS", 3), ("_TILE", 4)):
            monkeypatch.setattr(hardneg, name, value)
    rng = random.Random(5)
    heads = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.4) for x in rng.choice(heads)], rng.choice([0, 0, 0, 1, 2])) for i in range(150)]
    rows += [(i, [0.5, 0.25] + [0.0] * 6, i % 2) for i in range(200, 230)]  # ties
    rows += [(201, [0.5, 0.25] + [0.0] * 6, 1), (202, rows[2][1], 0), (202, rows[2][1], 0)]  # repeated ids and rows
    rows += [(300, None, 1), (301, [None] + [1.0] * 7, 1), (302, [float("nan")] * 8, 1), (303, [float("inf")] * 8, 0), (304, heads[0], None), (None, heads[0], 0), (None, heads[1], 1), (306, [], 0)]
    rows += [(400 + i, [1.0 - i / 100, 0.5, 0.1], i % 2) for i in range(12)]  # another length
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 300


def test_empty_tables_and_single_labels(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(i, [1.0, i / 10], 4) for i in range(6)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [-1.0], 1), (2, [0.5], 2)]) == []  # a negative score has no window
    assert mined(spark, [(0, [0.0], 1), (1, [1.0], 1), (3, [5.0], 2)]) == [(0, 1, 1, 3, 0, 0)]
