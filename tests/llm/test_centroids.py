import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from factweave.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster int, distance long, inertia long, v binary"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(-4, 4), min_size=3, max_size=3), min_size=1, max_size=30), st.lists(st.lists(st.integers(-6, 6), min_size=3, max_size=3), max_size=20), st.sampled_from([1, 1 << 24]))
def test_the_tree_finds_the_nearest_of_smallest_number(points, queries, scale):
    points, queries = np.array(points) * scale, np.array(queries).reshape(-1, 3) * scale
    owner, best = centroids.VantageTree(points).nearest(queries)
    apart = ((queries[:, None] - points[None]) ** 2).sum(axis=2)
    assert (owner == apart.argmin(axis=1)).all() and (best == apart.min(axis=1)).all()


def test_bounds_spare_most_distances(monkeypatch):
    rng = np.random.default_rng(1)
    points = rng.integers(-1000, 1000, (500, 2))
    seen, real = [], centroids.squared
    tree = centroids.VantageTree(points)
    monkeypatch.setattr(centroids, "squared", lambda rows, point: (seen.append(len(rows)), real(rows, point))[1])
    tree.nearest(rng.integers(-1000, 1000, (200, 2)))
    assert sum(seen) < 0.2 * 200 * 500


def brute(rows, k, rounds, seed, scale, dims):
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), i, j) for j, (i, _) in enumerate(kept) if i is not None)
    centres = [kept[j][1] for *_, j in first[:k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), g) for g, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centres = [[sum(x) // len(x) for x in zip(*groups[g])] if g in groups else c for g, c in enumerate(centres)]
    own = [(i, *nearest(v)[::-1]) for i, v in kept]
    sums = {g: sum(d for _, x, d in own if x == g) for g in range(k)}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, g, d, sums[g], sum(sums.values()), shas[g]) for i, g, d in own), key=str)


def run(spark, rows, k=4, rounds=6, dims=3):
    frame = spark.createDataFrame([(*r, *[None] * 4) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in centroids.cluster(frame, k=k, rounds=rounds, seed=3, scale=16, dims=dims).collect()), key=str)


def test_clusters_are_those_of_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(i % 5, 0.5), rng.gauss(-(i % 3), 0.5), rng.gauss(0, 1)]) for i in range(200)]
    rows += [(i, [1.0, -1.0, 0.0]) for i in range(300, 340)]  # equal vectors
    rows += [(300, [1.0, -1.0, 0.0]), (None, [2.0, 2.0, 2.0]), (400, None), (401, [1.0, 2.0]), (402, [1.0, None, 2.0]), (403, [float("nan"), 0.0, 0.0]), (404, [float("inf"), 0.0, 0.0]), (405, [])]
    got = run(spark, rows)
    assert got == brute(rows, 4, 6, 3, 16, 3) and len({r[1] for r in got}) > 1


def test_few_vectors_equal_starts_and_empty_tables(spark):
    rows = [(i, [0.5, 0.5, 0.5]) for i in range(9)]
    assert run(spark, rows) == brute(rows, 4, 6, 3, 16, 3) and {r[1] for r in run(spark, rows)} == {0}
    rows = [(1, [0.0, 0.0, 1.0]), (2, [3.0, 0.0, 1.0])]
    assert run(spark, rows) == brute(rows, 4, 6, 3, 16, 3)
    assert run(spark, []) == run(spark, [(None, [1.0, 1.0, 1.0])]) == []


def test_components_beyond_the_exact_range_are_refused(spark):
    with pytest.raises(Exception, match="would not stay exact"):
        run(spark, [(1, [1e30, 0.0, 0.0]), (2, [0.0, 0.0, 0.0])])
