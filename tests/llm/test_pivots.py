import numpy as np
import pytest

from factweave.llm import pivots


def brute(rows, threshold):
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, np.float64)
        return v / np.linalg.norm(v)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    units = [unit(v) for _, v, _ in rows]
    for i in range(n):
        for j in range(i):
            same = units[i] is not None and units[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j])
            if same and units[i] @ units[j] >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (v, _, _) in enumerate(rows):
        if v is not None:
            least[find(i)] = min(least.get(find(i), v), v)
    return sorted(((rows[i][0], links[i], least.get(find(i))) for i in range(n)), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, cls string, n int")


def test_links_match_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(25):
        base = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 9))):
            v = base + rng.normal(size=16) * rng.choice([0, 0.03, 0.08, 0.3])
            rows.append((len(rows), [float(np.float32(x)) for x in v], int(g % 3)))
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 0), (502, rows[0][1], 1), (503, rows[0][1], None), (500, rows[0][1], 0)]
    rows += [(510, None, 0), (511, [], 0), (512, [0.0] * 16, 0), (513, [None] * 16, 0), (514, [float("nan")] * 16, 0), (515, [float("inf")] + [1.0] * 15, 0), (516, [1.0, 2.0], 0), (517, [2.0, 4.0], 0), (518, [1.0, -2.0], 0), (None, [1.0, 2.0], 0)]
    got = pivots.near_vectors(frame(spark, rows), 0.98, block=3).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(rows, 0.98)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_recall_of_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.981 * x + np.sqrt(1 - 0.981**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    rows = [(i, [float(a) for a in v], 0) for i, v in enumerate(np.concatenate([x, y]))]
    assert pivots.near_vectors(frame(spark, rows), 0.98).selectExpr("sum(n_links)").first()[0] >= 0.98 * 800


@pytest.mark.parametrize("share", [1 / 3, 1])
def test_recall_in_one_large_group_of_near_copies(spark, share):
    rng = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(rng.normal(size=(1800, 64)))
    n = int(1800 * share)
    x[:n] = unit(np.sqrt(0.985) * x[:1] + np.sqrt(0.015) * unit(rng.normal(size=(n, 64))))
    want = int((x @ x.T >= 0.98).sum()) - len(x)
    got = pivots.near_vectors(frame(spark, [(i, v, 0) for i, v in enumerate(x.tolist())]), 0.98).selectExpr("sum(n_links)").first()[0]
    assert want > n * n / 2 and 0.98 * want <= got <= want * 1.001


def test_empty_table(spark):
    assert pivots.near_vectors(frame(spark, []), 0.98).collect() == []
