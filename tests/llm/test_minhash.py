import random
from collections import Counter

import numpy as np
import pytest

from factweave.llm import minhash
from factweave.llm.common import components

VOCABULARY = [f"w{i}" for i in range(400)]


def brute(rows, words, percent):
    """component and set size of each (doc_id, text), by comparing all sets."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        k = min(words, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), doc if not sets[i] else least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def edited(rng, words, share):
    return [rng.choice(VOCABULARY) if rng.random() < share else w for w in words]


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(spark, docs_of, words, percent):
    rng = random.Random(7)
    rows = []
    for _ in range(12):
        base = [rng.choice(VOCABULARY) for _ in range(rng.randint(20, 400))]
        for _ in range(rng.randint(1, 6)):
            rows.append((len(rows), " ".join(edited(rng, base, rng.choice([0, 0.01, 0.03, 0.1])))))
    rows += [(900, None), (901, ""), (902, " \n\t "), (903, "Two Words"), (904, "two\vwords"), (905, "one"), (906, "one two"), (3, "one"), (3, "one"), (None, "two words"), (None, None)]
    rows.append((950, "long " + " ".join(rng.choice(VOCABULARY) for _ in range(30_000))))
    got = minhash.near_duplicates(docs_of(rows), words, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, words, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_cluster_is_verified_in_blocks(spark, docs_of):
    rng = random.Random(3)
    base = [rng.choice(VOCABULARY) for _ in range(120)]
    rows = [(i, " ".join(edited(rng, base, 0.02 + 0.04 * (i % 3)))) for i in range(90)]
    got = minhash.near_duplicates(docs_of(rows), 3, 85, block=8).collect()
    want = brute(rows, 3, 85)
    assert len({c for _, _, c in want}) > 3
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want


def test_empty_table_and_filter(spark, docs_of):
    assert minhash.near_duplicates(docs_of([])).collect() == []
    docs = docs_of([(5, "a b c d e f g"), (2, "A B C D E F G"), (7, None), (8, ""), (9, "x")])
    kept = minhash.first_of_group(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 7, 8, 9]
    assert kept.columns == docs.columns


def test_rows_are_known_by_id_and_text(spark):
    one, other, odd = "a b c d e f g h", "q r s t u v w x", "k l m n o p q r"
    rows = [(1, one, "x"), (2, one, "y"), (2, other, "z"), (None, other.upper(), "n"), (None, odd, "m"), (None, odd, "m"), (3, odd, "l"), (4, "", "e"), (4, "", "e"), (None, None, "e"), (5, "i j k l m n", "p"), (5, "i j k l m n", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id string").repartition(3)
    kept = minhash.first_of_group(docs)
    assert kept.columns == docs.columns
    want = [(1, one, "x"), (2, other, "z"), (3, odd, "l"), (4, "", "e"), (4, "", "e"), (None, None, "e"), (5, "i j k l m n", "p")]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)


def test_signature_is_one_permutation_shifted():
    items = np.random.default_rng(1).integers(0, 1 << 63, 300).astype(np.uint64)
    a, b = minhash.signature(items, 64), minhash.signature(items[::-1], 64)
    assert (a == b).all() and (minhash.signature(items, 32) == a[:32]).all()
    near = np.concatenate([items[:270], items[:30] + np.uint64(1)])
    j = 270 / 330
    assert abs((minhash.signature(items, 2048) == minhash.signature(near, 2048)).mean() - j) < 0.06


def test_overlaps_are_exact():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 50, rng.integers(1, 60)).astype(np.uint64)) for _ in range(20)]
    assert [[int(x) for x in row] for row in minhash.overlaps(sets)] == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    random.Random(1).shuffle(edges)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200, 202: 200}
    assert Counter(got.values())[0] == 61
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
