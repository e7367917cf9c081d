import random

import numpy as np

from factweave.llm import decontam


def brute(docs, items, min_words=10, min_share=0.5, penalty=2.0):
    """(doc, item, equal words) of the best stretch over all diagonals."""
    out = set()
    for doc, text in docs:
        w = decontam.words_of((text or "").encode())
        for item, said in items:
            v = decontam.words_of((said or "").encode())
            best = 0
            for d in range(-len(v), len(w)):
                score = alike = 0
                top = (0, 0)
                for k in range(max(0, -d), min(len(v), len(w) - d)):
                    same = w[d + k] == v[k]
                    score, alike = score + (1 if same else -penalty), alike + same
                    if score <= 0:
                        score = alike = 0
                    top = max(top, (score, alike))
                best = max(best, top[1])
            if best >= min_words and best >= min_share * len(v):
                out.add((doc, item, best))
    return out


def test_planted_passages_are_found_through_substitutions(spark, docs_of):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(15, 50)))) for i in range(12)] + [(50, None), (51, ""), (52, "too short"), (0, None)]
    docs = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if i % 3 == 0:
            passage = items[i % 12][1].split()
            for k in range(rng.choice([0, 0, 1, 2])):
                passage[(k + 1) * len(passage) // 4] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() + "," for w in passage]
        docs.append((i, " ".join(words)))
    docs += [(100, None), (101, ""), (0, docs[0][1]), (102, "word " * 50_000 + items[3][1])]
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, h string")
    found = decontam.contaminated(docs_of(docs), bench).collect()
    want = brute(docs[:-1], items) | {(102, 3, len(items[3][1].split()))}
    assert {(r.doc_id, r.item_id, r.alike) for r in found} == want and len(found) == len(want) >= 20
    kept = decontam.without_benchmark(docs_of(docs), bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in docs if i not in {d for d, _, _ in want})
    assert kept.columns == docs_of(docs).columns
    assert decontam.contaminated(docs_of([]), bench).collect() == []
    assert decontam.contaminated(docs_of(docs), bench.limit(0)).collect() == []


def test_seeds_ignore_their_gaps():
    words = np.arange(40, dtype=np.uint64)
    changed = words.copy()
    changed[12] = 99
    a, b = (decontam.seed_hashes(x, "1101", 0) for x in (words, changed))
    assert a[10] == b[10] and (a[[9, 11, 12]] != b[[9, 11, 12]]).all()


def test_best_stretch():
    same = np.array([1, 0, 1, 1, 1, 0, 1, 1, 1, 0, 0, 1], bool)
    assert decontam.best_stretch(same, 2.0) == (2, 9)
    assert decontam.best_stretch(np.zeros(3, bool), 2.0) == (0, 0)
