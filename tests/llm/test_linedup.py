import random

import numpy as np
import xxhash
from hypothesis import given, settings, strategies as st

from factweave.llm import linedup


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=14), st.lists(st.integers(0, 9), max_size=14))
def test_alignment_rises_in_both(a, b):
    pairs = linedup.aligned(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
    assert len(pairs) <= lcs(a, b)


@given(st.permutations(range(8)), st.permutations(range(8)))
def test_distinct_lines_align_as_the_longest_common_sequence(a, b):
    assert len(linedup.aligned(list(a), list(b))) == lcs(a, b)


def brute(rows, min_words=8, anchor_words=5):
    """The text left of each row: each pair of a document and a first holder of one of its lines is aligned."""
    lines = [linedup.lines_of((t or "").encode()) for _, t in rows]
    holders = {}
    for (doc, _), own in zip(rows, lines):
        for x in own:
            if len(x.split()) >= anchor_words and doc is not None:
                holders.setdefault(x, set()).add(doc)
    repeated = {x for x, docs in holders.items() if len(docs) > 1}

    def sequence(own):
        near = set()
        for i, x in enumerate(own):
            if x in repeated:
                for step in (-1, 1):
                    at = i
                    while 0 <= at < len(own):
                        near.add(at)
                        if at != i and len(own[at].split()) >= anchor_words:
                            break
                        at += step
        near = sorted(near)
        return near, [xxhash.xxh3_64_intdigest(own[i]) for i in near], [np.array([xxhash.xxh32_intdigest(w) for w in own[i].split()], np.uint32) for i in near]

    at = {}
    for i, (doc, _) in enumerate(rows):
        at.setdefault(doc, i)
    out = []
    for i, (doc, text) in enumerate(rows):
        cuts = set()
        for c in {min(holders[x]) for x in lines[i] if x in repeated and doc is not None} - {doc}:
            cuts |= set(linedup.common_blocks(sequence(lines[at[c]]), sequence(lines[i]), min_words))
        gone = linedup.cut_spans(text or "", [dict(zip(("s0", "w0", "s1", "w1"), x)) for x in sorted(cuts)])
        for a, b in reversed(gone):
            text = text[:a] + text[b:]
        out.append((doc, text))
    return out


def corpus():
    rng = random.Random(9)
    word = lambda: f"t{rng.randrange(3000)}"
    sentence = lambda n: " ".join(word() for _ in range(n)) + "."
    shared = [[sentence(rng.randint(2, 14)) for _ in range(rng.randint(1, 7))] for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [sentence(rng.randint(1, 14)) for _ in range(rng.randint(0, 10))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            at = rng.randint(0, len(parts))
            parts[at:at] = rng.choice(shared)
        rows.append((i, rng.choice([" ", "\n", "\n\n"]).join(parts)))
    return rows


def test_cuts_match_aligning_all_pairs(spark, docs_of):
    rows = corpus() + [(100, None), (101, ""), (102, "\n \n"), (103, corpus()[5][1]), (None, corpus()[5][1])]
    left = linedup.without_repeats(docs_of(rows), cuts="gone")
    got = left.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(brute(rows), key=str)
    assert left.columns == docs_of(rows).columns + ["gone"]
    assert sum(len(r.gone) for r in got) > 20


def test_a_passage_within_lines_stays_only_once(spark, docs_of):
    rng = random.Random(3)
    passage = ". ".join(" ".join(f"p{rng.randrange(900)}" for _ in range(9)) for _ in range(7))
    rows = [(i, " ".join(f"d{i}x{k}" for k in range(30)) + f" {passage} " + " ".join(f"e{i}x{k}" for k in range(30))) for i in range(40)]
    got = {r.doc_id: r.text for r in linedup.without_repeats(docs_of(rows)).collect()}
    assert got[0] == rows[0][1]
    for i in range(1, 40):
        assert got[i] == rows[i][1].replace(passage + " ", "")


def test_repeated_ids_and_long_texts(spark, docs_of):
    block = "one two three four five six seven eight nine ten."
    rows = [(1, block + " alpha beta."), (1, block + " gamma."), (2, "x. " * 100_000 + block), (3, block)]
    got = sorted((r.doc_id, len(r.text)) for r in linedup.without_repeats(docs_of(rows)).collect())
    assert got == sorted([(1, len(rows[0][1])), (1, len(rows[1][1])), (2, 300_000), (3, 0)])
    assert linedup.without_repeats(docs_of([])).collect() == []


def test_swapped_and_doubled_passages_go():
    def parsed(names):
        lines = [f"{x} {k} is a line of eight words".encode() for x in names for k in (range(3) if x in "PQ" else range(1))]
        return list(range(len(lines))), lines, [np.array([hash(w) for w in x.split()]) for x in lines]

    rng = random.Random(8)
    shapes = [("aPbQc", "dQePf"), ("aPb", "dPePf"), ("aPbPc", "dPePfPg"), ("PQ", "QP")]
    shapes += [("".join(rng.choice("PQabRS") for _ in range(8)), "".join(rng.choice("PQcdRS") for _ in range(8))) for _ in range(60)]
    for x, y in shapes:
        a, b = parsed(x), parsed(y)
        gone = {line for s0, w0, s1, w1 in linedup.common_blocks(a, b, 8) for line in range(s0 + (w0 > 0), s1 + (w1 == len(b[2][s1])))}
        assert gone == {j for j, line in enumerate(b[1]) if line in a[1]}, (x, y)
