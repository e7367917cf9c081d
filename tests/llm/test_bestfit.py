import random
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st

from factweave.llm import bestfit
from factweave.llm.queries import tokenizer_path


def one_by_one(lengths, limit):
    """Sequences when each length, longest first, goes into the fullest one that has room."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        best = min((r for r in range(len(rooms)) if rooms[r] >= n), key=rooms.__getitem__, default=None)
        if best is None:
            rooms.append(limit - n)
        else:
            rooms[best] -= n
    return rooms


def checked(plan, lengths, limit):
    placed = Counter()
    for pattern, count in plan:
        assert count > 0 and 0 < sum(n * k for n, k in pattern) <= limit
        for n, k in pattern:
            placed[n] += k * count
    assert placed == Counter(lengths)
    return sum(count for _, count in plan)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=80))
def test_plans_hold_every_piece_in_no_more_sequences_than_best_fit(lengths):
    found = checked(bestfit.plan(Counter(lengths), 60), lengths, 60)
    assert found <= len(one_by_one(lengths, 60))
    for share in (2, 3, 8):
        checked(bestfit._plan(Counter(lengths), 60, 4, share), lengths, 60)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_best_fit_is_the_one_by_one_rule(lengths):
    found = bestfit.best_fit([], Counter(lengths), 40)
    rooms = Counter()
    for pattern, count in found:
        rooms[40 - sum(n * k for n, k in pattern)] += count
    assert rooms == Counter(one_by_one(lengths, 40))


def test_groups_are_of_equal_cardinality_and_rounded_up():
    lengths = Counter({n: 10 for n in range(51, 100)})
    groups = bestfit.grouped(lengths, 7)
    assert [sum(n for _, n in g) for g in groups] == [70] * 7 and sum((Counter(dict(g)) for g in groups), Counter()) == lengths
    assert all(a[-1][0] >= b[0][0] for a, b in zip(groups, groups[1:]))


def test_configurations_reach_the_optimum_of_few_sizes():
    # 300 of 44 and 300 of 28 in 100: two of the one or three of the other fill 88 and 84, but 44 + 28 + 28 fills all.
    found = bestfit.configurations(np.array([44, 28]), np.array([300.0, 300.0]), 100)
    assert sum(n for _, n in found) == 225 and {tuple(t) for t, _ in found} == {(1, 2), (2, 0)}


def test_mixes_beat_best_fit_where_it_goes_wrong():
    rng = np.random.default_rng(2)
    lengths = rng.integers(600, 1200, 5000).tolist()
    found = checked(bestfit.plan(Counter(lengths), 2048), lengths, 2048)
    assert found < len(one_by_one(lengths, 2048))


def test_plan_size_does_not_grow_with_the_counts():
    rng = np.random.default_rng(1)
    few = Counter((rng.zipf(1.3, 3000) % 2048 + 1).tolist())
    many = Counter({n: 100_000 * k for n, k in few.items()})
    assert len(bestfit.plan(many, 2048)) < 3 * len(bestfit.plan(few, 2048)) + 2048
    assert checked(bestfit.plan(few, 2048), few, 2048) >= sum(n * k for n, k in few.items()) / 2048


def test_pieces_are_whole_and_gapless(spark, docs_of):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta,", "gamma!", "é", "<|endoftext|>"]) for _ in range(rng.choice([0, 3, 50, 400])))) for i in range(60)]
    rows += [(100, None), (101, ""), (99, "twice"), (99, "twice"), (None, "no id")]
    got = bestfit.pack(docs_of(rows), tokenizer_path(), limit=64, end=0, with_ids=True).collect()
    want = Counter()
    for i, t in rows:
        ids = encoder.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 64):
            want[i, k // 64, k, tuple(ids[k : k + 64])] += 1
    assert Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in got) == want
    assert all(r.length == len(r.ids) and zlib.crc32(np.array(r.ids, np.uint32).tobytes()) == r.ids_crc32 for r in got)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    assert len(sequences) <= len(one_by_one([r.length for r in got], 64))
    assert bestfit.pack(docs_of([]), tokenizer_path()).collect() == []
