import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from factweave.llm import packing
from factweave.llm.queries import tokenizer_path

ALPHABET = "aAbZéÉßÿÀ×÷'s.,;:!?-_$%&*#<|>\"`~{}[]^@/\\()+= \n\t\x0b\x0c\ŕİΣσ1²ñ😀\x1c\xa0\x85"


@pytest.fixture(scope="module")
def encoder():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=20), st.booleans())
def test_words_one_by_one_give_the_ids_of_the_text(encoder, text, special):
    text += " <|endoftext|>b a<|startoftext|>" if special else ""
    codes = packing.WordCodes(encoder)
    want = encoder.encode(text, add_special_tokens=False).ids
    code = b"".join(map(codes.__getitem__, text.encode().split()))
    assert np.frombuffer(code, np.uint32).tolist() == want
    ids, ends = packing.token_ids(pa.array(["x", text, None, text, ""])[1:], codes)
    assert ids.tolist() == want + want and ends.tolist() == [len(want), len(want), 2 * len(want), 2 * len(want)]


def one_by_one(lengths, limit):
    """Rooms left when each piece, longest first, goes into the emptiest pack that holds it."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        best = max(range(len(rooms)), key=rooms.__getitem__, default=None)
        if best is not None and rooms[best] >= n:
            rooms[best] -= n
        else:
            rooms.append(limit - n)
    return rooms


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_shortest_pack_first_is_the_one_by_one_rule(lengths):
    patterns = packing.shortest_pack_first(Counter(lengths), 40)
    rooms = Counter()
    placed = Counter()
    for pattern, count in patterns:
        rooms[40 - sum(n * k for n, k in pattern)] += count
        for n, k in pattern:
            placed[n] += k * count
    assert placed == Counter(lengths) and rooms == Counter(one_by_one(lengths, 40)) and min(rooms, default=0) >= 0


def test_pieces_and_sequences_are_whole(spark, docs_of, encoder):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta,", "gamma!", "é", "<|endoftext|>"]) for _ in range(rng.choice([0, 3, 50, 400])))) for i in range(60)]
    rows += [(100, None), (101, ""), (99, "twice"), (99, "twice"), (None, "no id")]
    packed = packing.pack(docs_of(rows), tokenizer_path(), limit=128, end=2, with_ids=True)
    got = packed.collect()
    want = Counter((i, tuple(encoder.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in rows)
    by = {}
    for r in got:
        assert 0 < r.length == len(r.ids) <= 128 and zlib.crc32(np.array(r.ids, np.uint32).tobytes()) == r.ids_crc32
        by.setdefault(r.doc_id, []).append(r)
    for doc in {d for d, _ in want}:
        starts = sorted((r.start, r.ids) for r in by[doc])
        copies = sum(n for (d, _), n in want.items() if d == doc)
        ids = next(list(x) for d, x in want if d == doc)
        assert starts == sorted([(s, ids[s : s + 128]) for s in range(0, len(ids), 128)] * copies)
        assert {r.doc_tokens for r in by[doc]} == {len(ids)}
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 128
    assert sorted(sequences) == list(range(len(sequences)))
    full = packing.sequences(packed, limit=128, pad=0).collect()
    assert {len(r.ids) for r in full} == {128} and len(full) == len(sequences)
    assert packing.pack(docs_of([]), tokenizer_path()).collect() == []
