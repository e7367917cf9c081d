import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from factweave.llm import ppm

ORDER = 3


def learned(texts, least=1):
    """Counts by context and byte: the longest contexts by occurrence, shorter ones by longer contexts."""
    raw = Counter()
    for t in texts:
        s = b"\xff" * ORDER + t + b"\xff"
        for i in range(ORDER, len(s)):
            raw[s[i - ORDER : i + 1]] += 1
    levels, plain, seen = {}, dict(raw), dict(raw)
    for k in range(ORDER, -1, -1):
        total = defaultdict(int)
        for node, m in seen.items():
            total[node[:-1]] += m
        levels[k] = ({node: m for node, m in seen.items() if k < 2 or plain[node] >= least}, total)
        shorter, again = Counter(), Counter()
        for node, n in plain.items():
            shorter[node[1:]] += n
            again[node[1:]] += 1
        plain, seen = dict(shorter), dict(again)
    return levels


def next_byte(levels, before, byte):
    """log10 probability of a byte after the last ORDER bytes before it."""
    out, gone = 0.0, set()
    for k in range(ORDER, -1, -1):
        nodes, total = levels[k]
        context = before[len(before) - k :]
        here = {n[-1]: m for n, m in nodes.items() if n[:-1] == context}
        if not here:
            continue
        left = total[context] - sum(here[b] for b in gone)
        if byte in here:
            return out + math.log10((here[byte] - 0.5) / left) if byte not in gone else -math.inf
        escape = 0.5 * (len(here) - len(gone)) + total[context] - sum(here.values())
        if escape > 0:
            out += math.log10(escape / left)
        gone = set(here)
    return out - math.log10(256 - len(gone))


def brute(levels, text):
    s = b"\xff" * ORDER + text + b"\xff"
    return sum(next_byte(levels, s[:i], s[i]) for i in range(ORDER, len(s)))


def texts():
    rng = random.Random(4)
    made = ["".join(rng.choice("abcab é\n") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    return list(enumerate(made)) + [(100, None), (101, ""), (102, "zzz ÿ😀"), (20, "Again"), (20, "Again"), (None, "a b")]


@pytest.mark.parametrize("resolution", [1 << 23, 300])
def test_scores_match_brute_force(spark, docs_of, resolution):
    rows = texts()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    train = [(t or "").encode() for i, t in rows if not held(i)]
    least = -(-sum(len(t) + 1 for t in train) // resolution)
    levels = learned(train, least)
    words = Counter(w for t in train for w in [*t.lower().split(), b""])
    n, v = sum(words.values()), len(words)
    got = sorted(ppm.language_scores(docs_of(rows), ORDER, resolution).collect(), key=lambda r: (str(r.doc_id), r.score))
    want = sorted(((str(i), brute(levels, (t or "").encode()), held(i), [*(t or "").encode().lower().split(), b""]) for i, t in rows), key=lambda x: x[:2])
    assert len(got) == len(want) and any(x[2] for x in want)
    for r, (doc, score, out, tokens) in zip(got, want):
        assert (str(r.doc_id), r.held_out, r.n_tokens, r.train_tokens) == (doc, out, len(tokens), n)
        assert r.n_known == sum(w in words for w in tokens)
        assert r.score == pytest.approx(score, rel=1e-9)
        assert r.base_score == pytest.approx(sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens), rel=1e-9)


@pytest.mark.parametrize("least", [1, 2])
def test_probabilities_of_the_next_byte_sum_to_one(least):
    levels = learned([b"abracadabra", b"banana", b"cab"], least)
    for before in (b"\xff\xff\xff", b"abr", b"zna", b"zzz"):
        assert sum(10 ** next_byte(levels, before, b) for b in range(256)) == pytest.approx(1, rel=1e-9)


def test_rare_runs_count_in_more_than_eight_megabytes_of_training(spark, docs_of):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10]
    held = next(i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0)
    rare = "".join(map(chr, range(0x3B1, 0x3C9)))  # each context of five bytes stands once, each byte is half a count of one
    rows = [(i, "the same prose again. " * 4600) for i in ids[:90]] + [(ids[90], rare), (held, rare)]
    got = {r.doc_id: r.score for r in ppm.language_scores(docs_of(rows)).collect()}
    size = len(rare.encode()) + 1
    assert got[held] == pytest.approx(got[ids[90]]) and got[held] > size * math.log10(0.5) - 5


def test_index_finds_all_keys_and_nothing_else():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 5000).astype(np.uint64))
    index = ppm.Index(keys)
    assert (index.find(keys) == np.arange(len(keys))).all()
    assert (index.find(keys + np.uint64(1 << 50)) == -1).all()
    assert (ppm.Index(keys[:0]).find(keys[:9]) == -1).all()


def test_words_are_those_of_split_and_equal_words_alone_have_equal_hashes():
    rng = random.Random(7)
    made = [bytes(rng.choice(b"abABz \t\n\x0b\x0c\r\x00\x08\x0e\x1c\x85\xa0\xc3\xff") for _ in range(rng.randint(0, 90))) for _ in range(400)]
    made += [b"", b" ", b"a", b"a ", b" a", b"x" * 7, b"x" * 8, b"x" * 9, b"x" * 8 + b"\0", b"x" * 17, b"\0", b"\0\0", b"Word word WORD", b""]
    made += [b"ab " + c * n + e for c in (b"y", b"Y", b"yz") for n in (63, 64, 65, 66, 200, 1 << 20) for e in (b"", b"\0", b" c")]
    hashes, starts = ppm.words(made)
    want = [[*t.lower().split(), b""] for t in made]
    assert np.diff(starts, append=len(hashes)).tolist() == [len(w) for w in want]
    pairs = set(zip(hashes.tolist(), (w for own in want for w in own), strict=True))
    assert len(pairs) == len({w for own in want for w in own}) == len({h for h, _ in pairs})
    one = [ppm.words([t])[0].tolist() for t in made]
    assert [h for own in one for h in own] == hashes.tolist()


def test_features_are_ordered_once_and_by_the_group_first(spark, docs_of):
    parts = docs_of([(i, f"some words {i}") for i in range(30)]).selectExpr("0 AS part", "false AS held_out", "text")
    plan = ppm._features(parts, 5)
    seen = []

    def stored(df, name):
        if name == "sized":
            seen.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    with pytest.MonkeyPatch.context() as m:
        m.setattr(ppm, "stored", stored)
        m.setattr(ppm, "_features", lambda *_: plan)
        ppm._needs(parts, 5, None)
    sorts = [line for line in seen[0].splitlines() if "Sort [" in line]
    assert len(sorts) == 1 and "Sort [group" in sorts[0]


def test_empty_table_and_no_training(spark, docs_of):
    assert ppm.language_scores(docs_of([])).collect() == []
    row = ppm.language_scores(docs_of([(20, "ab")]) if zlib.crc32(b"20") % 10 == 0 else docs_of([(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10 == 0), "ab")])).first()
    assert row.held_out and row.score == pytest.approx(-3 * math.log10(256)) and row.base_score == pytest.approx(0)


def test_parts_grow_with_the_bytes_of_text_and_not_with_the_splits(spark, docs_of):
    docs = docs_of([(i, "é" * 500) for i in range(200)] + [(-1, None)]).coalesce(1)
    assert ppm.n_parts(docs, 1 << 24) == 12 and ppm.n_parts(docs, 2000) == 100
    assert ppm.n_parts(docs_of([]), 2000) == max(12, docs_of([]).rdd.getNumPartitions())


def test_features_go_out_in_small_batches_whatever_a_worker_holds(spark, monkeypatch):
    kept = ppm._features.__globals__
    seen = []

    class Parts:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            text = "".join(chr(97 + x % 26) + chr(97 + x // 26 % 26) + chr(97 + x // 676 % 26) + " " for x in range(3000))
            batch = ppm.pa.RecordBatch.from_pydict({"part": ppm.pa.array([0, 0, 1], ppm.pa.int32()), "held_out": [False, True, False], "text": [text, text, "ab ab"]})
            seen.extend(run(iter([batch])))

    for held, pending in ((1 << 22, 1 << 20), (1 << 22, 1), (1, 1)):
        seen.clear()
        monkeypatch.setitem(kept, "_SENT", 100)
        monkeypatch.setitem(kept, "_HELD", held)
        monkeypatch.setitem(kept, "_PENDING", pending)
        ppm._features(Parts(), 5)
        assert max(b.num_rows for b in seen) <= 100
        total = Counter()
        for b in seen:
            for r in b.to_pylist():
                total[r["part"], r["word"]] += r["n"]
        assert total == {(0, True): 3001, (0, False): 12001, (1, True): 3, (1, False): 6}
