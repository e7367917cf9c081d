import random
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from factweave.llm import toxicity
from factweave.llm.toxicity import Matcher, Term


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(terms, word):
    found = []
    for i, t in enumerate(terms):
        d = min(distance(t.text, word[:n]) for n in range(len(word) + 1)) if t.stem else distance(t.text, word)
        if d <= t.edits:
            found.append((d, i))
    return min(found)[0] if found else None


WORDS = st.text(alphabet="abcé", min_size=1, max_size=8)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.builds(Term, WORDS, st.booleans(), st.integers(0, 2)), min_size=1, max_size=6), st.lists(WORDS, max_size=6))
def test_automaton_accepts_what_the_distance_allows(terms, words):
    matcher = Matcher(terms)
    for word in words + [t.text for t in terms] + [""]:
        got = matcher.match(word)
        assert (got[1] if got else None) == brute(terms, word)


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    plain = [f"word{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 40))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["scumbag", "moronic", "vexi" + rng.choice(["ta", "lo", "rum", "na"])]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark, docs_of):
    docs, labels = corpus()
    frame = spark.createDataFrame([*labels, (3, None, None), (7, 1, 0), (99_999, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels, toxicity.fit(docs_of(docs), frame, support=3)


def test_held_out_documents_are_told_apart(docs_of, fitted):
    docs, labels, model = fitted
    got = {r.doc_id: r for r in toxicity.score(docs_of(docs), model).collect()}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sorted(i for i in got if got[i].held_out) == held and len(held) > 100
    assert sum(got[i].predicted == labels[i][2] for i in held) >= 0.97 * len(held)
    assert {t.text for t in model.terms if t.stem} >= {"vexi"}


def test_misspellings_hit_and_quotation_is_told(fitted):
    model = fitted[2]
    hits = toxicity.Hits(model.terms)
    assert hits["scumbaag!"][1] == 1 and hits["Scumbag".lower()][1] == 0 and hits["word7"] is None
    value = dict(zip(toxicity.FEATURES, toxicity.features("you are a scumbag", hits, model.weights, 6)))
    quoted = dict(zip(toxicity.FEATURES, toxicity.features('he said "you are a scumbag" then', hits, model.weights, 6)))
    assert value["exact"] > 0 == value["exact_quoted"] and value["addressed"] > 0
    assert quoted["exact_quoted"] > 0 == quoted["exact"] and quoted["addressed"] == 0


def test_edges(spark, docs_of, fitted):
    docs, _, model = fitted
    rows = [(1, None), (2, ""), (3, "x " * 200_000), (None, "scumbag moronic scumbag"), (4, "word1"), (4, "word1")]
    got = toxicity.score(docs_of(rows), model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert next(r for r in got if r.doc_id is None).predicted == 1
    kept = toxicity.keep(docs_of(rows), model)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 4] and kept.columns == docs_of(rows).columns
    assert toxicity.score(docs_of([]), model).collect() == []
    none = toxicity.fit(docs_of(docs), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score(docs_of(rows), none).collect()} == {0}


def test_filter_keeps_columns_of_any_name(spark):
    rows = [(1, "you are a zogbar fool", 1), (2, "a kind word for all", 0)] * 20
    docs = spark.createDataFrame([(i, t, "x", "y") for i, (_, t, _) in enumerate(rows)], "doc_id long, text string, __text string, __scored string")
    labels = spark.createDataFrame([(i, 1, b) for i, (_, _, b) in enumerate(rows)], "doc_id long, quality int, toxic int")
    kept = toxicity.keep(docs, toxicity.fit(docs, labels), threshold=0.7)
    assert kept.columns == docs.columns and {r.text for r in kept.collect()} <= {t for _, t, _ in rows} and {(r["__text"], r["__scored"]) for r in kept.collect()} == {("x", "y")}
