"""Toxicity scores from a lexicon matched with misspellings, in context (operator 9).

The lexicon is learned from labelled documents. Its terms make a trie; the Levenshtein automaton of
the terms, that is the trie's nodes with the edits used so far, is run over each word and made
deterministic as it goes, so a word costs a look-up a letter. The words around a hit tell quotation
from abuse, and a logistic model over the counts gives the score.

Defined cases: a null or empty text has no hits and gets the score of a text without hits. Every row
gives a row, repeated ids included. A label that is null is no label; of several labels of a document
the highest counts. Without labels of both kinds the score is the share of toxic labels (0 if there is
none). Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_batches, sliced, stored

#: Marks and words that introduce what others said; words that address someone.
QUOTES = "\"“”„«»‹›"
REPORTS = frozenset("said says say called calls wrote writes quote quoted quotes word term sagte sagt nannte schrieb zitat wort dit disait écrit appelé mot dijo dice llamó escribió palabra".split())
ADDRESS = frozenset("you your you're youre u du dich dir ihr dein tu te toi vous ton usted tú ti eres".split())
#: Lengths of the word beginnings that can be terms.
STEMS = (4, 5, 6)
_STATES = 1 << 13
_WORDS = 1 << 18


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool  # stands for every word that begins so
    edits: int


class Matcher:
    """The lexicon's trie with up to ``edits`` edits, as an automaton that is determinised lazily.

    A state is the set of (node, edits used), least edits kept for each node. match(word) is (term,
    edits) of the best term, or None: a whole-word term at the word's end, a stem at any place.
    """

    def __init__(self, terms: list[Term]) -> None:
        self.terms, self.children, self.ends = terms, [{}], [[]]
        for i, term in enumerate(terms):
            node = 0
            for c in term.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                node = self.children[node][c]
            self.ends[node].append(i)
        self.most = max((t.edits for t in terms), default=0)
        # Edits still worth taking below a node: no term there allows more.
        self.below = [0] * len(self.children)
        for node in range(len(self.children) - 1, -1, -1):
            self.below[node] = max([terms[i].edits for i in self.ends[node]] + [self.below[x] for x in self.children[node].values()], default=0)
        self.reset()

    def reset(self) -> None:
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.stems: list[tuple | None] = []
        self.moves: list[dict[str, int]] = []
        self.start = self.add({0: 0})

    def add(self, state: dict[int, int]) -> int:
        """The number of a state, closed under letters of a term that the word leaves out; -1 if empty."""
        stack = list(state)
        while stack:
            node = stack.pop()
            for child in self.children[node].values():
                e = state[node] + 1
                if e <= self.below[child] and e < state.get(child, e + 1):
                    state[child] = e
                    stack.append(child)
        key = tuple(sorted(state.items()))
        if not key:
            return -1
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            self.stems.append(self.best(key, True))
        return self.number[key]

    def best(self, state: tuple, stem: bool) -> tuple[int, int] | None:
        found = [(e, i) for node, e in state for i in self.ends[node] if e <= self.terms[i].edits and self.terms[i].stem == stem]
        return min(found)[::-1] if found else None

    def move(self, number: int, c: str) -> int:
        new: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.below[node] and e < new.get(node, e + 1):
                new[node] = e

        for node, e in self.states[number]:
            put(node, e + 1)  # a letter too many
            for letter, child in self.children[node].items():
                put(child, e if letter == c else e + 1)
        to = self.moves[number][c] = self.add(new)
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        if len(self.states) > _STATES:
            self.reset()
        state, stem = self.start, self.stems[self.start]
        for c in word:
            to = self.moves[state].get(c)
            if to is None:
                to = self.move(state, c)
            if to < 0:
                return stem
            state = to
            if (found := self.stems[state]) and (stem is None or found[1] < stem[1]):
                stem = found
        whole = self.best(self.states[state], False)
        return min((x for x in (whole, stem) if x), key=lambda x: x[1], default=None)


def bare(word: str) -> str:
    """A lower-case word without what stands around its letters and digits."""
    i, j = 0, len(word)
    while i < j and not word[i].isalnum():
        i += 1
    while j > i and not word[j - 1].isalnum():
        j -= 1
    return word[i:j]


class Hits(dict):
    """The lexicon's match for a word as it stands in a text, remembered for a bounded number of words."""

    def __init__(self, terms: list[Term]) -> None:
        super().__init__()
        self.matcher = Matcher(terms)

    def __missing__(self, word: str) -> tuple[int, int] | None:
        if len(self) >= _WORDS:
            self.clear()
        found = self[word] = self.matcher.match(bare(word))
        return found


FEATURES = ("exact", "fuzzy", "exact_quoted", "fuzzy_quoted", "addressed", "distinct", "rate", "weight", "words")


def features(text: str | None, hits: Hits, weights: np.ndarray, window: int) -> list[float]:
    words = text.lower().split() if text else []
    found = [(i, m) for i, m in enumerate(map(hits.__getitem__, words)) if m is not None]
    counts = [0, 0, 0, 0]
    addressed, weight = 0, 0.0
    if found:
        # Number of quotation marks before each word: odd within a quotation.
        marks = np.cumsum([0] + [sum(map(w.count, QUOTES)) for w in words])
        for i, (term, edits) in found:
            around = set(map(bare, words[max(0, i - window) : i + window + 1]))
            near = marks[min(len(words), i + window + 1)] - marks[max(0, i - window)]
            quoted = bool((marks[i] % 2 or marks[i + 1] > marks[i]) and near >= 2) or not around.isdisjoint(REPORTS)
            counts[2 * quoted + (edits > 0)] += 1
            addressed += not quoted and not around.isdisjoint(ADDRESS)
            weight = max(weight, weights[term] if not edits else 0.0)
    exact, fuzzy, exact_quoted, fuzzy_quoted = map(float, np.log1p(counts))
    distinct = len({m[0] for _, m in found if not m[1]})
    return [exact, fuzzy, exact_quoted, fuzzy_quoted, float(np.log1p(addressed)), float(np.log1p(distinct)), min(1.0, 20 * counts[0] / max(1, len(words))), weight, float(np.log1p(len(words)))]


def remainder(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def training(docs: DataFrame, labels: DataFrame, sample: int, modulus: int, held: int) -> DataFrame:
    """text and toxic of at most sample labelled documents that are not held out: those whose hash is least."""
    known = labels.where(F.col("toxic").isNotNull() & (remainder(modulus) != held)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return rows.join(F.broadcast(chosen), "doc_id").select("text", "toxic")  # bounded by sample


def lexicon(train: DataFrame, size: int, support: int, precision: float, edits: int) -> tuple[list[Term], np.ndarray]:
    """At most size terms and their weights (log odds): words and beginnings of words that stand in at least
    support toxic documents and as many different surroundings (so that copies count once), nearly only there. Where toxic documents are few, 2 % of them but three at least are support."""

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            sums: dict[tuple, list[int]] = {}
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                words = [bare(w) for w in text.lower().split()] if text else []
                seen: dict[tuple, int] = {}
                for i, w in enumerate(words):
                    if len(w) < 3:
                        continue
                    mask = 0
                    if toxic:
                        mask = 1 << (xxhash.xxh3_64_intdigest("\0".join(words[max(0, i - 2) : i] + words[i + 1 : i + 3])) & 63)
                    for key in [(w, False)] + [(w[:n], True) for n in STEMS if len(w) > n]:
                        seen[key] = seen.get(key, 0) | mask
                for key, mask in seen.items():
                    s = sums.setdefault(key, [0, 0, 0])
                    s[0 if toxic else 1] += 1
                    s[2] |= mask
            return {
                "term": pa.array([k[0] for k in sums], pa.string()), "stem": pa.array([k[1] for k in sums], pa.bool_()),
                "n1": pa.array([s[0] for s in sums.values()], pa.int64()), "n0": pa.array([s[1] for s in sums.values()], pa.int64()),
                "mask": pa.array([s[2] - (1 << 64) * (s[2] >> 63) for s in sums.values()], pa.int64()),
            }

        return run

    part = map_batches(train, make, "term string, stem boolean, n1 long, n0 long, mask long")
    sums = part.groupBy("term", "stem").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.bit_count(F.bit_or("mask")).alias("places"))
    total = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return [], np.zeros(0)
    support = max(3, min(support, -(-total[1] // 50)))
    odds = F.log((F.col("n1") + 0.5) / (total[1] + 1.0)) - F.log((F.col("n0") + 0.5) / (total[0] + 1.0))
    pure = F.col("n1") / total[1] / (F.col("n1") / total[1] + (F.col("n0") + 0.5) / total[0])
    fit = sums.where((F.col("n1") >= support) & (F.col("places") >= support)).where(pure >= precision)
    z = odds / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    rows = fit.select("term", "stem", "n1", odds.alias("odds"), z.alias("z")).orderBy(F.desc("z"), "term", "stem").limit(size).collect()
    words = {r["term"]: r["n1"] for r in rows if not r["stem"]}
    kept: dict[str, float] = {}
    for r in sorted((r for r in rows if r["stem"]), key=lambda r: len(r["term"])):
        text = r["term"]
        longer = max((n for w, n in words.items() if w.startswith(text)), default=0)
        # A stem is a term of its own if it stands for more than one word, and no shorter one covers it.
        if r["n1"] >= 1.5 * longer and not any(text[:n] in kept for n in STEMS if n < len(text)):
            kept[text] = r["odds"]
    covered = lambda text: any(text[:n] in kept for n in STEMS)
    found = [(Term(r["term"], False, edits if len(r["term"]) >= 5 else 0), r["odds"]) for r in rows if not r["stem"] and not covered(r["term"])]
    found += [(Term(text, True, edits if len(text) >= 6 else 0), odds) for text, odds in kept.items()]
    return [t for t, _ in found], np.array([w for _, w in found])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic model with a ridge, by Newton's method; the last is the constant's."""
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (p - y) + keep * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    terms: list[Term]
    weights: np.ndarray
    coefficients: np.ndarray
    window: int


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, size: int = 2_000, support: int = 5, precision: float = 0.95, edits: int = 1, window: int = 6, modulus: int = 3, held: int = 1) -> Model:
    """Lexicon and classifier from at most sample labelled documents outside the held-out remainder.

    sample bounds what is learned from (and what comes to the driver: nine numbers a document);
    everything else covers all documents.
    """
    train = stored(training(docs, labels, sample, modulus, held), "train")
    terms, weights = lexicon(train, size, support, precision, edits)
    empty = Model(terms, weights, np.zeros(len(FEATURES) + 1), window)
    rows = _scored(train, empty, raw=True).toPandas()
    y = rows["toxic"].to_numpy(float) if len(rows) else np.zeros(0)
    if len(set(y)) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return Model(terms, weights, np.array([0.0] * len(FEATURES) + [np.log(max(share, 1e-12) / max(1 - share, 1e-12))]), window)
    return Model(terms, weights, fit_logistic(np.array(rows["x"].tolist()), y), window)


def _scored(docs: DataFrame, model: Model, raw: bool = False) -> DataFrame:
    plain = ([(t.text, t.stem, t.edits) for t in model.terms], model.weights, model.coefficients, model.window)
    shared = docs.sparkSession.sparkContext.broadcast(plain)  # bounded by the lexicon's size

    def make():
        terms, weights, coefficients, window = shared.value
        hits = Hits([Term(*t) for t in terms])

        def run(batch: pa.RecordBatch) -> dict:
            x = [features(t, hits, weights, window) for t in batch["text"].to_pylist()]
            if raw:
                return {"toxic": batch["toxic"], "x": pa.array(x, pa.list_(pa.float64()))}
            z = np.column_stack([np.array(x), np.ones(len(x))]) @ coefficients
            return {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))}

        return run

    return map_batches(docs, make, "toxic int, x array<double>" if raw else "doc_id long, held_out boolean, score double")


def score(docs: DataFrame, model: Model, threshold: float = 0.7, modulus: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; reads the documents once, without a shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(modulus) == held, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return _scored(rows, model).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """docs whose score is under the threshold, with all their columns."""
    plain = ([(t.text, t.stem, t.edits) for t in model.terms], model.weights, model.coefficients, model.window)
    shared = docs.sparkSession.sparkContext.broadcast(plain)  # bounded by the lexicon's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights, coefficients, window = shared.value
        hits = Hits([Term(*t) for t in terms])
        for batch in sliced(batches):
            z = np.array([[*features(t, hits, weights, window), 1.0] for t in batch[place].to_pylist()]) @ coefficients
            good = 1 / (1 + np.exp(-np.clip(z, -30, 30))) < threshold
            kept = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays(kept.columns[:place], names=kept.schema.names[:place])

    place = len(docs.columns)
    plain = docs.toDF(*[f"c{i}" for i in range(place)])  # the text as a string comes last, whatever the others are called
    return plain.withColumn("text", F.col(f"c{docs.columns.index('text')}").cast("string")).mapInArrow(run, docs.schema)
