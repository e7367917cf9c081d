"""Hard negatives of anchors by products in a residue number system (operator 11).

Components become integers floor(scale * x). Scores of anchors against rows are matrix products modulo
several small primes: residues lie within half a prime of zero, so that a product of 64 of them is exact
in float32; the exact signed scores come back by Chinese remaindering (mixed radix digits). As many primes
are used as the largest components of the two blocks need.

A first pass finds each anchor's best rows of its own label (its positives), within the label; a second
one finds, for each positive, the best rows of other labels whose score lies in its window. Both go
over all rows in blocks: anchors and rows of a pass are dealt over blocks, a task holds one block of
anchors and streams a part of the rows past it, in the order of their ids, with the best so far of
each anchor; Spark merges the parts. No group is gathered, whatever its label holds.

Defined cases: rows whose label or vector is null, or whose vector is empty or holds a null or
non-finite component, take no part. Vectors of different length have no score. Repeated rows are rows
of their own: each is an anchor, and another row's positive. A null id is never an anchor and comes last
among equal scores (ids lie below 2**63 - 1). Other columns are ignored. An empty table gives no rows.
A component beyond 2**24 after scaling, or vectors whose scores might reach 2**62, are refused (ValueError).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import fixed_point, map_batches, matrix, runs, stored

#: Components of a product that are added in float32, and the primes whose residues allow that many:
#: chunk * (p // 2) ** 2 + p stays below 2 ** 24.
CHUNK = 64
PRIMES = [p for p in range(1013, 970, -1) if all(p % q for q in range(2, 32))]
#: Components of a block of anchors, rows of the smallest part of rows, parts for each block of anchors.
_BLOCK, _PART, _PARTS = 1 << 20, 2048, 16
#: Anchors that are multiplied at a time.
_TILE = 256
_NONE = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p, within about half of p of zero. Exact below 2**24."""
    return x - p * np.rint(x * np.float32(1 / p))


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Integer components modulo p as float32 within half of p of zero."""
    r = x % p
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def primes_for(bound: int) -> list[int]:
    """As many primes as distinguish scores within +-bound, with room for digits that are off by one."""
    product = 1
    for i, p in enumerate(PRIMES):
        product *= p
        if product > 4 * bound and bound < 1 << 62:
            return PRIMES[: i + 1]
    raise ValueError("scores may leave 64 bits")


class Multiplier:
    """Exact scores of a block of anchors, whose residues are kept, with any rows."""

    def __init__(self, anchors: np.ndarray) -> None:
        self.anchors, self.most = anchors, int(np.abs(anchors.astype(np.int64)).max(initial=1))
        self.parts: dict[int, np.ndarray] = {}

    def scores(self, rows: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """(which anchors, their scores with the rows as int64), some anchors at a time."""
        d = rows.shape[1]
        primes = primes_for(d * self.most * int(np.abs(rows.astype(np.int64)).max(initial=1)))
        right = {p: np.ascontiguousarray(residues(rows, p).T) for p in primes}
        for p in primes:
            if p not in self.parts:
                self.parts[p] = residues(self.anchors, p)
        for i in range(0, len(self.anchors), _TILE):
            some = slice(i, i + _TILE)
            yield some, self._exact([self._product(self.parts[p][some], right[p], p) for p in primes], primes)

    @staticmethod
    def _product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
        out = balanced(a[:, :CHUNK] @ b[:CHUNK], p)
        for i in range(CHUNK, a.shape[1], CHUNK):
            out = balanced(out + balanced(a[:, i : i + CHUNK] @ b[i : i + CHUNK], p), p)
        return out

    @staticmethod
    def _exact(products: list[np.ndarray], primes: list[int]) -> np.ndarray:
        """Signed integers from their residues: digits to the bases of the primes, each near zero, then added up."""
        digits = []
        for x, p in zip(products, primes):
            for digit, q in zip(digits, primes):
                inverse = pow(q, -1, p)
                x = balanced(balanced(x - digit, p) * np.float32(inverse if inverse <= p // 2 else inverse - p), p)
            digits.append(x)
        out = digits[-1].astype(np.int64)
        for digit, p in zip(digits[-2::-1], primes[len(digits) - 2 :: -1]):
            out = out * p + digit.astype(np.int64)
        return out


class Best:
    """The best k scores so far with their ids, for each place of an array of any shape."""

    def __init__(self, shape: tuple[int, ...], k: int) -> None:
        self.k = k
        self.score, self.id = np.full((*shape, k), _NONE), np.full((*shape, k), _LAST)

    def add(self, at: tuple, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of rows whose ids rise and exceed all before; _NONE stands for no row. Changes scores."""
        if scores.max(initial=_NONE) == _NONE:
            return
        where = np.arange(len(scores))
        score, found = [self.score[at]], [self.id[at]]
        for _ in range(min(self.k, scores.shape[1])):
            column = scores.argmax(axis=1)  # the first, so the smallest id, of equal ones
            score.append(scores[where, column][:, None])
            found.append(ids[column][:, None])
            scores[where, column] = _NONE
        score, found = np.concatenate(score, axis=1), np.concatenate(found, axis=1)
        order = np.argsort(-np.maximum(score, -_LAST), axis=1, kind="stable")[:, : self.k]
        self.score[at], self.id[at] = np.take_along_axis(score, order, 1), np.take_along_axis(found, order, 1)

    def rows(self) -> tuple[np.ndarray, ...]:
        """Indices of the entries that hold a row."""
        return np.nonzero(self.score > _NONE)


def _nullable(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == _LAST)


def integer_rows(vectors: DataFrame, scale: int, anchor: Column) -> DataFrame:
    """row (a number of its own), id, label, d, is_anchor and v (int32 components) of the rows that take part."""

    def make():
        def run(batch: pa.RecordBatch) -> dict | None:
            found = list(fixed_point(batch["embedding"], scale, 1 << 24))
            if not found:
                return None
            rows = pa.array(np.concatenate([r for r, _ in found]))
            out = {k: batch[k].take(rows) for k in ("row", "id", "label", "is_anchor")}
            return out | {"d": np.concatenate([np.full(len(r), x.shape[1], np.int32) for r, x in found]), "v": pa.array([x.tobytes() for _, m in found for x in m], pa.binary())}

        return run

    chosen = vectors.where("label IS NOT NULL").select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("vec_id").cast("long"), F.lit(int(_LAST))).alias("id"), F.col("label").cast("long").alias("label"), F.coalesce(anchor & F.col("vec_id").isNotNull(), F.lit(False)).alias("is_anchor"), "embedding"
    )
    return map_batches(chosen, make, "row long, id long, label long, is_anchor boolean, d int, v binary")


def _dealt(anchors: DataFrame, rows: DataFrame, *group: str) -> DataFrame:
    """Anchors and rows of a group (columns) dealt over cells (group, i, j): a cell's anchors come first, then its rows by id.

    i: a block of anchors; j: a part of the rows. An anchor goes to every part, a row to every block.
    """
    held = anchors.groupBy(*group).agg(F.count("*").alias("a"))
    most = F.greatest(F.lit(_TILE), F.floor(F.lit(_BLOCK) / F.col("d")))
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n")).join(held, list(group)).withColumn("blocks", F.ceil(F.col("a") / most).cast("int"))
    sizes = sizes.select(*group, "blocks", F.least(F.ceil(F.col("n") / _PART), F.lit(_PARTS) * F.col("blocks")).cast("int").alias("parts"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = anchors.join(sizes, list(group)).withColumn("i", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).withColumn("j", each("parts")).withColumn("side", F.lit(0))
    right = rows.join(sizes, list(group)).withColumn("j", F.pmod(F.xxhash64("row", F.lit(1)), F.col("parts")).cast("int")).withColumn("i", each("blocks")).withColumn("side", F.lit(1))
    cell = [*group, "i", "j"]
    return left.unionByName(right, allowMissingColumns=True).repartition(*cell).sortWithinPartitions(*cell, "side", "id", "row")


def _stream(dealt: DataFrame, keys: list[str], cell: Callable[[pa.Table], "_Cell"], schema: str) -> DataFrame:
    """A cell object is made of each cell's anchors, is given the batches of its rows and yields its result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchors, current = None, [], None
        for (*now, side), part in runs(batches, *keys, "side"):
            if now != key:
                if current:
                    yield from current.result()
                key, anchors, current = now, [], None
            if side == 0:
                anchors.append(part)
                continue
            current = current or cell(pa.Table.from_batches(anchors).combine_chunks())
            current.add(part)
        if current:
            yield from current.result()

    return dealt.mapInArrow(run, schema)


class _Cell:
    """The anchors of a cell."""

    def __init__(self, anchors: pa.Table) -> None:
        self.row, self.label = anchors["row"].to_numpy(), anchors["label"].to_numpy()
        self.multiplier = Multiplier(matrix(anchors["v"]))


def _positives_of(k: int) -> Callable[[pa.Table], _Cell]:
    class Positives(_Cell):
        def __init__(self, anchors: pa.Table) -> None:
            super().__init__(anchors)
            self.best = Best((len(self.row),), k)
            self.order = np.argsort(self.row)

        def add(self, batch: pa.RecordBatch) -> None:
            ids, row = batch["id"].to_numpy(), batch["row"].to_numpy()
            at = np.minimum(np.searchsorted(self.row, row, sorter=self.order), len(self.row) - 1)
            own, column = self.order[at], np.arange(len(row))
            same = self.row[own] == row
            for some, scores in self.multiplier.scores(matrix(batch["v"])):
                mine = same & (own >= some.start) & (own < some.stop)
                scores[own[mine] - some.start, column[mine]] = _NONE  # itself
                self.best.add((some,), scores, ids)

        def result(self) -> Iterator[pa.RecordBatch]:
            a, r = self.best.rows()
            yield pa.RecordBatch.from_pydict({"row": self.row[a], "id": _nullable(self.best.id[a, r]), "score": self.best.score[a, r]})

    return Positives


def _negatives_of(k: int) -> Callable[[pa.Table], _Cell]:
    class Negatives(_Cell):
        def __init__(self, anchors: pa.Table) -> None:
            super().__init__(anchors)
            windows = anchors["windows"].to_pylist()
            self.most = max(map(len, windows))
            self.place = np.full((len(windows), self.most), -1)
            self.low, self.high = (np.full(self.place.shape, x) for x in (_LAST, _NONE))
            for i, w in enumerate(windows):
                for c, x in enumerate(w):
                    self.place[i, c], self.low[i, c], self.high[i, c] = x["place"], x["low"], x["high"]
            self.best = Best(self.place.shape, k)

        def add(self, batch: pa.RecordBatch) -> None:
            ids, label = batch["id"].to_numpy(), batch["label"].to_numpy()
            for some, scores in self.multiplier.scores(matrix(batch["v"])):
                scores[self.label[some][:, None] == label[None, :]] = _NONE
                for c in range(self.most):
                    inside = (scores <= self.high[some, c][:, None]) & (scores >= self.low[some, c][:, None])
                    if inside.any():
                        self.best.add((some, c), np.where(inside, scores, _NONE), ids)

        def result(self) -> Iterator[pa.RecordBatch]:
            a, c, r = self.best.rows()
            yield pa.RecordBatch.from_pydict({"row": self.row[a], "place": pa.array(self.place[a, c], pa.int32()), "id": _nullable(self.best.id[a, c, r]), "score": self.best.score[a, c, r]})

    return Negatives


def _first(found: DataFrame, key: list[str], k: int, name: str) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def mine(vectors: DataFrame, anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    vectors: vec_id, label (integer) and embedding; anchor says which rows are anchors. An anchor's positives
    are its best rows of the same label; a positive's negatives are the best rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score (0 <= low <= high <= 100).
    """
    rows = stored(integer_rows(vectors, scale, anchor), "rows")
    data = rows.select("row", "id", "label", "d", "v")
    anchors = rows.where("is_anchor").select("row", "id", "label", "d", "v")
    cells = _dealt(anchors, data, "d", "label")
    found = _stream(cells, ["d", "label", "i", "j"], _positives_of(positives), "row long, id long, score long")
    best = stored(_first(found, ["row"], positives, "place"), "positives")
    # A negative score has an empty window. Rounded inward without a product that could leave 64 bits.
    share = lambda percent: F.expr(f"score div 100 * {percent} + (score % 100 * {percent}) div 100")
    up = lambda percent: F.expr(f"score div 100 * {percent} + (score % 100 * {percent} + 99) div 100")
    window = F.struct("place", up(low).alias("low"), share(high).alias("high"))
    windows = best.where("score >= 0").groupBy("row").agg(F.collect_list(window).alias("windows"))  # a few for each anchor
    cells = _dealt(anchors.join(windows, "row"), data, "d")
    found = _stream(cells, ["d", "i", "j"], _negatives_of(negatives), "row long, place int, id long, score long")
    worst = _first(found, ["row", "place"], negatives, "rank").withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    named = best.withColumnsRenamed({"id": "positive_id", "score": "positive_score"}).join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
    return named.join(worst, ["row", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
