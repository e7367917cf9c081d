"""Near-duplicate vectors by a pivot-permutation index (operator 5).

A vector is described by its nearest reference points (pivots), nearest first. Inverted lists hold the
vectors by two of their pivots; vectors that meet in a list share at least these two, and the count of
shared pivots decides which pairs are verified by cosine in double precision.

Defined cases: a vector that is null, empty, zero, or holds a null or non-finite component, or whose
label is null, links with nothing and is its own component. Vectors of different length or label are
never compared. Equal vectors of a label are one class: linked, and compared once. Every row gives a
row, repeated ids included; a null id takes part, but is never the smallest. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import components, map_batches, stored

#: Candidates looked at for each pivot, and the cosine that two pivots do not reach.
_CANDIDATES = 16
_APART = 0.85


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with the class of each or null, classes: cls, label, embedding, low, n)."""
    value = F.col("embedding").cast("array<double>")
    finite = ~F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.col("label").isNotNull() & finite & F.exists(value, lambda x: x != 0)
    plain = F.transform(value, lambda x: x + F.lit(0.0))  # one zero
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fit, F.xxhash64("label", plain)).alias("cls"), "label", plain.alias("embedding"))
    known = rows.where("cls IS NOT NULL").groupBy("cls", "label", "embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    return rows.select("vec_id", "cls"), known


def choose_pivots(classes: DataFrame, pivots: int) -> dict[int, np.ndarray]:
    """By vector length, as many unit vectors as pivots says, none near another.

    Candidates are the classes whose hash is least, _CANDIDATES for each pivot. In this order one is taken
    if its cosine with those before it is below _APART: a group of near copies would else hold its share of the pivots, and
    noise would pick among them. Directions drawn from the length alone fill up what is missing.
    """
    most = pivots * _CANDIDATES
    sized = classes.select("embedding", "cls", F.size("embedding").alias("d"))
    # A part by another hash that holds about four times as many rows goes to the ranking, whatever the input.
    part = sized.join(sized.groupBy("d").agg(F.count("*").alias("m")), "d").where(F.pmod(F.xxhash64("cls", F.lit(1)), F.lit(1 << 40)) * F.col("m") <= F.lit(4.0 * most * (1 << 40)))
    ranked = part.withColumn("r", F.row_number().over(Window.partitionBy("d").orderBy(F.xxhash64("cls"), "cls")))
    found: dict[int, list] = {}
    for row in ranked.where(F.col("r") <= most).collect():
        found.setdefault(row["d"], []).append((row["r"], row["embedding"]))
    return {d: _apart(_unit(np.array([v for _, v in sorted(x)])), pivots) for d, x in found.items()}


def _apart(candidates: np.ndarray, pivots: int) -> np.ndarray:
    made = _unit(np.random.default_rng(0).normal(size=(pivots, candidates.shape[1])))
    n = 0
    for v in candidates:
        if n < pivots and (made[:n] @ v < _APART).all():
            made[n] = v
            n += 1
    return made


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of any finite value stay finite
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def describe(classes: DataFrame, pivots: dict[int, np.ndarray], prefix: int) -> DataFrame:
    """classes with near: the prefix nearest pivots, nearest first (smaller number first on ties)."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)  # a fixed number of vectors

    def make():
        by = shared.value

        def run(batch: pa.RecordBatch) -> dict:
            near: list = [None] * batch.num_rows
            vectors = batch["embedding"].to_pylist()
            for d in set(map(len, vectors)):
                at = [i for i, v in enumerate(vectors) if len(v) == d]
                order = np.argsort(-np.round(_unit(np.array([vectors[i] for i in at])) @ by[d].T, 12), axis=1, kind="stable")[:, :prefix]
                for i, o in zip(at, order.tolist()):
                    near[i] = o
            return {"cls": batch["cls"], "label": batch["label"].cast(pa.string()), "embedding": batch["embedding"], "n": batch["n"], "near": pa.array(near, pa.list_(pa.int32()))}

        return run

    return map_batches(classes.select("cls", "label", "embedding", "n"), make, "cls long, label string, embedding array<double>, n long, near array<int>")


def _ragged(lists: pa.Array) -> Callable[[int, int], np.ndarray]:
    """Rows a to b of an array of lists, which have one length there, as a matrix."""
    ends, values = np.cumsum([0, *lists.value_lengths().to_pylist()]), lists.flatten().to_numpy()
    return lambda a, b: values[ends[a] : ends[b]].reshape(b - a, -1)


def _linked(dealt: DataFrame, threshold: float, shared: int, pivots: int) -> DataFrame:
    """Verified links within groups (list, i, j): cls, links (rows linked), to (a class of its component).

    A pair is counted in one list only: that of the two smallest pivots it shares.
    """

    def group(cls, block, n, p, q, i, j, near, vectors) -> tuple[np.ndarray, ...]:
        unit = _unit(vectors)
        has = np.zeros((len(cls), pivots), np.float32)
        np.put_along_axis(has, near, 1, axis=1)
        first = has[:, : q + 1]
        ok = (has @ has.T >= shared) & (first @ first.T == 2) & (unit @ unit.T >= threshold)
        np.fill_diagonal(ok, False)
        if i != j:
            ok &= block[:, None] != block[None, :]
        own = ok.any(axis=1)
        if not own.any():
            return ()
        ok, cls, n = ok[own][:, own], cls[own], n[own]
        root, last = np.arange(len(cls)), None
        while last is None or (root != last).any():
            last = root
            root = np.minimum(root, np.where(ok, root[None, :], len(cls)).min(axis=1))
        return cls, ok @ n, cls[root]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            c = {k: rows[k].to_numpy() for k in ("p", "q", "i", "j", "g", "cls", "block", "n")}
            vectors, near = (_ragged(rows[k].combine_chunks()) for k in ("embedding", "near"))
            change = np.flatnonzero((c["g"][1:] != c["g"][:-1]) | (c["i"][1:] != c["i"][:-1]) | (c["j"][1:] != c["j"][:-1])) + 1
            out = []
            for a, b in zip([0, *change], [*change, len(rows)]):
                if b - a > 1:
                    out.append(group(c["cls"][a:b], c["block"][a:b], c["n"][a:b], c["p"][a], c["q"][a], c["i"][a], c["j"][a], near(a, b), vectors(a, b)))
            out = [x for x in out if x]
            if out:
                yield pa.RecordBatch.from_pydict({"cls": np.concatenate([x[0] for x in out]), "links": np.concatenate([x[1] for x in out]).astype(np.int64), "to": np.concatenate([x[2] for x in out])})

        for batch in batches:
            held.append(batch)
            rows = pa.Table.from_batches(held)
            key = [rows[k].to_numpy() for k in ("g", "i", "j")]
            same = np.all([k == k[-1] for k in key], axis=0)
            cut = len(rows) - int(same[::-1].argmin()) if not same.all() else 0
            if cut:
                yield from solve(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
        if held:
            yield from solve(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "cls long, links long, to long")


def near_vectors(vectors: DataFrame, threshold: float = 0.98, pivots: int = 128, prefix: int = 5, shared: int = 2, block: int = 512) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest id reachable) and kept.

    pivots: number of reference points, chosen apart from each other; every vector is indexed. Links are the pairs of
    one label that share at least ``shared`` (two or more) of their ``prefix`` nearest pivots and reach
    the cosine; not every such pair shares them (README has the recall measured). A long list is compared in
    blocks of about ``block`` vectors, a group for each two blocks, so no list is ever gathered.
    """
    if shared < 2:
        raise ValueError("lists are by two pivots: shared is 2 or more")
    rows, classes = _classes(vectors)
    classes = stored(classes, "classes")
    near = stored(describe(classes, choose_pivots(classes, pivots), prefix), "near")
    two = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("p"), b.alias("q")))))
    lists = near.select("cls", "label", F.size("embedding").alias("d"), F.array_sort("near").alias("s")).select("cls", "label", "d", F.explode(two).alias("k")).select("cls", "label", "d", "k.p", "k.q")
    key = ["label", "d", "p", "q"]
    blocks = lists.groupBy(*key).agg(F.count("*").alias("m")).where("m > 1").select(*key, F.ceil(F.col("m") / block).cast("int").alias("b"))
    member = lists.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("b")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    group = member.select("cls", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "p", "q", F.xxhash64(*key).alias("g"))
    dealt = group.join(near.select("cls", "n", "near", "embedding"), "cls").repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "block", "cls")
    links = stored(_linked(dealt, threshold, shared, pivots), "links")
    joined = components(links.where("cls <> to").select(F.col("cls").alias("a"), F.col("to").alias("b")))
    found = classes.select("cls", "low", "n").join(links.groupBy("cls").agg(F.sum("links").alias("links")), "cls", "left").join(joined.withColumnRenamed("id", "cls"), "cls", "left")
    found = found.withColumn("component", F.coalesce("component", "cls")).withColumn("n_links", F.col("n") - 1 + F.coalesce("links", F.lit(0)))
    least = found.groupBy("component").agg(F.min("low").alias("component_id"))
    named = found.join(least, "component").select("cls", "n_links", "component_id")
    out = rows.join(named, "cls", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
