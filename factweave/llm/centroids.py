"""Clustering vectors around centroids with a vantage-point tree (operator 12).

Components become integers floor(scale * x). Every round the centroids are built into a vantage-point
tree that goes to the workers; a vector finds its nearest centroid by best-first branch-and-bound: of
the nodes it has not looked at, the one with the least bound is next, as long as that bound does not
exceed the best distance so far (equality included, so that ties reach the centroid of smaller number).
Distances at nodes are exact integers; only bounds are rounded, and they are widened by more than
their rounding. Each task adds up its vectors, and Spark adds the tasks' sums; a round brings k rows of
sums to the driver.

Defined cases: vectors that are null, have another length than ``dims``, or hold a null or non-finite
component are left out. Repeated rows are vectors of their own. A null id is assigned like any other,
but never starts a centroid. Fewer vectors with an id than k give fewer centroids; a centroid without
vectors stays. Other columns are ignored. An empty table gives no rows. A component beyond 2**27 after
scaling (less with more than 64 dimensions) is refused (ValueError), as squared distances might leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import fixed_point, map_batches, matrix, sliced, stored

#: By how much a bound is widened, as a share of the distances that it is made of; far above the rounding of a square root.
_SLACK = 1e-12
#: Entries of the table of bounds that a worker holds at a time.
_TABLE = 1 << 22


class Node(NamedTuple):
    """A centroid, and for each side its next node with the range of distances of all centroids there."""

    centroid: int
    sides: tuple[tuple[int, float, float], ...]


class VantageTree:
    """Centroids (rows of integers) by their distances to vantage points."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids.astype(np.int64)
        self.nodes: list[Node] = []
        if len(centroids):
            self._build(np.arange(len(centroids)))

    def _build(self, members: np.ndarray) -> int:
        """A node for members: the first is the vantage point, the rest are halved at the median distance from it."""
        place, point, rest = len(self.nodes), int(members[0]), members[1:]
        self.nodes.append(Node(point, ()))
        apart = np.sqrt(squared(self.centroids[rest], self.centroids[point]).astype(float))
        order = np.argsort(apart, kind="stable")
        half = len(rest) // 2
        sides = tuple((self._build(rest[part]), float(apart[part].min()), float(apart[part].max())) for part in (order[:half], order[half:]) if len(part))
        self.nodes[place] = Node(point, sides)
        return place

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, the smaller one on ties; squared distance) of each vector."""
        step = max(1, _TABLE // len(self.nodes))
        parts = [self._nearest(vectors[i : i + step].astype(np.int64)) for i in range(0, max(1, len(vectors)), step)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = len(vectors)
        bounds = np.full((m, len(self.nodes)), np.inf)  # of the nodes that a vector may still look at
        bounds[:, 0] = 0
        owner, best, radius = np.full(m, len(self.nodes)), np.full(m, np.iinfo(np.int64).max), np.full(m, np.inf)
        open_ = np.arange(m)
        while len(open_):
            node = bounds[open_].argmin(axis=1)
            low = bounds[open_, node]
            keep = (low <= radius[open_]) & (low < np.inf)
            open_, node, low = open_[keep], node[keep], low[keep]
            for k in np.unique(node):
                here = node == k
                rows, bound = open_[here], low[here]
                point, sides = self.nodes[k]
                exact = squared(vectors[rows], self.centroids[point])
                better = (exact < best[rows]) | ((exact == best[rows]) & (point < owner[rows]))
                owner[rows[better]], best[rows[better]] = point, exact[better]
                away = np.sqrt(exact.astype(float))
                radius[rows] = np.minimum(radius[rows], away)
                bounds[rows, k] = np.inf
                for child, least, most in sides:
                    gap = np.maximum(away - most, least - away) - _SLACK * (away + most)
                    bounds[rows, child] = np.maximum(bound, gap)
        return owner, best


def squared(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows from a point."""
    gap = rows - point
    return np.einsum("ij,ij->i", gap, gap)


def kept(vectors: DataFrame, scale: int, dims: int) -> DataFrame:
    """vec_id and v (int32 components) of the vectors that take part."""
    most = min(1 << 27, int((2**62 / dims) ** 0.5) // 2)

    def make():
        def run(batch: pa.RecordBatch) -> dict | None:
            for rows, ints in fixed_point(batch["embedding"], scale, most):
                if ints.shape[1] == dims:
                    return {"vec_id": batch["vec_id"].take(pa.array(rows)), "v": pa.array([x.tobytes() for x in ints], pa.binary())}
            return None

        return run

    sized = vectors.where(F.size("embedding") == dims)
    return map_batches(sized.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), make, "vec_id long, v binary")


def start(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose hash of seed and id is least, in this order."""
    named = vectors.where("vec_id IS NOT NULL").withColumn("h", F.sha2(F.concat_ws(":", F.lit(seed), "vec_id"), 256))
    rows = [r["v"] for r in named.orderBy("h", "vec_id", "v").limit(k).collect()]
    return np.array([np.frombuffer(v, np.int32) for v in rows], np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids as the componentwise floor of the mean of their vectors; those without vectors stay."""
    shared = vectors.sparkSession.sparkContext.broadcast(VantageTree(centroids))  # k vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        sums, counts = np.zeros(tree.centroids.shape, np.int64), np.zeros(len(tree.nodes), np.int64)
        for batch in sliced(batches):
            v = matrix(batch["v"])
            owner, _ = tree.nearest(v)
            order = np.argsort(owner, kind="stable")
            found, first = np.unique(owner[order], return_index=True)
            sums[found] += np.add.reduceat(v[order].astype(np.int64), first, axis=0)
            counts += np.bincount(owner, minlength=len(counts))
        some = np.flatnonzero(counts)
        totals = np.column_stack([counts, sums])[some]
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(some, pa.int32()), "totals": pa.array(list(totals), pa.list_(pa.int64()))})

    tasks = vectors.select("v").mapInArrow(run, "cluster int, totals array<long>")
    added = tasks.select("cluster", F.posexplode("totals").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x"))
    rows = added.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("t")).collect()  # k rows at most
    out = centroids.copy()
    for r in rows:
        n, *total = (x["x"] for x in r["t"])
        out[r["cluster"]] = [x // n for x in total]
    return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024, dims: int = 64) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector that takes part.

    vectors: vec_id and embedding. Starts from the k vectors of least hash of "seed:vec_id"; ends before
    all rounds are over when no centroid moves, as none would move again.
    """
    spark = vectors.sparkSession
    rows = stored(kept(vectors, scale, dims), "vectors")
    centroids = start(rows, k, seed)
    if not len(centroids):
        rows = rows.limit(0)
        centroids = np.zeros((1, dims), np.int64)
        rounds = 0
    for _ in range(rounds):
        last, centroids = centroids, moved(rows, centroids)
        if (last == centroids).all():
            break
    shared = spark.sparkContext.broadcast(VantageTree(centroids))

    def make():
        tree = shared.value

        def run(batch: pa.RecordBatch) -> dict:
            owner, best = tree.nearest(matrix(batch["v"]))
            return {"vec_id": batch["vec_id"], "cluster": owner.astype(np.int32), "distance": best}

        return run

    assigned = stored(map_batches(rows, make, "vec_id long, cluster int, distance long"), "assigned")
    wide = "decimal(38,0)"  # sums of many squares
    each = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast(wide)).alias("s"))
    total = each.agg(F.sum("s").alias("t"))
    names = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    named = each.join(spark.createDataFrame(names, "cluster int, centroid_sha256 string"), "cluster").crossJoin(F.broadcast(total))  # k rows by one
    facts = named.select("cluster", F.col("s").cast("long").alias("cluster_inertia"), F.col("t").cast("long").alias("inertia"), "centroid_sha256")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
