"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard (operator 1).

One permutation of the hash universe scatters the shingles, a second one, shifted by k, gives
signature coordinate k; two permutations thus make the whole signature. Bands of coordinates find
candidates, and every link is confirmed on the full shingle sets.

Defined cases: words are maximal runs of bytes other than space and \\t\\n\\v\\f\\r, ASCII letters
lower-cased. A null or blank text has no shingles and links with nothing; a text of fewer words than
a shingle is one shingle. Documents with equal sets are one class and always linked. Every input row
gives an output row, repeated ids included; a null id takes part, but is never the smallest. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import WordHashes, as_bytes, components, map_batches, shingles, sliced, stars, stored

#: Odd multipliers of the two permutations of 32-bit numbers.
_SCATTER = (np.uint32(0x7FEB352D), np.uint32(0x846CA68B))
_ORDER = (np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))
#: Elements of one block of the shifted permutation; keeps it in the processor's cache.
_BLOCK = 1 << 17
#: Columns of the 0/1 matrices that are multiplied at a time.
_COLUMNS = 1 << 13


def _permute(x: np.ndarray, factors: tuple[np.uint32, np.uint32]) -> np.ndarray:
    """A bijection of 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= factors[0]
    x ^= x >> np.uint32(13)
    x *= factors[1]
    x ^= x >> np.uint32(16)
    return x


def signature(items: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash of a set of 64-bit hashes: coordinate k is the least p((s(x) + k) mod 2**32)."""
    scattered = _permute((items >> np.uint64(32)).astype(np.uint32) ^ items.astype(np.uint32), _SCATTER)
    shifts = np.arange(size, dtype=np.uint32)
    out = np.full(size, np.uint32(0xFFFFFFFF))
    step = max(1, _BLOCK // size)
    for i in range(0, len(scattered), step):
        np.minimum(out, _permute(scattered[i : i + step, None] + shifts[None, :], _ORDER).min(axis=0), out=out)
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, cls (128-bit hash of the set; null if empty) and band hashes."""

    def make():
        memo = WordHashes()

        def run(batch: pa.RecordBatch) -> dict:
            n, cls, band = [], [], []
            for text in as_bytes(batch["text"]):
                items = shingles(memo.of(text.lower().split()), words) if text else ()
                n.append(len(items))
                if not len(items):
                    cls.append(None)
                    band.append(None)
                    continue
                cls.append(xxhash.xxh3_128_digest(items.tobytes()))
                keys = np.empty((bands, rows + 1), np.uint32)
                keys[:, 0], keys[:, 1:] = np.arange(bands), signature(items, bands * rows).reshape(bands, rows)
                band.append([xxhash.xxh3_64_intdigest(k.tobytes()) - (1 << 63) for k in keys])
            return {"doc_id": batch["doc_id"], "h": batch["h"], "n_shingles": pa.array(n, pa.int64()), "cls": pa.array(cls, pa.binary()), "bands": pa.array(band, pa.list_(pa.int64()))}

        return run

    return map_batches(_rows(docs), make, "doc_id long, h long, n_shingles long, cls binary, bands array<long>")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("h"))


def _centred(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (c, m) whose full shingle sets reach the similarity, as (a, b)."""
    rows = stars(pairs, texts, "rep").select("c", "side", "rep", "text")

    def make():
        memo, held = WordHashes(), [None, None]

        def run(batch: pa.RecordBatch) -> dict:
            a, b = [], []
            for c, side, rep, text in zip(batch["c"].to_pylist(), batch["side"].to_pylist(), batch["rep"].to_pylist(), as_bytes(batch["text"])):
                items = shingles(memo.of(text.lower().split()), words)
                if side == 0:
                    held[:] = [c, items]
                    continue
                if held[0] != c:
                    raise ValueError(f"the row of centre {c} is missing")
                both = len(np.intersect1d(held[1], items, assume_unique=True))
                if 100 * both >= percent * (len(items) + len(held[1]) - both):
                    a.append(c)
                    b.append(rep)
            return {"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}

        return run

    return map_batches(rows, make, "a long, b long")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a block of sets: a product of 0/1 matrices, some columns at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    n = int(shared.sum())
    for first in range(0, n, _COLUMNS):
        a, b = np.searchsorted(column, (first, first + _COLUMNS))
        part = np.zeros((len(sets), min(_COLUMNS, n - first)), np.float32)
        part[owner[a:b], column[a:b] - first] = 1
        out += part @ part.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out  # exact below 2**24


def _blocks(groups: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) that connect what is alike within each group (component, i, j) of rep, text.

    A group has a bounded number of texts; it is the unit of work, and only links that join its parts
    are returned, so a group of n alike texts gives n - 1 rows.
    """
    dealt = groups.select("component", "i", "j", "rep", "text").repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "rep")

    def linked(reps: list[int], sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
        both = overlaps(sets)
        size = np.diag(both)
        alike = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        root, last = np.arange(len(reps)), None
        while last is None or (root != last).any():
            last = root
            root = np.minimum(root, np.where(alike, root[None, :], len(reps)).min(axis=1))
        at = np.flatnonzero(root != np.arange(len(reps)))
        return [reps[r] for r in root[at]], [reps[i] for i in at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, key, reps, sets = WordHashes(), None, [], []
        a, b = [], []
        for batch in sliced(batches):
            for c, i, j, rep, text in zip(*(batch[k].to_pylist() for k in range(4)), as_bytes(batch["text"])):
                if key != (c, i, j):
                    if len(reps) > 1:
                        for out, x in zip((a, b), linked(reps, sets)):
                            out += x
                    key, reps, sets = (c, i, j), [], []
                if not reps or reps[-1] != rep:  # a text may be on both sides of a group
                    reps.append(rep)
                    sets.append(shingles(memo.of(text.lower().split()), words))
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
            a, b = [], []
        if len(reps) > 1:
            a, b = linked(reps, sets)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 25, rows: int = 5, block: int = 256) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links) and kept, a row per row.

    docs: doc_id (integer), text. Links: 100 * |intersection| >= percent * |union| of the distinct
    shingles. A pair at similarity s is a candidate with probability 1 - (1 - s**rows)**bands: with 25
    bands of 5 rows 0.99995 at 0.8 and 0.9999995 at 0.85.

    Equal sets are one class, and only classes are compared. Each class of a bucket is tied to the
    bucket's smallest class, and what hangs together is a cluster: every candidate pair lies in one.
    Clusters of up to two blocks are verified as they are. In a larger one, all texts are first compared
    with one centre; the pairs left are those with a text unlike the centre, and they are verified in
    groups of a block of such texts and a block of the cluster. Sets are only ever compared in full.
    """
    out = _grouped(docs, words, percent, bands, rows, block).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _grouped(docs: DataFrame, words: int, percent: int, bands: int = 25, rows: int = 5, block: int = 256) -> DataFrame:
    """doc_id, h, n_shingles, group (a number of the component; null for an empty set) and component_id, a row per row."""
    made = stored(sketches(docs, words, bands, rows), "minhash")
    last = F.coalesce("doc_id", F.lit(2**63 - 1))
    cls = made.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("low"), F.min_by(F.struct("doc_id", "h", "bands"), F.struct(last, "h")).alias("s"))
    cls = stored(cls.select("cls", F.xxhash64("cls").alias("rep"), "low", "s.*"), "classes")
    buckets = cls.select("rep", F.explode("bands").alias("band"))
    heads = buckets.groupBy("band").agg(F.min("rep").alias("head"), F.count("*").alias("n")).where("n > 1").select("band", "head")
    cluster = components(buckets.join(heads, "band").where("head <> rep").select(F.col("head").alias("a"), F.col("rep").alias("b")))
    cluster = stored(cluster.withColumnRenamed("id", "rep"), "clusters")
    sizes = cluster.groupBy("component").agg(F.count("*").alias("n"))
    needed = cls.join(cluster.join(sizes, "component"), "rep").select("rep", "component", "n", F.col("doc_id").alias("id"), F.col("h").alias("th"))
    text = _rows(docs).where("text IS NOT NULL")
    texts = stored(text.join(needed, (text.h == needed.th) & text.doc_id.eqNullSafe(needed.id)).select("rep", "component", "n", "text").dropDuplicates(["rep"]), "texts")
    none = F.lit(0)
    small = texts.where(F.col("n") <= 2 * block).select("component", none.alias("i"), none.alias("j"), "rep", "text")
    large = texts.where(F.col("n") > 2 * block)
    if large.isEmpty():
        links = stored(_blocks(small, words, percent), "links")
    else:
        first = stored(_centred(large.where("rep <> component").select(F.col("component").alias("c"), F.col("rep").alias("m")), large.select("rep", "text"), words, percent), "links")
        rest = large.where("rep <> component").join(first.select(F.col("b").alias("rep")), "rep", "left_anti")
        parts = rest.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("is"), F.ceil(F.max("n") / block).cast("int").alias("js"))
        part = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(none, F.col(n) - 1))
        few = rest.join(parts, "component").select("component", part("is").alias("i"), every("js").alias("j"), "rep", "text")
        most = large.join(parts, "component").select("component", every("is").alias("i"), part("js").alias("j"), "rep", "text")
        links = stored(_blocks(small.unionByName(few).unionByName(most), words, percent).unionByName(first), "links")
    group = components(links)
    named = cls.select("cls", "rep", "low").join(group.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    out = made.select("doc_id", "h", "n_shingles", "cls").join(named.join(least, "component").select("cls", F.col("component").alias("group"), "component_id"), "cls", "left")
    whole = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "h", "n_shingles", "group", whole.alias("component_id"))


def first_of_group(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group: that of the smallest id (a null is the largest), then of the smallest text hash.

    Rows are known by id and text: another text under an id that goes stays, and of equal rows one stays. Rows
    without words are in no group and all stay.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # so that no column is called like those below
    doc, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    key = [F.coalesce(doc.cast("long"), F.lit(-(2**63))).alias("__id"), F.xxhash64(text.cast("string")).alias("__h")]
    rows = _grouped(docs, words, percent).where("group IS NOT NULL").select("group", "doc_id", F.col("h").alias("__h")).distinct()
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__h")).alias("first"))
    told = rows.join(first, "group").select(F.coalesce("doc_id", F.lit(-(2**63))).alias("__id"), "__h", F.struct(F.col("doc_id").isNull(), "doc_id", "__h").eqNullSafe(F.col("first")).alias("__first"))
    marked = plain.select("*", *key).join(told, ["__id", "__h"], "left").where("__first IS NULL OR __first")
    at = F.row_number().over(Window.partitionBy("__id", "__h").orderBy(F.xxhash64(*plain.columns)))
    return marked.withColumn("__at", at).where("__first IS NULL OR __at = 1").select(*plain.columns).toDF(*docs.columns)
