"""Benchmark decontamination by spaced-seed hashing (operator 10).

A seed is a fixed mask over a run of words that ignores some positions, so a hash of the masked run
survives substitutions there. Hashes of test items and of documents are joined; each hit gives a
diagonal (place in the document less place in the item), and along it the longest stretch that stays
alike under substitutions is measured.

Defined cases: words are runs of bytes other than white space and ASCII punctuation, ASCII letters
lower-cased. A null or empty text, of a document or an item, matches nothing; so does an item shorter
than the shortest seed. Rows of a repeated doc_id are separate documents, told apart by their text;
equal ones are one. A null id is an id. Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WordHashes, as_bytes, bit_table, map_batches, mixed, passes, stored

#: The seeds. 1 compares a word, 0 ignores it. The first is a plain run; the others
#: tolerate single and neighbouring substitutions at different places.
SEEDS = ("111111", "1101101011", "1110010111", "101100110101")
_CLEAN = bytes(range(65, 91)) + b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN = bytes.maketrans(_CLEAN, bytes(range(97, 123)) + b" " * (len(_CLEAN) - 26))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_PLAIN).split() if text else []


def seed_hashes(words: np.ndarray, seed: str, number: int) -> np.ndarray:
    """A hash of the masked run at each place where it fits."""
    n = len(words) - len(seed) + 1
    if n <= 0:
        return words[:0]
    out = np.full(n, np.uint64(number + 1))
    for i, bit in enumerate(seed):
        if bit == "1":
            out = (out ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return mixed(out)


def item_seeds(items: DataFrame, seeds: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(item_id, words: their hashes) and (hash, item_id, at) of all items."""

    def make():
        memo = WordHashes()

        def run(batch: pa.RecordBatch) -> dict:
            words = [memo.of(words_of(t)) for t in as_bytes(batch["text"])]
            return {"item_id": batch["item_id"], "words": pa.array([w.tobytes() for w in words], pa.binary())}

        return run

    chosen = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropDuplicates()
    known = stored(map_batches(chosen, make, "item_id long, words binary"), "items").withColumn("item", F.xxhash64("item_id", "words"))

    def make_seeds():
        def run(batch: pa.RecordBatch) -> dict:
            keys, item, at = [], [], []
            for i, w in zip(batch["item"].to_pylist(), batch["words"].to_pylist()):
                w = np.frombuffer(w, np.uint64)
                for k, seed in enumerate(seeds):
                    h = seed_hashes(w, seed, k)
                    keys.append(h)
                    item += [i] * len(h)
                    at.append(np.arange(len(h), dtype=np.int32))
            return {"hash": pa.array(np.concatenate(keys).view(np.int64)), "item": pa.array(item, pa.int64()), "at": pa.array(np.concatenate(at))}

        return run

    return known, stored(map_batches(known.select("item", "words"), make_seeds, "hash long, item long, at int"), "seeds")


def document_hits(docs: DataFrame, table: np.ndarray, seeds: tuple[str, ...]) -> DataFrame:
    """doc_id, h, words and hits (hash, at) of the documents with a hash that the filter lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(table))  # 2 MB

    def make():
        bits, memo = np.unpackbits(shared.value).view(bool), WordHashes()

        def run(batch: pa.RecordBatch) -> dict | None:
            rows, words, hits = [], [], []
            for r, text in enumerate(as_bytes(batch["text"])):
                w = memo.of(words_of(text))
                found = []
                for k, seed in enumerate(seeds):
                    h = seed_hashes(w, seed, k)
                    at = np.flatnonzero(passes(bits, h))
                    found += zip(h[at].view(np.int64).tolist(), at.tolist())
                if found:
                    rows.append(r)
                    words.append(w.tobytes())
                    hits.append([{"hash": h, "at": a} for h, a in found])
            if not rows:
                return None
            take = pa.array(rows)
            return {"doc_id": batch["doc_id"].take(take), "h": batch["h"].take(take), "words": pa.array(words, pa.binary()), "hits": pa.array(hits, pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32())])))}

        return run

    text = F.col("text").cast("string")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("h"), text.alias("text"))
    return map_batches(chosen, make, "doc_id long, h long, words binary, hits array<struct<hash:long,at:int>>")


def best_stretch(same: np.ndarray, penalty: float) -> tuple[int, int]:
    """(start, end) of the stretch with the largest (words alike) - penalty * (words not alike)."""
    sums = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0, -penalty))])
    low = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - low))
    return int(np.argmin(sums[: end + 1])), end


def contaminated(docs: DataFrame, items: DataFrame, seeds: tuple[str, ...] = SEEDS, min_words: int = 10, min_share: float = 0.5, penalty: float = 2.0) -> DataFrame:
    """Verified overlaps: doc_id, h, item_id, start, end (words of the document), item_start, alike, share.

    Kept is, for each document and item, the best stretch of all its diagonals, if it has at least
    min_words equal words and covers min_share of the item's words; words in it may differ at a
    cost of penalty equal ones. Only the filter's bits (2 MB) are broadcast; the join of hashes is
    Spark's, whatever the size of the benchmark.
    """
    known, seeded = item_seeds(items, seeds)
    found = stored(document_hits(docs, bit_table(seeded.select("hash")), seeds), "hits").dropDuplicates(["doc_id", "h"])
    each = found.select("doc_id", "h", F.explode("hits").alias("x")).select("doc_id", "h", "x.hash", "x.at")
    diagonals = each.join(seeded.withColumnRenamed("at", "item_at"), "hash").select("doc_id", "h", "item", (F.col("at") - F.col("item_at")).alias("d")).distinct()
    pairs = diagonals.groupBy("doc_id", "h", "item").agg(F.collect_list("d").alias("d"))  # a document's own diagonals with one item
    same = [pairs.doc_id.eqNullSafe(found.doc_id), pairs.h == found.h]
    rows = pairs.join(found, same).select(pairs.doc_id, pairs.h, "item", "d", F.col("words").alias("doc_words")).join(known, "item")

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            out = []
            for doc, h, item, ds, w, v in zip(*(batch[k].to_pylist() for k in ("doc_id", "h", "item_id", "d", "doc_words", "words"))):
                w, v = np.frombuffer(w, np.uint64), np.frombuffer(v, np.uint64)
                best = (0, 0, 0, 0)
                for d in sorted(ds):
                    a, b = max(0, d), min(len(w), d + len(v))
                    same = w[a:b] == v[a - d : b - d]
                    s, e = best_stretch(same, penalty)
                    best = max(best, (int(same[s:e].sum()), -(a + s), a + e, a + s - d))
                alike, start, end, at = best
                if alike >= min_words and alike >= min_share * len(v):
                    out.append((doc, h, item, -start, end, at, alike, alike / len(v)))
            columns = list(zip(*out)) or [()] * 8
            kinds = [pa.int64()] * 7 + [pa.float64()]
            return {k: pa.array(c, t) for k, c, t in zip(("doc_id", "h", "item_id", "start", "end", "item_start", "alike", "share"), columns, kinds)}

        return run

    chosen = rows.select("doc_id", "h", "item_id", "d", "doc_words", "words")
    return map_batches(chosen, make, "doc_id long, h long, item_id long, start long, end long, item_start long, alike long, share double")


def without_benchmark(docs: DataFrame, items: DataFrame, **limits) -> DataFrame:
    """docs without the rows that overlap an item."""
    found = contaminated(docs, items, **limits).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct()
    text = F.col("text").cast("string")
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("doc_id").cast("long"), text) == F.col("__h")), "left_anti")
