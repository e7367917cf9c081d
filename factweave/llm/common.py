"""Helpers shared by the corpus operators: tables, words, stored intermediates, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Distinct words whose hashes a Python worker remembers before it starts afresh.
MEMO = 1 << 18
#: Rows of a record batch that are turned into Python objects at a time.
ROWS = 1000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read from there.

    Cuts the lineage: a lost executor costs no more than the stage that reads the files. The
    folder is the one ``spark.checkpoint.dir`` names; only a session on one machine may lack it.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="factweave-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scan_parts(df: DataFrame) -> int:
    """Number of tasks that read df: grows with its bytes, whatever the session's settings are."""
    return max(1, df.rdd.getNumPartitions())


def sliced(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most so many rows, without a copy, so that few texts are Python objects at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | None]], schema: str, rows: int = ROWS) -> DataFrame:
    """df through a function of record batches of at most so many rows. make() is called once a task and gives the function,
    which returns columns by name in the order of schema (or None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in sliced(batches, rows):
            if (out := f(batch)) is not None:
                yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


class WordHashes(dict):
    """64-bit hash of a word, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (two rounds of xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of size words; of the whole sequence if it is shorter."""
    size = min(size, len(words))
    if not size:
        return words[:0]
    n = len(words) - size + 1
    out = np.full(n, np.uint64(size))
    for i in range(size):
        out = mixed(out * _ODD + words[i : i + n])
    return np.unique(out)


def binary_rows(parts: Iterable[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in parts], pa.binary())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id in edges; component is the smallest id reachable.

    Every vertex joins its smallest neighbour and the graph is contracted, until no edge is left.
    The first rounds order by id (groups linked to their smallest member end there), later ones by
    a hash that changes with the round, so that long chains shrink by a constant share. All of it
    stays distributed; only "is it empty" comes to the driver.
    """
    cur = stored(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct(), "edges")
    steps: list[DataFrame] = []
    while not cur.isEmpty():
        both = cur.select(F.col("a").alias("v"), F.col("b").alias("n")).unionByName(cur.select(F.col("b").alias("v"), F.col("a").alias("n")))
        rank = (lambda c: F.col(c)) if len(steps) < 2 else (lambda c, k=len(steps): F.xxhash64(F.lit(k), F.col(c)))
        least = both.groupBy("v").agg(F.min(F.struct(rank("n").alias("r"), F.col("n").alias("id"))).alias("m"))
        step = stored(least.select("v", F.least("m", F.struct(rank("v").alias("r"), F.col("v").alias("id")))["id"].alias("root")), "step")
        steps.append(step)
        ends = cur
        for end in ("a", "b"):
            ends = ends.join(step.select(F.col("v").alias(end), F.col("root").alias(f"r{end}")), end)
        cur = stored(ends.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a <> b").distinct(), "edges")
    if not steps:
        kind = cur.schema["a"].dataType
        return cur.select(F.col("a").alias("id"), F.col("b").cast(kind).alias("component"))
    out = steps[0]
    for step in steps[1:]:
        out = out.join(step.select(F.col("v").alias("root"), F.col("root").alias("next")), "root", "left").select("v", F.coalesce("next", "root").alias("root"))
    if len(steps) > 2:
        out = stored(out, "roots")
        out = out.join(out.groupBy("root").agg(F.min("v").alias("least")), "root").select("v", F.col("least").alias("root"))
    return out.select(F.col("v").alias("id"), F.col("root").alias("component"))


def stars(pairs: DataFrame, rows: DataFrame, key: str, *order: str, chunk: int = 1000) -> DataFrame:
    """Rows of centres and members, dealt so that a task streams a centre's row before its members.

    pairs: (c, m). rows: key and payload columns; of several rows of a key, order gives their order. A centre with many members is
    dealt over several groups of about chunk members, each with its own copy of the centre's row;
    no group is gathered. Returns c, part, side (0 centre, 1 member), key and payload, partitioned
    by (c, part) and sorted by (c, part, side, key).
    """
    pairs = pairs.select("c", "m").distinct()
    parts = pairs.groupBy("c").agg(F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("n"))
    member = pairs.join(parts, "c").select("c", F.pmod(F.xxhash64("m"), F.col("n")).cast("int").alias("part"), F.lit(1).alias("side"), F.col("m").alias(key))
    centre = parts.select("c", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part")).select("c", "part", F.lit(0).alias("side"), F.col("c").alias(key))
    return member.unionByName(centre).join(rows, key).repartition("c", "part").sortWithinPartitions("c", "part", "side", key, *order)


#: Bits of the filters that workers get: 2 MB, whatever the input.
FILTER_BITS = 24


def bit_table(hashes: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter of 2**bits bits over the long column hash, two bits of it each. What it lets
    through by chance, a join drops later; only its fixed size is collected and broadcast."""
    places = [F.call_function("shiftrightunsigned", "hash", F.lit(k * bits)).bitwiseAND(F.lit((1 << bits) - 1).cast("long")) for k in range(2)]
    each = hashes.select(F.explode(F.array(*places)).alias("bit"))
    mask = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int")))
    rows = each.groupBy(F.floor(F.col("bit") / 64).cast("int").alias("w")).agg(mask.alias("b")).toPandas()  # 2**(bits - 6) rows at most
    table = np.zeros((1 << bits) // 64, np.uint64)
    table[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64).view(np.uint64)
    return np.unpackbits(table.view(np.uint8), bitorder="little").view(bool)


def passes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the 64-bit hashes the filter lets through."""
    bits, mask = np.uint64(len(table).bit_length() - 1), np.uint64(len(table) - 1)
    return table[(hashes & mask).astype(np.int64)] & table[(hashes >> bits & mask).astype(np.int64)]


def runs(batches: Iterable[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The batches cut where a key changes, each part with its keys (integers without nulls)."""
    for batch in sliced(batches):
        columns = [batch[k].to_numpy() for k in keys]
        changed = np.zeros(max(0, batch.num_rows - 1), bool)
        for c in columns:
            changed |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield tuple(int(c[a]) for c in columns), batch.slice(a, b - a)


def fixed_point(column: pa.Array, scale: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, floor(scale * x) of their components as int32) by vector length, for vectors that are neither
    null nor empty and hold only finite components. Raises ValueError beyond +-most, where sums would not stay exact."""
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null vectors have no values here
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == d)
        x = values[starts[rows][:, None] + np.arange(d)]
        fit = np.isfinite(x).all(axis=1)
        ints = np.floor(scale * x[fit])
        if ints.size and np.abs(ints).max() > most:
            raise ValueError(f"a component times {scale} exceeds {most}: scores would not stay exact in 64 bits")
        yield rows[fit], ints.astype(np.int32)


def matrix(column: pa.Array) -> np.ndarray:
    """int32 rows of equal length, kept as binary, as a matrix."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.int32).reshape(len(rows), -1)
