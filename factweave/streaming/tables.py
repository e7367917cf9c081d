"""Tables that streams keep up to date by key: a base and the batches since, merged now and then."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


class UpsertTable:
    """Rows by key, of which the latest batch wins.

    A micro-batch is one folder and overwrites itself on a replay. When the batches since the last base
    outgrow ``share`` of it, base and batches are merged into a new base and what it replaces is removed:
    a read touches the base and at most that share of it, never the whole log, and each row is rewritten a
    bounded number of times. A base counts once its _SUCCESS file is there, and says up to which batch it goes;
    a batch at or below that is not read, so a replay after a merge adds nothing.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], share: float = 0.5) -> None:
        self.spark, self.path, self.keys, self.share = spark, path.rstrip("/"), list(keys), share

    def _at(self, *parts: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _numbers(self, folder: str, prefix: str) -> list[int]:
        """Numbers of the finished folders ``prefix=number``."""
        fs, place = self._at(*([folder] if folder else []))
        names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
        found = [int(n.partition("=")[2]) for n in names if n.startswith(f"{prefix}=")]
        return sorted(n for n in found if fs.exists(self._at(*([folder] if folder else []), f"{prefix}={n}", "_SUCCESS")[1]))

    def _bytes(self, *parts: str) -> int:
        fs, place = self._at(*parts)
        return fs.getContentSummary(place).getLength()

    def state(self) -> tuple[int | None, list[int]]:
        """(last batch of the base or None, batches after it)."""
        base = max(self._numbers("base", "upto"), default=None)
        return base, [n for n in self._numbers("", "batch_id") if base is None or n > base]

    def write(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")
        self.compact()

    def read(self) -> DataFrame:
        """The last version of each key."""
        base, batches = self.state()
        parts = [self.spark.read.parquet(f"{self.path}/batch_id={n}").withColumn("__batch", F.lit(n)) for n in batches]
        if base is not None:
            parts.append(self.spark.read.parquet(f"{self.path}/base/upto={base}").withColumn("__batch", F.lit(base)))
        if not parts:
            raise ValueError(f"nothing has been written to {self.path}")
        if not batches:
            return parts[0].drop("__batch")
        log = parts[0]
        for part in parts[1:]:
            log = log.unionByName(part)
        rest = [c for c in log.columns if c not in self.keys and c != "__batch"]
        return log.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "__batch").alias("v")).select(*self.keys, "v.*")

    def compact(self) -> bool:
        """Merge if the batches have outgrown their share; says whether it did."""
        base, batches = self.state()
        grown = sum(self._bytes(f"batch_id={n}") for n in batches)
        if len(batches) < 2 or (base is not None and grown <= self.share * self._bytes("base", f"upto={base}")):
            return False
        self.read().write.mode("overwrite").parquet(f"{self.path}/base/upto={batches[-1]}")
        for n in self._numbers("", "batch_id"):
            if n <= batches[-1]:
                self._drop(f"batch_id={n}")
        if base is not None:
            self._drop("base", f"upto={base}")
        return True

    def _drop(self, *parts: str) -> None:
        fs, place = self._at(*parts)
        fs.delete(place, True)
