"""Refresh: change events between two snapshots of the same entities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.numeric import ratio
from .joins import aligned
from .rows import all_of, any_of, unfold, union_all

ORG = "organisation_number"


def _json(name: str, schema: T.DataType) -> Column:
    """A value as JSON text that compares by content. Callers sort lists before they get here."""
    c = F.col(name)
    if isinstance(schema, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return F.when(c.isNotNull(), c.cast("string"))


def diff(old: DataFrame, new: DataFrame, fields: Mapping[str, str] | Sequence[str], check: bool = True) -> DataFrame:
    """One row per changed field: old and new value, and the provenance of both sides.

    ``fields`` maps a change's name to its column. The provenance of a field named ``module.x`` is
    taken from the columns ``module_source_url``, ``module_retrieved_at``, ``module_effective_at`` and
    ``module_content_sha256`` where they exist. One join; the fields unfold inside the joined row.
    """
    fields = dict(fields) if isinstance(fields, Mapping) else {f: f for f in fields}
    both = aligned(old, new, check)
    none = F.lit(None).cast("string")

    def meta(side: str, field: str, name: str) -> Column:
        column = f"{field.split('.', 1)[0]}_{name}"
        return F.col(f"{side}.{column}") if column in new.columns else none

    items = []
    for order, (field, column) in enumerate(fields.items()):
        before, after = _json(f"o.{column}", old.schema[column].dataType), _json(f"n.{column}", new.schema[column].dataType)
        change = F.struct(
            F.lit(order).alias("field_order"), F.lit(field).alias("field"), before.alias("old_value"), after.alias("new_value"),
            meta("n", field, "source_url").alias("source_url"), meta("n", field, "retrieved_at").alias("retrieved_at"), meta("n", field, "effective_at").alias("effective_at"),
            meta("o", field, "content_sha256").alias("old_content_sha256"), meta("n", field, "content_sha256").alias("new_content_sha256"),
        )
        items.append(F.when(~before.eqNullSafe(after), change))
    return unfold(both, [ORG], F.array(*items), "c").select(ORG, "c.*")


def diff_in_order(old: DataFrame, new: DataFrame, fields: Mapping[str, str] | Sequence[str], check: bool = True) -> DataFrame:
    """Changes ordered by entity, then by the catalogue order of the fields."""
    return diff(old, new, fields, check).orderBy(ORG, "field_order")


def replay_report(changes: DataFrame, expected: DataFrame, repeat: DataFrame) -> DataFrame:
    """Precision and recall against expected changes, completeness of provenance, and idempotence.

    ``repeat`` is the diff of the new snapshot with itself. One grouping of all three by (entity, field).
    """
    key = [ORG, "field"]
    complete = all_of(*[F.col(c).isNotNull() for c in ("source_url", "retrieved_at", "effective_at", "old_content_sha256", "new_content_sha256")])
    marked = lambda df, e, o, full, again: df.select(*key, *[F.lit(x).cast("long").alias(n) if isinstance(x, int) else x.cast("long").alias(n) for n, x in (("e", e), ("o", o), ("full", full), ("again", again))])
    rows = union_all(marked(expected, 1, 0, 0, 0), marked(changes, 0, 1, complete, 0), marked(repeat, 0, 0, 0, 1))
    each = rows.groupBy(*key).agg((F.max("e") > 0).alias("e"), F.sum("o").alias("o"), F.sum("full").alias("full"), F.sum("again").alias("again"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    row = each.agg(
        F.count_if(F.col("e") & (F.col("o") > 0)).alias("true_positive"), F.count_if(~F.col("e") & (F.col("o") > 0)).alias("false_positive"),
        F.count_if(F.col("e") & (F.col("o") == 0)).alias("false_negative"), total("o").alias("observed_changes"), total("full").alias("__full"), (total("again") == 0).alias("idempotent_rerun"),
    )
    hit, n = F.col("true_positive"), F.col("observed_changes")
    row = row.withColumns({
        "precision": ratio(hit, hit + F.col("false_positive"), 1.0), "recall": ratio(hit, hit + F.col("false_negative"), 1.0),
        "evidence_complete": F.col("__full") == n, "evidence_share": ratio(F.col("__full"), n, 1.0),
    }).drop("__full")
    passed = (F.col("precision") >= 0.95) & (F.col("recall") >= 0.95) & F.col("evidence_complete") & F.col("idempotent_rerun")
    return row.withColumn("qualification_passed", passed)


# ---- stored snapshots ------------------------------------------------------------------

class Snapshot:
    """Rows of a snapshot by hash bucket, with a digest of each bucket.

    Buckets (leaves) lie in a fixed number of folders (parts), sorted within; a digest table of two levels says
    which parts, and in them which leaves, two snapshots differ in. Only these are read to compare them.
    """

    PARTS, LEAVES = 64, 64  # leaves in a part

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def write(cls, df: DataFrame, path: str, ignore: Sequence[str] = ()) -> Snapshot:
        """Store df, one row an entity. ignore: columns that differ between snapshots without a change, such as times of retrieval."""
        place = F.pmod(F.xxhash64(ORG), F.lit(cls.PARTS * cls.LEAVES)).cast("int")
        said = [F.to_json(F.struct(c)) if isinstance(df.schema[c].dataType, T.MapType) else F.col(c) for c in df.columns if c not in ignore]
        made = df.withColumn("__part", (place / cls.LEAVES).cast("int")).withColumn("__leaf", place).withColumn("__digest", F.xxhash64(*said, *[F.col(c).isNull() for c in df.columns if c not in ignore]))
        out = cls(df.sparkSession, path)
        made.repartitionByRange("__leaf").sortWithinPartitions("__part", "__leaf").write.partitionBy("__part").parquet(f"{out.path}/rows")
        stored = out.spark.read.parquet(f"{out.path}/rows")
        leaves = stored.groupBy("__part", "__leaf").agg(F.count("*").alias("n"), F.bit_xor("__digest").alias("x"), F.sum(F.col("__digest").cast("decimal(38,0)")).alias("s"))
        leaves.write.parquet(f"{out.path}/digests")
        return out

    def rows(self, leaves: Sequence[int] | None = None) -> DataFrame:
        """All rows, or those of some leaves: only their folders are read."""
        df = self.spark.read.parquet(f"{self.path}/rows")
        if leaves is not None:
            df = df.where(F.col("__part").isin(sorted({i // self.LEAVES for i in leaves})) & F.col("__leaf").isin(list(leaves)))
        return df.drop("__part", "__leaf", "__digest")

    def unequal(self, other: Snapshot) -> list[int]:
        """Leaves in which the two differ: first the parts, then the leaves of those. There are at most PARTS * LEAVES."""
        mine, theirs = (s.spark.read.parquet(f"{s.path}/digests") for s in (self, other))
        whole = lambda df: df.groupBy("__part").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.sum("s").alias("s"))
        differ = lambda a, b, key: [r[0] for r in a.join(b, key, "full_outer").where(any_of(*[~a[c].eqNullSafe(b[c]) for c in ("n", "x", "s")])).select(key).collect()]
        parts = differ(whole(mine), whole(theirs), "__part")
        if not parts:
            return []
        inside = lambda df: df.where(F.col("__part").isin(parts)).drop("__part")
        return sorted(differ(inside(mine), inside(theirs), "__leaf"))


def diff_snapshots(old: Snapshot, new: Snapshot, fields: Mapping[str, str] | Sequence[str], check: bool = True) -> DataFrame:
    """The diff of two stored snapshots, from the buckets in which they differ alone."""
    leaves = old.unequal(new)
    return diff(old.rows(leaves), new.rows(leaves), fields, check)
