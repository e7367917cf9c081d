"""Reproducible samples by hash rank.

The rank is the hash of a seed and the entity number, so a sample does not depend on input order,
partitioning or cluster. A sample may be of any size: a histogram of rank prefixes gives the bucket in which
the last drawn row lies, rows of later buckets go, and positions are those within a bucket plus the sizes of
the buckets before it. No task holds more than a bucket and the histogram.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ids import hash_rank
from ..functions.text import clean, text
from ..functions.url import site_host
from ..session import written
from .blocks import number_rows
from .gates import filer_eligible
from .rows import first_per_key, top_per_key

ORG = "organisation_number"

#: Leading hex digits of a rank that make its bucket: 65,536 buckets, whatever the input.
PREFIX = 4


def bucket(rank: Column | str) -> Column:
    return F.substring(rank, 1, PREFIX)


def first_k(df: DataFrame, k: int, buckets: Sequence[Column], order: Sequence[Column | str], position: str = "position") -> DataFrame:
    """The first k rows in an order, with their position.

    buckets: columns by which the order begins, at least as coarse as it is, and of few values (prefixes, turns, strata);
    their histogram is the only thing that one task sees whole.
    """
    names = [f"__b{i}" for i in range(len(buckets))]
    cut = df.withColumns(dict(zip(names, buckets)))
    earlier = Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(*names).agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    near = cut.join(sizes.where(F.col("__before") < k).drop("__n"), names)
    within = F.row_number().over(Window.partitionBy(*names).orderBy(*order)) - 1
    return near.withColumn(position, F.col("__before") + within).where(F.col(position) < k).drop(*names, "__before")


def _employee_band(employees: Column | str = "employees") -> Column:
    e = F.col(employees) if isinstance(employees, str) else employees
    return (
        F.when(e.isNull(), "missing").when(e == 0, "0").when(e < 5, "1-4").when(e < 20, "5-19").when(e < 100, "20-99").otherwise("100+")
    )


def stratum() -> Column:
    """Form, staff band, state and web presence."""
    form = F.when(F.col("legal_form").isin("AS", "ASA", "ENK"), F.col("legal_form")).otherwise("OTHER")
    state = F.when(F.col("bankrupt") | F.col("liquidating"), "adverse").otherwise("active")
    return F.concat_ws("|", form, _employee_band(), state, F.when(text("website") != "", "web").otherwise("no-web"))


def filer_stratum() -> Column:
    """Form, staff band, industry division, region and web presence."""
    filled = lambda c: F.coalesce(F.nullif(text(c), F.lit("")), F.lit("missing"))
    return F.concat_ws(
        "|", filled("legal_form"), _employee_band(), F.split_part(filled("industry_code"), F.lit("."), F.lit(1)),
        F.substring(filled("municipality_number"), 1, 2), F.when(text("website") != "", "web").otherwise("no-web"),
    )


def strata_counts(registry: DataFrame, key: Column | None = None) -> DataFrame:
    return registry.groupBy((stratum() if key is None else key).alias("stratum")).agg(F.count("*").alias("n"))


def _exclude(df: DataFrame, excluded: DataFrame | None, key: str = ORG) -> DataFrame:
    return df if excluded is None else df.join(excluded.select(key), key, "left_anti")


def extension_sample(registry: DataFrame, k: int, excluded: DataFrame | None = None, seed: int = 20260824) -> DataFrame:
    """The ``k`` entities of smallest hash rank that are not excluded."""
    ranked = _exclude(registry, excluded).withColumn("rank", hash_rank(seed, ORG))
    drawn = first_k(ranked, k, [bucket("rank")], ["rank", ORG]).drop("position")
    return drawn.withColumn("sample_slice", F.lit("extension")).withColumn("evaluation_split", F.lit("extension_holdout"))


def sample_digest(sample: DataFrame) -> DataFrame:
    """Size of a sample and the hash of its sorted numbers, which is one text by its definition: for samples that fit one task."""
    return sample.agg(
        F.count("*").alias("selected"), F.sha2(F.array_join(F.array_sort(F.collect_set(ORG)), "\n"), 256).alias("selected_sha256")
    )


def assign_splits(sample: DataFrame, k: int, order: Column) -> DataFrame:
    """Development, validation and held-out by position in ``order`` (a hash rank): 60, 20 and 20 per cent of ``k``."""
    placed = number_rows(sample.drop("position").withColumn("__order", order), [], bucket("__order"), ["__order", ORG]).drop("__order")
    development, validation = round(k * 0.6), round(k * 0.2)
    split = F.when(F.col("position") < development, "development").when(F.col("position") < development + validation, "validation").otherwise("held_out")
    return placed.withColumn("evaluation_split", split)


def filer_sample(
    registry: DataFrame, k: int, latest_year: str, preserved: DataFrame | None = None, excluded: DataFrame | None = None, seed: int = 20260825
) -> DataFrame:
    """Eligible filers: preserved entities first, the rest by hash rank, then split by a second hash."""
    eligible = _exclude(registry.where(filer_eligible(latest_year)), excluded)
    if preserved is None:
        marked = eligible.withColumn("__kept", F.lit(False))
    else:
        keep = preserved.select(ORG).distinct().withColumn("__p", F.lit(True))
        marked = eligible.join(keep, ORG, "left").withColumn("__kept", F.coalesce("__p", F.lit(False))).drop("__p")
    # one order for both groups: all preserved rows come before the others
    rank = F.when(F.col("__kept"), hash_rank(f"{seed}:preserved", ORG)).otherwise(hash_rank(seed, ORG))
    drawn = first_k(marked.withColumn("__rank", rank), k, [~F.col("__kept"), bucket("__rank")], ["__rank", ORG])
    out = assign_splits(written(drawn, "filers"), k, hash_rank(f"{seed}:order", ORG))
    slice_name = F.when(F.col("__kept"), "preserved_eligible").otherwise("financial_filer_population")
    return out.withColumn("sample_slice", slice_name).drop("__kept", "__rank")


def stratified_sample(registry: DataFrame, k: int, seed: int = 20260822) -> DataFrame:
    """Seven tenths by population hash rank, a minimum from each stratum, and a hash-ranked fill.

    No entity is drawn twice. The steps run over number, stratum and ranks alone, each written once;
    the drawn entities then meet their registry rows.
    """
    population_size = round(k * 0.7)
    stress = k - population_size
    ranks = registry.select(ORG, stratum().alias("stratum"), hash_rank(seed, ORG).alias("__rank"), hash_rank(f"{seed}:stress", ORG).alias("__srank"))
    base = written(ranks, "ranks")
    population = first_k(base, population_size, [bucket("__rank")], ["__rank", ORG]).select(ORG, F.lit(0).alias("__turn"))
    marked = written(base.join(population, ORG, "left"), "population")
    # at least one from each stratum, up to three while all strata together stay within the stress share
    strata = marked.groupBy("stratum").agg(F.lit(1).alias("__one")).withColumn("__strata", F.count("*").over(Window.partitionBy("__one")))
    minimum = F.greatest(F.lit(1), F.least(F.lit(3), F.floor(F.lit(stress) / F.col("__strata"))))
    first = top_per_key(marked.where("__turn IS NULL"), ["stratum"], ["__srank", ORG], 3, rank="__at")
    floor_rows = first.join(strata, "stratum").where(F.col("__at") <= minimum).select(ORG, F.lit(1).alias("__floor"))
    turned = written(marked.join(floor_rows, ORG, "left").withColumn("__turn", F.coalesce("__turn", "__floor")).drop("__floor"), "floor")
    fill = first_k(turned.where("__turn IS NULL"), stress, [bucket("__srank")], ["__srank", ORG]).drop("position").withColumn("__turn", F.lit(2))
    chosen = written(turned.where("__turn IS NOT NULL").unionByName(fill), "chosen")
    drawn = first_k(chosen, k, [F.col("__turn"), F.col("stratum"), bucket("__rank")], ["__rank", ORG])
    split = assign_splits(written(drawn.select(ORG, "stratum", "__turn"), "drawn"), k, hash_rank(seed, ORG))
    slices = split.withColumn("sample_slice", F.when(F.col("__turn") == 0, "population").otherwise("stress")).drop("__turn")
    return registry.join(slices, ORG)


def host_unique_sample(
    registry: DataFrame, k: int, excluded: DataFrame | None = None, excluded_hosts: DataFrame | None = None, seed: int = 20260823
) -> DataFrame:
    """The first ``k`` entities by hash rank whose website host no earlier one has."""
    seeded = _exclude(registry.where(clean("website") != ""), excluded)
    hosted = seeded.withColumn("host", site_host("website")).where("host <> ''").withColumn("rank", hash_rank(seed, ORG))
    if excluded_hosts is not None:
        hosted = hosted.join(excluded_hosts.select("host"), "host", "left_anti")
    one = first_per_key(hosted, ["host"], ["rank", ORG])
    drawn = first_k(one, k, [bucket("rank")], ["rank", ORG]).drop("position")
    return drawn.withColumn("sample_slice", F.lit("fresh_website_audit")).withColumn("evaluation_split", F.lit("independent_final"))


def entry_batch(registry: DataFrame, k: int = 1000, seed: int = 0) -> DataFrame:
    """An entry batch of at least a thousand entities, in number order."""
    if k < 1000:
        raise ValueError("an entry batch has at least 1000 entities")
    drawn = first_k(registry.withColumn("rank", hash_rank(seed, ORG)), k, [bucket("rank")], ["rank", ORG])
    return drawn.drop("rank", "position").orderBy(ORG)
