"""Exact rank statistics that no single task has to sort, in two passes over the data.

A mergeable quantile sketch per group (one aggregation, one row out) brackets every wanted rank between
values a known number of ranks below and above it. The second pass keeps only values inside the
brackets, counted by value, and counts what lies below; the wanted rank is then found by a running
count over the few values of a part of its bracket.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Rank:
    """A zero-based index in the sorted values, given their number, that lies within one of ``share`` times it."""

    share: float
    index: Callable[[Column], Column]


def nearest_rank(q: float) -> Rank:
    """The smallest value with at least the share ``q`` at or below it."""
    if not 0 <= q <= 1:
        raise ValueError("quantile must be between zero and one")
    return Rank(q, lambda n: F.greatest(F.ceil(F.lit(q) * n) - 1, F.lit(0)))


def scaled_index(q: float) -> Rank:
    """min(n - 1, int(q n))"""
    return Rank(q, lambda n: F.least(n - 1, F.floor(F.lit(q) * n)))


def inner_index(q: float) -> Rank:
    """min(n - 1, int((n - 1) q))"""
    return Rank(q, lambda n: F.least(n - 1, F.floor((n - 1) * F.lit(q))))


upper_middle = Rank(0.5, lambda n: F.floor(n / 2))
lower_middle = Rank(0.5, lambda n: F.floor((n - 1) / 2))

#: The sketch's error is at most 1 / ACCURACY of the ranks. A bracket goes MARGIN errors to either side and has PARTS parts.
ACCURACY = 50_000
MARGIN = 5
PARTS = 4
#: Groups of fewer rows are ordered whole: a bracket would hold only a few of their ranks.
SMALL = 4 * ACCURACY // MARGIN


def _brackets(data: DataFrame, keys: list[str], rules: Mapping[str, Rank]) -> DataFrame:
    """(keys, __n, __r): for each rule its name, index and the bounds of the parts of its bracket, ends open at the extremes."""
    width = MARGIN / ACCURACY
    shares = {k: [r.share + width * (2 * i / PARTS - 1) for i in range(PARTS + 1)] for k, r in rules.items()}
    flat = sorted({min(1.0, max(0.0, s)) for x in shares.values() for s in x})
    sketch = data.groupBy(*keys).agg(F.count("*").alias("__n"), F.percentile_approx("__v", flat, ACCURACY).alias("__q"))
    low, high = F.lit(float("-inf")), F.lit(float("nan"))  # Spark's order has NaN last

    def bound(share: float, i: int) -> Column:
        end = low if share <= 0 else high if share >= 1 else F.col("__q")[flat.index(share)]
        whole = low if i == 0 else high
        return F.when(F.col("__n") < SMALL, whole).otherwise(end)

    made = [F.struct(F.lit(k).alias("rule"), r.index(F.col("__n")).cast("long").alias("at"), F.array(*[bound(s, i) for i, s in enumerate(shares[k])]).alias("b")) for k, r in rules.items()]
    return sketch.select(*keys, "__n", F.array(*made).alias("__r"))


def rank_values(df: DataFrame, value: str, rules: Mapping[str, Rank], by: Sequence[str] = ()) -> DataFrame:
    """One row per group with n and the value at each rule's index."""
    keys = [*by] or ["__all"]
    data = df.where(F.col(value).isNotNull()).select(*(by or [F.lit(1).alias("__all")]), F.col(value).cast("double").alias("__v"))
    v = F.col("__v")
    # A value gives its part of the bracket a row of its own, and every later part a count of what is below it.
    part = lambda b: F.when(v < b[0], F.lit(-1)).when(v > b[PARTS], F.lit(PARTS)).otherwise(sum((v >= b[i]).cast("int") for i in range(1, PARTS)))
    told = F.transform("__r", lambda r: F.struct(r["rule"].alias("rule"), r["at"].alias("at"), part(r["b"]).alias("part")))
    own = lambda t, i: F.struct(t["rule"].alias("rule"), t["at"].alias("at"), i.alias("part"), F.when(i == t["part"], v).alias("v"))
    rows = F.flatten(F.transform(F.filter(told, lambda t: t["part"] < PARTS), lambda t: F.transform(F.sequence(F.greatest(t["part"], F.lit(0)), F.lit(PARTS - 1)), lambda i: own(t, i))))
    joined = data.join(_brackets(data, keys, rules), keys)
    place = [*keys, "__n", "rule", "at", "part"]
    counts = joined.select(*keys, "__n", F.explode(rows).alias("__e")).select(*keys, "__n", "__e.*").groupBy(*place, "v").agg(F.count("*").alias("__c"))
    upto = Window.partitionBy(*place).orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumn("__run", F.sum("__c").over(upto)).where("v IS NOT NULL AND at < __run AND at >= __run - __c")
    found = run.groupBy(*keys).agg(F.first("__n").alias("n"), *[F.max(F.when(F.col("rule") == k, F.col("v"))).alias(k) for k in rules])
    sure = {k: F.when(F.col(k).isNull(), F.raise_error(F.lit(f"rank {k} lies outside its bracket"))).otherwise(F.col(k)) for k in rules}
    return found.withColumns(sure).drop("__all")


def latency_summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """n, median, 95th percentile and maximum by nearest rank."""
    out = rank_values(df, value, {"p50": nearest_rank(0.5), "p95": nearest_rank(0.95), "max": nearest_rank(1.0)}, by)
    return out.select(*by, "n", *[F.round(c, 3).alias(c) for c in ("p50", "p95", "max")])


INDEX_RULES: dict[str, dict[str, Rank]] = {
    "batch": {"p50": upper_middle, "p95": scaled_index(0.95)},
    "search": {"p50": inner_index(0.5), "p95": inner_index(0.95)},
    "model": {"p50": lower_middle},
}


def index_percentiles(df: DataFrame, value: str, by: Sequence[str] = (), rules: Sequence[str] = tuple(INDEX_RULES)) -> DataFrame:
    """The percentile rules of the batch, search and model reports: a row for each group and rule, from one pair of passes."""
    wide = rank_values(df, value, {f"{rule}_{k}": r for rule in rules for k, r in INDEX_RULES[rule].items()}, by)
    one = lambda rule, k: (F.col(f"{rule}_{k}") if k in INDEX_RULES[rule] else F.lit(None).cast("double")).alias(k)
    long = F.inline(F.array(*[F.struct(F.lit(rule).alias("rule"), one(rule, "p50"), one(rule, "p95")) for rule in rules]))
    return wide.select(*by, "n", long)


def host_fairness(requests: DataFrame, host: str = "host") -> DataFrame:
    """Requests per host: hosts, median, 95th percentile, maximum."""
    per_host = requests.groupBy(host).agg(F.count("*").alias("requests"))
    out = latency_summary(per_host, "requests")
    return out.select(F.col("n").alias("domains"), *[F.col(c).alias(f"{c}_requests") for c in ("p50", "p95", "max")])


def medians(df: DataFrame, values: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Mean of the two middle values of each column, per group, from one pair of passes over all columns."""
    long = df.select(*by, F.inline(F.array(*[F.struct(F.lit(v).alias("__name"), F.col(v).cast("double").alias("__value")) for v in values])))
    middle = rank_values(long, "__value", {"__lo": lower_middle, "__hi": upper_middle}, [*by, "__name"])
    each = [F.max(F.when(F.col("__name") == v, (F.col("__lo") + F.col("__hi")) / 2)).alias(f"median_{v}") for v in values]
    return middle.groupBy(*by).agg(*each)
