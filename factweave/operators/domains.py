"""Registered domains under a table of public-suffix rules.

A rule is a suffix ("co.uk"), a wildcard ("*.ck": any one label before ck) or an exception to one ("!www.ck").
The longest rule that a host ends with gives its suffix, an exception goes before all, and a host
that no rule matches has its last label as suffix. The registered domain is the suffix with one label more.

Every host is looked at once: its endings (one for each label) meet the rules in an equi join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import text
from ..functions.url import raw_host


def suffix_rules(lines: DataFrame, column: str = "rule") -> DataFrame:
    """(base, plain, wild, exception) from lines in the public list's format; comments and blank lines are left out."""
    rule = F.lower(F.regexp_extract(text(column), r"^\s*(\S*)", 1))
    kept = lines.select(rule.alias("r")).where("r <> '' AND NOT startswith(r, '//')")
    parts = kept.select(F.regexp_replace("r", r"^(\*\.|!|\.)", "").alias("base"), F.col("r").startswith("*.").alias("w"), F.col("r").startswith("!").alias("e"))
    return parts.groupBy("base").agg(F.max(~F.col("w") & ~F.col("e")).alias("plain"), F.max("w").alias("wild"), F.max("e").alias("exception"))


def _ending(labels: Column, k: Column) -> Column:
    n = F.size(labels)
    return F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")


def host_domains(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, domain) of distinct hosts; the domain is empty if the host is a suffix itself."""
    labels = F.split(F.rtrim("host", F.lit(".")), r"\.")
    split = hosts.select("host", labels.alias("labels"), F.size(labels).alias("n"))
    endings = split.select("host", "n", "labels", F.explode(F.sequence(F.lit(1), "n")).alias("k")).select("host", "n", "k", _ending(F.col("labels"), F.col("k")).alias("base"))
    matched = endings.join(rules, "base").groupBy("host").agg(
        F.max(F.when(F.col("exception"), F.col("k") - 1)).alias("spared"),
        F.max(F.greatest(F.when(F.col("plain"), F.col("k")), F.when(F.col("wild") & (F.col("k") < F.col("n")), F.col("k") + 1))).alias("longest"),
    )
    size = F.coalesce("spared", "longest", F.lit(1))
    found = split.join(matched, "host", "left").withColumn("size", size)
    return found.select("host", F.when(F.col("n") > F.col("size"), _ending(F.col("labels"), F.col("size") + 1)).otherwise(F.lit("")).alias("domain"))


def with_domains(df: DataFrame, urls: Sequence[str], rules: DataFrame) -> DataFrame:
    """df with ``<url>_domain`` for each URL column. A URL without a host has an empty domain."""
    hosts = {c: f"__{c}_host" for c in urls}
    told = df.withColumns({h: raw_host(c) for c, h in hosts.items()})
    known = host_domains(told.select(F.explode(F.array(*hosts.values())).alias("host")).where("host <> ''").distinct(), rules)
    for c, h in hosts.items():
        told = told.join(known.select(F.col("host").alias(h), F.col("domain").alias(f"{c}_domain")), h, "left").drop(h)
    return told.withColumns({f"{c}_domain": F.coalesce(f"{c}_domain", F.lit("")) for c in urls})
