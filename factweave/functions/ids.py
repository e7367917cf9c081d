"""Hashes, ids and organisation-number checks as Column builders."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import constants as K
from .text import as_col, text


def sha64(value: Column | str, seed: Column | str) -> Column:
    """A 64-digit hex value passes in lower case; anything else is hashed, the seed standing in for nothing."""
    v = text(value)
    return F.when(v.rlike("^[0-9a-fA-F]{64}$"), F.lower(v)).otherwise(
        F.sha2(F.when(v == "", text(seed)).otherwise(v), 256)
    )


def short_id(*parts: Column | str) -> Column:
    """First 24 hex digits of the hash over the parts in a fixed order, NULL marked apart from empty."""
    joined = F.concat_ws("|", *[F.coalesce(as_col(p).cast("string"), F.lit("\u0000")) for p in parts])
    return F.substring(F.sha2(joined, 256), 1, 24)


def hash_rank(seed: str | int, key: Column | str) -> Column:
    """Sampling rank: hex hash of ``seed:key``, equal on any cluster and any input order."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), text(key)), 256)


def orgnr_valid(value: Column | str) -> Column:
    """Nine digits whose last is the modulus-11 check digit."""
    v = text(value)
    total = F.lit(0)
    for i, weight in enumerate(K.ORGNR_WEIGHTS):
        total = total + F.coalesce(F.substring(v, i + 1, 1).try_cast("int"), F.lit(0)) * weight
    rest = total % 11
    check = F.when(rest == 0, F.lit(0)).otherwise(F.lit(11) - rest)
    return v.rlike("^[0-9]{9}$") & (check != 10) & (check == F.substring(v, 9, 1).try_cast("int"))


def orgnrs_in(value: Column | str) -> Column:
    """Distinct valid organisation numbers written in a text, blanks or dots between digits allowed."""
    found = F.regexp_extract_all(text(value), F.lit(r"\b(\d(?:[ .]?\d){8})\b"), F.lit(1))
    plain = F.transform(found, lambda m: F.regexp_replace(m, "[^0-9]", ""))
    return F.array_distinct(F.filter(plain, orgnr_valid))


def orgnr_verdict(org: Column | str, value: Column | str) -> Column:
    found = orgnrs_in(value)
    return (
        F.when(F.array_contains(found, as_col(org)), "match")
        .when(F.size(found) > 0, "conflict")
        .otherwise("none")
    )
