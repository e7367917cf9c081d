"""Gates: predicates and reason lists as Column expressions, so that they reach the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K
from ..functions.text import as_col, clean, text
from ..functions.url import host, is_skipped
from .rows import all_of, any_of, first_per_key, top_per_key


def _missing(c: Column | str) -> Column:
    return text(c) == ""


def _outside(c: Column | str, allowed: Sequence[str]) -> Column:
    return ~F.coalesce(as_col(c).isin(*allowed), F.lit(False))


def _false(c: Column | str) -> Column:
    return ~F.coalesce(as_col(c).cast("boolean"), F.lit(False))


def observation_checks() -> list[tuple[str, Column]]:
    """(reason, defect) pairs in reporting order."""
    graded = F.col("sentiment_label").isNotNull()
    defects = [
        clean("id") == "",
        ~text("organisation_number").rlike("^[0-9]+$"),
        _outside("platform", K.PLATFORMS),
        _outside("signal_type", K.SIGNAL_TYPES),
        host("source_url") == "",
        _missing("retrieved_at"),
        F.length(text("content_sha256")) != 64,
        _false("exact_entity"),
        F.coalesce(F.size("identity_proof"), F.lit(0)) <= 0,
        _outside("acquisition_mode", K.PUBLISHABLE_MODES),
        ~F.col("rights_status").eqNullSafe("approved"),
        ~_outside("signal_type", K.SPAN_SIGNALS) & _missing("evidence_span"),
        graded & _outside("sentiment_label", K.SENTIMENT_LABELS),
        graded & _outside("source_class", K.OBSERVATION_SENTIMENT_CLASSES),
        graded & _missing("sentiment_model_version"),
    ]
    return list(zip(K.OBSERVATION_REASONS, defects))


def _reasons(checks: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(bad, F.lit(reason)) for reason, bad in checks]))


def observation_reasons() -> Column:
    """Every reason an observation row may not be published; empty for a publishable one."""
    return _reasons(observation_checks())


def publishable() -> Column:
    """True for a publishable observation, without building the reason list."""
    return ~any_of(*[bad for _, bad in observation_checks()])


def split_observations(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected rows with their reasons."""
    graded = obs.withColumn("reasons", observation_reasons())
    return (
        graded.where(F.size("reasons") == 0).drop("reasons"),
        graded.where(F.size("reasons") > 0),
    )


def experimental() -> Column:
    """Evidence that may be benchmarked but not published."""
    return (
        F.coalesce(F.col("acquisition_mode").isin(*K.EXPERIMENTAL_MODES), F.lit(False))
        & ~_false("exact_entity")
        & (F.coalesce(F.size("identity_proof"), F.lit(0)) > 0)
        & ~_missing("content_sha256")
    )


def sentiment_reasons(text_column: str = "text") -> Column:
    """Reasons against using an item as sentiment input."""
    checks = [
        ("exact company identity is not verified", _false("exact_entity")),
        ("source is not an allowed independent class", _outside("source_class", K.ROLLUP_SENTIMENT_CLASSES)),
    ]
    for field in ("source_url", "retrieved_at", "evidence_span", "content_sha256"):
        checks.append((f"missing {field}", _missing(field)))
    checks.append(("missing text", _missing(text_column)))
    return _reasons(checks)


def publishable_sentiment(label: str = "label") -> Column:
    """Independent, supported item with a known label; its span can stand in for the text."""
    return (
        ~_false("exact_entity")
        & ~_outside("source_class", K.ROLLUP_SENTIMENT_CLASSES)
        & all_of(*[~_missing(f) for f in ("source_url", "retrieved_at", "evidence_span", "content_sha256")])
        & ~_outside(label, K.SENTIMENT_LABELS)
    )


def filer_eligible(latest_year: str, active_only: bool = True) -> Column:
    ok = text("latest_submitted_accounts") == str(latest_year)
    return ok & _false("bankrupt") & _false("liquidating") if active_only else ok


def complete_entities(evidence: DataFrame, modules: Sequence[str] = K.MODULES) -> DataFrame:
    """Per entity: does every module have a record that was fetched?"""
    fetched = F.when(F.col("status").isNull() | (F.col("status") != "not_fetched"), F.col("module"))
    known = F.when(F.col("module").isin(*modules), fetched)
    return evidence.groupBy("organisation_number").agg(
        (F.count_distinct(known) == len(set(modules))).alias("complete")
    )


def exact_identity(live: Column | str, org: Column | str) -> Column:
    return as_col(live).cast("string").eqNullSafe(as_col(org).cast("string"))


def candidate_sites(results: DataFrame, k: int | None = None) -> DataFrame:
    """Per entity the result URLs by rank (the best ``k``), one per host, known directories left out."""
    usable = results.withColumn("host", host("url")).where(
        F.col("url").contains("://") & (F.col("host") != "") & ~is_skipped(F.col("host"))
    )
    one = first_per_key(usable, ["organisation_number", "host"], ["rank", "url"])
    return top_per_key(one, ["organisation_number"], ["rank", "url"], k, "position")
