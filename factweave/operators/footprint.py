"""Per-entity aggregates over observations.

Everything is a mergeable aggregate with map-side combine: sums, flags as maxima, platform sets as
bit masks over the closed list, and distinct counts that shuffle on (entity, value) first. No
entity's observations are ever gathered in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K
from ..functions.numeric import half_up, ratio
from ..functions.text import text
from ..functions.timefn import is_fresh, iso_ts
from ..functions.url import host
from . import gates as G

ORG = "organisation_number"


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def any_where(condition: Column) -> Column:
    return F.coalesce(F.max(F.coalesce(condition, F.lit(False))), F.lit(False))


def footprint(obs: DataFrame, as_of: str, freshness_days: int = 45) -> DataFrame:
    """One row per entity: accepted and rejected counts, platforms, freshness, reviews, jobs, public
    items with engagement, and contextual sentiment.

    Metrics are flat columns likes, comments and shares. Counts stay per kind and are never summed
    into one popularity number.
    """
    o = obs.withColumn("ok", G.publishable())
    ok, signal, label = F.col("ok"), F.col("signal_type"), F.col("sentiment_label")
    public = ok & signal.isin("public_post", "public_mention", "buzz_metrics")
    graded = ok & (text(label) != "")
    engagement = sum((F.coalesce(F.col(m).cast("long"), F.lit(0)) for m in ("likes", "comments", "shares")), F.lit(0).cast("long"))
    sign = F.when(label == "positive", 1).when(label == "negative", -1).when(label == "neutral", 0)
    folded = o.groupBy(ORG).agg(
        count_where(ok).alias("accepted_observations"),
        count_where(~ok).alias("rejected_observations"),
        F.bit_or(F.when(ok, platform_bit())).alias("__platforms"),
        count_where(ok & is_fresh(iso_ts("retrieved_at"), as_of, freshness_days)).alias("fresh_observations"),
        count_where(ok & signal.isin("review", "review_summary")).alias("review_signal_count"),
        F.count_distinct(F.when(ok & (signal == "job_posting"), text("source_url"))).alias("active_job_count"),
        F.count_distinct(F.when(public, text("source_url"))).alias("public_item_count"),
        F.coalesce(F.sum(F.when(public, engagement)), F.lit(0)).alias("public_engagement"),
        count_where(graded).alias("sentiment_items"),
        F.count_distinct(F.when(graded, host("source_url"))).alias("independent_sources"),
        F.count_distinct(F.when(graded, F.nullif(F.col("reviewer_id"), F.lit("")))).alias("independent_reviewers"),
        F.sum(F.when(graded, sign)).alias("__sum"),
        F.count(F.when(graded, sign)).alias("__n"),
    )
    ready = (F.col("sentiment_items") >= 10) & ((F.col("independent_sources") >= 2) | (F.col("independent_reviewers") >= 10))
    score = F.when(ready & (F.col("__n") > 0), half_up(50 + 50 * F.col("__sum") / F.col("__n"), 1))
    return folded.select(
        ORG,
        F.when(F.col("accepted_observations") > 0, "available").otherwise("not_available").alias("status"),
        "accepted_observations", "rejected_observations", platform_names("__platforms").alias("platforms"),
        "fresh_observations", "review_signal_count", "active_job_count", "public_item_count", "public_engagement",
        "sentiment_items", "independent_sources", "independent_reviewers",
        F.when(ready, "available").otherwise("abstain").alias("sentiment_status"), score.alias("sentiment_score"),
    )


def platform_bit(column: str = "platform") -> Column:
    """Bit of a listed platform, NULL for any other."""
    pairs = [x for i, p in enumerate(K.PLATFORMS) for x in (F.lit(p), F.lit(1 << i).cast("long"))]
    return F.try_element_at(F.create_map(*pairs), F.coalesce(F.col(column), F.lit("")))


def platform_names(mask: str) -> Column:
    """Sorted platform names of a bit mask."""
    names = sorted(K.PLATFORMS)
    held = [F.when(F.getbit(F.coalesce(F.col(mask), F.lit(0).cast("long")), F.lit(K.PLATFORMS.index(p))) == 1, F.lit(p)) for p in names]
    return F.array_compact(F.array(*held))


def platform_counts(obs: DataFrame) -> DataFrame:
    """Accepted observations per entity and platform."""
    return obs.where(G.publishable()).groupBy(ORG, "platform").agg(F.count("*").alias("observations"))


def rejections(obs: DataFrame) -> DataFrame:
    """Rejected observations with their reasons, as rows."""
    _, bad = G.split_observations(obs)
    return bad.select(ORG, "id", "reasons")


def sentiment_rollup(items: DataFrame) -> DataFrame:
    """Company-level label from at least two independent sources, else an abstention.

    ``items``: label, text or evidence_span, source fields and optionally source_id.
    """
    ok = G.publishable_sentiment()
    own = F.lower(F.trim(F.col("source_id"))) if "source_id" in items.columns else F.lit(None).cast("string")
    source = F.nullif(F.coalesce(F.nullif(own, F.lit("")), host("source_url")), F.lit(""))
    labelled = items.withColumn("ok", ok).withColumn("__source", source)
    has = lambda v: F.col("ok") & (F.col("label") == v)
    folded = labelled.groupBy(ORG).agg(
        count_where(F.col("ok")).alias("accepted_items"),
        count_where(~F.col("ok")).alias("rejected_items"),
        F.count_distinct(F.when(F.col("ok"), F.col("__source"))).alias("independent_sources"),
        *[count_where(has(v)).alias(f"{v}_items") for v in K.SENTIMENT_LABELS],
    )
    loud = [v for v in K.SENTIMENT_LABELS if v != "neutral"]
    kinds = sum(((F.col(f"{v}_items") > 0).cast("int") for v in loud), F.lit(0))
    only = F.coalesce(*[F.when(F.col(f"{v}_items") > 0, F.lit(v)) for v in loud])
    label = F.when(kinds == 1, only).when(kinds > 1, "mixed").otherwise("neutral")
    enough = F.col("independent_sources") >= 2
    return folded.withColumn("status", F.when(enough, "available").otherwise("abstain")).withColumn("label", F.when(enough, label))


# ---- development score -----------------------------------------------------------------
_GROUPS = {
    "profile_metrics": ("profile_metrics",),
    "places_identity": ("place_summary",),
    "places_reviews": ("review", "review_summary"),
    "workforce_jobs": ("job_posting", "workforce_snapshot"),
    "public_buzz": ("public_post", "public_mention", "buzz_metrics"),
}


def score_facts(obs: DataFrame, keys: Sequence[str] = (ORG,)) -> DataFrame:
    """What the score needs to know of a group of observations, as mergeable columns.

    Strict columns are over publishable observations, ``x_`` columns over experimental ones.
    """
    o = obs.withColumn("ok", G.publishable()).withColumn("ex", G.experimental())
    signal, platform = F.col("signal_type"), F.col("platform")
    aggs = [F.count("*").alias("observations")]
    for prefix, on in (("", F.col("ok")), ("x_", F.col("ex"))):
        aggs.append(count_where(on).alias(f"{prefix}items"))
        aggs += [any_where(on & signal.isin(*kinds)).alias(f"{prefix}{name}") for name, kinds in _GROUPS.items()]
        aggs.append(F.coalesce(F.bit_or(F.when(on & (signal == "profile_handle"), platform_bit())), F.lit(0).cast("long")).alias(f"{prefix}handles"))
        aggs.append(count_where(on & (text("sentiment_label") != "")).alias(f"{prefix}sentiment_items"))
    place = (platform == "google_places") & (signal == "place_summary")
    aggs.append(any_where(F.col("ok") & (((platform == "wikidata") & (signal == "company_profile")) | place)).alias("third_party_identity"))
    aggs.append(any_where(F.col("ex") & (((platform == "company_directory") & (signal == "company_profile")) | place)).alias("x_identity"))
    summary = F.col("ex") & (signal == "review_summary") & (F.col("review_count") >= 10) & (F.col("rating") > 0) & (F.col("rating") <= 5)
    aggs.append(any_where(summary).alias("x_review_summary"))
    return o.groupBy(*keys).agg(*aggs)


def sentiment_breadth(obs: DataFrame) -> DataFrame:
    """Distinct sentiment hosts and reviewers per entity, strict and experimental."""
    o = obs.withColumn("ok", G.publishable()).withColumn("ex", G.experimental()).where("coalesce(sentiment_label, '') <> ''")
    reviewer = F.nullif(F.col("reviewer_id"), F.lit(""))
    return o.groupBy(ORG).agg(
        F.count_distinct(F.when(F.col("ok"), host("source_url"))).alias("hosts"),
        F.count_distinct(F.when(F.col("ok"), reviewer)).alias("reviewers"),
        F.count_distinct(F.when(F.col("ex"), host("source_url"))).alias("x_hosts"),
        F.count_distinct(F.when(F.col("ex"), reviewer)).alias("x_reviewers"),
    )


def score_components() -> dict[str, tuple[Column, Column]]:
    """(strict, potential) column of each component over ``score_facts`` and ``sentiment_breadth``."""
    m = K.SCORE_MAXIMA
    c = F.col
    ready = (c("sentiment_items") >= 10) & ((c("hosts") >= 2) | (c("reviewers") >= 10))
    x_ready = c("x_review_summary") | ((c("x_sentiment_items") >= 10) & ((c("x_hosts") >= 2) | (c("x_reviewers") >= 10)))
    identity = c("site_publishable") | c("third_party_identity")
    full = lambda name, on: F.when(on, m[name]).otherwise(0.0)
    handles = lambda mask: F.least(F.lit(m["verified_handles"]), F.bit_count(mask) * 5.0)
    out = {
        "exact_external_identity": (
            full("exact_external_identity", identity & (c("items") > 0)),
            full("exact_external_identity", (identity | c("x_identity")) & ((c("items") > 0) | (c("x_items") > 0))),
        ),
        "verified_handles": (handles(c("handles")), handles(c("handles").bitwiseOR(c("x_handles")))),
    }
    for name in _GROUPS:
        out[name] = (full(name, c(name)), full(name, c(name) | c(f"x_{name}")))
    out["independent_sentiment"] = (full("independent_sentiment", ready), full("independent_sentiment", ready | x_ready))
    fresh = full("freshness_evidence", c("items") > 0)
    out["freshness_evidence"] = (fresh, fresh)
    return out


def development_score(profiles: DataFrame, obs: DataFrame) -> DataFrame:
    """Coverage score of each entity, strict and with experimental evidence counted.

    ``profiles``: organisation_number and site_publishable. Components leave as columns
    ``c_<name>`` and ``p_<name>``.
    """
    joined = profiles.select(ORG, F.coalesce("site_publishable", F.lit(False)).alias("site_publishable")).join(score_facts(obs), ORG, "left").join(
        sentiment_breadth(obs), ORG, "left"
    )
    flags = [f"{p}{n}" for p in ("", "x_") for n in _GROUPS] + ["third_party_identity", "x_identity", "x_review_summary"]
    counts = ["observations", "items", "x_items", "handles", "x_handles", "sentiment_items", "x_sentiment_items", "hosts", "reviewers", "x_hosts", "x_reviewers"]
    filled = joined.fillna(False, flags).fillna(0, counts)
    parts = score_components()
    out = filled.select(
        ORG, F.col("items").alias("accepted_observations"), F.col("x_items").alias("experimental_observations"),
        *[s.alias(f"c_{n}") for n, (s, _) in parts.items()], *[p.alias(f"p_{n}") for n, (_, p) in parts.items()],
    )
    total = lambda prefix: sum((F.col(f"{prefix}{n}") for n in parts), F.lit(0.0))
    return out.withColumn("score", total("c_")).withColumn("experimental_potential_score", total("p_"))


# ---- completeness ----------------------------------------------------------------------

def completeness(profiles: DataFrame, scores: DataFrame) -> DataFrame:
    """Foundation and enrichment points of each scored entity.

    ``profiles``: organisation_number, live_organisation_number and the status columns
    financials_status, roles_status, locations_status, website_status (NULL if the module is absent).
    """
    w = K.FOUNDATION_WEIGHTS
    present = lambda c: F.col(c).isNotNull() & ~F.col(c).isin("error", "not_run")
    full = lambda name, on: F.when(on, w[name]).otherwise(0.0).alias(f"f_{name}")
    foundation = [
        full("official_identity", F.coalesce(text("live_organisation_number") == text(ORG), F.lit(False))),
        full("annual_accounts", F.coalesce(F.col("financials_status") == "available", F.lit(False))),
        full("roles", present("roles_status")),
        full("locations", present("locations_status")),
        full("website_terminal_state", present("website_status")),
    ]
    base = scores.join(profiles.select(ORG, *foundation), ORG, "inner")
    scaled = lambda prefix, n, weight: half_up(weight * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col(f"{prefix}{n}"), F.lit(0.0)) / K.SCORE_MAXIMA[n])), 3)
    rows = base.select(
        ORG, *[f"f_{n}" for n in w],
        *[scaled("c_", n, x).alias(f"s_{n}") for n, x in K.ENRICHMENT_WEIGHTS.items()],
        *[scaled("p_", n, x).alias(f"e_{n}") for n, x in K.ENRICHMENT_WEIGHTS.items()],
    )
    total = lambda prefix, names: sum((F.col(f"{prefix}{n}") for n in names), F.lit(0.0))
    return (
        rows.withColumn("foundation_score", half_up(total("f_", w), 3))
        .withColumn("strict_completeness_score", half_up(F.col("foundation_score") + total("s_", K.ENRICHMENT_WEIGHTS), 3))
        .withColumn("experimental_completeness_score", half_up(F.col("foundation_score") + total("e_", K.ENRICHMENT_WEIGHTS), 3))
    )


def completeness_summary(scored: DataFrame, by: str | None = None) -> DataFrame:
    """Means, threshold counts and component coverage, overall and (with ``by``) per slice."""
    mean = lambda c: half_up(F.avg(F.col(c).cast("decimal(18,3)")).cast("double"), 3)
    share = lambda c: half_up(F.avg((F.col(c) > 0).cast("double")), 4)
    grouped = scored.rollup(by) if by else scored.groupBy()
    return grouped.agg(
        F.count("*").alias("companies"),
        mean("foundation_score").alias("foundation_mean"),
        mean("strict_completeness_score").alias("strict_completeness_mean"),
        mean("experimental_completeness_score").alias("experimental_completeness_mean"),
        F.count_if(F.col("strict_completeness_score") >= 50).alias("strict_at_50"),
        F.count_if(F.col("experimental_completeness_score") >= 65).alias("experimental_at_65"),
        *[share(f"f_{n}").alias(f"coverage_{n}") for n in K.FOUNDATION_WEIGHTS],
        *[share(f"s_{n}").alias(f"coverage_{n}") for n in K.ENRICHMENT_WEIGHTS],
    )


def score_distribution(scored: DataFrame) -> DataFrame:
    return scored.groupBy("strict_completeness_score").agg(F.count("*").alias("companies"))


def transfer(summary: DataFrame, slice_column: str, base: str, extension: str) -> DataFrame:
    """Change of the means from the base slice to its extension."""
    pick = lambda s, c: F.max(F.when(F.col(slice_column) == s, F.col(c)))
    out = []
    for kind in ("strict", "experimental"):
        b, e = pick(base, f"{kind}_completeness_mean"), pick(extension, f"{kind}_completeness_mean")
        out += [half_up(e - b, 3).alias(f"{kind}_mean_delta"), F.when(b != 0, half_up(e / b, 4)).alias(f"{kind}_retention")]
    return summary.agg(*out)


def coverage_ratios(profiles: DataFrame, obs: DataFrame) -> DataFrame:
    """Shares of all entities with each kind of accepted evidence."""
    signal = F.col("signal_type")
    facts = obs.where(G.publishable()).groupBy(ORG).agg(
        F.bit_count(F.bit_or(platform_bit())).alias("platforms"),
        any_where(signal.isin("job_posting", "workforce_snapshot")).alias("workforce_jobs"),
        any_where(signal.isin("review", "review_summary", "place_summary")).alias("ratings_reviews"),
        any_where(signal.isin("public_post", "public_mention", "profile_metrics")).alias("buzz_engagement"),
        any_where(text("sentiment_label") != "").alias("sentiment"),
    )
    joined = profiles.select(ORG).distinct().join(facts, ORG, "left")
    n = F.count("*")
    share = lambda on, name: ratio(count_where(on), n).alias(name)
    return joined.agg(
        n.alias("profiles"), share(F.col("platforms") >= 1, "any_external"), share(F.col("platforms") >= 2, "two_platforms"),
        *[share(F.col(c), c) for c in ("workforce_jobs", "ratings_reviews", "buzz_engagement", "sentiment")],
    )
