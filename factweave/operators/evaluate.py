"""Evaluation reports: audits, classifiers, batches, crawls, portfolios.

Reports are one-row or long tables of aggregates; nothing is collected to compute them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import constants as K
from ..functions.numeric import capped, half_up, ratio
from ..functions.text import text
from . import gates as G
from .footprint import count_where
from .joins import audit_join, gold_join
from .rows import all_of, beside, union_all

ORG = "organisation_number"


def audit_report(obs: DataFrame, labels: DataFrame, min_audit: int = 100, check: bool = True) -> DataFrame:
    """Audit of published observations against exact-entity labels.

    ``labels``: id, exact_entity_label, metric_correct, sentiment_correct.
    """
    audited = audit_join(obs, labels, check).withColumn("ok", G.publishable())
    ok, graded = F.col("ok"), F.col("ok") & F.col("sentiment_label").isNotNull()
    wrong = lambda c: ok & ~F.coalesce(F.col(c), F.lit(False))
    counts = audited.agg(
        F.count("*").alias("audited_observations"),
        count_where(ok).alias("published_audited"),
        count_where(wrong("exact_entity_label")).alias("wrong_entity_publications"),
        count_where(wrong("metric_correct")).alias("wrong_metric_publications"),
        F.lit(0).cast("long").alias("unsupported_publications"),  # published means free of reasons
        count_where(graded).alias("sentiment_audited"),
        count_where(graded & F.col("sentiment_correct")).alias("sentiment_correct"),
    )
    size = labels.agg(F.count("*").alias("label_count"))
    n = F.col("published_audited")
    out = beside(counts, size)
    out = (
        out.withColumn("entity_precision", ratio(n - F.col("wrong_entity_publications"), n))
        .withColumn("metric_precision", ratio(n - F.col("wrong_metric_publications"), n))
        .withColumn("sentiment_accuracy", ratio(F.col("sentiment_correct"), F.col("sentiment_audited"), None))
        .withColumn("audit_size_gate", F.col("label_count") >= min_audit)
    )
    passed = (
        F.col("audit_size_gate") & (n > 0) & (F.col("wrong_entity_publications") == 0)
        & (F.col("entity_precision") >= 0.995) & (F.col("metric_precision") >= 0.98)
    )
    return out.withColumn("qualification_passed", passed).drop("label_count", "sentiment_correct")


def label_metrics(gold: DataFrame, predictions: DataFrame, check: bool = True) -> DataFrame:
    """Precision, recall, F1 and support of each label, from one confusion table."""
    pairs = gold_join(gold, predictions, check)
    confusion = pairs.groupBy("gold_label", "predicted_label").agg(F.count("*").alias("n"))
    sides = confusion.select(
        F.explode(
            F.array(
                F.struct(F.col("gold_label").alias("label"), F.lit("gold").alias("side")),
                F.struct(F.col("predicted_label").alias("label"), F.lit("predicted").alias("side")),
            )
        ).alias("s"),
        (F.col("gold_label").eqNullSafe(F.col("predicted_label"))).alias("hit"), "n",
    ).select("s.label", "s.side", "hit", "n").where(F.col("label").isin(*K.SENTIMENT_LABELS))
    total = lambda side, hit=None: F.coalesce(F.sum(F.when((F.col("side") == side) & (F.lit(True) if hit is None else F.col("hit") == hit), F.col("n"))), F.lit(0))
    per = sides.groupBy("label").agg(total("gold", True).alias("tp"), total("predicted", False).alias("fp"), total("gold", False).alias("fn"), total("gold").alias("support"))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = per.withColumn("precision", precision).withColumn("recall", recall)
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def classification_report(gold: DataFrame, predictions: DataFrame, min_items: int = 300, check: bool = True) -> DataFrame:
    """Accuracy, macro F1 over labels present in the gold set, support of evidence, and the gates."""
    if min_items < 300:
        raise ValueError("the qualification minimum cannot be lower than 300 items")
    pairs = gold_join(gold, predictions, check)
    published = F.col("predicted_label").isin(*K.SENTIMENT_LABELS)
    overall = pairs.withColumn("text", F.col("evidence_span")).agg(
        F.count("*").alias("gold_items"),
        count_where(published).alias("published_predictions"),
        count_where(F.col("gold_label") == F.col("predicted_label")).alias("correct"),
        count_where(published & ~F.coalesce(F.col("exact_entity"), F.lit(False))).alias("wrong_entity_predictions"),
        count_where(published & G.publishable_sentiment("predicted_label")).alias("evidence_supported_predictions"),
        count_where(published & (F.col("source_class") == "company_owned")).alias("company_owned_predictions"),
    )
    m = label_metrics(gold, predictions, check=False)
    of = lambda label, c: F.coalesce(F.max(F.when((F.col("label") == label) & (F.col("support") > 0), F.col(c))), F.lit(0))
    labels = m.agg(
        # summed label by label, so that the order of rows cannot touch the last digit
        ratio(sum((of(v, "f1") for v in K.SENTIMENT_LABELS), F.lit(0.0)), F.count_if(F.col("support") > 0)).alias("macro_f1"),
        of("positive", "precision").alias("__pos"), of("negative", "precision").alias("__neg"), of("mixed", "support").alias("__mixed"),
        (F.count_if(F.col("label").isin("positive", "neutral", "negative") & (F.col("support") > 0)) == 3).alias("required_labels_present"),
    )
    n, pub = F.col("gold_items"), F.col("published_predictions")
    out = (
        beside(overall, labels)
        .withColumn("accuracy", ratio(F.col("correct"), n, None))
        .withColumn("exact_entity_precision", ratio(pub - F.col("wrong_entity_predictions"), pub, None))
        .withColumn("evidence_support_rate", ratio(F.col("evidence_supported_predictions"), pub, None))
        .withColumn("coverage", ratio(pub, n, None))
    )
    gate = (
        (n >= min_items) & F.col("required_labels_present") & (F.col("wrong_entity_predictions") == 0) & (F.col("company_owned_predictions") == 0)
        & (F.col("macro_f1") >= 0.8) & (F.col("__pos") >= 0.9) & (F.col("__neg") >= 0.9)
        & (F.col("evidence_supported_predictions") == pub) & F.coalesce(F.col("coverage") >= 0.5, F.lit(False))
    )
    return (
        out.withColumn("qualification_passed", gate)
        .withColumn("production_scale_gate_passed", gate & (n >= 600) & (F.col("__mixed") > 0))
        .drop("__pos", "__neg", "__mixed", "correct")
    )


def identity_completeness(profiles: DataFrame) -> DataFrame:
    """Share of profiles whose live record carries their own number, with the failing count."""
    exact = G.exact_identity("live_organisation_number", ORG)
    n = F.count("*")
    return profiles.agg(
        n.alias("profiles"), count_where(~exact).alias("failures"), ratio(count_where(exact), n).alias("exact_registry_ratio")
    )


def identity_failures(profiles: DataFrame) -> DataFrame:
    return profiles.where(~G.exact_identity("live_organisation_number", ORG)).select(ORG)


def batch_checks(envelopes: DataFrame, modules: DataFrame, manifest: DataFrame) -> DataFrame:
    """Contract of a batch: as many envelopes as the manifest asks for, each entity once, all states terminal.

    One grouping of the three by entity.
    """
    known = F.coalesce(F.col("state").isin(*K.TERMINAL_STATES), F.lit(False))
    zero = F.lit(0).cast("long")
    rows = union_all(
        envelopes.select(ORG, F.lit(1).cast("long").alias("n"), known.alias("terminal"), zero.alias("bad"), zero.alias("asked")),
        modules.select(ORG, zero.alias("n"), F.lit(None).cast("boolean").alias("terminal"), (~known).cast("long").alias("bad"), zero.alias("asked")),
        manifest.select(ORG, zero.alias("n"), F.lit(None).cast("boolean").alias("terminal"), zero.alias("bad"), F.lit(1).cast("long").alias("asked")),
    )
    each = rows.groupBy(ORG).agg(F.sum("n").alias("n"), F.min("terminal").alias("terminal"), F.sum("bad").alias("bad"), F.sum("asked").alias("asked"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = each.agg(
        total("n").alias("emitted"), F.count_if(F.col("n") > 0).alias("entities"), total("asked").alias("asked"),
        F.coalesce(F.min("terminal"), F.lit(True)).alias("all_entity_states_terminal"), total("bad").alias("invalid_states"),
    )
    out = (
        out.withColumn("exact_expected_count", F.col("emitted") == F.col("asked"))
        .withColumn("unique_organisation_numbers", F.col("emitted") == F.col("entities"))
        .withColumn("all_module_states_terminal", F.col("invalid_states") == 0)
    )
    out = out.withColumn("zero_silent_drops", F.col("exact_expected_count") & F.col("unique_organisation_numbers"))
    checks = ("exact_expected_count", "unique_organisation_numbers", "all_entity_states_terminal", "all_module_states_terminal", "zero_silent_drops")
    return out.withColumn("passed", all_of(*[F.col(c) for c in checks])).drop("entities", "asked")


def crawl_report(profiles: DataFrame, events: DataFrame) -> DataFrame:
    """Status counts and coverage of a crawl, as (section, key, value) rows.

    ``events`` may carry ``error``; its text before the first colon names the error bucket.
    """
    seeds = profiles.where(text("website") != "").select(ORG)
    rows = F.array(
        F.struct(F.lit("website_status").alias("section"), F.col("status").alias("key")),
        F.struct(F.lit("page_kind").alias("section"), F.col("page_kind").alias("key")),
        F.struct(F.lit("response_status").alias("section"), F.col("status_code").cast("string").alias("key")),
        F.struct(F.lit("error_bucket").alias("section"), F.split_part(F.col("error"), F.lit(":"), F.lit(1)).alias("key")),
    )
    counts = (
        events.select(F.explode(rows).alias("r")).where(F.col("r.key").isNotNull())
        .groupBy("r.section", "r.key").agg(F.count("*").cast("double").alias("value"))
    )
    marked = seeds.join(events.groupBy(ORG).agg(F.count("*").alias("events")), ORG, "left")
    totals = marked.agg(
        F.count("*").alias("seeds"), F.count("events").alias("covered"), F.coalesce(F.sum("events"), F.lit(0)).alias("requests")
    ).select(
        F.explode(
            F.array(
                F.struct(F.lit("website_seeds_selected").alias("key"), F.col("seeds").cast("double").alias("value")),
                F.struct(F.lit("terminal_coverage").alias("key"), half_up(ratio(F.col("covered"), F.col("seeds"), None), 6).alias("value")),
                F.struct(F.lit("request_amplification_per_seed").alias("key"), half_up(ratio(F.col("requests"), F.col("seeds"), None), 3).alias("value")),
            )
        ).alias("t")
    ).select(F.lit("crawl").alias("section"), "t.key", "t.value")
    return counts.unionByName(totals)


def status_report(results: DataFrame) -> DataFrame:
    """Results and distinct entities per connector status."""
    return results.groupBy("status").agg(F.count("*").alias("results"), F.count_distinct(ORG).alias("companies"))


def channel_metrics(posts: DataFrame) -> DataFrame:
    """Posts and views of each accepted channel; a post without a view count has no part in the views."""
    return posts.groupBy(ORG, "channel_url").agg(
        F.count("*").alias("matched_recent_posts"), F.sum("view_count").alias("recent_views_total"),
        half_up(F.avg("view_count"), 1).alias("recent_views_mean"),
    )


# ---- portfolio scorecard ---------------------------------------------------------------

def module_ratios(profiles: DataFrame) -> DataFrame:
    """Shares of profiles with exact identity, accounts, roles and locations, and a website record."""
    n = F.count("*")
    there = lambda c: F.col(c).isNotNull()
    return profiles.agg(
        n.alias("profiles"),
        ratio(count_where(G.exact_identity("live_organisation_number", ORG)), n).alias("exact_registry"),
        ratio(count_where(F.col("financials_status") == "available"), n).alias("financials"),
        ratio(count_where(there("roles_status") & there("locations_status")), n).alias("roles_and_locations"),
        ratio(count_where(there("website_status")), n).alias("website_terminal"),
    )


def scorecard(ratios: DataFrame, coverage: DataFrame, audit: DataFrame, facts: Mapping[str, object], target: float = 80.0) -> DataFrame:
    """Portfolio score out of five categories; awardable only if every gate holds.

    ``facts`` are the results of other reports: sentiment_qualified, fresh_coverage,
    connector_policy, research_score, external_qa, batch_passed, resume_passed, refresh_passed,
    p95_ms, ux_score, ux_external.
    """
    f = {k: F.lit(v) for k, v in facts.items()}
    row = beside(ratios, coverage.drop("profiles"), audit)
    qualified = F.col("qualification_passed")
    zero_wrong = (F.col("wrong_entity_publications") == 0) & (F.col("published_audited") > 0)
    supported = (F.col("unsupported_publications") == 0) & (F.col("published_audited") > 0)
    when = lambda on, points: F.when(on, points).otherwise(0.0)
    external = {
        "verified_external_identity": when(qualified & zero_wrong, 10.0),
        "multi_source_breadth": when(qualified, capped(10, "two_platforms")),
        "workforce_and_jobs": when(qualified, capped(7, "workforce_jobs")),
        "ratings_and_reviews": when(qualified, capped(8, "ratings_reviews")),
        "buzz_and_engagement": when(qualified, capped(7, "buzz_engagement")),
        "qualified_sentiment": when(f["sentiment_qualified"], capped(10, "sentiment")),
        "external_freshness": when(qualified, capped(3, f["fresh_coverage"])),
    }
    foundation = {
        "official_identity": capped(4, "exact_registry"),
        "annual_accounts": capped(4, "financials"),
        "roles_and_locations_points": capped(4, "roles_and_locations"),
        "website_seed_and_terminal_state": capped(3, "website_terminal"),
    }
    research_raw = half_up(F.least(F.lit(10.0), F.least(F.lit(12.0), f["research_score"].cast("double")) * 10 / 12), 3)
    research = F.when(f["external_qa"], research_raw).otherwise(F.least(F.lit(5.0), research_raw))
    daily = {
        "terminal_daily_batch": when(f["batch_passed"], 4.0),
        "deterministic_resume": when(f["resume_passed"], 2.0),
        "measured_refresh_diffs": when(f["refresh_passed"], 3.0),
        "latency_budget": when(f["batch_passed"] & F.coalesce(f["p95_ms"].cast("double") <= 10_000, F.lit(False)), 1.0),
        "connector_rights_and_rate_policy": when(f["connector_policy"], 2.0),
    }
    ux_raw = F.least(F.lit(8.0), f["ux_score"].cast("double"))
    ux = F.when(f["ux_external"], ux_raw).otherwise(F.least(F.lit(4.0), ux_raw))
    add = lambda parts: half_up(sum(parts.values(), F.lit(0.0)), 3)
    out = row.select(
        "profiles", add(external).alias("external_footprint_intelligence"), add(foundation).alias("official_company_foundation"),
        research.alias("research_agent"), add(daily).alias("daily_extensibility_refresh"), ux.alias("product_ux_design"),
        (F.col("audit_size_gate") & zero_wrong & supported & f["connector_policy"] & (F.col("exact_registry") == 1.0) & f["batch_passed"] & f["refresh_passed"]).alias("qualification_passed"),
    )
    categories = ("external_footprint_intelligence", "official_company_foundation", "research_agent", "daily_extensibility_refresh", "product_ux_design")
    out = out.withColumn("raw_score", half_up(sum((F.col(c) for c in categories), F.lit(0.0)), 3))
    return out.withColumn("target_met", F.col("raw_score") >= target).withColumn(
        "awardable_score", F.when(F.col("qualification_passed"), F.col("raw_score")).otherwise(0.0)
    )


# ---- sets ------------------------------------------------------------------------------

def change_recall(expected: DataFrame, observed: DataFrame, keys: Sequence[str] = (ORG, "field")) -> DataFrame:
    """Expected against observed changes: hits, false alarms, misses, precision and recall."""
    keys = list(keys)
    e = expected.select(*keys).distinct().withColumn("__e", F.lit(True))
    o = observed.select(*keys).distinct().withColumn("__o", F.lit(True))
    both = e.join(o, keys, "full_outer")
    counts = both.agg(
        count_where(F.col("__e") & F.col("__o")).alias("true_positive"),
        count_where(F.col("__e").isNull()).alias("false_positive"),
        count_where(F.col("__o").isNull()).alias("false_negative"),
    )
    tp = F.col("true_positive")
    return counts.withColumn("precision", ratio(tp, tp + F.col("false_positive"), 1.0)).withColumn(
        "recall", ratio(tp, tp + F.col("false_negative"), 1.0)
    )


def overlap(a: DataFrame, b: DataFrame, key: str = ORG) -> DataFrame:
    """Sizes and overlap of two samples."""
    left = a.select(key).distinct().withColumn("__a", F.lit(1))
    right = b.select(key).distinct().withColumn("__b", F.lit(1))
    return left.join(right, key, "full_outer").agg(
        F.count("__a").alias("left_size"), F.count("__b").alias("right_size"),
        count_where(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("overlap"),
    )
