"""Queries over footprints, scores and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K, url as U
from ..operators import contract as C, control, evaluate as E, feed, footprint as P, normalise as N, percentiles as Q
from . import base, sqltext as S
from .catalog import load, query
from .identity import channel_hits
from .joins import audit_labels, gold, predictions
from .projections import graded_profiles

ORG = "organisation_number"
AS_OF = "2024-01-31T00:00:00Z"
_FRESH = "CAST(retrieved_at AS TIMESTAMP) <= TIMESTAMP '2024-01-31' AND CAST(retrieved_at AS TIMESTAMP) >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY"
_HOST = S.host("source_url")

_FOOTPRINT = f"""SELECT o.organisation_number, count(a.event_id) AS accepted_observations, count(*) - count(a.event_id) AS rejected_observations,
 count(*) FILTER (a.event_id IS NOT NULL AND {_FRESH.replace('retrieved_at', 'a.retrieved_at')}) AS fresh_observations,
 count(*) FILTER (a.signal_type IN ('review', 'review_summary')) AS review_signal_count, count(DISTINCT CASE WHEN a.signal_type = 'job_posting' THEN a.source_url END) AS active_job_count,
 count(DISTINCT CASE WHEN a.signal_type IN ('public_post', 'public_mention', 'buzz_metrics') THEN a.source_url END) AS public_item_count,
 COALESCE(CAST(sum(CASE WHEN a.signal_type IN ('public_post', 'public_mention', 'buzz_metrics') THEN a.likes + a.comments + COALESCE(a.shares, 0) END) AS BIGINT), 0) AS public_engagement,
 count(a.sentiment_label) AS sentiment_items, count(DISTINCT CASE WHEN a.sentiment_label IS NOT NULL THEN {_HOST.replace('source_url', 'a.source_url')} END) AS independent_sources,
 count(DISTINCT CASE WHEN a.sentiment_label IS NOT NULL THEN a.reviewer_id END) AS independent_reviewers,
 sum(CASE a.sentiment_label WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 WHEN 'neutral' THEN 0 END) AS s, count(CASE WHEN a.sentiment_label IN ('positive', 'negative', 'neutral') THEN 1 END) AS n
 FROM observations o LEFT JOIN accepted a USING (event_id) GROUP BY 1"""
base.VIEWS["footprint"] = (("observations", "accepted"), _FOOTPRINT)


@query(
    "agg_01_footprint",
    base.oracle("footprint", """SELECT organisation_number, CASE WHEN accepted_observations > 0 THEN 'available' ELSE 'not_available' END AS status, accepted_observations, rejected_observations, fresh_observations,
    review_signal_count, active_job_count, public_item_count, public_engagement, COALESCE(platforms, '') AS platforms FROM footprint LEFT JOIN
    (SELECT organisation_number, string_agg(DISTINCT platform, ',' ORDER BY platform) AS platforms FROM accepted GROUP BY 1) USING (organisation_number)"""),
)
def footprint(spark, folder):
    return P.footprint(base.observations(spark, folder), AS_OF, 10).select(
        ORG, "status", "accepted_observations", "rejected_observations", "fresh_observations", "review_signal_count",
        "active_job_count", "public_item_count", "public_engagement", F.array_join("platforms", ",").alias("platforms"),
    )


@query(
    "agg_02_footprint_sentiment",
    base.oracle("footprint", """SELECT organisation_number, sentiment_items, independent_sources, independent_reviewers, CASE WHEN ready THEN 'available' ELSE 'abstain' END AS sentiment_status,
    CASE WHEN ready AND n > 0 THEN floor((50 + 50 * s / n) * 10 + 0.5) / 10 END AS sentiment_score
    FROM (SELECT *, sentiment_items >= 10 AND (independent_sources >= 2 OR independent_reviewers >= 10) AS ready FROM footprint)"""),
)
def footprint_sentiment(spark, folder):
    return P.footprint(base.observations(spark, folder), AS_OF, 10).select(
        ORG, "sentiment_items", "independent_sources", "independent_reviewers", "sentiment_status", "sentiment_score"
    )


@query(
    "agg_01_platform_counts",
    base.oracle("accepted", "SELECT organisation_number, platform, count(*) AS observations FROM accepted GROUP BY 1, 2"),
)
def platform_counts(spark, folder):
    return P.platform_counts(base.observations(spark, folder))


_PUB = f"exact_entity AND source_class IN {K.ROLLUP_SENTIMENT_CLASSES} AND source_url IS NOT NULL AND retrieved_at IS NOT NULL AND evidence_span IS NOT NULL AND sentiment_label IN {K.SENTIMENT_LABELS}"


@query(
    "agg_03_sentiment_rollup",
    base.oracle("observations", f"""SELECT organisation_number, accepted_items, rejected_items, independent_sources, CASE WHEN independent_sources >= 2 THEN 'available' ELSE 'abstain' END AS status,
    CASE WHEN independent_sources >= 2 THEN CASE p + g + m WHEN 0 THEN 'neutral' WHEN 1 THEN CASE WHEN p = 1 THEN 'positive' WHEN g = 1 THEN 'negative' ELSE 'mixed' END ELSE 'mixed' END END AS label
    FROM (SELECT organisation_number, count(*) FILTER (COALESCE({_PUB}, false)) AS accepted_items, count(*) FILTER (NOT COALESCE({_PUB}, false)) AS rejected_items,
    count(DISTINCT CASE WHEN {_PUB} THEN NULLIF({_HOST}, '') END) AS independent_sources,
    COALESCE(max(CASE WHEN {_PUB} AND sentiment_label = 'positive' THEN 1 END), 0) AS p, COALESCE(max(CASE WHEN {_PUB} AND sentiment_label = 'negative' THEN 1 END), 0) AS g,
    COALESCE(max(CASE WHEN {_PUB} AND sentiment_label = 'mixed' THEN 1 END), 0) AS m FROM observations GROUP BY 1)"""),
)
def sentiment_rollup(spark, folder):
    items = base.observations(spark, folder).withColumnRenamed("sentiment_label", "label")
    return P.sentiment_rollup(items).select(ORG, "accepted_items", "rejected_items", "independent_sources", "status", "label")


_FLAG = lambda v, src, cond: f"COALESCE(bool_or({src} AND ({cond})), false) AS {v}"
_KINDS = {
    "profile_metrics": "signal_type = 'profile_metrics'", "places_identity": "signal_type = 'place_summary'",
    "places_reviews": "signal_type IN ('review', 'review_summary')", "workforce_jobs": "signal_type IN ('job_posting', 'workforce_snapshot')",
    "public_buzz": "signal_type IN ('public_post', 'public_mention', 'buzz_metrics')",
}
_PLACE = "platform = 'google_places' AND signal_type = 'place_summary'"
SCORE_SQL = f"""SELECT g.organisation_number, COALESCE(items, 0) AS accepted_observations, COALESCE(x_items, 0) AS experimental_observations,
 {', '.join(f"CASE WHEN {n} THEN {K.SCORE_MAXIMA[n]} ELSE 0 END AS c_{n}, CASE WHEN {n} OR x_{n} THEN {K.SCORE_MAXIMA[n]} ELSE 0 END AS p_{n}" for n in _KINDS)},
 CASE WHEN (COALESCE(website_publishable, false) OR third) AND items > 0 THEN 20.0 ELSE 0 END AS c_exact_external_identity,
 CASE WHEN (COALESCE(website_publishable, false) OR third OR x_third) AND (items > 0 OR x_items > 0) THEN 20.0 ELSE 0 END AS p_exact_external_identity,
 least(15.0, COALESCE(handles, 0) * 5.0) AS c_verified_handles, least(15.0, COALESCE(all_handles, 0) * 5.0) AS p_verified_handles,
 CASE WHEN ready THEN 15.0 ELSE 0 END AS c_independent_sentiment, CASE WHEN ready OR x_ready THEN 15.0 ELSE 0 END AS p_independent_sentiment,
 CASE WHEN items > 0 THEN 5.0 ELSE 0 END AS c_freshness_evidence, CASE WHEN items > 0 THEN 5.0 ELSE 0 END AS p_freshness_evidence
 FROM graded g LEFT JOIN (SELECT organisation_number, count(*) FILTER (ok) AS items, count(*) FILTER (ex) AS x_items,
  {', '.join(_FLAG(n, 'ok', c) + ', ' + _FLAG('x_' + n, 'ex', c) for n, c in _KINDS.items())},
  {_FLAG('third', 'ok', f"(platform = 'wikidata' AND signal_type = 'company_profile') OR ({_PLACE})")}, {_FLAG('x_third', 'ex', f"(platform = 'company_directory' AND signal_type = 'company_profile') OR ({_PLACE})")},
  count(DISTINCT CASE WHEN ok AND signal_type = 'profile_handle' THEN platform END) AS handles, count(DISTINCT CASE WHEN (ok OR (ex AND platform <> 'myspace')) AND signal_type = 'profile_handle' THEN platform END) AS all_handles,
  count(*) FILTER (ok AND sentiment_label IS NOT NULL) >= 10 AND (count(DISTINCT CASE WHEN ok AND sentiment_label IS NOT NULL THEN {_HOST} END) >= 2 OR count(DISTINCT CASE WHEN ok AND sentiment_label IS NOT NULL THEN reviewer_id END) >= 10) AS ready,
  COALESCE(bool_or(ex AND signal_type = 'review_summary' AND review_count >= 10 AND rating > 0 AND rating <= 5), false) OR (count(*) FILTER (ex AND sentiment_label IS NOT NULL) >= 10 AND
   (count(DISTINCT CASE WHEN ex AND sentiment_label IS NOT NULL THEN {_HOST} END) >= 2 OR count(DISTINCT CASE WHEN ex AND sentiment_label IS NOT NULL THEN reviewer_id END) >= 10)) AS x_ready
  FROM (SELECT o.*, a.event_id IS NOT NULL AS ok, x.event_id IS NOT NULL AS ex FROM observations o LEFT JOIN accepted a USING (event_id) LEFT JOIN experimental x USING (event_id)) GROUP BY 1) f USING (organisation_number)"""
base.VIEWS["scores"] = (("graded", "observations", "accepted", "experimental"), SCORE_SQL)
_C_SUM = " + ".join(f"c_{n}" for n in K.SCORE_MAXIMA)
_P_SUM = " + ".join(f"p_{n}" for n in K.SCORE_MAXIMA)


def score_profiles(spark, folder):
    return graded_profiles(spark, folder).withColumn("site_publishable", F.coalesce("website_publishable", F.lit(False)))


def scores(spark, folder):
    return P.development_score(score_profiles(spark, folder), base.observations(spark, folder))


@query(
    "agg_04_development_score",
    base.oracle("scores", "SELECT organisation_number, accepted_observations, experimental_observations, "
                + ", ".join(f"CAST(c_{n} AS DOUBLE) AS c_{n}, CAST(p_{n} AS DOUBLE) AS p_{n}" for n in K.SCORE_MAXIMA)
                + f", CAST({_C_SUM} AS DOUBLE) AS score, CAST({_P_SUM} AS DOUBLE) AS experimental_potential_score FROM scores"),
)
def development_score(spark, folder):
    return scores(spark, folder)


def module_profiles(spark, folder):
    e = graded_profiles(spark, folder)
    return e.select(
        ORG, "municipality", F.when(F.col("employees") % 5 != 0, F.col(ORG)).alias("live_organisation_number"), "financials_status",
        F.when(~F.col("bankrupt"), F.lit("available")).alias("roles_status"), F.when(F.col("liquidating"), "error").otherwise("available").alias("locations_status"), "website_status",
    )


base.VIEWS["module_profiles"] = (("graded",), """SELECT organisation_number, municipality, CASE WHEN employees % 5 <> 0 THEN organisation_number END AS live, financials_status,
 CASE WHEN NOT bankrupt THEN 'available' END AS roles_status, CASE WHEN liquidating THEN 'error' ELSE 'available' END AS locations_status, website_status FROM graded""")
_SCALE = lambda p, n, w: f"floor({w} * least(1.0, {p}_{n} / {K.SCORE_MAXIMA[n]}) * 1000 + 0.5) / 1000"
_COMPLETE = f"""SELECT organisation_number, municipality, CASE WHEN live = organisation_number THEN 5.0 ELSE 0 END + CASE WHEN financials_status = 'available' THEN 10.0 ELSE 0 END
 + CASE WHEN roles_status IS NOT NULL THEN 5.0 ELSE 0 END + CASE WHEN locations_status <> 'error' THEN 5.0 ELSE 0 END + 5.0 AS f,
 {' + '.join(_SCALE('c', n, w) for n, w in K.ENRICHMENT_WEIGHTS.items())} AS s, {' + '.join(_SCALE('p', n, w) for n, w in K.ENRICHMENT_WEIGHTS.items())} AS e, c_public_buzz FROM module_profiles JOIN scores USING (organisation_number)"""
base.VIEWS["complete"] = (("module_profiles", "scores"), f"SELECT organisation_number, municipality, CAST(f AS DOUBLE) AS f, floor((f + s) * 1000 + 0.5) / 1000 AS s, floor((f + e) * 1000 + 0.5) / 1000 AS e, c_public_buzz FROM ({_COMPLETE})")


def complete(spark, folder):
    return P.completeness(module_profiles(spark, folder), scores(spark, folder))


@query("agg_05_completeness", base.oracle("complete", "SELECT organisation_number, f AS foundation_score, CAST(s AS DOUBLE) AS strict_completeness_score, CAST(e AS DOUBLE) AS experimental_completeness_score FROM complete"))
def completeness(spark, folder):
    return complete(spark, folder).select(ORG, "foundation_score", "strict_completeness_score", "experimental_completeness_score")


_MEAN = lambda c: f"floor(CAST(sum(CAST({c} AS DECIMAL(18,3))) AS DOUBLE) / count(*) * 1000 + 0.5) / 1000"


@query(
    "agg_06_completeness_summary",
    base.oracle("complete", f"""SELECT municipality, count(*) AS companies, {_MEAN('f')} AS foundation_mean, {_MEAN('s')} AS strict_completeness_mean, {_MEAN('e')} AS experimental_completeness_mean,
    count(*) FILTER (s >= 50) AS strict_at_50, count(*) FILTER (e >= 65) AS experimental_at_65, floor(avg(CASE WHEN c_public_buzz > 0 THEN 1.0 ELSE 0.0 END) * 10000 + 0.5) / 10000 AS coverage_public_buzz
    FROM complete GROUP BY ROLLUP (municipality)"""),
)
def completeness_summary(spark, folder):
    scored = complete(spark, folder).join(base.entities(spark, folder).select(ORG, "municipality"), ORG)
    return P.completeness_summary(scored, "municipality").select(
        "municipality", "companies", "foundation_mean", "strict_completeness_mean", "experimental_completeness_mean", "strict_at_50", "experimental_at_65", "coverage_public_buzz"
    )


@query("agg_06_score_distribution", base.oracle("complete", "SELECT CAST(s AS DOUBLE) AS strict_completeness_score, count(*) AS companies FROM complete GROUP BY 1"))
def score_distribution(spark, folder):
    return P.score_distribution(complete(spark, folder))


@query(
    "agg_06_transfer",
    base.oracle("complete", f"""SELECT floor((e.s - b.s) * 1000 + 0.5) / 1000 AS strict_mean_delta, floor(e.s / b.s * 10000 + 0.5) / 10000 AS strict_retention, floor((e.x - b.x) * 1000 + 0.5) / 1000 AS experimental_mean_delta, floor(e.x / b.x * 10000 + 0.5) / 10000 AS experimental_retention
    FROM (SELECT {_MEAN('s')} AS s, {_MEAN('e')} AS x FROM complete WHERE organisation_number < '100000100') b, (SELECT {_MEAN('s')} AS s, {_MEAN('e')} AS x FROM complete WHERE organisation_number >= '100000100') e"""),
)
def transfer(spark, folder):
    part = F.when(F.col(ORG) < "100000100", "base").otherwise("extension")
    summary = P.completeness_summary(complete(spark, folder).withColumn("part", part), "part")
    return P.transfer(summary, "part", "base", "extension")


_COVERAGE = """SELECT count(*) AS profiles, count(p) / count(*) AS any_external, count(CASE WHEN p >= 2 THEN 1 END) / count(*) AS two_platforms, count(CASE WHEN w THEN 1 END) / count(*) AS workforce_jobs,
 count(CASE WHEN r THEN 1 END) / count(*) AS ratings_reviews, count(CASE WHEN b THEN 1 END) / count(*) AS buzz_engagement, count(CASE WHEN s THEN 1 END) / count(*) AS sentiment
 FROM entities LEFT JOIN (SELECT organisation_number, count(DISTINCT platform) AS p, bool_or(signal_type IN ('job_posting', 'workforce_snapshot')) AS w, bool_or(signal_type IN ('review', 'review_summary', 'place_summary')) AS r,
 bool_or(signal_type IN ('public_post', 'public_mention', 'profile_metrics')) AS b, bool_or(sentiment_label IS NOT NULL) AS s FROM accepted GROUP BY 1) USING (organisation_number)"""


@query("agg_07_coverage_ratios", base.oracle("entities accepted", _COVERAGE))
def coverage_ratios(spark, folder):
    return P.coverage_ratios(base.entities(spark, folder), base.observations(spark, folder))


_AUDIT = """SELECT count(*) AS audited_observations, count(ok) AS published_audited, count(ok) FILTER (NOT exact_entity_label) AS wrong_entity_publications, count(ok) FILTER (NOT metric_correct) AS wrong_metric_publications,
 0 AS unsupported_publications, count(ok) FILTER (sentiment_label IS NOT NULL) AS sentiment_audited, count(ok) FILTER (sentiment_label IS NOT NULL AND sentiment_correct) AS sc
 FROM observations o JOIN audit_labels l USING (id) LEFT JOIN (SELECT event_id, 1 AS ok FROM accepted) a USING (event_id)"""


@query(
    "agg_08_audit_report",
    base.oracle("observations accepted audit_labels", f"""SELECT audited_observations, published_audited, wrong_entity_publications, wrong_metric_publications, CAST(unsupported_publications AS BIGINT) AS unsupported_publications, sentiment_audited,
    (published_audited - wrong_entity_publications) / published_audited AS entity_precision, (published_audited - wrong_metric_publications) / published_audited AS metric_precision, sc / sentiment_audited AS sentiment_accuracy,
    (SELECT count(*) FROM labels) >= 100 AS audit_size_gate, false AS qualification_passed FROM ({_AUDIT})"""),
)
def audit_report(spark, folder):
    return E.audit_report(base.observations(spark, folder), audit_labels(spark, folder))


_PER_LABEL = """SELECT l.label, count(*) FILTER (g.label = l.label AND p.label = l.label) AS tp, count(*) FILTER (g.label <> l.label AND p.label = l.label) AS fp,
 count(*) FILTER (g.label = l.label AND p.label IS DISTINCT FROM l.label) AS fn, count(*) FILTER (g.label = l.label) AS support
 FROM (VALUES ('positive'), ('neutral'), ('negative'), ('mixed')) l(label), gold g LEFT JOIN predictions p ON g.id = p.id GROUP BY 1"""
base.VIEWS["per_label"] = (("gold", "predictions"), f"SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM ({_PER_LABEL})")


@query(
    "agg_09_label_metrics",
    base.oracle("per_label", "SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM per_label"),
)
def label_metrics(spark, folder):
    return E.label_metrics(gold(spark, folder), predictions(spark, folder))


@query(
    "agg_09_classification_report",
    base.oracle("gold predictions per_label", f"""SELECT o.*, m.macro_f1, true AS required_labels_present, correct / gold_items AS accuracy, (published_predictions - wrong_entity_predictions) / published_predictions AS exact_entity_precision,
    evidence_supported_predictions / published_predictions AS evidence_support_rate, published_predictions / gold_items AS coverage, false AS qualification_passed, false AS production_scale_gate_passed FROM
    (SELECT count(*) AS gold_items, count(p.label) AS published_predictions, count(*) FILTER (g.label = p.label) AS correct, count(*) FILTER (p.label IS NOT NULL AND NOT exact_entity) AS wrong_entity_predictions,
    count(*) FILTER (p.label IS NOT NULL AND exact_entity AND source_class IN {K.ROLLUP_SENTIMENT_CLASSES} AND evidence_span <> '') AS evidence_supported_predictions,
    count(*) FILTER (p.label IS NOT NULL AND source_class = 'company_owned') AS company_owned_predictions FROM gold g LEFT JOIN predictions p USING (id)) o,
    (SELECT (max(f) FILTER (label = 'positive') + max(f) FILTER (label = 'neutral') + max(f) FILTER (label = 'negative') + max(f) FILTER (label = 'mixed')) / 4 AS macro_f1
    FROM (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f FROM per_label)) m""").replace("SELECT o.*,", "SELECT o.* EXCLUDE (correct),"),
)
def classification_report(spark, folder):
    return E.classification_report(gold(spark, folder), predictions(spark, folder))


@query(
    "agg_10_identity_completeness",
    base.oracle("module_profiles", "SELECT count(*) AS profiles, count(*) FILTER (live IS NULL) AS failures, count(live) / count(*) AS exact_registry_ratio FROM module_profiles"),
)
def identity_completeness(spark, folder):
    return E.identity_completeness(module_profiles(spark, folder))


def module_states(spark, folder):
    from .gates import module_records

    records = module_records(spark, folder)
    return records.select(ORG, "module", C.terminal_state("status", F.lit(None)).alias("state"))


@query(
    "agg_11_batch_checks",
    f"""SELECT CAST(sum(n) AS BIGINT) AS emitted, true AS all_entity_states_terminal, 0 AS invalid_states, true AS exact_expected_count, max(n) = 1 AS unique_organisation_numbers, true AS all_module_states_terminal,
    max(n) = 1 AS zero_silent_drops, max(n) = 1 AS passed FROM (SELECT user_id, count(DISTINCT CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS n FROM events GROUP BY 1)""",
)
def batch_checks(spark, folder):
    m = module_states(spark, folder)
    envelopes = m.select(ORG, "state").distinct()
    return E.batch_checks(envelopes, m, envelopes)


@query(
    "agg_11_batch_against_manifest",
    f"""WITH b AS (SELECT user_id, bool_or(event_type = 'error') AS bad FROM events GROUP BY 1) SELECT count(*) AS emitted, true AS all_entity_states_terminal, CAST((SELECT count(*) FROM nation) AS BIGINT) AS invalid_states,
    false AS exact_expected_count, true AS unique_organisation_numbers, false AS all_module_states_terminal, false AS zero_silent_drops, false AS passed FROM b WHERE NOT bad OR user_id % 2 = 0""",
)
def batch_against_manifest(spark, folder):
    """The manifest asks for every user; some with an error gave no envelope, and some module states are unknown."""
    user = (F.col("user_id") + 100000000).cast("string").alias(ORG)
    events = load(spark, folder, "events")
    seen = events.groupBy(user).agg(F.max(F.col("event_type") == "error").alias("bad"))
    envelopes = seen.where(~F.col("bad") | (F.col(ORG).cast("long") % 2 == 0)).select(ORG, F.when(F.col("bad"), "submission_error").otherwise("complete").alias("state"))
    odd = load(spark, folder, "nation").select(F.col("n_name").alias(ORG), F.lit("module").alias("module"), F.lit("half done").alias("state"))
    return E.batch_checks(envelopes, module_states(spark, folder).unionByName(odd), seen.select(ORG))


@query(
    "agg_10_identity_failures",
    base.oracle("module_profiles", "SELECT organisation_number FROM module_profiles WHERE live IS NULL"),
)
def identity_failures(spark, folder):
    return E.identity_failures(module_profiles(spark, folder))


@query(
    "agg_01_rejections",
    base.oracle("observations accepted", "SELECT organisation_number, id, true AS has_reasons FROM observations WHERE id NOT IN (SELECT id FROM accepted)"),
)
def rejections(spark, folder):
    return P.rejections(base.observations(spark, folder)).select(ORG, "id", (F.size("reasons") > 0).alias("has_reasons"))


FACTS = {
    "sentiment_qualified": True, "fresh_coverage": 0.5, "connector_policy": True, "research_score": 11.0, "external_qa": True,
    "batch_passed": True, "resume_passed": True, "refresh_passed": False, "p95_ms": 1418.0, "ux_score": 9.0, "ux_external": False,
}


@query(
    "agg_12_scorecard",
    base.oracle("module_profiles entities accepted", f"""SELECT profiles, floor(10 * sentiment * 1000 + 0.5) / 1000 AS external_footprint_intelligence, floor((a + b + c + d) * 1000 + 0.5) / 1000 AS official_company_foundation, 9.167 AS research_agent,
    9.0 AS daily_extensibility_refresh, 4.0 AS product_ux_design, false AS qualification_passed, floor((floor(10 * sentiment * 1000 + 0.5) / 1000 + floor((a + b + c + d) * 1000 + 0.5) / 1000 + 9.167 + 9.0 + 4.0) * 1000 + 0.5) / 1000 AS raw_score, false AS target_met, 0.0 AS awardable_score
    FROM ({_COVERAGE}) cov, (SELECT floor(4 * count(live) / count(*) * 1000 + 0.5) / 1000 AS a, floor(4 * count(*) FILTER (financials_status = 'available') / count(*) * 1000 + 0.5) / 1000 AS b,
    floor(4 * count(roles_status) / count(*) * 1000 + 0.5) / 1000 AS c, 3.0 AS d FROM module_profiles) f""").replace("9.167 AS research", "CAST(9.167 AS DOUBLE) AS research").replace("9.0 AS daily", "CAST(9.0 AS DOUBLE) AS daily").replace("4.0 AS product", "CAST(4.0 AS DOUBLE) AS product").replace("0.0 AS award", "CAST(0.0 AS DOUBLE) AS award"),
)
def scorecard(spark, folder):
    obs = base.observations(spark, folder)
    ratios = E.module_ratios(module_profiles(spark, folder))
    coverage = P.coverage_ratios(base.entities(spark, folder), obs)
    return E.scorecard(ratios, coverage, E.audit_report(obs, audit_labels(spark, folder)), FACTS)


@query(
    "agg_13_latency_summary",
    "SELECT event_type, count(*) AS n, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, max(value) AS max FROM events GROUP BY 1",
)
def latency_summary(spark, folder):
    return Q.latency_summary(load(spark, folder, "events"), "value", ["event_type"])


@query(
    "agg_14_index_percentiles",
    """WITH s AS (SELECT event_type, count(*) AS n, list(value ORDER BY value) AS v FROM events GROUP BY 1)
    SELECT event_type, 'batch' AS rule, n, v[CAST(floor(n / 2) AS INT) + 1] AS p50, v[least(n, CAST(floor(0.95 * n) AS INT) + 1)] AS p95 FROM s UNION ALL
    SELECT event_type, 'search', n, v[CAST(floor((n - 1) * 0.5) AS INT) + 1], v[least(n, CAST(floor((n - 1) * 0.95) AS INT) + 1)] FROM s UNION ALL
    SELECT event_type, 'model', n, v[CAST(floor((n - 1) / 2) AS INT) + 1], NULL FROM s""",
)
def index_percentiles(spark, folder):
    events = load(spark, folder, "events")
    return Q.index_percentiles(events, "value", ["event_type"])


@query(
    "agg_15_host_fairness",
    f"""SELECT count(*) AS domains, percentile_disc(0.5) WITHIN GROUP (ORDER BY CAST(n AS DOUBLE)) AS p50_requests, percentile_disc(0.95) WITHIN GROUP (ORDER BY CAST(n AS DOUBLE)) AS p95_requests, CAST(max(n) AS DOUBLE) AS max_requests
    FROM (SELECT {S.host('url')} AS host, count(*) AS n FROM pages GROUP BY 1)""",
)
def host_fairness(spark, folder):
    return Q.host_fairness(load(spark, folder, "pages").withColumn("host", U.host("url")))


_CSTATUS = "CASE WHEN status_code IN (404, 410) THEN 'not_found' WHEN status_code >= 300 THEN 'source_error' WHEN content_type LIKE '%pdf%' THEN 'source_error' ELSE 'available' END"
_CERROR = "CASE WHEN status_code <> 200 THEN 'HTTP ' || CAST(status_code AS VARCHAR) WHEN content_type LIKE '%pdf%' THEN 'Unsupported content type' END"
base.VIEWS["crawl_events"] = (("captures",), f"SELECT *, {_CSTATUS} AS status, {_CERROR} AS bucket FROM captures")


@query(
    "agg_16_crawl_report",
    base.oracle("crawl_events", """SELECT 'website_status' AS section, status AS key, CAST(count(*) AS DOUBLE) AS value FROM crawl_events GROUP BY 2 UNION ALL SELECT 'page_kind', page_kind, count(*) FROM crawl_events GROUP BY 2
    UNION ALL SELECT 'response_status', CAST(status_code AS VARCHAR), count(*) FROM crawl_events GROUP BY 2 UNION ALL SELECT 'error_bucket', bucket, count(*) FROM crawl_events WHERE bucket IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'crawl', 'website_seeds_selected', count(*) FROM seeds UNION ALL SELECT 'crawl', 'terminal_coverage', floor(count(n) / count(*) * 1000000 + 0.5) / 1000000 FROM seeds
    UNION ALL SELECT 'crawl', 'request_amplification_per_seed', floor(sum(COALESCE(n, 0)) / count(*) * 1000 + 0.5) / 1000 FROM seeds""").replace(
        " SELECT 'website_status'", ", seeds AS (SELECT s.organisation_number, n FROM (SELECT DISTINCT organisation_number FROM captures UNION ALL SELECT 'extra' || CAST(n_nationkey AS VARCHAR) FROM nation) s LEFT JOIN (SELECT organisation_number, count(*) AS n FROM captures GROUP BY 1) c USING (organisation_number)) SELECT 'website_status'", 1),
)
def crawl_report(spark, folder):
    from ..operators.extract import page_events

    events = page_events(base.captures(spark, folder))
    known = base.captures(spark, folder).select(ORG).distinct()
    extra = load(spark, folder, "nation").select(F.concat(F.lit("extra"), F.col("n_nationkey").cast("string")).alias(ORG))
    return E.crawl_report(known.unionByName(extra).withColumn("website", F.lit("x.no")), events)


@query(
    "agg_17_fresh_coverage",
    base.oracle("entities job_index", """SELECT count(*) AS entities, count(f.organisation_number) AS fresh_entities, count(f.organisation_number) / count(*) AS fresh_coverage FROM entities e LEFT JOIN
    (SELECT DISTINCT organisation_number FROM job_index WHERE CAST(published AS TIMESTAMP) BETWEEN TIMESTAMP '2024-01-21' AND TIMESTAMP '2024-01-31') f USING (organisation_number)"""),
)
def fresh_coverage(spark, folder):
    jobs = feed.job_index(N.parse_feed(base.feed(spark, folder)))
    return feed.fresh_coverage(base.entities(spark, folder), jobs, AS_OF, 10)


_BAND = "CASE WHEN employees IS NULL THEN 'missing' WHEN employees = 0 THEN '0' WHEN employees < 5 THEN '1-4' WHEN employees < 20 THEN '5-19' WHEN employees < 100 THEN '20-99' ELSE '100+' END"
STRATUM_SQL = f"""concat_ws('|', CASE WHEN legal_form IN ('AS', 'ASA', 'ENK') THEN legal_form ELSE 'OTHER' END, {_BAND}, CASE WHEN bankrupt OR liquidating THEN 'adverse' ELSE 'active' END, CASE WHEN website <> '' THEN 'web' ELSE 'no-web' END)"""
FILER_STRATUM_SQL = f"""concat_ws('|', legal_form, {_BAND}, split_part(industry_code, '.', 1), left(municipality_number, 2), CASE WHEN website <> '' THEN 'web' ELSE 'no-web' END)"""


@query(
    "agg_18_strata",
    base.oracle("entities", f"SELECT {STRATUM_SQL} AS stratum, 'population' AS kind, count(*) AS n FROM entities GROUP BY 1 UNION ALL SELECT {FILER_STRATUM_SQL}, 'filer', count(*) FROM entities GROUP BY 1"),
)
def strata(spark, folder):
    from ..operators.sampling import filer_stratum, strata_counts

    e = base.entities(spark, folder)
    return strata_counts(e).withColumn("kind", F.lit("population")).unionByName(strata_counts(e, filer_stratum()).withColumn("kind", F.lit("filer")))


@query(
    "agg_19_status_report",
    base.oracle("observations", "SELECT acquisition_mode AS status, count(*) AS results, count(DISTINCT organisation_number) AS companies FROM observations GROUP BY 1"),
)
def status_report(spark, folder):
    return E.status_report(base.observations(spark, folder).withColumnRenamed("acquisition_mode", "status"))


HISTORY_SQL = "SELECT strategy, CASE WHEN likes % 3 = 0 THEN 0.0 ELSE (likes - 40) / 8.0 END AS learning_gain, CASE WHEN comments % 4 = 0 THEN NULL ELSE comments / 16.0 END AS score_delta FROM observations"
base.VIEWS["history"] = (("observations",), HISTORY_SQL)
_REWARD = "COALESCE(NULLIF(learning_gain, 0), score_delta, 0)"


def history(spark, folder):
    return base.observations(spark, folder).select(
        "strategy", F.when(F.col("likes") % 3 == 0, 0.0).otherwise((F.col("likes") - 40) / 8.0).alias("learning_gain"),
        F.when(F.col("comments") % 4 != 0, F.col("comments") / 16.0).alias("score_delta"),
    )


@query(
    "agg_20_strategy_history",
    base.oracle("history", f"""SELECT strategy, count(*) AS prior_runs, count(*) FILTER ({_REWARD} > 0) AS prior_successes, floor(CAST(sum(CAST({_REWARD} AS DECIMAL(18,6))) AS DOUBLE) / count(*) * 1000 + 0.5) / 1000 AS prior_mean_learning_gain FROM history GROUP BY 1"""),
)
def strategy_history(spark, folder):
    return control.strategy_history(history(spark, folder))


@query(
    "agg_21_channel_metrics",
    f"""SELECT CAST(100000000 + user_id AS VARCHAR) AS organisation_number, 'https://youtube.com/c/' || CAST(k % 7 AS VARCHAR) AS channel_url, count(*) AS matched_recent_posts, CAST(sum(v) AS BIGINT) AS recent_views_total,
    floor(sum(v) / count(v) * 10 + 0.5) / 10 AS recent_views_mean FROM (SELECT *, CASE WHEN k % 5 <> 0 THEN CAST(floor(value) AS BIGINT) END AS v FROM (SELECT *, {base._K} AS k FROM events) WHERE k % 11 <> 0) GROUP BY 1, 2""",
)
def channel_metrics(spark, folder):
    return E.channel_metrics(channel_hits(spark, folder).where("channel_url <> ''"))


@query(
    "set_01_change_recall",
    """SELECT count(*) FILTER (a AND b) AS true_positive, count(*) FILTER (NOT a AND b) AS false_positive, count(*) FILTER (a AND NOT b) AS false_negative, count(*) FILTER (a AND b) / count(*) FILTER (b) AS precision, count(*) FILTER (a AND b) / count(*) FILTER (a) AS recall
    FROM (SELECT bool_or(e) AS a, bool_or(NOT e) AS b FROM (SELECT o_custkey AS c, o_orderpriority AS p, true AS e FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_custkey, o_orderpriority, false FROM orders WHERE o_orderstatus <> 'O') GROUP BY c, p)""",
)
def change_recall(spark, folder):
    o = load(spark, folder, "orders").select("o_orderstatus", F.col("o_custkey").cast("string").alias(ORG), F.col("o_orderpriority").alias("field"))
    return E.change_recall(o.where("o_orderstatus <> 'F'"), o.where("o_orderstatus <> 'O'"))


@query(
    "set_02_overlap",
    base.oracle("entities", """SELECT count(*) FILTER (employees > 50) AS left_size, count(*) FILTER (website <> '') AS right_size, count(*) FILTER (employees > 50 AND website <> '') AS overlap FROM entities"""),
)
def overlap(spark, folder):
    e = base.entities(spark, folder)
    return E.overlap(e.where("employees > 50"), e.where("website <> ''"))


@query(
    "set_03_union_families",
    base.oracle("accepted job_index", """SELECT signal_type, count(*) AS n FROM (SELECT signal_type FROM accepted UNION ALL SELECT 'job_posting' FROM job_index) GROUP BY 1"""),
)
def union_families(spark, folder):
    from ..operators import gates as G, observations as O
    from ..operators.rows import union_all

    jobs = O.job_observations(feed.job_index(N.parse_feed(base.feed(spark, folder))), "2026-01-01T00:00:00Z")
    obs = base.observations(spark, folder).drop("identity_proof").withColumn("identity_proof", F.when(F.col("k") != 29, F.array(F.struct(F.lit("name").alias("type"), F.lit("x").alias("value")))))
    shared = [c for c in jobs.columns if c in obs.columns]
    both = union_all(obs, jobs.select(*shared))
    return both.where(G.publishable()).groupBy("signal_type").agg(F.count("*").alias("n"))
