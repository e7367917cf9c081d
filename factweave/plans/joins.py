"""Queries over the joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J, normalise as N
from ..session import shared_folder
from ..sources import sinks
from . import base
from .catalog import load, query

ORG = "organisation_number"


def order_manifest(spark, folder):
    """A manifest of the customers seen in orders plus numbers the registry never had."""
    return load(spark, folder, "supplier").select(
        (F.col("s_suppkey") * 17 + 100000000).cast("string").alias(ORG), F.col("s_suppkey").alias("position")
    )


base.VIEWS["manifest"] = ((), "SELECT CAST(s_suppkey * 17 + 100000000 AS VARCHAR) AS organisation_number, s_suppkey AS position FROM supplier")


@query(
    "jon_01_anchor_manifest",
    base.oracle("manifest entities", """SELECT m.organisation_number, position, name, employees, CASE WHEN e.name IS NULL THEN 'not_found' ELSE 'available' END AS registry_status
    FROM manifest m LEFT JOIN entities e USING (organisation_number)"""),
)
def anchor_manifest(spark, folder):
    return J.anchor_manifest(order_manifest(spark, folder), base.entities(spark, folder)).select(ORG, "position", "name", "employees", "registry_status")


@query(
    "jon_02_present_universe",
    base.oracle("manifest entities", """SELECT count(*) AS total, count(e.name) AS kept, count(*) - count(e.name) AS missing FROM manifest m LEFT JOIN entities e USING (organisation_number)"""),
)
def present_universe(spark, folder):
    return J.universe_counts(order_manifest(spark, folder), base.entities(spark, folder))


@query(
    "jon_03_missing_seed_events",
    base.oracle("entities", """SELECT organisation_number, 'https://' || website || '/' AS requested_url, 0 AS status_code, 'source_error' AS status
    FROM entities e WHERE website <> '' AND NOT EXISTS (SELECT 1 FROM events v WHERE CAST(100000000 + user_id AS VARCHAR) = e.organisation_number)"""),
)
def missing_seed_events(spark, folder):
    seen = load(spark, folder, "events").select((F.col("user_id") + 100000000).cast("string").alias(ORG))
    return J.missing_seed_events(base.entities(spark, folder), seen).select(ORG, "requested_url", "status_code", "status")


@query(
    "jon_04_exact_job_lookup",
    base.oracle("job_index entities", "SELECT j.organisation_number, job_id, title FROM job_index j WHERE organisation_number IN (SELECT organisation_number FROM entities WHERE employees > 20)"),
)
def exact_job_lookup(spark, folder):
    from ..operators.feed import job_index

    spaced = F.concat_ws(" ", F.substring(ORG, 1, 3), F.substring(ORG, 4, 3), F.substring(ORG, 7, 3)).alias(ORG)
    wanted = base.entities(spark, folder).where("employees > 20").select(spaced)
    jobs = job_index(N.parse_feed(base.feed(spark, folder)))
    return J.jobs_for(jobs, wanted).select(ORG, "job_id", "title")


@query(
    "jon_05_observations_by_entity",
    base.oracle("entities observations", """SELECT e.organisation_number, COALESCE(n, 0) AS observations, platforms, last_retrieved_at FROM entities e LEFT JOIN
    (SELECT organisation_number, count(*) AS n, count(DISTINCT platform) AS platforms, max(retrieved_at) AS last_retrieved_at FROM observations GROUP BY 1) o USING (organisation_number)"""),
)
def observations_by_entity(spark, folder):
    return J.observations_by_entity(base.entities(spark, folder).select(ORG), base.observations(spark, folder))


@query(
    "jon_05_colocated",
    base.oracle("entities observations", """SELECT e.organisation_number, count(o.id) AS observations, max(o.retrieved_at) AS last_retrieved_at FROM entities e LEFT JOIN observations o USING (organisation_number) GROUP BY 1"""),
)
def colocated(spark, folder):
    """Entities and observations in tables of equal buckets: grouped and joined without a shuffle."""
    tables = []
    for name, df in (("profiles", base.entities(spark, folder).select(ORG, "name")), ("observations", base.observations(spark, folder).select(ORG, "id", "platform", "retrieved_at"))):
        path = shared_folder(spark, name)
        tables.append(sinks.write_bucketed(df, path.rsplit("/", 1)[-1].replace("-", "_"), ORG, 8, path))
    return J.observations_by_entity(*tables).select(ORG, "observations", "last_retrieved_at")


@query(
    "jon_02_present_rows",
    base.oracle("manifest entities", "SELECT organisation_number FROM manifest WHERE organisation_number IN (SELECT organisation_number FROM entities)"),
)
def present_rows(spark, folder):
    return J.present_universe(order_manifest(spark, folder), base.entities(spark, folder)).select(ORG)


@query("jon_06_pending", base.oracle("entities", "SELECT organisation_number FROM entities WHERE NOT (employees >= 30) OR employees IS NULL"))
def pending(spark, folder):
    e = base.entities(spark, folder).select(ORG, "employees")
    return J.pending(e.select(ORG), e.where("employees >= 30").select(ORG))


def audit_labels(spark, folder):
    return load(spark, folder, "labels").select(
        F.concat(F.lit("obs-"), F.col("doc_id").cast("string")).alias("id"), (F.col("quality") == 1).alias("exact_entity_label"),
        (F.col("toxic") == 0).alias("metric_correct"), (F.col("quality") == 1).alias("sentiment_correct"),
    )


base.VIEWS["audit_labels"] = ((), "SELECT 'obs-' || CAST(doc_id AS VARCHAR) AS id, quality = 1 AS exact_entity_label, toxic = 0 AS metric_correct, quality = 1 AS sentiment_correct FROM labels")


@query(
    "jon_07_audit_join",
    base.oracle("observations audit_labels", "SELECT id, platform, exact_entity_label, metric_correct FROM observations JOIN audit_labels USING (id)"),
)
def audit_join(spark, folder):
    return J.audit_join(base.observations(spark, folder), audit_labels(spark, folder)).select("id", "platform", "exact_entity_label", "metric_correct")


GOLD_LABEL = "CASE WHEN quality = 1 AND toxic = 0 THEN 'positive' WHEN quality = 1 THEN 'mixed' WHEN toxic = 1 THEN 'negative' ELSE 'neutral' END"
PRED_LABEL = "CASE WHEN n_chars % 13 = 0 THEN NULL WHEN n_chars > 1500 THEN 'positive' WHEN n_chars > 900 THEN 'negative' WHEN n_chars > 500 THEN 'mixed' ELSE 'neutral' END"
PRED_CLASS = "CASE n_chars % 5 WHEN 0 THEN 'company_owned' WHEN 1 THEN 'licensed_news' WHEN 2 THEN 'public_news' ELSE 'official_notice' END"
base.VIEWS["gold"] = ((), f"SELECT CAST(doc_id AS VARCHAR) AS id, {GOLD_LABEL} AS label FROM labels")
base.VIEWS["predictions"] = ((), f"SELECT CAST(doc_id AS VARCHAR) AS id, {PRED_LABEL} AS label, n_chars % 7 <> 0 AS exact_entity, {PRED_CLASS} AS source_class, source AS source_url, lang AS retrieved_at, CASE WHEN n_chars % 11 = 0 THEN '' ELSE lang END AS evidence_span, lang AS content_sha256 FROM documents")


def gold(spark, folder):
    return load(spark, folder, "labels").selectExpr("CAST(doc_id AS STRING) AS id", f"{GOLD_LABEL} AS label")


def predictions(spark, folder):
    return load(spark, folder, "documents").selectExpr(
        "CAST(doc_id AS STRING) AS id", f"{PRED_LABEL} AS label", "n_chars % 7 <> 0 AS exact_entity", f"{PRED_CLASS} AS source_class",
        "source AS source_url", "lang AS retrieved_at", "CASE WHEN n_chars % 11 = 0 THEN '' ELSE lang END AS evidence_span", "lang AS content_sha256",
    )


@query(
    "jon_08_gold_join",
    base.oracle("gold predictions", "SELECT g.id, g.label AS gold_label, p.label AS predicted_label, p.source_class FROM gold g LEFT JOIN predictions p USING (id)"),
)
def gold_join(spark, folder):
    return J.gold_join(gold(spark, folder), predictions(spark, folder)).select("id", "gold_label", "predicted_label", "source_class")


@query(
    "jon_09_aligned",
    base.oracle("accounts", """SELECT organisation_number, min(year) AS old_year, max(year) AS new_year FROM accounts GROUP BY 1"""),
)
def aligned(spark, folder):
    a = base.accounts(spark, folder)
    old = a.groupBy(ORG).agg(F.min("year").alias("year"))
    new = a.groupBy(ORG).agg(F.max("year").alias("year"))
    return J.aligned(old, new).select(ORG, F.col("o.year").alias("old_year"), F.col("n.year").alias("new_year"))


@query(
    "jon_10_apply_seeds",
    base.oracle("entities", """SELECT organisation_number, CASE WHEN employees > 80 THEN 'https://seed.example/' || organisation_number ELSE website END AS website,
    CASE WHEN employees > 80 THEN 'independently_verified_exact_entity' END AS website_seed_source, CASE WHEN employees > 80 THEN 'https://proof.example/' END AS website_seed_proof_url,
    CASE WHEN employees > 80 THEN municipality END AS website_seed_proof FROM entities"""),
)
def apply_seeds(spark, folder):
    e = base.entities(spark, folder).select(ORG, "website", "employees", "municipality")
    seeds = e.where("employees > 80").select(
        ORG, F.concat(F.lit(" https://seed.example/"), ORG).alias("website"), F.lit("https://proof.example/").alias("proof_url"), F.col("municipality").alias("proof")
    )
    return J.apply_seeds(e, seeds).drop("employees", "municipality")


@query(
    "jon_11_reviewed_observations",
    base.oracle("observations entities", """SELECT DISTINCT 'verified-observation-' || substr(sha256(o.organisation_number || '|' || source_url || '|' || signal_type), 1, 24) AS id, o.organisation_number, signal_type,
    'rights_review_experiment' AS acquisition_mode, 'approved' AS rights_status, e.name AS proof_name FROM observations o JOIN entities e USING (organisation_number)
    WHERE k = 1 AND source_url IS NOT NULL"""),
)
def reviewed_observations(spark, folder):
    none = F.lit(None).cast("string")
    e = base.entities(spark, folder)
    config = (
        base.observations(spark, folder).where("k = 1 AND source_url IS NOT NULL").join(e.select(ORG), ORG, "left_semi")
        .select(ORG, "platform", "signal_type", "source_url", F.sha2("source_url", 256).alias("content_sha256"), F.lit("checked").alias("proof"),
                none.alias("acquisition_mode"), F.lit("approved").alias("rights_status"), none.alias("source_class"), none.alias("strategy"), "evidence_span")
    )
    out = J.reviewed_observations(config, e, "2026-08-23T05:28:01Z")
    return out.select("id", ORG, "signal_type", "acquisition_mode", "rights_status", F.col("identity_proof")[0]["value"].alias("proof_name")).distinct()


@query(
    "jon_12_exact_handle_jobs",
    """SELECT CAST(100000000 + c_custkey AS VARCHAR) AS organisation_number, CAST(1000000 + o_orderkey AS VARCHAR) AS job_id,
    'https://www.linkedin.com/jobs/view/' || CAST(1000000 + o_orderkey AS VARCHAR) AS job_url FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'""",
)
def exact_handle_jobs(spark, folder):
    slug = F.concat(F.lit("https://no.linkedin.com/company/Firm-"), F.col("o_custkey").cast("string"), F.lit("/?trk=x"))
    job = (F.col("o_orderkey") + 1000000).cast("string")
    by_urn = F.col("o_orderpriority") == "1-URGENT"
    cards = load(spark, folder, "orders").select(
        F.col("o_orderkey").alias("seq"), slug.alias("company_link"),
        F.when(by_urn, F.concat(F.lit("urn:li:jobPosting:"), job)).otherwise("urn").alias("urn"),
        F.when(by_urn, "").otherwise(F.concat(F.lit("https://www.linkedin.com/jobs/view/clerk-"), job, F.lit("?x=1"))).alias("job_link"),
    )
    cards = cards.unionByName(cards.withColumn("seq", F.col("seq") + 10**9))
    handles = load(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").select(
        (F.col("c_custkey") + 100000000).cast("string").alias(ORG),
        F.concat(F.lit("https://www.linkedin.com/company/firm-"), F.col("c_custkey").cast("string"), F.lit("/about")).alias("profile_url"),
    )
    return J.exact_handle_jobs(cards, handles).select(ORG, "job_id", "job_url")


_WORDS = "[a-z0-9æøå]+"
MENTION_SQL = f"""WITH titles AS (SELECT doc_id, regexp_extract_all(lower(CASE WHEN position(' - ' IN text) > 0 THEN left(text, length(text) - position(' - ' IN reverse(text)) - 2) ELSE text END), '{_WORDS}') AS w FROM documents),
firsts AS (SELECT doc_id, regexp_extract_all(lower(text), '{_WORDS}')[1:CASE WHEN doc_id % 5 = 4 THEN 5 WHEN doc_id % 2 = 1 THEN 2 ELSE 1 END] AS n FROM documents),
names AS (SELECT array_to_string(n, ' ') AS name, min(doc_id) AS key, n FROM firsts WHERE len(n) > 0 GROUP BY n),
places AS (SELECT doc_id, i, w FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM titles) WHERE i = 1 OR w[i - 1] IN ('av', 'for', 'fra', 'hos', 'i', 'med', 'om', 'på', 'til', 'og', 'kjøper', 'velger'))
SELECT DISTINCT CAST(100000000 + key AS VARCHAR) AS organisation_number, name AS legal_name, doc_id AS title_id
FROM places p JOIN names n ON n.n[1] = p.w[p.i] AND p.w[p.i : p.i + len(n.n) - 1] = n.n"""


def mention_names(spark, folder):
    """Legal names of one, two and five words that start the documents."""
    from ..functions.text import full_name_tokens

    n = F.when(F.col("doc_id") % 5 == 4, 5).when(F.col("doc_id") % 2 == 1, 2).otherwise(1)
    words = load(spark, folder, "documents").select("doc_id", F.slice(full_name_tokens("text"), 1, n).alias("w")).where(F.size("w") > 0)
    return words.groupBy(F.array_join("w", " ").alias("name")).agg((F.min("doc_id") + 100000000).cast("string").alias(ORG))


@query("jon_13_title_mentions", MENTION_SQL)
def title_mentions(spark, folder):
    titles = load(spark, folder, "documents").select(F.col("doc_id").alias("title_id"), F.col("text").alias("title"))
    return J.title_mentions(mention_names(spark, folder), titles)
