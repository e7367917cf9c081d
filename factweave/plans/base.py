"""Relations the queries read, derived from the given tables.

The tables hold customers, orders, events and pages; these views give them the roles of a
registry, filed accounts, observations, a job feed and captures. Each view is written once as
portable SQL expressions and runs over the whole table in either engine. The operators under
test are not part of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import constants as K
from ..operators.normalise import normalise_registry
from .catalog import load, spread


def pick(index: str, items) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(items))
    return f"CASE {index} {arms} END"


def quote(name: str, spark: bool) -> str:
    return f"`{name}`" if spark else f'"{name}"'


def iso(ts: str, spark: bool) -> str:
    return f"date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")" if spark else f"strftime({ts}, '%Y-%m-%dT%H:%M:%SZ')"


def sha(x: str, spark: bool) -> str:
    return f"sha2({x}, 256)" if spark else f"sha256({x})"


# ---- registry --------------------------------------------------------------------------
_CENTS = "CAST(FLOOR(ABS(c_acctbal) * 100 + 0.5) AS BIGINT)"
_FORM = "CASE c_mktsegment WHEN 'BUILDING' THEN 'AS' WHEN 'HOUSEHOLD' THEN 'ENK' WHEN 'MACHINERY' THEN 'ASA' WHEN 'AUTOMOBILE' THEN 'da' ELSE 'KBO' END"
_WORD = "CASE c_mktsegment WHEN 'BUILDING' THEN 'Byggmester Ærlig' WHEN 'HOUSEHOLD' THEN 'Hjemmestell' WHEN 'MACHINERY' THEN 'Mekanisk Verksted' WHEN 'AUTOMOBILE' THEN 'Bilsenter' ELSE 'Møbelhuset Åse' END"
_KEY = "CAST(c_custkey AS STRING)"

REGISTRY_COLUMNS = [
    ("organisasjonsnummer", "CAST(100000000 + c_custkey AS STRING)"),
    ("navn", f"{_WORD} || ' ' || {_KEY} || ' ' || upper({_FORM})"),
    ("organisasjonsform.kode", _FORM),
    ("organisasjonsform.beskrivelse", "lower(c_mktsegment) || ' form'"),
    ("antallAnsatte", "CASE WHEN c_acctbal < 0 THEN '' WHEN c_acctbal > 9000 THEN 'n/a' ELSE CAST(CAST(FLOOR(c_acctbal / 50) AS BIGINT) AS STRING) END"),
    ("konkurs", "CASE WHEN c_acctbal > 9500 THEN 'true' ELSE 'false' END"),
    ("underAvvikling", "CASE WHEN c_acctbal > 9000 AND c_acctbal <= 9500 THEN 'TRUE' ELSE 'false' END"),
    ("forretningsadresse.kommune", "n_name"),
    ("forretningsadresse.kommunenummer", "lpad(CAST(n_nationkey * 37 + 301 AS STRING), 4, '0')"),
    ("forretningsadresse.adresse", f"'Storgata ' || CAST({_CENTS} % 90 + 1 AS STRING)"),
    ("forretningsadresse.postnummer", f"CASE WHEN {_CENTS} % 7 = 0 THEN '' ELSE lpad(CAST({_CENTS} % 9000 AS STRING), 4, '0') END"),
    ("forretningsadresse.poststed", "n_name"),
    ("forretningsadresse.land", f"CASE WHEN {_CENTS} % 2 = 0 THEN 'Norge' ELSE '' END"),
    ("naeringskode1.kode", f"CAST({_CENTS} % 80 + 10 AS STRING) || '.' || lpad(CAST({_CENTS} % 1000 AS STRING), 3, '0')"),
    ("naeringskode1.beskrivelse", f"CASE WHEN {_CENTS} % 11 = 0 THEN '' WHEN {_CENTS} % 3 = 0 THEN 'Utleie av egen eiendom' ELSE lower(c_mktsegment) || ' trade' END"),
    ("hjemmeside", f"CASE WHEN {_CENTS} % 3 = 0 THEN '' ELSE 'www.firma' || CAST({_CENTS} % 5000 AS STRING) || '.example.no' END"),
    ("sisteInnsendteAarsregnskap", f"CASE WHEN {_CENTS} % 4 = 0 THEN '' ELSE CAST(2022 + {_CENTS} % 4 AS STRING) END"),
    ("kapital.belop", f"CASE WHEN {_CENTS} % 5 = 0 THEN CAST({_CENTS} AS STRING) || '.00' ELSE '' END"),
    ("kapital.valuta", f"CASE WHEN {_CENTS} % 10 = 0 THEN 'EUR' ELSE '' END"),
    ("epostadresse", f"CASE {_CENTS} % 4 WHEN 0 THEN '' WHEN 1 THEN 'post@gmail.com' ELSE 'Post@Firma' || CAST({_CENTS} % 5000 AS STRING) || '.no' END"),
    ("telefon", f"CASE WHEN {_CENTS} % 3 = 1 THEN '+47 ' || CAST(20000000 + {_CENTS} AS STRING) ELSE '' END"),
    ("mobil", f"CASE WHEN {_CENTS} % 3 = 2 THEN CAST(90000000 + {_CENTS} AS STRING) ELSE '' END"),
    ("registrertIMvaRegisteret", f"CASE WHEN {_CENTS} % 2 = 0 THEN 'true' ELSE 'false' END"),
    ("registreringsdatoMerverdiavgiftsregisteret", f"CASE WHEN {_CENTS} % 2 = 0 THEN '2019-05-01' ELSE '' END"),
    ("registreringsdatoEnhetsregisteret", "'1995-02-19'"),
    ("registrertIForetaksregisteret", f"CASE WHEN {_CENTS} % 6 = 0 THEN 'TRUE' ELSE 'false' END"),
    ("maalform", "'Bokmål'"),
]
REGISTRY_SQL = (
    "SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in REGISTRY_COLUMNS)
    + ", c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey"
)


def registry_raw(spark: SparkSession, folder: str) -> DataFrame:
    joined = spread(load(spark, folder, "customer")).join(load(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.selectExpr(*[f"{e} AS `{n}`" for n, e in REGISTRY_COLUMNS], "c_custkey")


def entities(spark: SparkSession, folder: str) -> DataFrame:
    return normalise_registry(registry_raw(spark, folder))


ENTITIES_SQL = """
SELECT organisasjonsnummer AS organisation_number, navn AS name, "organisasjonsform.kode" AS legal_form,
  TRY_CAST(antallAnsatte AS INTEGER) AS employees, lower(konkurs) = 'true' AS bankrupt,
  lower(underAvvikling) = 'true' AS liquidating, "forretningsadresse.kommune" AS municipality,
  "forretningsadresse.kommunenummer" AS municipality_number, "naeringskode1.kode" AS industry_code,
  "naeringskode1.beskrivelse" AS industry_label, hjemmeside AS website,
  sisteInnsendteAarsregnskap AS latest_submitted_accounts
FROM registry"""

# ---- filed accounts: orders by customer and year ---------------------------------------
ACCOUNTS_SQL = """
SELECT CAST(100000000 + o_custkey AS VARCHAR) AS organisation_number, CAST(year(o_orderdate) AS INTEGER) AS year,
  SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS revenue,
  SUM(CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END * CAST(o_totalprice AS DECIMAL(18,2))) AS annual_result
FROM orders GROUP BY 1, 2"""


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    money = F.col("o_totalprice").cast("decimal(18,2)")
    return (
        load(spark, folder, "orders")
        .groupBy((F.col("o_custkey") + 100000000).cast("string").alias("organisation_number"), F.year("o_orderdate").alias("year"))
        .agg(
            F.sum(money).cast("decimal(38,2)").alias("revenue"),
            F.sum(F.when(F.col("o_orderstatus") == "F", -money).otherwise(money)).cast("decimal(38,2)").alias("annual_result"),
        )
    )


# ---- observations: events --------------------------------------------------------------
_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
_SIGNAL = (
    "CASE WHEN k = 10 THEN 'unknown_signal' ELSE CASE event_type"
    " WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'public_post' ELSE 'public_mention' END"
    " WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN 'review' ELSE 'review_summary' END"
    " WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 'job_posting' ELSE 'workforce_snapshot' END"
    " WHEN 'purchase' THEN CASE WHEN k % 3 = 0 THEN 'profile_handle' WHEN k % 3 = 1 THEN 'profile_metrics' ELSE 'place_summary' END"
    " ELSE CASE WHEN k % 2 = 0 THEN 'company_profile' ELSE 'buzz_metrics' END END END"
)
_MODES = ("official_api", "licensed_api", "company_authorized_export", "permitted_public_page", "official_api", "licensed_api", "permitted_public_page") + K.EXPERIMENTAL_MODES
_CLASSES = ("customer_review", "employee_review", "licensed_news", "public_news", "public_mention", "licensed_review", "official_notice")
_LABELS = ("positive", "neutral", "negative", "mixed", "positive", "bullish")


def observation_columns(spark: bool) -> list[tuple[str, str]]:
    proof_full = "array(named_struct('type', 'name', 'value', event_type))" if spark else "[{'type': 'name', 'value': event_type}]"
    proof_none = "CAST(array() AS ARRAY<STRUCT<type: STRING, value: STRING>>)" if spark else "CAST([] AS STRUCT(type VARCHAR, value VARCHAR)[])"
    return [
        ("id", "CASE WHEN k = 5 THEN ' ' ELSE 'obs-' || CAST(event_id AS STRING) END"),
        ("organisation_number", "CASE WHEN k = 7 THEN 'x' || CAST(user_id AS STRING) ELSE CAST(100000000 + user_id AS STRING) END"),
        ("platform", pick("k % 20", K.PLATFORMS + ("myspace",))),
        ("signal_type", _SIGNAL),
        ("source_url", "CASE WHEN k = 13 THEN NULL WHEN k = 14 THEN 'no-url' ELSE 'https://www.Site' || CAST(k % 37 AS STRING) || '.example.org/item/' || CAST(event_id % 50 AS STRING) END"),
        ("retrieved_at", f"CASE WHEN k = 17 THEN NULL ELSE {iso('ts', spark)} END"),
        ("content_sha256", f"CASE WHEN k = 19 THEN 'short' ELSE {sha('CAST(event_id AS STRING)', spark)} END"),
        ("exact_entity", "k <> 23"),
        ("identity_proof", f"CASE WHEN k = 29 THEN {proof_none} ELSE {proof_full} END"),
        ("acquisition_mode", pick("k % 10", _MODES)),
        ("rights_status", "CASE WHEN k = 31 THEN 'unknown' ELSE 'approved' END"),
        ("source_class", pick("k % 7", _CLASSES)),
        ("evidence_span", "CASE WHEN k = 37 THEN NULL ELSE event_type || ' ' || CAST(k AS STRING) END"),
        ("sentiment_label", f"CASE WHEN event_type IN ('view', 'click') AND k % 4 <> 3 THEN {pick('k % 6', _LABELS)} END"),
        ("sentiment_model_version", "CASE WHEN k = 43 THEN NULL ELSE 'v1' END"),
        ("reviewer_id", "CASE WHEN k % 9 = 0 THEN NULL ELSE 'rev-' || CAST(event_id % 17 AS STRING) END"),
        ("strategy", pick("k % 18", K.STRATEGIES)),
        ("likes", "CAST(FLOOR(value) AS BIGINT)"),
        ("comments", "CAST(k AS BIGINT)"),
        ("shares", "CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(k % 3 AS BIGINT) END"),
        ("rating", "CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(k % 6 AS DOUBLE) END"),
        ("review_count", "CAST(k % 25 AS BIGINT)"),
        ("event_id", "event_id"),
        ("k", "k"),
    ]


OBSERVATIONS_SQL = (
    "SELECT " + ", ".join(f"{e} AS {n}" for n, e in observation_columns(False))
    + f" FROM (SELECT *, {_K} AS k FROM events) e"
)


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Observations over all cores.

    The columns come out of explodes of one element, a few in each: a filter on them would else take their
    expressions along below them, once for every mention, and one method would hold more code than the JVM compiles.
    """
    out = spread(load(spark, folder, "events")).select("*", F.explode_outer(F.array(F.expr(_K))).alias("k"))
    made = [F.expr(e).alias(n) for n, e in observation_columns(True) if n not in out.columns]
    for i in range(0, len(made), 6):
        out = out.select("*", F.inline_outer(F.array(F.struct(*made[i : i + 6]))))
    return out.select(*[n for n, _ in observation_columns(True)])


# the observation validator in SQL, shared by the oracles that build on it
_CHECKS_SQL = [
    "trim(coalesce(id, '')) = ''",
    "NOT regexp_full_match(coalesce(organisation_number, ''), '[0-9]+')",
    f"coalesce(platform, '') NOT IN {K.PLATFORMS}",
    f"coalesce(signal_type, '') NOT IN {K.SIGNAL_TYPES}",
    "NOT regexp_matches(coalesce(source_url, ''), '^[a-z]+://[^/]+')",
    "coalesce(retrieved_at, '') = ''",
    "length(coalesce(content_sha256, '')) <> 64",
    "NOT coalesce(exact_entity, false)",
    "len(identity_proof) = 0",
    f"coalesce(acquisition_mode, '') NOT IN {K.PUBLISHABLE_MODES}",
    "coalesce(rights_status, '') <> 'approved'",
    f"coalesce(signal_type, '') IN {K.SPAN_SIGNALS} AND coalesce(evidence_span, '') = ''",
    f"sentiment_label IS NOT NULL AND sentiment_label NOT IN {K.SENTIMENT_LABELS}",
    f"sentiment_label IS NOT NULL AND coalesce(source_class, '') NOT IN {K.OBSERVATION_SENTIMENT_CLASSES}",
    "sentiment_label IS NOT NULL AND coalesce(sentiment_model_version, '') = ''",
]
REASONS_SQL = "concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for c, r in zip(_CHECKS_SQL, K.OBSERVATION_REASONS)) + ")"
ACCEPTED_SQL = "SELECT * FROM observations WHERE NOT (" + " OR ".join(f"({c})" for c in _CHECKS_SQL) + ")"
EXPERIMENTAL_SQL = (
    f"SELECT * FROM observations WHERE acquisition_mode IN {K.EXPERIMENTAL_MODES} AND exact_entity"
    " AND len(identity_proof) > 0 AND coalesce(content_sha256, '') <> ''"
)

# ---- job feed: events as arriving entries ----------------------------------------------


def feed_columns(spark: bool) -> list[tuple[str, str]]:
    published = "CAST(ts AS DATE) - k" if not spark else "date_sub(CAST(ts AS DATE), k)"
    return [
        ("seq", "event_id"),
        ("job_id", "'j' || CAST(user_id AS STRING) || '-' || CAST(k % 12 AS STRING)"),
        ("status", "CASE WHEN event_type = 'error' THEN 'inactive' ELSE 'Active' END"),
        ("orgnr", "CASE WHEN k = 3 THEN '' ELSE '100 ' || lpad(CAST(user_id AS STRING), 6, '0') END"),
        ("title", "event_type || ' job ' || CAST(k AS STRING)"),
        ("published", f"CAST({published} AS STRING) || 'T08:00:00Z'"),
        ("updated", iso("ts", spark)),
        ("city", "CASE WHEN k % 4 = 0 THEN '' ELSE 'City' || CAST(k % 9 AS STRING) END"),
    ]


_ENTRY = (
    "'{\"id\":\"' || job_id || '\",\"_feed_entry\":{\"uuid\":\"u' || CAST(seq AS STRING) || '\",\"status\":\"' || status ||"
    " '\",\"title\":\"' || title || '\",\"employer\":{\"name\":\"Employer\",\"orgnr\":\"' || orgnr || '\"},\"published\":\"' || published ||"
    " '\",\"updated\":\"' || updated || '\",\"workLocations\":[{\"municipal\":\"' || city || '\",\"city\":\"Elsewhere\"}]}}'"
)
FEED_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in feed_columns(False)) + f" FROM (SELECT *, {_K} AS k FROM events) e"


def feed_entries(events: DataFrame) -> DataFrame:
    """Feed entries as JSON text with their arrival number; works on a stream of events too."""
    cols = events.withColumn("k", F.expr(_K)).selectExpr(*[f"{e} AS {n}" for n, e in feed_columns(True)])
    return cols.selectExpr("seq", f"{_ENTRY} AS entry")


def feed(spark: SparkSession, folder: str) -> DataFrame:
    return feed_entries(spread(load(spark, folder, "events")))


# jobs as the feed parser sees them, and the index they fold into
JOBS_PARSED_SQL = """
SELECT seq, job_id, status = 'Active' AND orgnr <> '' AS active, replace(orgnr, ' ', '') AS organisation_number,
  title, published, updated, CASE WHEN city = '' THEN 'Elsewhere' ELSE city END AS municipal
FROM feed"""
JOB_INDEX_SQL = """
SELECT p.organisation_number, p.job_id, p.title, p.published, p.updated, p.municipal
FROM (SELECT *, row_number() OVER (PARTITION BY organisation_number, job_id ORDER BY updated DESC, seq DESC) AS rn
      FROM jobs_parsed WHERE active) p
JOIN (SELECT job_id, arg_max(active, seq) AS alive FROM jobs_parsed GROUP BY 1) l ON p.job_id = l.job_id
WHERE rn = 1 AND alive"""

# ---- captures: pages -------------------------------------------------------------------


def capture_columns(spark: bool) -> list[tuple[str, str]]:
    ts = "CAST('2026-01-01 00:00:00' AS TIMESTAMP) + page_id * INTERVAL '1' MINUTE" if not spark else "timestampadd(MINUTE, page_id, timestamp'2026-01-01 00:00:00')"
    site = "regexp_extract(url, '^[a-z]+://([^/]+)', 1)"
    return [
        ("page_id", "page_id"),
        ("organisation_number", f"CAST(200000000 + length({site}) * 1000 + ascii(substr({site}, 3, 1)) * 7 + ascii(substr({site}, 6, 1)) AS STRING)"),
        ("requested_url", "url"),
        ("final_url", "url"),
        ("status_code", "CAST(CASE WHEN page_id % 11 = 7 THEN 404 WHEN page_id % 13 = 5 THEN 500 ELSE 200 END AS INT)"),
        ("content_type", "CASE WHEN page_id % 17 = 3 THEN 'application/pdf' ELSE 'text/HTML; charset=utf-8' END"),
        ("page_kind", "CASE WHEN page_id % 5 < 2 THEN 'homepage' ELSE 'secondary' END"),
        ("retrieved_at", iso(ts, spark)),
        ("html", "html"),
    ]


CAPTURES_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in capture_columns(False)) + " FROM pages"


def captures(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "pages").selectExpr(*[f"{e} AS {n}" for n, e in capture_columns(True)])


# ---- assembling oracle text ------------------------------------------------------------
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "registry": ((), REGISTRY_SQL),
    "entities": (("registry",), ENTITIES_SQL),
    "accounts": ((), ACCOUNTS_SQL),
    "observations": ((), OBSERVATIONS_SQL),
    "accepted": (("observations",), ACCEPTED_SQL),
    "experimental": (("observations",), EXPERIMENTAL_SQL),
    "feed": ((), FEED_SQL),
    "jobs_parsed": (("feed",), JOBS_PARSED_SQL),
    "job_index": (("jobs_parsed",), JOB_INDEX_SQL),
    "captures": ((), CAPTURES_SQL),
}


def oracle(needs: str, body: str) -> str:
    """``body`` behind the WITH clauses of the views it needs (names separated by blanks)."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in VIEWS[name][0]:
            add(dep)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    clauses = ", ".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in order)
    body = body.strip()
    if not order:
        return body
    return f"WITH {clauses}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {clauses} {body}"
