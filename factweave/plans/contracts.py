"""Queries over screens, facts, the output contract and refresh."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import contract as C, joins as J, normalise as N, observations as O, refresh as R, screen as Q
from ..session import shared_folder, written
from . import base
from .catalog import load, query
from .projections import _CLAIM_SQL, graded_profiles
from .ranking import screen_profiles

ORG = "organisation_number"
MUNICIPALITY = "NATION_3"


@query(
    "qry_01_screen",
    base.oracle("screen", f"""SELECT organisation_number, name, municipality, employees, CAST(revenue AS DOUBLE) AS revenue, 'financials,registry' AS cited, sha256(organisation_number || 'financials') AS first_hash FROM screen
    WHERE lower(municipality) = lower('{MUNICIPALITY}') AND revenue > 200000 ORDER BY revenue DESC, organisation_number LIMIT 10"""),
)
def screen(spark, folder):
    plan = Q.ScreenPlan(
        (Q.Filter("municipality", "eq", MUNICIPALITY, "registry"), Q.Filter("revenue", ">", 200000, "financials")), Q.Sort("revenue", 10)
    )
    out = Q.screen(screen_profiles(spark, folder), plan)
    cited = F.array_join(F.transform("citations", lambda c: c["module"]), ",")
    return out.select(ORG, "name", "municipality", "employees", F.col("revenue").cast("double").alias("revenue"), cited.alias("cited"), F.col("citations")[0]["content_sha256"].alias("first_hash"))


_FILTERS = {
    "a_eq": (Q.Filter("legal_form", "eq", "DA", "registry"), "upper(legal_form) = 'DA'"),
    "b_present": (Q.Filter("website", "present", True, "website"), "website_status = 'available' AND COALESCE(website_publishable, true)"),
    "c_available": (Q.Filter("financials", "available", False, "financials"), "financials_status <> 'available'"),
    "d_contains": (Q.Filter("industry", "contains", "EIENDOM", "registry"), "position('eiendom' IN lower(industry_code || ' ' || industry_label)) > 0"),
    "e_gt": (Q.Filter("employees", ">", 100, "registry"), "COALESCE(employees > 100, false)"),
    "f_ge": (Q.Filter("revenue", ">=", 250000, "financials"), "COALESCE(revenue >= 250000, false)"),
    "g_lt": (Q.Filter("annual_result", "<", 0, "financials"), "COALESCE(annual_result < 0, false)"),
    "h_le": (Q.Filter("employees", "<=", 3, "registry"), "COALESCE(employees <= 3, false)"),
    "i_is": (Q.Filter("employees", "=", 7, "registry"), "COALESCE(employees = 7, false)"),
}


@query("flt_12_screen_predicates", base.oracle("screen", "SELECT organisation_number, " + ", ".join(f"{sql} AS {n}" for n, (_, sql) in _FILTERS.items()) + " FROM screen"))
def screen_predicates(spark, folder):
    return screen_profiles(spark, folder).select(ORG, *[Q.predicate(f).alias(n) for n, (f, _) in _FILTERS.items()])


@query(
    "flt_13_search",
    base.oracle("graded", "SELECT organisation_number, name FROM graded WHERE position('møbelhuset' IN lower(name || ' ' || organisation_number)) > 0 AND municipality = 'NATION_7' AND financials_status = 'available'"),
)
def search(spark, folder):
    p = graded_profiles(spark, folder).withColumn("has_website", N.verified_site()).withColumn("has_financials", F.col("financials_status") == "available").withColumn("signals", F.lit(0))
    return Q.search(p, " MØBELhuset ", "NATION_7", None, "financials").select(ORG, "name")


@query(
    "flt_14_seed_errors",
    base.oracle("manifest entities", """SELECT m.organisation_number, CASE WHEN e.name IS NULL THEN 'unknown organisation' ELSE 'website and proof_url must be absolute' END AS reason FROM manifest m LEFT JOIN entities e USING (organisation_number) WHERE e.name IS NULL OR position % 4 = 0"""),
)
def seed_errors(spark, folder):
    from .joins import order_manifest

    seeds = order_manifest(spark, folder).select(ORG, F.when(F.col("position") % 4 == 0, "www.x.no").otherwise("https://x.no").alias("website"), F.lit("http://p.no").alias("proof_url"))
    return J.seed_errors(seeds, base.entities(spark, folder))


def roles_table(spark, folder):
    """Two registered roles per entity, the first inactive for some."""
    e = base.entities(spark, folder)
    rows = F.array(
        F.struct(F.lit(1).alias("seq"), F.concat(F.lit("Ada "), "municipality").alias("name"), F.lit("LEDE").alias("role_code"), F.lit("Chair").alias("role"), F.lit("2024-01-01").alias("last_changed"), (F.coalesce(F.col("employees"), F.lit(0)) % 2 == 1).alias("inactive")),
        F.struct(F.lit(2).alias("seq"), F.lit("Bo").alias("name"), F.lit("DAGL").alias("role_code"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("last_changed"), F.lit(False).alias("inactive")),
    )
    return e.select(ORG, F.explode(rows).alias("r")).select(ORG, "r.*").withColumn("group", F.lit("Board"))


_FACTS = """SELECT organisation_number, 'registry' AS topic, c AS claim, v AS value FROM (SELECT organisation_number, unnest(['Registered name', 'Organisation number', 'Legal form', 'Municipality', 'Registry employee count']) AS c, unnest([name, organisation_number, legal_form, municipality, CAST(employees AS VARCHAR)]) AS v FROM screen) WHERE v IS NOT NULL
 UNION ALL SELECT organisation_number, 'financials', c, v FROM (SELECT organisation_number, unnest(['Reporting period', 'Revenue', 'Annual result']) AS c, unnest([CAST(period AS VARCHAR), CAST(revenue AS VARCHAR), CAST(annual_result AS VARCHAR)]) AS v FROM screen) WHERE v IS NOT NULL
 UNION ALL SELECT organisation_number, 'roles', 'Chair', 'Ada ' || municipality FROM screen WHERE COALESCE(employees, 0) % 2 = 0 UNION ALL SELECT organisation_number, 'roles', 'Board', 'Bo' FROM screen
 UNION ALL SELECT organisation_number, 'website', 'Website description', 'd' || legal_form FROM screen WHERE website_status = 'available' AND COALESCE(website_publishable, true)"""
base.VIEWS["facts"] = (("screen",), _FACTS)


def known_facts(spark, folder):
    p = screen_profiles(spark, folder)
    items = p.select(ORG, F.lit("Website description").alias("kind"), F.lit(1).alias("seq"), F.concat(F.lit("d"), "legal_form").alias("value"))
    return Q.facts(p, roles_table(spark, folder), None, items)


@query("qry_02_facts", base.oracle("facts", "SELECT * FROM facts"))
def facts(spark, folder):
    return known_facts(spark, folder).select(ORG, "topic", "claim", "value")


@query(
    "qry_02_facts_all_topics",
    base.oracle("facts", """SELECT organisation_number, topic, claim, value FROM facts UNION ALL SELECT organisation_number, 'locations', 'Registered subunit', '{"name":"' || name || ' avd","address":"' || municipality || '"}' FROM screen WHERE employees % 3 = 0
    UNION ALL SELECT organisation_number, 'locations', 'Registered subunit', '{"name":"","address":"Gata 2"}' FROM screen WHERE employees % 3 = 0
    UNION ALL SELECT organisation_number, 'workforce', 'Workforce (from official annual report)', '{"value":"' || CAST(employees + 1 AS VARCHAR) || '","measure":"employees","year":"2025"}' FROM screen WHERE employees % 4 = 1"""),
)
def facts_all_topics(spark, folder):
    """Registry, accounts, roles, locations, website and workforce together."""
    p = screen_profiles(spark, folder)
    e = p.select(ORG, "name", "municipality", "employees")
    place = F.inline(F.array(F.struct(F.lit(1).alias("seq"), F.concat("name", F.lit(" avd")).alias("name"), F.col("municipality").alias("address")), F.struct(F.lit(2).alias("seq"), F.lit("").alias("name"), F.lit("Gata 2").alias("address"))))
    report = F.create_map(F.lit("workforce_value"), (F.col("employees") + 1).cast("string"), F.lit("measure"), F.lit("employees"), F.lit("year"), F.lit("2025"))
    filed = e.where("employees % 4 = 1").select(ORG, report.alias("metrics"), *[F.lit(x).alias(x) for x in ("source_url", "retrieved_at", "content_sha256")])
    items = p.select(ORG, F.lit("Website description").alias("kind"), F.lit(1).alias("seq"), F.concat(F.lit("d"), "legal_form").alias("value"))
    known = Q.facts(p, roles_table(spark, folder), e.where("employees % 3 = 0").select(ORG, place), items, filed)
    return known.select(ORG, "topic", "claim", "value")


_QUESTIONS = ("Who leads the company?", "What is the revenue and debt?", "How many employees?", "What do we know about this company?", "Any sentiment?")
_TOPICS = ("['roles']", "['financials']", "['registry', 'workforce']", "['registry', 'financials', 'roles', 'locations', 'website', 'workforce']", "[]")


def questions(spark, folder):
    e = base.entities(spark, folder)
    k = F.col(ORG).cast("long")
    return e.select((k - 100000000).alias("question_id"), ORG, F.element_at(F.array(*[F.lit(q) for q in _QUESTIONS]), (k % 5 + 1).cast("int")).alias("question"))


@query(
    "jon_14_facts_for_questions",
    base.oracle("facts", f"""SELECT CAST(organisation_number AS BIGINT) - 100000000 AS question_id, topic, claim, value FROM facts WHERE list_contains(CASE CAST(organisation_number AS BIGINT) % 5 {' '.join(f'WHEN {i} THEN {t}' for i, t in enumerate(_TOPICS[:4]))} END, topic)"""),
)
def facts_for_questions(spark, folder):
    return Q.facts_for_questions(questions(spark, folder), known_facts(spark, folder)).select("question_id", "topic", "claim", "value")


@query(
    "qry_02_unsupported",
    base.oracle("graded", """SELECT question_id, CASE WHEN q = 4 THEN 'Sentiment is not scored' WHEN website_status <> 'available' THEN 'The registry-linked company website' ELSE 'A registry-linked website was fetched' END AS note FROM
    (SELECT *, CAST(organisation_number AS BIGINT) - 100000000 AS question_id, CAST(organisation_number AS BIGINT) % 5 AS q FROM graded) WHERE q = 4 OR (q = 3 AND (website_status <> 'available' OR NOT COALESCE(website_publishable, true)))
    UNION ALL SELECT CAST(organisation_number AS BIGINT) - 100000000, 'No registered subunit was returned' FROM graded WHERE CAST(organisation_number AS BIGINT) % 5 = 3"""),
)
def unsupported(spark, folder):
    e = graded_profiles(spark, folder)
    notes = Q.unsupported_notes(questions(spark, folder), e, {"roles": roles_table(spark, folder), "locations": e.where("false")})
    heads = ("Sentiment is not scored", "The registry-linked company website", "A registry-linked website was fetched", "No registered subunit was returned")
    return notes.select("question_id", F.coalesce(*[F.when(F.col("note").startswith(h), h) for h in heads]).alias("note"))


@query(
    "qry_03_compare",
    base.oracle("entities", """SELECT fact, max(v) FILTER (organisation_number = '100000003') AS "100000003", max(v) FILTER (organisation_number = '100000011') AS "100000011" FROM (SELECT organisation_number, unnest(['Municipality', 'Legal form', 'Industry', 'Latest accounts year', 'Employees', 'Website']) AS fact,
    unnest([municipality, legal_form, industry_label, latest_submitted_accounts, CAST(employees AS VARCHAR), website]) AS v FROM entities WHERE organisation_number IN ('100000003', '100000011')) GROUP BY 1"""),
)
def compare(spark, folder):
    return Q.compare(base.entities(spark, folder).withColumn("website_url", F.col("website")), ["100000003", "100000011"])


@query(
    "qry_04_suite_eval",
    base.oracle("screen", """SELECT municipality AS query_id, len(list(organisation_number)) <= 1 OR right(municipality, 1) NOT IN ('1', '3', '5') AS exact_membership_and_order, true AS citations_complete, count(*) AS results, count(*) AS expected FROM screen WHERE employees > 150 GROUP BY 1"""),
)
def suite_eval(spark, folder):
    p = screen_profiles(spark, folder).where("employees > 150")
    cited = p.select(F.col("municipality").alias("query_id"), ORG, Q.citations(["registry", "financials"]).alias("citations"))
    place = lambda *order: F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1
    results = cited.withColumn("position", place(ORG))
    flipped = F.col("query_id").rlike("[135]$")
    key = F.when(flipped, -F.col(ORG).cast("long")).otherwise(F.col(ORG).cast("long"))
    return Q.suite_eval(results, cited.withColumn("position", place(key)))


@query(
    "qry_04_suite_points",
    base.oracle("screen", """SELECT 4.0::DOUBLE AS cited_single_company_qa, 3 * avg(CASE WHEN n <= 1 OR right(q, 1) NOT IN ('1', '3', '5') THEN 1.0 ELSE 0.0 END)::DOUBLE AS cross_company_screening, 1.0::DOUBLE AS exact_inspectable_filters, 0.0::DOUBLE AS unsupported_abstention,
    1.0::DOUBLE AS saved_history, 1.0::DOUBLE AS provenance_export FROM (SELECT municipality AS q, count(*) AS n FROM screen WHERE employees > 150 GROUP BY 1)"""),
)
def suite_points(spark, folder):
    """Points of the suite above; half of the plans name the expected filters."""
    plans = load(spark, folder, "region").select(F.col("r_name").alias("query_id"), F.array(F.lit("employees")).alias("filter_fields"), F.array(F.lit("employees")).alias("expected_fields"))
    plans = plans.unionByName(plans.withColumn("expected_fields", F.array(F.lit("revenue"))))
    return Q.suite_points(suite_eval(spark, folder), plans, True, False, True).drop("score")


# ---- contract --------------------------------------------------------------------------
base.VIEWS["records"] = (("accounts",), "SELECT *, row_number() OVER (PARTITION BY organisation_number ORDER BY year DESC) AS seq FROM accounts")
_WEB = """SELECT organisation_number, website_status = 'available' AS seen, COALESCE(website_publishable, false) AS pub, NULLIF(website, '') AS site, 'https://' || website AS url, website_status FROM graded"""
def _claims_sql(heads: str = "[0, 1, 2, 4, 5]", facts: str = "", shared: str = "") -> str:
    """Claims of all entities; facts and shared add rows, heads lists the modules that an entity has a record of."""
    return f"""WITH rc AS (SELECT *, row_number() OVER (PARTITION BY organisation_number ORDER BY field) AS seq FROM ({_CLAIM_SQL})),
 years AS (SELECT DISTINCT organisation_number, year FROM accounts), web AS ({_WEB}),
 f AS (SELECT organisation_number, 0 AS fam, seq * 16 + 100 AS sub, field, value, reporting_period, 0.97 AS confidence FROM rc
  UNION ALL SELECT organisation_number, 1, seq * 16 + 100, 'financials.revenue', CAST(revenue AS VARCHAR), CAST(year AS VARCHAR), 0.97 FROM records
  UNION ALL SELECT organisation_number, 1, seq * 16 + 102, 'financials.annual_result', CAST(annual_result AS VARCHAR), CAST(year AS VARCHAR), 0.97 FROM records
  UNION ALL SELECT organisation_number, 2, 16 + 100, 'role.lede', 'Ada ' || municipality, '2024-01-01', 0.97 FROM graded WHERE COALESCE(employees, 0) % 2 = 0 UNION ALL SELECT organisation_number, 2, 32 + 100, 'role.dagl', 'Bo', NULL, 0.97 FROM graded
  UNION ALL SELECT organisation_number, 4, year * 16 + 100, 'financial_history.year', CAST(year AS VARCHAR), CAST(year AS VARCHAR), 0.97 FROM years{facts}),
 h AS (SELECT organisation_number, unnest({heads}) AS fam FROM graded),
 n AS (SELECT *, row_number() OVER (PARTITION BY organisation_number ORDER BY fam, sub, field, value) - 1 AS pos FROM (SELECT *, false AS head FROM f UNION ALL SELECT organisation_number, fam, 0, NULL, NULL, NULL, NULL, true FROM h WHERE fam IS NOT NULL))
 SELECT organisation_number, field, value, 'available' AS availability, confidence, 'ev-' || ['registry', 'fin', 'role', 'loc', 'fh', 'web'][fam + 1] || '-' || CAST(pos AS VARCHAR) AS evidence_id, reporting_period FROM n WHERE NOT head
 UNION ALL SELECT organisation_number, 'financial_history.years', string_agg(CAST(year AS VARCHAR), ',' ORDER BY year), 'available', 0.97, 'ev-financial_history', NULL FROM years GROUP BY 1
 UNION ALL SELECT organisation_number, 'roles', CASE WHEN COALESCE(employees, 0) % 2 = 0 THEN '[{{"seq":1,"name":"Ada ' || municipality || '","role":"Chair"}},' ELSE '[' END || '{{"seq":2,"name":"Bo"}}]', 'available', 0.97, 'ev-roles', NULL FROM graded
 UNION ALL SELECT organisation_number, 'financials', NULL, CASE financials_status WHEN 'available' THEN 'available' ELSE 'not_available' END, 0.5, 'ev-financials', NULL FROM graded WHERE organisation_number NOT IN (SELECT organisation_number FROM accounts)
 UNION ALL SELECT organisation_number, 'official_website', CASE WHEN seen AND pub THEN url ELSE site END, CASE WHEN (seen AND pub) OR site IS NOT NULL THEN 'available' WHEN website_status = 'not_found' THEN 'not_available' ELSE 'blocked' END, CASE WHEN seen AND pub THEN 0.95 WHEN site IS NOT NULL THEN 0.9 ELSE 0.5 END,
  CASE WHEN (seen AND pub) OR site IS NULL THEN 'ev-website' ELSE 'ev-registry' END, NULL FROM web
 UNION ALL SELECT organisation_number, 'official_website_crawl_unverified', url, 'ambiguous', 0.5, 'ev-website', NULL FROM web WHERE seen AND NOT pub{shared}"""


_CLAIMS = _claims_sql()


def contract_tables(spark, folder):
    p = graded_profiles(spark, folder).select(
        ORG, F.lit("available").alias("registry_status"), "financials_status", F.lit("available").alias("roles_status"), F.lit("available").alias("financial_history_status"), "website_status",
        "website_publishable", F.lit(None).cast("double").alias("website_score"), F.concat(F.lit("https://"), "website").alias("website_url"), F.col("website").alias("registry_site"),
    )
    a = base.accounts(spark, folder)
    # years of an entity are few, so their rank is a short window
    records = a.withColumn("seq", F.row_number().over(Window.partitionBy(ORG).orderBy(F.col("year").desc()))).withColumn("period", F.col("year").cast("string"))
    registry = N.registry_claims(base.registry_raw(spark, folder))
    return p, {"registry": registry, "records": records, "roles": roles_table(spark, folder), "years": a.select(ORG, "year")}


def contract_ledger(spark, folder):
    p, tables = contract_tables(spark, folder)
    return C.ledger(p, **tables)


def contract_claims(spark, folder):
    return C.ledger_claims(contract_ledger(spark, folder))


@query("ctr_01_contract_claims", base.oracle("registry graded accounts records", _CLAIMS))
def contract_claims_query(spark, folder):
    return contract_claims(spark, folder).drop("span")


_MODULE = """CASE WHEN evidence_id LIKE 'ev-registry%' THEN 'registry' WHEN evidence_id LIKE 'ev-fin-%' OR evidence_id = 'ev-financials' THEN 'financials' WHEN evidence_id LIKE 'ev-role%' THEN 'roles'
 WHEN evidence_id LIKE 'ev-fh-%' OR evidence_id = 'ev-financial_history' THEN 'financial_history' ELSE 'website' END"""


def contract_evidence(spark, folder):
    sources = []
    for m in C.FAMILIES:
        sources += [
            F.lit(f"https://source.example/{m}").alias(f"{m}_source_url"), F.lit(f"{m}_record").alias(f"{m}_source_class"),
            F.lit("2026-01-01T00:00:00Z").alias(f"{m}_retrieved_at"), F.sha2(F.concat(ORG, F.lit(m)), 256).alias(f"{m}_content_sha256"),
        ]
    return C.evidence(contract_claims(spark, folder), base.entities(spark, folder).select(ORG, *sources))


@query(
    "ctr_01_contract_evidence",
    base.oracle("registry graded accounts records", f"""SELECT DISTINCT organisation_number, evidence_id, 'https://source.example/' || m AS source_url, m || '_record' AS source_class, '2026-01-01T00:00:00Z' AS retrieved_at, sha256(organisation_number || m) AS content_sha256
    FROM (SELECT *, {_MODULE} AS m FROM ({_CLAIMS}))"""),
)
def contract_evidence_query(spark, folder):
    return contract_evidence(spark, folder).drop("span")


@query("ctr_01_contract_unresolved", "SELECT CAST(0 AS BIGINT) AS unresolved")
def contract_unresolved(spark, folder):
    """Every claim, those of observations too, cites evidence that is there."""
    obs = base.observations(spark, folder)
    entries = written(contract_ledger(spark, folder), "ledger")
    claimed = C.ledger_claims(entries).unionByName(C.observation_claims(obs))
    return C.unresolved(claimed, C.references(entries, base.entities(spark, folder), obs)).agg(F.count("*").alias("unresolved"))


_FULL = _claims_sql(
    heads="[CASE WHEN CAST(organisation_number AS BIGINT) % 5 > 0 THEN 0 END, 1, 2, CASE WHEN employees IS NOT NULL THEN 3 END, 4, 5]",
    facts="""
  UNION ALL SELECT organisation_number, 3, 116, 'location', '{"name":"' || name || ' avd","address":"' || municipality || '"}', NULL, 0.97 FROM graded WHERE employees % 3 = 0
  UNION ALL SELECT organisation_number, 5, 70, 'website_description', 'd' || legal_form, NULL, 0.9 FROM graded WHERE website_status = 'available' AND website_publishable
  UNION ALL SELECT organisation_number, 5, s, f, v, NULL, 0.9 FROM graded, (VALUES (10000001, 'job_posting', 'Clerk'), (10000002, 'job_posting', 'Cook'), (20000001, 'job_posting', 'https://s/jobs'), (30000001, 'news', 'Opened'), (90000000, 'website.telephone', '21')) t(s, f, v)
   WHERE website_status = 'available' AND website_publishable
  UNION ALL SELECT organisation_number, 5, 100000000, 'social.' || p, 'https://' || p || '.com/e' || organisation_number, NULL, 0.9 FROM graded, (VALUES ('facebook'), ('x')) t(p)""",
    shared="""
 UNION ALL SELECT organisation_number, 'locations', '[{"seq":1,"name":"' || name || ' avd","address":"' || municipality || '"},{"seq":2,"name":"","address":"Gata 2"}]', 'available', 0.97, 'ev-locations', NULL FROM graded WHERE employees % 3 = 0
 UNION ALL SELECT organisation_number, 'locations', NULL, CASE WHEN employees % 2 = 0 THEN 'not_available' ELSE 'available' END, 0.5, 'ev-locations', NULL FROM graded WHERE employees % 3 > 0""",
)


def full_ledger(spark, folder):
    """A ledger with every kind of table; one entity in five has no registry record to cite."""
    p, tables = contract_tables(spark, folder)
    e = graded_profiles(spark, folder).select(ORG, "name", "municipality", "legal_form", "employees")
    states = e.select(ORG, F.when(F.col(ORG).cast("long") % 5 > 0, "available").alias("registry_status"), F.when(F.col("employees") % 2 == 0, "not_found").when(F.col("employees").isNotNull(), "available").alias("locations_status"), F.concat(F.lit("d"), "legal_form").alias("website_description"))
    listed = lambda rows: F.inline(F.array(*[F.struct(*[(F.lit(x) if not hasattr(x, "alias") else x).alias(n) for n, x in r.items()]) for r in rows]))
    places = e.where("employees % 3 = 0").select(ORG, listed([{"seq": 1, "name": F.concat("name", F.lit(" avd")), "address": F.col("municipality")}, {"seq": 2, "name": "", "address": "Gata 2"}]))
    items = [("job_posting", 2, "Cook"), ("job_posting", 1, "Clerk"), ("careers_page", 1, "https://s/jobs"), ("news", 1, "Opened"), ("telephone", 2, "22"), ("telephone", 1, "21")]
    site_items = e.select(ORG, listed([{"kind": k, "seq": n, "value": v, "quote": v} for k, n, v in items]))
    home = lambda host: F.concat(F.lit(f"https://{host}.com/e"), F.col(ORG))
    socials = e.select(ORG, listed([{"platform": "x", "url": home("x")}, {"platform": "facebook", "url": home("facebook")}, {"platform": "", "url": "u"}]))
    return C.ledger(p.drop("registry_status").join(states, ORG), **tables, locations=places, site_items=site_items, socials=socials)


@query(
    "ctr_01_contract_full",
    base.oracle("registry graded accounts records", f"""SELECT c.*, regexp_matches(evidence_id, '-[0-9]+$') OR evidence_id NOT IN ('ev-registry', 'ev-locations') OR (evidence_id = 'ev-registry' AND CAST(c.organisation_number AS BIGINT) % 5 > 0) OR (evidence_id = 'ev-locations' AND employees IS NOT NULL) AS resolved
    FROM ({_FULL}) c JOIN graded USING (organisation_number)""").replace("SELECT c.*, regexp", "SELECT c.organisation_number, c.field, c.value, c.availability, c.confidence, c.evidence_id, c.reporting_period, regexp"),
)
def contract_full(spark, folder):
    """Claims of all families, locations, site items and socials too, and whether the evidence built apart from them has what they cite."""
    entries = written(full_ledger(spark, folder), "ledger")
    known = C.references(entries, base.entities(spark, folder)).select(ORG, "evidence_id", F.lit(True).alias("resolved"))
    return C.ledger_claims(entries).drop("span").join(known, [ORG, "evidence_id"], "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))


@query(
    "ctr_01_observation_claims",
    base.oracle("accepted", "SELECT organisation_number, platform || '.' || signal_type AS field, source_url AS value, 'ev-obs-' || CAST(row_number() OVER (PARTITION BY organisation_number ORDER BY retrieved_at, id) - 1 AS VARCHAR) AS evidence_id FROM accepted"),
)
def observation_claims(spark, folder):
    return C.observation_claims(base.observations(spark, folder)).select(ORG, "field", "value", "evidence_id")


@query(
    "ctr_02_terminal_state",
    f"""SELECT state, count(*) AS n FROM (SELECT CASE WHEN k = 1 THEN 'budget_exhausted' WHEN event_type = 'view' THEN 'complete' WHEN event_type = 'click' THEN 'not_found' WHEN event_type = 'error' AND k % 2 = 0 THEN 'blocked_robots' WHEN event_type = 'error' THEN 'blocked_policy' WHEN event_type = 'signup' THEN 'source_error' ELSE 'submission_error' END AS state
    FROM (SELECT *, {base._K} AS k FROM events)) GROUP BY 1""",
)
def terminal_state(spark, folder):
    e = load(spark, folder, "events").withColumn("k", F.expr(base._K))
    t = F.col("event_type")
    status = F.when(t == "view", "available").when(t == "click", "not_found").when(t == "error", "blocked").when(t == "signup", "source_error").otherwise("not_fetched")
    note = F.when(F.col("k") == 1, "BUDGET_exhausted: x").when(F.col("k") % 2 == 0, "Robots.txt denied").otherwise("terms")
    return e.groupBy(C.terminal_state(status, note).alias("state")).agg(F.count("*").alias("n"))


@query(
    "ctr_03_envelopes",
    base.oracle("entities", f"""WITH m AS (SELECT CAST(100000000 + user_id AS VARCHAR) AS o, CASE {base._K} % 9 WHEN 0 THEN 'registry' WHEN 3 THEN 'financials' WHEN 5 THEN 'roles' END AS m, count(*) AS n, max(event_id) FILTER (event_type = 'error') AS bad, max(event_id) AS last FROM events GROUP BY 1, 2)
    SELECT organisation_number, CASE WHEN count(m.m) = 3 AND bool_and(bad IS DISTINCT FROM last) THEN 'complete' ELSE 'submission_error' END AS state, 3 AS modules FROM entities e LEFT JOIN m ON m.o = e.organisation_number AND m.m IS NOT NULL GROUP BY 1"""),
)
def envelopes(spark, folder):
    e = load(spark, folder, "events").withColumn("k", F.expr(base._K))
    records = e.select(
        (F.col("user_id") + 100000000).cast("string").alias(ORG), F.expr(base.pick("k % 9", C.N.K.MODULES)).alias("module"), F.when(F.col("event_type") == "error", "not_fetched").otherwise("available").alias("status"),
        F.lit("").alias("note"), F.lit(0).alias("retry_count"), F.format_string("%012d", F.col("event_id")).alias("retrieved_at"),
    )
    out = C.envelopes(base.entities(spark, folder), records, ["registry", "financials", "roles"], "run", "a", "b")
    return out.select(ORG, "state", F.size("modules").alias("modules"))


def summary_profiles(spark, folder):
    p = screen_profiles(spark, folder)
    staff = F.coalesce(F.col("employees"), F.lit(0))
    return p.withColumn("currency", F.lit(None).cast("string")).withColumn("operating_result", F.lit(None).cast("double")).withColumn("period_start", F.lit("")).withColumn(
        "period_end", F.col("period").cast("string")
    ).withColumn("has_record", F.col("period").isNotNull()).withColumn("lead_name", F.lit("Ada")).withColumn("lead_role", F.when(staff % 2 == 0, "Chair")).withColumn(
        "active_roles", staff % 3
    ).withColumn("location_count", staff % 2).withColumn("website_url", F.concat(F.lit("https://"), "website")).withColumn("job_count", staff % 4).withColumn("news_count", F.lit(0)).withColumn(
        "social_count", F.lit(1)
    ).withColumn("workforce_year", F.lit("2025")).withColumn("workforce_value", F.when(staff % 5 == 0, "7")).withColumn("workforce_measure", F.lit("employees"))


_SAY = """SELECT organisation_number, name || ' is a ' || legal_form || ' company' || CASE WHEN industry_label <> '' THEN ', operating in ' || lower(industry_label) ELSE '' END || ', registered in ' || left(municipality, 1) || lower(substr(municipality, 2)) || '.'
 || CASE WHEN bankrupt THEN ' The registry marks the entity as bankrupt.' ELSE '' END || CASE WHEN liquidating THEN ' The registry marks the entity as under liquidation.' ELSE '' END
 || CASE WHEN period IS NOT NULL THEN ' Latest filed accounts (' || CAST(period AS VARCHAR) || '): revenue ' || CAST(revenue AS VARCHAR) || ' NOK, annual result ' || CAST(annual_result AS VARCHAR) || ' NOK.' ELSE '' END
 || CASE WHEN s % 3 > 0 THEN ' Registered leadership includes Ada (' || CASE WHEN s % 2 = 0 THEN 'Chair' ELSE 'role' END || ')' || CASE WHEN s % 3 > 1 THEN ' and 1 other registered role(s)' ELSE '' END || '.' ELSE '' END
 || CASE WHEN s % 2 > 0 THEN ' 1 registered subunit(s)/workplace(s).' ELSE '' END
 || CASE WHEN website_status = 'available' AND COALESCE(website_publishable, false) THEN ' Company-owned sources: verified official website https://' || website || CASE WHEN s % 4 > 0 THEN ', ' || CAST(s % 4 AS VARCHAR) || ' open job posting(s)' ELSE '' END || ', 1 company-linked social profile(s).' ELSE '' END
 || CASE WHEN s % 5 = 0 THEN ' Workforce reported in the 2025 annual report: 7 (employees).' ELSE '' END AS narrative,
 concat_ws('; ', CASE WHEN period IS NULL THEN 'filed financial figures' END, CASE WHEN s % 3 = 0 THEN 'registered leadership/roles' END, CASE WHEN s % 2 = 0 THEN 'registered subunits/locations' END,
  CASE WHEN NOT (website_status = 'available' AND COALESCE(website_publishable, false)) THEN 'verified company website' END) AS unknowns FROM (SELECT *, COALESCE(employees, 0) AS s FROM screen)"""
base.VIEWS["told"] = (("screen",), _SAY)


@query("ctr_04_synthesis", base.oracle("told", "SELECT * FROM told"))
def synthesis(spark, folder):
    return C.synthesis(summary_profiles(spark, folder)).select(ORG, "narrative", F.array_join("unknowns", "; ").alias("unknowns"))


@query(
    "ctr_05_derive",
    base.oracle("registry told accepted entities", f"""SELECT t.organisation_number, r.n AS registry_claims, 1 + CASE WHEN e.employees IS NULL THEN 0 ELSE 1 END + COALESCE(a.n, 0) AS accepted_observations, 'available' AS footprint_status, narrative FROM told t JOIN (SELECT organisation_number, count(*) AS n FROM ({_CLAIM_SQL}) GROUP BY 1) r USING (organisation_number)
    JOIN entities e USING (organisation_number) LEFT JOIN (SELECT organisation_number, count(*) AS n FROM accepted GROUP BY 1) a USING (organisation_number)"""),
)
def derive(spark, folder):
    registry = O.registry_observations(base.entities(spark, folder), "2026-01-01T00:00:00Z")
    third_party = base.observations(spark, folder).drop("k", "event_id", "rating", "review_count")
    out = C.derive(summary_profiles(spark, folder), base.registry_raw(spark, folder), [registry, third_party], "2026-01-02T00:00:00Z")
    return out.select(ORG, "registry_claims", "accepted_observations", "footprint_status", "narrative")


# ---- refresh ---------------------------------------------------------------------------
FIELDS = {
    "registry.employees": "employees", "registry.website": "website", "registry.name": "name", "financial_history.years": "years", "financials.records": "revenue",
}


def snapshots(spark, folder):
    """Two snapshots of all entities; staff, site, revenue and years differ for some."""
    a = base.accounts(spark, folder)
    facts = a.groupBy(ORG).agg(F.array_sort(F.collect_set("year")).alias("years"), F.max("revenue").alias("revenue"))  # bounded by the calendar
    e = base.entities(spark, folder).select(ORG, "name", "employees", "website").join(facts, ORG, "left")
    meta = lambda df, v: df.select("*", *[
        c for m in ("registry", "financials", "financial_history") for c in (
            F.lit(f"https://s/{m}").alias(f"{m}_source_url"), F.lit(v).alias(f"{m}_retrieved_at"), F.lit(v).alias(f"{m}_effective_at"), F.sha2(F.lit(v + m), 256).alias(f"{m}_content_sha256"))
    ])
    new = e.withColumn("employees", F.when(F.col("employees") % 4 == 0, None).when(F.col("employees").isNull(), 0).otherwise(F.col("employees"))).withColumn(
        "website", F.when(F.col("website") == "", "https://ny.no").otherwise(F.col("website"))
    ).withColumn("years", F.when(F.size("years") % 2 == 0, F.concat("years", F.array(F.lit(2030)))).otherwise(F.array_sort("years"))).withColumn("revenue", F.when(F.col("revenue") > 900000, F.col("revenue") + 1).otherwise(F.col("revenue")))
    return meta(e, "2026-01-01T00:00:00Z"), meta(new, "2026-02-01T00:00:00Z")


_CHANGES = """SELECT organisation_number, 0 AS field_order, 'registry.employees' AS field, CAST(employees AS VARCHAR) AS old_value, CASE WHEN employees IS NULL THEN '0' END AS new_value FROM entities WHERE employees IS NULL OR employees % 4 = 0
 UNION ALL SELECT organisation_number, 1, 'registry.website', '', 'https://ny.no' FROM entities WHERE website = ''
 UNION ALL SELECT organisation_number, 3, 'financial_history.years', '[' || string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) || ']', '[' || string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) || ',2030]' FROM accounts GROUP BY 1 HAVING count(*) % 2 = 0
 UNION ALL SELECT organisation_number, 4, 'financials.records', CAST(max(revenue) AS VARCHAR), CAST(max(revenue) + 1 AS VARCHAR) FROM accounts GROUP BY 1 HAVING max(revenue) > 900000"""
base.VIEWS["changes"] = (("entities", "accounts"), _CHANGES)


@query("ref_01_profile_diff", base.oracle("changes", "SELECT organisation_number, field, old_value, new_value, '2026-02-01T00:00:00Z' AS retrieved_at, sha256('2026-01-01T00:00:00Z' || split_part(field, '.', 1)) AS old_content_sha256 FROM changes"))
def profile_diff(spark, folder):
    old, new = snapshots(spark, folder)
    return R.diff(old, new, FIELDS).select(ORG, "field", "old_value", "new_value", "retrieved_at", "old_content_sha256")


@query("ref_02_dataset_diff", base.oracle("changes", "SELECT organisation_number, field, field_order FROM changes"))
def dataset_diff(spark, folder):
    old, new = snapshots(spark, folder)
    return R.diff_in_order(old, new, FIELDS).select(ORG, "field", "field_order")


@query(
    "ref_03_replay_report",
    base.oracle("changes", """SELECT count(*) FILTER (field <> 'registry.website') AS true_positive, count(*) FILTER (field = 'registry.website') AS false_positive, 25 AS false_negative, count(*) AS observed_changes, true AS evidence_complete, true AS idempotent_rerun, false AS qualification_passed FROM changes"""),
)
def replay_report(spark, folder):
    """Over stored snapshots; the new one compared with itself differs in no bucket."""
    old, new = stored_snapshots(spark, folder)
    changes = written(R.diff_snapshots(old, new, FIELDS), "changes")
    missed = load(spark, folder, "nation").select(F.concat(F.lit("9"), F.col("n_nationkey").cast("string")).alias(ORG), F.lit("registry.name").alias("field"))
    expected = changes.where("field <> 'registry.website'").select(ORG, "field").unionByName(missed)
    return R.replay_report(changes, expected, R.diff_snapshots(new, new, FIELDS)).drop("precision", "recall", "evidence_share")


def stored_snapshots(spark, folder):
    home = shared_folder(spark, "snapshots")
    times = [f"{m}_{c}" for m in ("registry", "financials", "financial_history") for c in ("retrieved_at", "effective_at", "content_sha256")]
    return [R.Snapshot.write(df, f"{home}/{name}", ignore=times) for name, df in zip(("old", "new"), snapshots(spark, folder))]


@query(
    "ref_02_unequal_buckets",
    base.oracle("entities accounts", """SELECT count(*) AS entities, count(*) FILTER (mark = 1) AS changed FROM (SELECT organisation_number, CASE WHEN employees > 197 THEN 1 ELSE 0 END AS mark FROM entities)"""),
)
def unequal_buckets(spark, folder):
    """Few entities change: what is read again is the buckets of these, and the changes are all there."""
    home = shared_folder(spark, "sparse")
    e = base.entities(spark, folder).select(ORG, "name", "employees", "website")
    old = R.Snapshot.write(e, f"{home}/old")
    new = R.Snapshot.write(e.withColumn("name", F.when(F.col("employees") > 197, F.concat("name", F.lit(" NY"))).otherwise(F.col("name"))), f"{home}/new")
    changes = R.diff_snapshots(old, new, {"registry.name": "name", "registry.website": "website"})
    return new.rows().join(changes.select(ORG, F.lit(1).alias("__c")), ORG, "left").agg(F.count("*").alias("entities"), F.count("__c").alias("changed"))
