"""Queries over the normalisers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import normalise as N
from . import base
from .catalog import load, query


@query(
    "prj_01_alias_coalesce",
    base.oracle("registry", """SELECT organisasjonsnummer AS org, COALESCE(NULLIF(telefon, ''), NULLIF(mobil, ''), '') AS phone,
    COALESCE(NULLIF("kapital.valuta", ''), NULLIF("forretningsadresse.land", ''), '') AS first_of_two FROM registry"""),
)
def alias_coalesce(spark, folder):
    return base.registry_raw(spark, folder).select(
        F.col("organisasjonsnummer").alias("org"), N.first_filled("telefon", "mobil").alias("phone"),
        N.first_filled("`kapital.valuta`", "`forretningsadresse.land`").alias("first_of_two"),
    )


@query("prj_02_registry", base.oracle("entities", "SELECT * FROM entities"))
def registry(spark, folder):
    return base.entities(spark, folder)


@query(
    "prj_03_evidence",
    base.oracle("entities", """SELECT organisation_number, 'registry' AS field, CASE WHEN website = '' THEN 'not_found' ELSE 'available' END AS status,
    'official_registry_bulk' AS source_class, '2026-01-01T00:00:00Z' AS retrieved_at, website AS value, CAST(NULL AS VARCHAR) AS note,
    organisation_number AS source_row_key FROM entities"""),
)
def evidence(spark, folder):
    e = N.evidence(
        "registry", F.when(F.col("website") == "", "not_found").otherwise("available"), "official_registry_bulk",
        F.lit(N.BULK_SOURCE), F.lit("2026-01-01T00:00:00Z"), value=F.col("website"), source_row_key=F.col("organisation_number"),
    )
    return base.entities(spark, folder).select("organisation_number", e.alias("e")).select(
        "organisation_number", "e.field", "e.status", "e.source_class", "e.retrieved_at", "e.value", "e.note", "e.source_row_key"
    )


@query(
    "prj_04_http_status",
    """SELECT status, COUNT(*) AS n FROM (SELECT CASE CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 404 WHEN 'signup' THEN 410 WHEN 'error' THEN 500 ELSE 0 END
    WHEN 200 THEN 'available' WHEN 404 THEN 'not_found' WHEN 410 THEN 'not_found' ELSE 'source_error' END AS status FROM events) GROUP BY 1""",
)
def http_status(spark, folder):
    t = F.col("event_type")
    code = F.when(t == "view", 200).when(t == "click", 404).when(t == "signup", 410).when(t == "error", 500).otherwise(0)
    return load(spark, folder, "events").select(N.http_status(code).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


_FIN_SQL = """SELECT o_orderkey AS k, '2025' AS id, CAST(o_totalprice AS DECIMAL(20,2)) AS revenue,
 CASE WHEN o_orderstatus = 'F' THEN CAST(0 AS DECIMAL(20,2)) WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(20,2)) END AS operating_result,
 CAST(NULL AS DECIMAL(20,2)) AS debt, o_orderpriority AS currency, strftime(o_orderdate, '%Y-%m-%d') AS period_end FROM orders"""


@query("prj_05_financials", _FIN_SQL)
def financials(spark, folder):
    price = F.col("o_totalprice").cast("decimal(20,2)").cast("string")
    operating = F.when(F.col("o_orderstatus") == "F", F.lit('"driftsresultat": 0, ')).when(
        F.col("o_orderstatus") == "O", F.concat(F.lit('"driftsresultat": '), price, F.lit(", "))
    ).otherwise(F.lit(""))
    body = F.concat(
        F.lit('[{"id": 2025, "valuta": "'), "o_orderpriority", F.lit('", "regnskapsperiode": {"tilDato": "'),
        F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('"}, "resultatregnskapResultat": {"driftsresultat": {'), operating,
        F.lit('"driftsinntekter": {"sumDriftsinntekter": '), price, F.lit("}}}}]"),
    )
    return (
        load(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), F.explode(N.financial_records(body)).alias("r"))
        .select("k", F.col("r.record_id").alias("id"), "r.revenue", "r.operating_result", "r.debt", "r.currency", F.col("r.period.tilDato").alias("period_end"))
    )


@query(
    "prj_06_filing_history",
    """SELECT CAST(100000000 + o_custkey AS VARCHAR) AS org, string_agg(DISTINCT CAST(year(o_orderdate) AS VARCHAR), ',' ORDER BY CAST(year(o_orderdate) AS VARCHAR)) AS years,
    max(CAST(year(o_orderdate) AS VARCHAR)) AS newest,
    'https://data.brreg.no/regnskapsregisteret/regnskap/aarsregnskap/kopi/' || CAST(100000000 + o_custkey AS VARCHAR) || '/' || max(CAST(year(o_orderdate) AS VARCHAR)) AS newest_url
    FROM orders GROUP BY o_custkey""",
)
def filing_history(spark, folder):
    org = (F.col("o_custkey") + 100000000).cast("string")
    # years of one customer are few: the set is bounded by the calendar, not by the orders
    years = load(spark, folder, "orders").groupBy(org.alias("org")).agg(F.collect_set(F.year("o_orderdate").cast("string")).alias("raw"))
    out = years.withColumn("raw", F.concat("raw", F.array(F.lit("invalid")))).withColumn("list", N.filing_years("raw"))
    copy = F.get(N.filing_copies("list", "org"), F.lit(0))
    return out.select("org", F.array_join("list", ",").alias("years"), copy["year"].alias("newest"), copy["url"].alias("newest_url"))


@query(
    "prj_07_roles",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'Ada ' || CAST(s_nationkey AS VARCHAR) || ' Nord' END AS name, 'LEDE' AS role_code, 'STYR' AS group_code,
    '2024-01-0' || CAST(s_suppkey % 9 + 1 AS VARCHAR) AS last_changed, s_acctbal < 0 AS inactive FROM supplier
    UNION ALL SELECT s_suppkey, 'Bo Sør', 'DAGL', 'DAGL', CAST(NULL AS VARCHAR), false FROM supplier""",
)
def roles(spark, folder):
    s = load(spark, folder, "supplier")
    who = F.when(
        F.col("s_suppkey") % 3 == 0, F.concat(F.lit('"enhet": {"navn": "'), "s_name", F.lit('"}'))
    ).otherwise(F.concat(F.lit('"person": {"fodselsdato": "1970-01-01", "navn": {"fornavn": "Ada", "mellomnavn": "'), F.col("s_nationkey").cast("string"), F.lit('", "etternavn": "Nord"}}')))
    body = F.concat(
        F.lit('{"rollegrupper": [{"sistEndret": "2024-01-0'), (F.col("s_suppkey") % 9 + 1).cast("string"),
        F.lit('", "type": {"kode": "STYR", "beskrivelse": "Board"}, "roller": [{"type": {"kode": "LEDE", "beskrivelse": "Chair"}, "avregistrert": '),
        (F.col("s_acctbal") < 0).cast("string"), F.lit(", "), who,
        F.lit('}]}, {"type": {"kode": "DAGL"}, "roller": [{"type": {"kode": "DAGL"}, "person": {"navn": {"fornavn": "Bo", "etternavn": "Sør"}}}]}]}'),
    )
    return s.select("s_suppkey", F.explode(N.roles(body)).alias("r")).select("s_suppkey", "r.name", "r.role_code", "r.group_code", "r.last_changed", "r.inactive")


@query(
    "prj_08_locations",
    """SELECT s_suppkey, CAST(300000000 + s_suppkey AS VARCHAR) AS organisation_number, s_name AS name,
    CASE WHEN s_nationkey % 2 = 0 THEN 'street ' ELSE 'box ' END || CAST(s_nationkey AS VARCHAR) AS address, CAST(s_nationkey AS INTEGER) AS employees FROM supplier""",
)
def locations(spark, folder):
    nation = F.col("s_nationkey").cast("string")
    street = F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit('"beliggenhetsadresse": {"adresse": ["street '), nation, F.lit('"]}, '))).otherwise(F.lit(""))
    body = F.concat(
        F.lit('{"_embedded": {"underenheter": [{"organisasjonsnummer": "'), (F.col("s_suppkey") + 300000000).cast("string"),
        F.lit('", "navn": "'), "s_name", F.lit('", '), street, F.lit('"postadresse": {"adresse": ["box '), nation,
        F.lit('"]}, "antallAnsatte": '), nation, F.lit("}]}}"),
    )
    return load(spark, folder, "supplier").select("s_suppkey", F.explode(N.locations(body)).alias("l")).select(
        "s_suppkey", "l.organisation_number", "l.name", F.col("l.address.adresse")[0].alias("address"), "l.employees"
    )


@query(
    "prj_09_live_entity",
    base.oracle("entities", """SELECT organisation_number, name, legal_form, employees, bankrupt, liquidating, NULLIF(website, '') AS website, municipality AS place FROM entities"""),
)
def live_entity(spark, folder):
    e = base.entities(spark, folder)
    body = F.to_json(
        F.struct(
            F.col("organisation_number").alias("organisasjonsnummer"), F.col("name").alias("navn"),
            F.struct(F.col("legal_form").alias("kode")).alias("organisasjonsform"), F.col("employees").alias("antallAnsatte"),
            F.col("bankrupt").alias("konkurs"), F.col("liquidating").alias("underAvvikling"),
            F.nullif("website", F.lit("")).alias("hjemmeside"),
            F.struct(F.array("municipality").alias("adresse"), F.col("municipality").alias("kommune")).alias("forretningsadresse"),
        )
    )
    return e.select(N.live_entity(body).alias("e")).select(
        "e.organisation_number", "e.name", "e.legal_form", "e.employees", "e.bankrupt", "e.liquidating", "e.website", F.col("e.business_address.kommune").alias("place")
    )


_OBLIGED_SQL = f"""CASE WHEN latest_submitted_accounts <> '' THEN 'filing_observed' WHEN upper(legal_form) IN {K.FORMS_ALWAYS_OBLIGED} THEN 'required_by_legal_form'
 WHEN upper(legal_form) IN {K.FORMS_CONDITIONAL} THEN 'threshold_or_activity_dependent' ELSE 'special_rule_or_review_required' END"""


@query("prj_10_obligation", base.oracle("entities", f"SELECT organisation_number, {_OBLIGED_SQL} AS classification FROM entities"))
def obligation(spark, folder):
    return base.entities(spark, folder).select("organisation_number", N.obligation_class("legal_form", "latest_submitted_accounts").alias("classification"))


_CLAIM_FIELDS = {
    "legal_name": "navn", "legal_form": '"organisasjonsform.beskrivelse"', "industry": '"naeringskode1.beskrivelse"',
    "registered_at": '"registreringsdatoEnhetsregisteret"', "email": "epostadresse", "website_registered": "hjemmeside",
    "legal_form_code": '"organisasjonsform.kode"', "industry_code": '"naeringskode1.kode"',
    "municipality": '"forretningsadresse.kommune"', "municipality_number": '"forretningsadresse.kommunenummer"',
    "postal_code": '"forretningsadresse.postnummer"', "language_form": "maalform",
    "vat_registered_date": "registreringsdatoMerverdiavgiftsregisteret",
}
_CLAIM_SQL = " UNION ALL ".join(
    f"SELECT organisasjonsnummer AS organisation_number, '{f}' AS field, '\"' || trim({c}) || '\"' AS value, CAST(NULL AS VARCHAR) AS reporting_period FROM registry WHERE trim({c}) <> ''"
    for f, c in _CLAIM_FIELDS.items()
) + """
 UNION ALL SELECT organisasjonsnummer, 'business_address', '"' || concat_ws(', ', "forretningsadresse.adresse",
   trim("forretningsadresse.postnummer" || ' ' || "forretningsadresse.poststed"), NULLIF("forretningsadresse.land", '')) || '"', NULL FROM registry
 UNION ALL SELECT organisasjonsnummer, 'share_capital', '{"amount":"' || "kapital.belop" || '","currency":"' || COALESCE(NULLIF("kapital.valuta", ''), 'NOK') || '"}', NULL FROM registry WHERE "kapital.belop" <> ''
 UNION ALL SELECT organisasjonsnummer, 'phone', '"' || COALESCE(NULLIF(telefon, ''), NULLIF(mobil, '')) || '"', NULL FROM registry WHERE telefon <> '' OR mobil <> ''
 UNION ALL SELECT organisasjonsnummer, 'employees_registered', '"' || antallAnsatte || '"', NULL FROM registry WHERE regexp_full_match(antallAnsatte, '[0-9]+')
 UNION ALL SELECT organisasjonsnummer, 'vat_registered', 'true', NULLIF(registreringsdatoMerverdiavgiftsregisteret, '') FROM registry WHERE registrertIMvaRegisteret = 'true'
 UNION ALL SELECT organisasjonsnummer, 'bankrupt', 'true', NULL FROM registry WHERE lower(konkurs) = 'true'
 UNION ALL SELECT organisasjonsnummer, 'under_liquidation', 'true', NULL FROM registry WHERE lower(underAvvikling) = 'true'
 UNION ALL SELECT organisasjonsnummer, 'foretaksregisteret_registered', lower(registrertIForetaksregisteret), NULL FROM registry"""


@query("prj_11_registry_claims", base.oracle("registry", _CLAIM_SQL))
def registry_claims(spark, folder):
    return N.registry_claims(base.registry_raw(spark, folder)).select("organisation_number", "field", "value", "reporting_period")


@query(
    "prj_12_address",
    base.oracle("registry", """SELECT organisasjonsnummer AS org, concat_ws(', ', "forretningsadresse.adresse",
    trim("forretningsadresse.postnummer" || ' ' || "forretningsadresse.poststed"), NULLIF("forretningsadresse.land", '')) AS address, CAST(NULL AS VARCHAR) AS postal FROM registry"""),
)
def address(spark, folder):
    raw = base.registry_raw(spark, folder)
    return raw.select(F.col("organisasjonsnummer").alias("org"), N.address(raw, "forretningsadresse").alias("address"), N.address(raw, "postadresse").alias("postal"))


@query(
    "prj_13_entity_card",
    base.oracle("entities observations", """SELECT e.organisation_number AS org, name, legal_form AS form, employees, municipality, industry_code, industry_label AS industry, website,
    bankrupt OR liquidating AS adverse, COALESCE(network_profiles, 0) > 0 AS network_available, network_profile_url, network_workforce_url,
    COALESCE(network_posts, 0) AS network_posts, COALESCE(network_jobs, 0) AS network_jobs, COALESCE(verified_handles, 0) AS verified_handles
    FROM entities e LEFT JOIN (SELECT organisation_number,
      count(*) FILTER (platform = 'linkedin' AND exact_entity AND signal_type = 'profile_metrics') AS network_profiles,
      arg_max(source_url, (retrieved_at, id)) FILTER (platform = 'linkedin' AND exact_entity AND signal_type = 'profile_metrics') AS network_profile_url,
      arg_max(source_url, (retrieved_at, id)) FILTER (platform = 'linkedin' AND exact_entity AND signal_type = 'workforce_snapshot') AS network_workforce_url,
      count(*) FILTER (platform = 'linkedin' AND exact_entity AND signal_type = 'public_post') AS network_posts,
      count(*) FILTER (platform = 'linkedin' AND exact_entity AND signal_type = 'job_posting') AS network_jobs,
      count(DISTINCT platform || source_url) FILTER (signal_type = 'profile_handle' AND exact_entity) AS verified_handles
      FROM observations GROUP BY 1) o ON o.organisation_number = e.organisation_number"""),
)
def entity_card(spark, folder):
    return N.entity_card(base.entities(spark, folder), base.observations(spark, folder))


@query(
    "prj_13_card_items",
    base.oracle("observations", """SELECT organisation_number AS org, id, row_number() OVER (PARTITION BY organisation_number ORDER BY retrieved_at, id) AS position FROM observations WHERE platform = 'linkedin' AND signal_type = 'public_post' AND exact_entity"""),
)
def card_items(spark, folder):
    return N.card_items(base.observations(spark, folder), "public_post").select(F.col("organisation_number").alias("org"), "id", F.col("position").cast("long").alias("position"))


_STATUS = """CASE WHEN latest_submitted_accounts = '' THEN 'not_found' ELSE 'available' END AS financials_status,
 CASE WHEN website = '' THEN 'not_found' WHEN bankrupt THEN 'blocked' ELSE 'available' END AS website_status,
 CASE WHEN employees IS NULL THEN NULL ELSE employees > 50 END AS website_publishable"""


def graded_profiles(spark, folder):
    return base.entities(spark, folder).selectExpr("*", *[p.strip() for p in _split_exprs(_STATUS)])


def _split_exprs(text):
    out, depth, cur = [], 0, ""
    for word in text.replace("\n", " ").split(" "):
        depth += (word == "CASE") - (word == "END" or word == "END,")
        cur += " " + word
        if word.endswith(",") and depth == 0:
            out.append(cur.rstrip(","))
            cur = ""
    return out + [cur]


base.VIEWS["graded"] = (("entities",), f"SELECT *, {_STATUS} FROM entities")


@query(
    "prj_14_coverage_flags",
    base.oracle("graded observations", """SELECT g.organisation_number, financials_status = 'available' AS financials,
    website_status = 'available' AND COALESCE(website_publishable, false) AS website, COALESCE(external, 0) AS external, COALESCE(signals, 0) AS signals
    FROM graded g LEFT JOIN (SELECT organisation_number, count(*) AS external,
    count(*) FILTER (signal_type IN ('job_posting', 'public_post', 'review', 'review_summary')) AS signals FROM observations GROUP BY 1) o USING (organisation_number)"""),
)
def coverage_flags(spark, folder):
    return N.coverage_flags(graded_profiles(spark, folder), base.observations(spark, folder))


@query(
    "prj_15_coverage_tier",
    base.oracle("graded", """SELECT CASE WHEN website_status = 'available' AND COALESCE(website_publishable, false) THEN 'website' WHEN financials_status = 'available' THEN 'financials' ELSE 'basic' END AS tier,
    count(*) AS n FROM graded GROUP BY 1"""),
)
def coverage_tier(spark, folder):
    return graded_profiles(spark, folder).groupBy(N.coverage_tier().alias("tier")).agg(F.count("*").alias("n"))


@query(
    "prj_16_availability",
    """SELECT event_type, CASE event_type WHEN 'view' THEN 'available' WHEN 'click' THEN 'not_available' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'blocked' ELSE 'not_available' END AS availability, count(*) AS n
    FROM events GROUP BY 1""",
)
def availability(spark, folder):
    t = F.col("event_type")
    status = F.when(t == "view", "available").when(t == "click", "not_found").when(t == "error", "source_error").when(t == "signup", "blocked_robots").otherwise("odd")
    return load(spark, folder, "events").select("event_type", N.availability(status).alias("availability")).groupBy("event_type", "availability").agg(F.count("*").alias("n"))


@query(
    "prj_17_snapshot_overlay",
    base.oracle("entities", """SELECT organisation_number, CASE WHEN NOT bankrupt THEN upper(name) ELSE name END AS name, legal_form,
    CASE WHEN NOT bankrupt AND employees > 10 THEN NULL ELSE employees END AS employees, website FROM entities"""),
)
def snapshot_overlay(spark, folder):
    e = base.entities(spark, folder)
    live = e.select(
        "organisation_number", F.when(F.col("bankrupt"), "source_error").otherwise("available").alias("status"),
        F.when(F.col("employees") > 10, F.array(F.lit("name"), F.lit("employees"))).otherwise(F.array(F.lit("name"))).alias("present"),
        F.upper("name").alias("name"), F.lit("X").alias("legal_form"), F.lit(None).cast("int").alias("employees"),
        F.lit("x").alias("website"), F.lit("x").alias("latest_submitted_accounts"),
    )
    return N.overlay_live(e, live).select("organisation_number", "name", "legal_form", "employees", "website")


@query(
    "prj_18_binding_fold",
    """SELECT CAST(100000000 + user_id AS VARCHAR) AS organisation_number, arg_min(event_type, event_id) FILTER (event_type <> 'error') AS label,
    arg_min(props, event_id) FILTER (event_type = 'purchase') AS website, CAST(NULL AS VARCHAR) AS "P4264" FROM events GROUP BY 1""",
)
def binding_fold(spark, folder):
    rows = load(spark, folder, "events").select(
        (F.col("user_id") + 100000000).cast("string").alias("organisation_number"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") != "error", F.col("event_type")).otherwise("").alias("label"),
        F.when(F.col("event_type") == "purchase", F.col("props")).alias("website"), F.lit(None).cast("string").alias("P4264"),
    )
    return N.fold_bindings(rows)


@query("prj_19_feed_entry", base.oracle("jobs_parsed", "SELECT * FROM jobs_parsed"))
def feed_entry(spark, folder):
    return N.parse_feed(base.feed(spark, folder)).select("seq", "job_id", "active", "organisation_number", "title", "published", "updated", "municipal")


@query(
    "prj_20_detail_entry",
    base.oracle("feed", """SELECT replace(orgnr, ' ', '') AS organisation_number, count(*) AS entries, count(DISTINCT job_id) AS jobs, max(updated) AS updated,
    arg_min(title || '.example', seq) FILTER (city <> '') AS homepage FROM feed WHERE status = 'Active' AND orgnr <> '' GROUP BY 1"""),
)
def detail_entry(spark, folder):
    cols = dict(base.feed_columns(True))
    f = load(spark, folder, "events").withColumn("k", F.expr(base._K)).selectExpr(*[f"{e} AS {n}" for n, e in cols.items()])
    detail = F.to_json(
        F.struct(
            "status", F.col("updated").alias("sistEndret"),
            F.struct(
                F.col("job_id").alias("uuid"), F.col("title"), F.col("published"),
                F.struct(F.col("orgnr"), F.when(F.col("city") != "", F.concat("title", F.lit(".example"))).alias("homepage")).alias("employer"),
            ).alias("ad_content"),
        )
    )
    rows = N.feed_from_details(f.select("seq", detail.alias("detail"), F.lit("s").alias("stub_uuid"), F.lit("t").alias("stub_title"), F.lit("b").alias("stub_business")))
    counts = rows.groupBy("organisation_number").agg(F.count("*").alias("entries"), F.count_distinct("job_id").alias("jobs"), F.max("updated").alias("updated"))
    return counts.join(N.first_homepages(rows), "organisation_number", "left")


@query(
    "prj_21_search_query",
    base.oracle("entities", """SELECT organisation_number, '"' || name || '" ' || organisation_number || ' ' || municipality AS query FROM entities"""),
)
def search_query(spark, folder):
    return base.entities(spark, folder).select("organisation_number", N.search_query_text("name", "organisation_number", "municipality").alias("query"))


@query(
    "prj_22_search_results",
    """SELECT page_id AS query_id, 'https://b.example/' || CAST(page_id AS VARCHAR) AS url, '' AS title, url AS snippet, 2 AS rank FROM pages
    UNION ALL SELECT page_id, url, 'T', '', 1 FROM pages WHERE page_id % 2 = 0""",
)
def search_results(spark, folder):
    first = F.when(F.col("page_id") % 2 == 0, F.col("url"))
    body = F.to_json(
        F.struct(
            F.struct(
                F.array(
                    F.struct(first.alias("url"), F.lit("T").alias("title"), F.lit(None).cast("string").alias("description")),
                    F.struct(F.concat(F.lit("https://b.example/"), F.col("page_id").cast("string")).alias("url"), F.lit(None).cast("string").alias("title"), F.col("url").alias("description")),
                ).alias("results")
            ).alias("web")
        )
    )
    return N.search_results(load(spark, folder, "pages").select(F.col("page_id").alias("query_id"), body.alias("body"))).drop("provider")


@query(
    "prj_23_budget_fill",
    base.oracle("graded", """SELECT organisation_number, module, 'source_error' AS status, 'budget_exhausted: time' AS note
    FROM graded, (VALUES ('financials'), ('roles'), ('website')) m(module)
    WHERE NOT (module = 'financials' AND financials_status = 'available') AND NOT (module = 'website' AND website_status = 'available')"""),
)
def budget_fill(spark, folder):
    g = graded_profiles(spark, folder)
    have = g.where("financials_status = 'available'").select("organisation_number", F.lit("financials").alias("module")).unionByName(
        g.where("website_status = 'available'").select("organisation_number", F.lit("website").alias("module"))
    )
    return N.fill_budget_exhausted(g, have, ["financials", "roles", "website"], "time")
