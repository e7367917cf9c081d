"""Queries over entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K, ids, text as T
from ..operators import identity as I
from . import base, sqltext as S
from .catalog import load, query, spread

ORG = "organisation_number"

# ---- sites: pages with a legal name to prove -------------------------------------------
_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
_FOOTER = "regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1)"
_SITE_ORG = "CAST(900000000 + page_id AS STRING)"


def site_columns(spark: bool) -> list[tuple[str, str]]:
    strip = (lambda x: f"trim(regexp_replace({x}, '<[^>]*>', ' '))") if spark else (lambda x: f"trim(regexp_replace({x}, '<[^>]*>', ' ', 'g'))")
    label = "regexp_extract(url, '^[a-z]+://([^/]+)', 1)"
    head = f"regexp_extract({_TITLE}, '^([^ ]+ [^ ]+ [^ ]+)', 1)"
    one = f"regexp_extract({_TITLE}, '^([^ ]+)', 1)"
    return [
        ("page_id", "page_id"),
        (ORG, _SITE_ORG),
        ("name", f"CASE page_id % 6 WHEN 0 THEN {label} || ' AS' WHEN 1 THEN {head} || ' ASA' WHEN 2 THEN {one} || ' Holding Invest AS' WHEN 3 THEN {one} WHEN 4 THEN {head} || ' Holding' ELSE 'Primulator B.I.L.' END"),
        ("final_url", "url"),
        ("title", _TITLE),
        ("description", "CASE WHEN page_id % 19 = 4 THEN 'This DOMAIN is for säle' WHEN page_id % 23 = 5 THEN 'Domain for sale | HugeDomains' ELSE '' END"),
        ("identity_text", f"{strip(_FOOTER)} || CASE WHEN page_id % 7 = 1 THEN ' Org.nr ' || {_SITE_ORG} WHEN page_id % 7 = 2 THEN ' 811111111 ' || {_SITE_ORG} ELSE '' END"),
        ("main_text", strip("regexp_extract(html, '(?s)<article>(.*?)</article>', 1)")),
    ]


base.VIEWS["sites"] = ((), "SELECT " + ", ".join(f"{e} AS {n}" for n, e in site_columns(False)) + " FROM pages")


def sites(spark, folder):
    return load(spark, folder, "pages").selectExpr(*[f"{e} AS {n}" for n, e in site_columns(True)])


_PARKED = " OR ".join(f"position('{m}' IN flat) > 0" for m in K.PARKED_MARKERS)
GRADED_SITES_SQL = f"""
SELECT *, CASE WHEN {_PARKED} THEN 0.1
  WHEN regexp_matches(name, '(?i)(^|\\s)B\\.?\\s*I\\.?\\s*L\\.?(\\s|$)') AND position('bedriftsidrett' IN array_to_string(toks, ' ')) = 0 THEN 0.3
  WHEN position(organisation_number IN regexp_replace(home, '[^0-9]', '', 'g')) > 0 AND len(list_distinct(regexp_extract_all(home, '\\b\\d{{9}}\\b'))) > 1 AND ratio < 0.5 THEN 0.6
  WHEN position(organisation_number IN regexp_replace(home, '[^0-9]', '', 'g')) > 0 THEN 1.0
  WHEN len(core) >= 2 AND named THEN 0.95 WHEN len(core) = 1 AND named AND length(trim(main_text)) >= 100 THEN 0.95
  WHEN ratio >= 0.75 AND hits >= 2 THEN 0.85 WHEN ratio >= 0.5 AND hits >= 2 THEN 0.65 ELSE 0.3 END AS site_score
FROM (SELECT *, len(list_intersect(list_distinct(core), toks)) AS hits,
   CASE WHEN len(core) > 0 THEN len(list_intersect(list_distinct(core), toks)) / len(list_distinct(core)) ELSE 0 END AS ratio
  FROM (SELECT *, {S.tokens('name', K.STOP_IDENTITY)} AS core, {S.tokens('home', K.STOP_IDENTITY)} AS toks,
    lower(regexp_replace(strip_accents(home), '[^\\x00-\\x7F]', '', 'g')) AS flat,
    list_bool_or([{', '.join(S.within(S.tokens('name', K.STOP_IDENTITY), S.tokens(f, K.STOP_IDENTITY)) for f in ('title', 'description', 'identity_text', 'lower(rawhost)'))}]) AS named
  FROM (SELECT *, regexp_extract(final_url, '^[a-z]+://([^/]+)', 1) AS rawhost, concat_ws(' ', title, description, identity_text, lower(regexp_extract(final_url, '^[a-z]+://([^/]+)', 1)), main_text) AS home FROM sites)))"""
base.VIEWS["graded_sites"] = (("sites",), GRADED_SITES_SQL)


@query(
    "idr_01_site_identity",
    base.oracle("graded_sites", "SELECT page_id, CAST(site_score AS DOUBLE) AS site_score, CASE WHEN site_score >= 0.9 THEN 'exact' WHEN site_score >= 0.8 THEN 'review' ELSE 'related_or_uncertain' END AS site_status, site_score >= 0.9 AS site_publishable FROM graded_sites"),
)
def site_identity(spark, folder):
    return I.assess_site(sites(spark, folder)).select("page_id", "site_score", "site_status", "site_publishable")


_HANDLE = "CASE c_custkey % 5 WHEN 0 THEN lower(c_mktsegment) || '-nr' || CAST(c_custkey AS STRING) WHEN 1 THEN lower(c_mktsegment) || '-of-' || n_name WHEN 2 THEN 'group-' || CAST(c_custkey AS STRING) WHEN 3 THEN n_name ELSE lower(c_mktsegment) END"
_SOCIAL_NAME = "CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || ' AS' ELSE c_mktsegment || ' Nr' || CAST(c_custkey AS STRING) || ' ' || n_name || ' Sør AS' END"


def social_links(spark, folder):
    joined = spread(load(spark, folder, "customer")).join(load(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.selectExpr(
        f"CAST(100000000 + c_custkey AS STRING) AS {ORG}", f"{_SOCIAL_NAME} AS name", f"'https://linkedin.com/company/' || {_HANDLE} AS url"
    )


base.VIEWS["social"] = ((), f"SELECT CAST(100000000 + c_custkey AS VARCHAR) AS {ORG}, {_SOCIAL_NAME} AS name, {_HANDLE} AS handle FROM customer JOIN nation ON c_nationkey = n_nationkey")
_SOCIAL_SCORE = f"""SELECT {ORG}, handle, CASE WHEN len(core) > 0 AND position(array_to_string(core, '') IN h) > 0 THEN 0.98 WHEN len(core) = 1 AND hits > 0 THEN 0.95
 WHEN hits / len(list_distinct(core)) >= 0.75 AND hits >= 2 THEN 0.9 ELSE 0.3 END AS score
 FROM (SELECT *, len(list_filter(list_distinct(core), lambda t: position(t IN h) > 0)) AS hits FROM
 (SELECT *, {S.tokens('name', K.STOP_IDENTITY)} AS core, array_to_string({S.tokens("'/company/' || handle", K.STOP_IDENTITY)}, '') AS h FROM social))"""
base.VIEWS["social_scores"] = (("social",), _SOCIAL_SCORE)


@query("idr_02_social_identity", base.oracle("social_scores", f"SELECT {ORG}, CAST(score AS DOUBLE) AS score, score >= 0.9 AS publishable FROM social_scores"))
def social_identity(spark, folder):
    s = I.social_score(T.identity_tokens("name"), F.col("url"))
    return social_links(spark, folder).select(ORG, s.alias("score")).withColumn("publishable", F.col("score") >= 0.9)


@query(
    "idr_03_site_gate",
    base.oracle("graded_sites", """SELECT page_id, site_score >= 0.9 AS publishable, CASE WHEN site_score >= 0.9 THEN 2 ELSE 0 END AS jobs, CASE WHEN site_score >= 0.9 THEN 0 ELSE 2 END AS quarantined_jobs,
    CASE WHEN site_score >= 0.9 THEN 1 ELSE 0 END AS news, CASE WHEN len(core) > 0 THEN 1 ELSE 0 END AS socials, CASE WHEN len(core) > 0 THEN 1 ELSE 2 END AS quarantined_socials FROM graded_sites"""),
)
def site_gate(spark, folder):
    handle = F.array_join(T.identity_tokens("name"), "-")
    rows = I.assess_site(sites(spark, folder)).withColumn(
        "social_links",
        F.array(
            F.struct(F.lit("linkedin").alias("platform"), F.concat(F.lit("https://linkedin.com/company/"), handle).alias("url")),
            F.struct(F.lit("x").alias("platform"), F.lit("https://x.com/zzzqqq").alias("url")),
        ),
    ).withColumn("job_postings", F.array("title", "final_url")).withColumn("news_articles", F.array("title"))
    out = I.site_gate(rows)
    return out.select(
        "page_id", F.col("site_publishable").alias("publishable"), F.size("job_postings").alias("jobs"), F.size("quarantined_job_postings").alias("quarantined_jobs"),
        F.size("news_articles").alias("news"), F.size("social_links").alias("socials"), F.col("quarantined_social_links").alias("quarantined_socials"),
    )


# ---- search results: three per page's entity -------------------------------------------
_NAME4 = "CASE page_id % 4 WHEN 0 THEN 'Thther Norge AS' WHEN 1 THEN 'Spam Farm AS' WHEN 2 THEN 'Ththth Group' ELSE 'Østre Blå Verk AS' END"


def result_columns() -> list[tuple[str, str]]:
    org = "CAST(100000000 + page_id % 90 AS STRING)"
    name = _NAME4.replace("page_id", "(page_id % 90)")
    return [
        (ORG, org), ("name", name), ("municipality", "CASE WHEN page_id % 2 = 0 THEN 'Sør Oslo' ELSE '' END"),
        ("url", "CASE WHEN page_id % 31 = 30 THEN 'https://no.linkedin.com/company/x' WHEN page_id % 29 = 28 THEN ' ' ELSE url END"),
        ("title", f"CASE page_id % 3 WHEN 0 THEN {name} || ' - forside' ELSE {_TITLE} END"),
        ("snippet", f"'Firma i sør oslo ' || CASE page_id % 5 WHEN 0 THEN 'org nr ' || {org} WHEN 1 THEN {name} ELSE 'thther' END"),
        ("rank", "CASE WHEN page_id % 9 = 8 THEN NULL ELSE CAST(page_id % 10 + 1 AS INT) END"),
    ]


base.VIEWS["results"] = ((), "SELECT " + ", ".join(f"{e} AS {n}" for n, e in result_columns()) + " FROM pages")
_T2 = lambda x: S.tokens(x, (), 2)
_BLOCK_RE = "(^|\\.)(" + "|".join(h.replace(".", "\\.") for h in K.BLOCKED_SITE_HOSTS) + ")$"
_SCORED = f"""SELECT *, score >= 75 AND in_host AND (org_match OR in_title) AS accepted FROM (SELECT *, CASE WHEN trim(url) = '' OR regexp_matches(host, '{_BLOCK_RE}') THEN 0 ELSE
 least(100, CASE WHEN org_match THEN 75 ELSE 0 END + CASE WHEN in_title THEN 45 WHEN anywhere THEN 25 ELSE 0 END + CASE WHEN in_host THEN 30 ELSE 0 END + CASE WHEN place THEN 10 ELSE 0 END) END AS score
 FROM (SELECT *, position({ORG} IN regexp_replace(title || ' ' || snippet, '[^0-9]', '', 'g')) > 0 AS org_match, {S.within('nt', 'tt')} AS in_title, {S.within('nt', 'list_concat(tt, st, ht)')} AS anywhere,
  len(nt) > 0 AND position(array_to_string(nt, '') IN array_to_string(ht, '')) > 0 AS in_host, {S.within('mt', 'st')} AS place
 FROM (SELECT *, {S.tokens('name', K.STOP_SEARCH_NAME)} AS nt, {_T2('title')} AS tt, {_T2('snippet')} AS st, {_T2('host')} AS ht, {_T2('municipality')} AS mt
 FROM (SELECT *, {S.host('url')} AS host FROM results))))"""
base.VIEWS["scored_results"] = (("results",), _SCORED)


def results(spark, folder):
    return load(spark, folder, "pages").selectExpr(*[f"{e} AS {n}" for n, e in result_columns()])


@query(
    "idr_04_search_candidate_score",
    base.oracle("scored_results", f"SELECT {ORG}, url, rank, score / 100.0 AS score, accepted, CASE WHEN accepted THEN 'accepted_for_crawl' WHEN score >= 60 THEN 'review' ELSE 'rejected' END AS status FROM scored_results"),
)
def search_candidate_score(spark, folder):
    return I.score_candidates(results(spark, folder)).select(ORG, "url", "rank", "score", "accepted", "status")


_CHOSEN = f"""SELECT r.{ORG}, c.url AS selected_url, c.score / 100.0 AS selected_score, c.rank AS selected_rank, c.url IS NULL AS abstained
 FROM (SELECT DISTINCT {ORG} FROM results) r LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY {ORG} ORDER BY score DESC, COALESCE(rank, 10000), url) AS rn FROM scored_results WHERE accepted) c
 ON c.{ORG} = r.{ORG} AND rn = 1"""
base.VIEWS["chosen"] = (("results", "scored_results"), _CHOSEN.replace("c.url AS", "regexp_replace(regexp_extract(c.url, '^[^?#]*'), '^([a-z]+://[^/]+)$', '\\1/') AS"))


@query("idr_05_choose_candidate", base.oracle("chosen", "SELECT * FROM chosen"))
def choose_candidate(spark, folder):
    r = results(spark, folder)
    return I.choose_candidates(r.select(ORG).distinct(), I.score_candidates(r))


_NINE = "\\b(\\d(?:[ .]?\\d){8})\\b"
_DOCTEXT = "text || CASE WHEN doc_id % 4 = 0 THEN ' Org.nr 923 609.016 MVA' WHEN doc_id % 4 = 1 THEN ' org 974760673' WHEN doc_id % 4 = 2 THEN ' nr 812345702 og 123456789' ELSE '' END"
_CHECK = "(" + " + ".join(f"CAST(d[{i + 1}] AS INT) * {w}" for i, w in enumerate(K.ORGNR_WEIGHTS)) + ")"
_VALID = f"(CASE WHEN (11 - {_CHECK} % 11) % 11 = 10 THEN false ELSE (11 - {_CHECK} % 11) % 11 = CAST(d[9] AS INT) END)"


@query(
    "idr_06_orgnr_verdict",
    f"""WITH f AS (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all({_DOCTEXT}, '{_NINE}'), lambda m: regexp_replace(m, '[^0-9]', '', 'g')))) AS d FROM documents),
    v AS (SELECT doc_id, d FROM f WHERE {_VALID})
    SELECT doc_id, CASE WHEN bool_or(d = '923609016') THEN 'match' WHEN count(d) > 0 THEN 'conflict' ELSE 'none' END AS verdict FROM documents LEFT JOIN v USING (doc_id) GROUP BY 1""",
)
def orgnr_verdict(spark, folder):
    return load(spark, folder, "documents").select("doc_id", ids.orgnr_verdict(F.lit("923609016"), F.expr(_DOCTEXT)).alias("verdict"))


@query(
    "idr_07_contact_verdict",
    base.oracle("registry", """SELECT organisasjonsnummer AS org, (length(regexp_replace(phone, '[^0-9]', '', 'g')) >= 8 AND c_custkey % 3 = 0) OR (epostadresse LIKE '%@%' AND (c_custkey % 3 = 1 OR lower(split_part(epostadresse, '@', 2)) = 'gmail.com')) AS contact
    FROM (SELECT *, telefon || mobil AS phone FROM registry)"""),
)
def contact_verdict(spark, folder):
    r = base.registry_raw(spark, folder)
    phone = F.concat("telefon", "mobil")
    spaced = F.regexp_replace(T.digits(phone), "(..)", "$1 ")
    page = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Ring "), spaced)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("Mail: kontakt@"), F.upper(F.split_part("epostadresse", F.lit("@"), F.lit(2))))).otherwise(F.lit("nothing"))
    return r.select(F.col("organisasjonsnummer").alias("org"), I.contact_match(phone, "epostadresse", page, F.lit("https://www.gmail.com/x")).alias("contact"))


def attempts(spark, folder):
    """Candidate captures: one per event of a user, its page text told by the event type."""
    t = F.col("event_type")
    page = (
        F.when((t == "click") & (F.col("k") < 20), F.lit("Org.nr 923609016"))
        .when((t == "view") & (F.col("k") < 40), F.lit("org 974760673"))
        .when((t == "signup") & (F.col("k") < 15), F.lit("Tlf 22 50 07 37"))
        .otherwise(F.lit("Velkommen"))
    )
    e = load(spark, folder, "events").withColumn("k", F.expr(base._K))
    return e.select(
        F.lit("923609016").alias("true_org"), F.col("user_id"), F.col("event_id").alias("ord"), F.when(t == "error", "source_error").otherwise("available").alias("status"),
        F.concat(F.lit("https://c"), F.col("event_id").cast("string"), F.lit(".example/")).alias("url"), page.alias("page"),
        F.lit("22500737").alias("phone"), F.lit("post@example.no").alias("email"),
    )


@query(
    "idr_08_discovery",
    f"""WITH e AS (SELECT *, {base._K} AS k FROM events), g AS (SELECT user_id, event_id, event_type,
      CASE WHEN event_type = 'click' AND k < 20 AND user_id % 5 = 0 THEN 'verified_orgnr' WHEN event_type = 'signup' AND k < 15 THEN 'verified_contact' END AS proof,
      (event_type = 'view' AND k < 40) OR (event_type = 'click' AND k < 20 AND user_id % 5 <> 0) AS conflict FROM e WHERE event_type <> 'error')
    SELECT CASE WHEN user_id % 5 = 0 THEN 923609016 ELSE 100000000 + user_id END AS org_key, user_id,
      CASE WHEN arg_min(proof, event_id) FILTER (proof IS NOT NULL) IS NOT NULL THEN arg_min(proof, event_id) FILTER (proof IS NOT NULL) WHEN bool_or(conflict) THEN 'rejected_conflicting_orgnr' ELSE 'no_match' END AS verdict,
      arg_min('https://c' || CAST(event_id AS VARCHAR) || '.example/', event_id) FILTER (proof IS NOT NULL) AS website FROM g GROUP BY user_id""",
)
def discovery(spark, folder):
    # several users stand for the one organisation whose number the pages show; the user keeps them apart
    a = attempts(spark, folder).withColumn(ORG, F.when(F.col("user_id") % 5 == 0, F.col("true_org")).otherwise((F.col("user_id") + 100000000).cast("string")))
    keys = (ORG, "user_id")
    seen = a.where("status = 'available'").select(*keys).distinct()
    return I.discover_sites(seen, a, keys).select(F.col(ORG).cast("long").alias("org_key"), "user_id", "verdict", "website")


@query(
    "idr_09_candidate_domains",
    base.oracle("registry", f"""SELECT organisasjonsnummer AS org, CASE WHEN len(w) = 0 THEN '' WHEN len(w) = 1 THEN w[1] || '.no,' || w[1] || '.com'
    ELSE array_to_string(w, '') || '.no,' || array_to_string(w, '') || '.com,' || array_to_string(w, '-') || '.no,' || array_to_string(w, '-') || '.com' END AS domains,
    CASE WHEN epostadresse LIKE '%@%' AND lower(split_part(epostadresse, '@', 2)) NOT IN ('gmail.com') THEN 'https://' || lower(split_part(epostadresse, '@', 2)) || '/' END AS mail_site
    FROM (SELECT *, list_filter(regexp_extract_all(replace(replace(replace(replace(lower(navn), 'ø', 'o'), 'å', 'a'), 'æ', 'ae'), 'é', 'e'), '[a-z0-9]+'), lambda t: t NOT IN {K.STOP_DOMAIN}) AS w FROM registry)"""),
)
def candidate_domains(spark, folder):
    return base.registry_raw(spark, folder).select(
        F.col("organisasjonsnummer").alias("org"), F.array_join(I.candidate_domains("navn"), ",").alias("domains"), I.mail_domain_site("epostadresse").alias("mail_site")
    )


def _listing(spark, folder):
    r = base.registry_raw(spark, folder)
    k = F.col("c_custkey")
    return r.select(
        F.col("organisasjonsnummer").alias(ORG), F.col("navn").alias("name"), F.col("`forretningsadresse.adresse`").alias("street"),
        F.col("`forretningsadresse.postnummer`").alias("postcode"), F.col("`forretningsadresse.poststed`").alias("city"),
        F.col("`forretningsadresse.kommune`").alias("municipality"), F.concat("telefon", "mobil").alias("registry_phone"),
        F.when(k % 2 == 0, F.concat(F.lit("https://"), "hjemmeside")).otherwise("").alias("site_url"), k.alias("k"),
        F.when(k % 4 == 3, F.regexp_replace("navn", "e", "")).otherwise(F.regexp_replace("navn", " (AS|ASA|ENK|DA)$", "")).alias("title"),
        F.when(k % 5 == 0, "Elsewhere 1, 9999 Nowhere").otherwise(
            F.concat_ws(", ", "`forretningsadresse.adresse`", F.concat_ws(" ", "`forretningsadresse.postnummer`", "`forretningsadresse.poststed`"))
        ).alias("address"),
        F.when(k % 3 == 0, F.concat("telefon", "mobil")).otherwise("11 11 11 11").alias("phone"),
        F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("http://shop."), F.regexp_replace("hjemmeside", "^www[.]", ""))).alias("web_site"),
        (k % 400).cast("int").alias("review_count"),
    )


_LISTING_VIEW = """SELECT organisasjonsnummer AS organisation_number, navn AS name, "forretningsadresse.adresse" AS street, "forretningsadresse.postnummer" AS postcode,
 "forretningsadresse.poststed" AS city, "forretningsadresse.kommune" AS municipality, telefon || mobil AS registry_phone, CASE WHEN c_custkey % 2 = 0 THEN hjemmeside ELSE '' END AS site, c_custkey AS k,
 CASE WHEN c_custkey % 4 = 3 THEN replace(navn, 'e', '') ELSE regexp_replace(navn, ' (AS|ASA|ENK|DA)$', '') END AS title,
 CASE WHEN c_custkey % 5 = 0 THEN 'Elsewhere 1, 9999 Nowhere' ELSE "forretningsadresse.adresse" || ', ' || "forretningsadresse.postnummer" || ' ' || "forretningsadresse.poststed" END AS address,
 CASE WHEN c_custkey % 3 = 0 THEN telefon || mobil ELSE '11 11 11 11' END AS phone, CASE WHEN c_custkey % 7 = 0 THEN '' WHEN hjemmeside = '' THEN 'shop.' ELSE 'shop.' || substr(hjemmeside, 5) END AS web, c_custkey % 400 AS review_count FROM registry"""
base.VIEWS["listing"] = (("registry",), _LISTING_VIEW)
_LW = lambda x: f"regexp_extract_all(replace(replace(replace(lower({x}), 'æ', 'ae'), 'ø', 'o'), 'å', 'a'), '[a-z0-9]+')"
_LN = lambda x: f"list_distinct(list_filter({_LW(x)}, lambda w: w NOT IN {K.STOP_LISTING} AND (length(w) >= 3 OR regexp_full_match(w, '[0-9]+'))))"
_P8 = lambda x: f"right(CASE WHEN regexp_replace({x}, '[^0-9]', '', 'g') LIKE '47%' AND length(regexp_replace({x}, '[^0-9]', '', 'g')) > 8 THEN substr(regexp_replace({x}, '[^0-9]', '', 'g'), 3) ELSE regexp_replace({x}, '[^0-9]', '', 'g') END, 8)"


@query(
    "idr_10_place_identity",
    base.oracle("listing", f"""SELECT organisation_number, {S.within('n', 'd')} AND position(lower(municipality) IN lower(address)) > 0 AS exact FROM (SELECT *,
    list_filter({_LW('name')}, lambda w: length(w) > 1 AND w NOT IN {K.STOP_PLACES}) AS n, list_filter({_LW('title')}, lambda w: length(w) > 1 AND w NOT IN {K.STOP_PLACES}) AS d FROM listing)"""),
)
def place_identity(spark, folder):
    return _listing(spark, folder).select(ORG, I.place_match("name", "municipality", "title", "address").alias("exact"))


@query(
    "idr_11_map_candidates",
    base.oracle("listing", f"""SELECT organisation_number, CASE WHEN web LIKE '%.%' THEN 'https://' || web END AS url, 1 AS position FROM listing
    WHERE web <> '' AND k % 5 <> 0 AND {S.within(f"list_filter({_LW('name')}, lambda w: length(w) > 1 AND w NOT IN {K.STOP_MAP_DATA})", f"list_filter({_LW('title')}, lambda w: length(w) > 1 AND w NOT IN {K.STOP_MAP_DATA})")}"""),
)
def map_candidates(spark, folder):
    none = F.lit(None).cast("string")
    rows = _listing(spark, folder).select(
        ORG, "name", "municipality", F.lit(1).alias("ord"), F.lit("").alias("entry_name"), F.concat("title", F.lit(", Street, Norge")).alias("display_name"),
        F.when(F.col("k") % 5 != 0, F.col("municipality")).alias("addr_municipality"), none.alias("city"), none.alias("town"), none.alias("village"), none.alias("county"),
        F.lit("nodot").alias("tag_website"), F.regexp_replace("web_site", "^http://", "").alias("tag_contact_website"), none.alias("tag_url"), none.alias("tag_contact_url"),
    )
    return I.map_candidates(rows.unionByName(rows.withColumn("ord", F.lit(2))))


_LISTING_MATCH = f"""SELECT *, name_score * 4 + CASE WHEN address_match THEN 3 ELSE 0 END + CASE WHEN phone_match THEN 2 ELSE 0 END + CASE WHEN website_match THEN 3 ELSE 0 END
  + CASE WHEN postcode_city_match THEN 2 ELSE 0 END + least(1.0, log10(greatest(1, review_count)) / 5) AS raw_score FROM (SELECT *, CASE WHEN len(n) > 0 THEN len(list_intersect(n, t)) / len(n) ELSE 0 END AS name_score,
  list_has_all(a, {_LW('street')}) AND (postcode = '' OR list_contains(a, postcode)) AS address_match, postcode <> '' AND list_contains(a, postcode) AND list_has_all(a, {_LW('city')}) AS postcode_city_match,
  length({_P8('registry_phone')}) >= 5 AND {_P8('registry_phone')} = {_P8('phone')} AS phone_match, site <> '' AND web <> '' AND web LIKE '%.' || substr(site, 5) AS website_match
  FROM (SELECT *, {_LN('name')} AS n, {_LN('title')} AS t, {_LW('address')} AS a FROM listing))"""
base.VIEWS["listing_match"] = (("listing",), _LISTING_MATCH)


@query(
    "idr_12_listing_score",
    base.oracle("listing_match", """SELECT organisation_number, round(name_score, 4) AS name_score, address_match, postcode_city_match, phone_match, website_match, round(raw_score, 4) AS score FROM listing_match"""),
)
def listing_score(spark, folder):
    return I.score_listings(_listing(spark, folder)).select(
        ORG, F.round("name_score", 4).alias("name_score"), "address_match", "postcode_city_match", "phone_match", "website_match", "score"
    )


# listings whose site is that of the entity bear its own name or one without a letter of it, where the ratio is 1 or 0
_NAMED = "SELECT * REPLACE (CASE WHEN site = '' THEN title WHEN k % 3 = 0 THEN name ELSE 'Zzzqqq' END AS title) FROM listing"
base.VIEWS["named_match"] = (("listing",), _LISTING_MATCH.replace("FROM listing)", f"FROM ({_NAMED}))"))


@query(
    "idr_12_listing_accept",
    base.oracle("named_match", f"""SELECT organisation_number, fuzzy AS fuzzy_name_score, (by_name OR (website_match AND fuzzy >= 0.85)) AND NOT (len(n) = 1 AND n[1] IN {tuple(K.GENERIC_LISTING_TOKENS)} AND NOT (address_match OR phone_match OR website_match)) AS accepted
    FROM (SELECT *, CASE WHEN website_match AND k % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS fuzzy, (name_score >= 0.99 AND channels >= 1) OR (name_score >= 0.66 AND channels >= 2) AS by_name
    FROM (SELECT *, CAST(address_match OR postcode_city_match AS INT) + CAST(phone_match AS INT) + CAST(website_match AS INT) AS channels FROM named_match))"""),
)
def listing_accept(spark, folder):
    named = F.when(F.col("site_url").isin("", "https://"), F.col("title")).when(F.col("k") % 3 == 0, F.col("name")).otherwise("Zzzqqq")
    return I.score_listings(_listing(spark, folder).withColumn("title", named)).select(ORG, "accepted", "fuzzy_name_score")


@query(
    "idr_13_best_listing",
    """WITH l AS (SELECT o_custkey % 700 AS c, CAST(o_orderkey % 5000 AS VARCHAR) AS place, arg_max(CAST(FLOOR(o_totalprice / 50000) AS INT), o_orderkey) AS s FROM orders GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY s DESC, place) AS rn FROM l WHERE s >= 2), t AS (SELECT c, max(s) FILTER (rn = 1) AS s1, max(s) FILTER (rn = 2) AS s2, max(place) FILTER (rn = 1) AS place FROM r GROUP BY c)
    SELECT CAST(100000000 + c AS VARCHAR) AS organisation_number, CASE WHEN s1 IS NULL THEN 'no_exact_match' WHEN s1 = s2 THEN 'ambiguous_exact_match' ELSE 'exact_match' END AS status, n AS candidates,
    CASE WHEN s2 IS NULL OR s1 <> s2 THEN place END AS place_id FROM (SELECT c, count(*) AS n FROM l GROUP BY c) LEFT JOIN t USING (c)""",
)
def best_listing(spark, folder):
    level = F.floor(F.col("o_totalprice") / 50000).cast("int")
    raw = load(spark, folder, "orders").select(
        (F.col("o_custkey") % 700 + 100000000).cast("string").alias(ORG), (F.col("o_orderkey") % 5000).cast("string").alias("place_id"),
        F.lit("").alias("data_id"), F.lit("").alias("link"), F.col("o_orderkey").alias("seq"), level.cast("double").alias("score"), (level >= 2).alias("accepted"),
        F.lit("t").alias("title"), F.lit("").alias("address"), F.lit("").alias("phone"),
    )
    one = I.dedupe_listings(raw)
    return I.best_listings(one.select(ORG).distinct(), one).select(ORG, "status", "candidates", "place_id")


def _network_pairs(spark, folder):
    r = base.registry_raw(spark, folder)
    k = F.col("c_custkey")
    bare = F.regexp_replace("navn", " [A-Za-z]+$", "")
    return r.select(
        F.col("organisasjonsnummer").alias(ORG), F.col("navn").alias("name"), F.col("hjemmeside").alias("official_url"), F.col("`forretningsadresse.kommune`").alias("municipality"),
        F.array(F.lit("Kjent Merke AS")).alias("aliases"), F.array(F.lit("Ada Nord"), F.lit("Bo Sør")).alias("leaders"),
        F.when(k % 4 == 0, F.col("navn")).when(k % 4 == 1, F.upper(bare)).when(k % 4 == 2, "Kjent merke").otherwise("Noe Annet").alias("page_name"),
        F.when(k % 3 == 0, F.col("hjemmeside")).otherwise("other.example").alias("page_website"),
        F.when(k % 5 < 2, F.concat(F.lit("HQ: "), "`forretningsadresse.kommune`", F.lit(" Norge"))).otherwise("Berlin").alias("page_location"),
        F.when(k % 7 == 0, "Daglig leder er ada NORD.").otherwise("").alias("page_text"), (k % 6 == 0).alias("job_link"), k.alias("k"),
    )


@query(
    "idr_14_network_identity",
    base.oracle("registry", """SELECT organisasjonsnummer AS organisation_number, k % 4 = 0 AS full_name_match, k % 4 <= 1 AND (k % 4 = 0 OR f <> 'KBO') AS core_name_match, k % 3 = 0 AND hjemmeside <> '' AS domain_match, k % 5 < 2 AS location_match, k % 4 = 2 AS alias_match,
    (k % 4 <= 1 AND (k % 4 = 0 OR f <> 'KBO') AND k % 3 = 0 AND hjemmeside <> '') OR (k % 4 = 2 AND k % 3 = 0 AND hjemmeside <> '') OR (k % 4 = 0 AND k % 5 < 2) OR (k % 4 = 0 AND k % 6 = 0) OR (k % 4 = 2 AND k % 5 < 2 AND k % 7 = 0) AS exact_entity
    FROM (SELECT *, c_custkey AS k, "organisasjonsform.kode" AS f FROM registry)"""),
)
def network_identity(spark, folder):
    return I.network_identity(_network_pairs(spark, folder)).select(ORG, "full_name_match", "core_name_match", "domain_match", "location_match", "alias_match", "exact_entity")


@query(
    "idr_15_aliases_leaders",
    f"""SELECT page_id, CASE WHEN page_id % 5 = 0 OR length({S.full('h')}) < 3 OR length({S.full('h')}) > 80 THEN 'Second Name' ELSE h || ',Second Name' END AS aliases,
    CASE WHEN page_id % 2 = 0 THEN 'Ada,Bo' ELSE 'Bo' END AS leaders FROM (SELECT page_id, trim(regexp_replace({_TITLE} || ' | x', '(?s)\\s+[|–—]\\s+.*$', '')) AS h FROM pages)""",
)
def aliases_leaders(spark, folder):
    title = F.expr(_TITLE)
    shown = F.when(F.col("page_id") % 5 == 0, F.lit("Velkommen | x")).otherwise(F.concat(title, F.lit(" | Norsk side – mer")))
    roles = F.array(
        F.struct(F.lit("Ada").alias("name"), F.when(F.col("page_id") % 2 == 0, "DAGL").otherwise("MEDL").alias("role_code")),
        F.struct(F.lit("Bo").alias("name"), F.lit("LEDE").alias("role_code")), F.struct(F.lit("").alias("name"), F.lit("INNH").alias("role_code")),
    )
    aliases = I.site_aliases(F.lit("Velkommen hjem AS"), shown, F.array(F.lit("Second Name"), F.lit("home"), F.lit("Velkommen HJEM as")))
    return load(spark, folder, "pages").select("page_id", F.array_join(aliases, ",").alias("aliases"), F.array_join(I.leaders(roles), ",").alias("leaders"))


@query(
    "idr_16_channel_match",
    f"""WITH h AS (SELECT CAST(100000000 + user_id AS VARCHAR) AS organisation_number, 'https://youtube.com/c/' || CAST(k % 7 AS VARCHAR) AS channel_url, event_type = 'purchase' AND k % 10 = 1 AS dom
      FROM (SELECT *, {base._K} AS k FROM events) WHERE event_type IN ('click', 'purchase') AND k % 3 <> 0 AND k % 11 <> 0),
    g AS (SELECT organisation_number, channel_url, count(*) AS matched, bool_or(dom) AS d FROM h GROUP BY 1, 2)
    SELECT organisation_number, channel_url, matched, matched >= 2 OR d AS accepted FROM (SELECT *, row_number() OVER (PARTITION BY organisation_number ORDER BY matched DESC, channel_url) AS rn FROM g) WHERE rn = 1""",
)
def channel_match(spark, folder):
    return I.match_channels(channel_hits(spark, folder)).select(ORG, "channel_url", "matched", "accepted")


def channel_hits(spark, folder):
    e = load(spark, folder, "events").withColumn("k", F.expr(base._K))
    user = F.col("user_id").cast("string")
    good = F.col("event_type").isin("click", "purchase") & (F.col("k") % 3 != 0)
    return e.select(
        (F.col("user_id") + 100000000).cast("string").alias(ORG), F.concat(F.lit("Blå Firma "), user, F.lit(" AS")).alias("name"),
        F.when(good, F.concat(F.lit("BLÅ firma, "), user)).otherwise(F.lit("Blå Firma")).alias("channel"),
        F.when(F.col("k") % 11 == 0, "").otherwise(F.concat(F.lit("https://youtube.com/c/"), (F.col("k") % 7).cast("string"))).alias("channel_url"),
        F.concat(F.lit("https://www.firma"), user, F.lit(".no/")).alias("site_url"),
        F.when((F.col("event_type") == "purchase") & (F.col("k") % 10 == 1), F.concat(F.lit("Se FIRMA"), user, F.lit(".no"))).otherwise("").alias("description"),
        F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("event_id").cast("string")).alias("url"),
        F.when(F.col("k") % 5 != 0, F.floor("value").cast("long")).alias("view_count"), F.col("event_id").alias("seq"), F.col("event_type").alias("video_title"),
    )


@query(
    "idr_17_social_renormalise",
    base.oracle("social_scores", """SELECT count(*) AS profiles, 5 * count(*) AS links_before, 2 * count(*) AS links_after, 3 * count(*) AS removed, count(*) FILTER (score >= 0.9) AS published FROM social_scores"""),
)
def social_renormalise(spark, folder):
    s = social_links(spark, folder)
    links = F.array(
        "url", F.concat(F.replace("url", F.lit("https://"), F.lit("http://www.")), F.lit("/about?x=1")), F.lit("https://facebook.com/sharer.php?u=1"),
        F.lit("https://www.facebook.com/Zzqq/"), F.lit("mailto:a@b.no"),
    )
    out = I.renormalise_socials(s.select(ORG, "name", links.alias("links"), F.lit(True).alias("publishable")))
    return out.agg(
        F.count("*").alias("profiles"), F.sum("links_before").alias("links_before"), F.sum("links_after").alias("links_after"),
        F.sum("removed").alias("removed"), F.sum(F.size("social_links")).alias("published"),
    )


@query(
    "idr_18_discovery_ledger",
    base.oracle("chosen", f"""SELECT CASE WHEN CAST({ORG} AS BIGINT) % 4 = 0 THEN 'registry_website_present_skipped' WHEN selected_url IS NULL THEN 'abstained_before_crawl'
    WHEN length(selected_url) % 3 <> 0 THEN 'verified' ELSE 'quarantined' END AS outcome, count(*) AS n FROM chosen GROUP BY 1"""),
)
def discovery_ledger(spark, folder):
    r = results(spark, folder)
    e = r.select(ORG).distinct().withColumn("website", F.when(F.col(ORG).cast("long") % 4 == 0, "x.no").otherwise(""))
    scored = I.score_candidates(r)
    captures = scored.select(F.col("candidate_url").alias("url")).where("url IS NOT NULL").distinct().select(
        "url", (F.length("url") % 3 != 0).alias("site_publishable"), F.lit("available").alias("status")
    )
    return I.ledger_counts(I.discovery_ledger(e, scored, captures))


@query(
    "idr_19_typeahead",
    base.oracle("registry", """SELECT organisasjonsnummer AS organisation_number, 'c' || CAST(c_custkey AS VARCHAR) AS company_id, c_custkey % 2 = 0 AS exact_full_name,
    c_custkey % 2 = 0 OR "organisasjonsform.kode" <> 'KBO' AS exact_core_name FROM registry"""),
)
def typeahead(spark, folder):
    r = base.registry_raw(spark, folder)
    shown = F.when(F.col("c_custkey") % 2 == 0, F.upper("navn")).otherwise(F.regexp_replace("navn", " [A-Za-z]+$", ""))
    key = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    body = F.to_json(
        F.array(
            F.struct(F.lit("GEO").alias("type"), F.lit("1").alias("id"), F.col("navn").alias("displayName")),
            F.struct(F.lit("COMPANY").alias("type"), key.alias("id"), shown.alias("displayName")),
            F.struct(F.lit("COMPANY").alias("type"), F.lit("").alias("id"), shown.alias("displayName")),
        )
    )
    rows = r.select(F.col("organisasjonsnummer").alias(ORG), F.col("navn").alias("name"), body.alias("body"))
    return I.typeahead_matches(rows).drop("display_name")


