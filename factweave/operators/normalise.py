"""Normalisers: source rows and source JSON to the columns the other operators use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K
from ..functions.text import as_col, blank_to_null, digits, squash, text
from ..sources.readers import canonical_json
from .rows import first_items, require_empty, top_per_key, unfold

BULK_SOURCE = "https://data.brreg.no/enhetsregisteret/api/enheter/lastned/csv"
RULE_SOURCE = "https://www.brreg.no/en/submission-of-annual-accounts/"
REPORT_COPY = "https://data.brreg.no/regnskapsregisteret/regnskap/aarsregnskap/kopi/%s/%s"

# fixed values: registry column and its alternative spelling
REGISTRY_ALIASES = {
    "organisation_number": ("organisasjonsnummer", "Organisasjonsnummer"),
    "name": ("navn", "Navn"),
    "legal_form": ("organisasjonsform.kode", "Organisasjonsform.kode"),
    "employees": ("antallAnsatte", "Antall ansatte"),
    "bankrupt": ("konkurs", "Konkurs"),
    "liquidating": ("underAvvikling", "Under avvikling"),
    "municipality": ("forretningsadresse.kommune", "Forretningsadresse.kommune"),
    "municipality_number": ("forretningsadresse.kommunenummer", "Forretningsadresse.kommunenummer"),
    "industry_code": ("naeringskode1.kode", "Næringskode1.kode"),
    "industry_label": ("naeringskode1.beskrivelse", "Næringskode1.beskrivelse"),
    "website": ("hjemmeside", "Hjemmeside"),
    "latest_submitted_accounts": ("sisteInnsendteAarsregnskap", "Siste innsendte årsregnskap"),
}


def raw_col(df: DataFrame, name: str) -> Column:
    """A source column by its dotted name; NULL if the extract lacks it."""
    return F.col(f"`{name}`").cast("string") if name in df.columns else F.lit(None).cast("string")


def first_filled(*columns: Column | str) -> Column:
    """First value that is neither NULL nor empty, else empty."""
    return F.coalesce(*[F.nullif(as_col(c).cast("string"), F.lit("")) for c in columns], F.lit(""))


def normalise_registry(df: DataFrame) -> DataFrame:
    """Twelve typed registry columns. A count that is no integer is NULL, never zero."""
    pick = {out: first_filled(*[raw_col(df, n) for n in names]) for out, names in REGISTRY_ALIASES.items()}
    pick["employees"] = F.when(pick["employees"].rlike(r"^\s*[+\-]?[0-9]+\s*$"), pick["employees"].try_cast("int"))
    for flag in ("bankrupt", "liquidating"):
        pick[flag] = F.lower(pick[flag]) == "true"
    return df.select(*[c.alias(out) for out, c in pick.items()])


def evidence(field: Column | str, status: Column, source_type: Column | str, source_url: Column, retrieved_at: Column, **extra: Column) -> Column:
    """Evidence envelope; the source class is the source type, the time is the run's own."""
    none = F.lit(None).cast("string")
    field = F.lit(field) if isinstance(field, str) else field
    source_type = F.lit(source_type) if isinstance(source_type, str) else source_type
    return F.struct(
        field.alias("field"),
        status.alias("status"),
        source_type.alias("source_type"),
        source_type.alias("source_class"),
        source_url.alias("source_url"),
        retrieved_at.alias("retrieved_at"),
        *[
            extra.get(name, none).alias(name)
            for name in ("value", "as_of", "note", "content_sha256", "source_row_key", "effective_at")
        ],
    )


def http_status(code: Column | str) -> Column:
    c = as_col(code)
    return F.when(c == 200, "available").when(c.isin(404, 410), "not_found").otherwise("source_error")


_MONEY = "DECIMAL(20,2)"
FINANCIAL_BODY = (
    "ARRAY<STRUCT<id: STRING, regnskapstype: STRING, valuta: STRING,"
    " regnskapsperiode: STRUCT<fraDato: STRING, tilDato: STRING>,"
    f" resultatregnskapResultat: STRUCT<ordinaertResultatFoerSkattekostnad: {_MONEY}, aarsresultat: {_MONEY},"
    f" driftsresultat: STRUCT<driftsresultat: {_MONEY}, driftsinntekter: STRUCT<sumDriftsinntekter: {_MONEY}>>>,"
    f" eiendeler: STRUCT<sumEiendeler: {_MONEY}>,"
    f" egenkapitalGjeld: STRUCT<egenkapital: STRUCT<sumEgenkapital: {_MONEY}>, gjeldOversikt: STRUCT<sumGjeld: {_MONEY}>>>>"
)


def financial_records(body: Column | str, k: int | None = None) -> Column:
    """The filed records (the first k). Zero stays zero, an absent figure is NULL."""
    items = first_items(F.from_json(body, FINANCIAL_BODY), k)

    def record(r: Column) -> Column:
        result = r["resultatregnskapResultat"]
        return F.struct(
            r["id"].alias("record_id"),
            r["regnskapstype"].alias("account_type"),
            r["regnskapsperiode"].alias("period"),
            r["valuta"].alias("currency"),
            result["driftsresultat"]["driftsinntekter"]["sumDriftsinntekter"].alias("revenue"),
            result["driftsresultat"]["driftsresultat"].alias("operating_result"),
            result["ordinaertResultatFoerSkattekostnad"].alias("profit_before_tax"),
            result["aarsresultat"].alias("annual_result"),
            r["eiendeler"]["sumEiendeler"].alias("assets"),
            r["egenkapitalGjeld"]["egenkapital"]["sumEgenkapital"].alias("equity"),
            r["egenkapitalGjeld"]["gjeldOversikt"]["sumGjeld"].alias("debt"),
        )

    return F.coalesce(F.transform(items, record), F.array().cast("array<struct<record_id:string,account_type:string,period:struct<fraDato:string,tilDato:string>,currency:string,revenue:decimal(20,2),operating_result:decimal(20,2),profit_before_tax:decimal(20,2),annual_result:decimal(20,2),assets:decimal(20,2),equity:decimal(20,2),debt:decimal(20,2)>>"))


def filing_years(years: Column | str) -> Column:
    """Distinct all-digit years, ascending."""
    text_years = F.transform(as_col(years), lambda y: y.cast("string"))
    return F.array_sort(F.array_distinct(F.filter(text_years, lambda y: F.coalesce(y.rlike("^[0-9]+$"), F.lit(False)))))


def filing_copies(years: Column | str, org: Column | str) -> Column:
    """Report copies, newest first."""
    return F.transform(
        F.reverse(as_col(years)),
        lambda y: F.struct(y.alias("year"), F.format_string(REPORT_COPY, as_col(org), y).alias("url")),
    )


ROLES_BODY = (
    "STRUCT<rollegrupper: ARRAY<STRUCT<sistEndret: STRING, type: STRUCT<kode: STRING, beskrivelse: STRING>,"
    " roller: ARRAY<STRUCT<type: STRUCT<kode: STRING, beskrivelse: STRING>, avregistrert: BOOLEAN,"
    " person: STRUCT<navn: STRUCT<fornavn: STRING, mellomnavn: STRING, etternavn: STRING>>,"
    " enhet: STRUCT<navn: STRING, organisasjonsnummer: STRING>>>>>>"
)


def roles(body: Column | str) -> Column:
    """Role holders of all groups as one list. Birth dates are not part of the schema and never read."""
    groups = F.from_json(body, ROLES_BODY)["rollegrupper"]

    def holder(group: Column, item: Column) -> Column:
        name = item["person"]["navn"]
        person = F.concat_ws(" ", *[F.nullif(name[p], F.lit("")) for p in ("fornavn", "mellomnavn", "etternavn")])
        return F.struct(
            F.coalesce(F.nullif(person, F.lit("")), F.nullif(item["enhet"]["navn"], F.lit(""))).alias("name"),
            item["enhet"]["organisasjonsnummer"].alias("organisation_number"),
            item["type"]["kode"].alias("role_code"),
            item["type"]["beskrivelse"].alias("role"),
            group["type"]["kode"].alias("group_code"),
            group["type"]["beskrivelse"].alias("group"),
            group["sistEndret"].alias("last_changed"),
            F.coalesce(item["avregistrert"], F.lit(False)).alias("inactive"),
        )

    return F.flatten(F.transform(groups, lambda g: F.transform(g["roller"], lambda r: holder(g, r))))


_ADDRESS = "STRUCT<adresse: ARRAY<STRING>, postnummer: STRING, poststed: STRING, kommune: STRING, land: STRING>"
_INDUSTRY = "STRUCT<kode: STRING, beskrivelse: STRING>"
LOCATIONS_BODY = (
    "STRUCT<_embedded: STRUCT<underenheter: ARRAY<STRUCT<organisasjonsnummer: STRING, navn: STRING,"
    f" beliggenhetsadresse: {_ADDRESS}, postadresse: {_ADDRESS}, naeringskode1: {_INDUSTRY}, antallAnsatte: INT>>>>"
)


def locations(body: Column | str) -> Column:
    """Workplaces; the postal address stands in for a missing street address."""
    units = F.from_json(body, LOCATIONS_BODY)["_embedded"]["underenheter"]
    return F.transform(
        units,
        lambda u: F.struct(
            u["organisasjonsnummer"].alias("organisation_number"),
            u["navn"].alias("name"),
            F.coalesce(u["beliggenhetsadresse"], u["postadresse"]).alias("address"),
            u["naeringskode1"].alias("industry"),
            u["antallAnsatte"].alias("employees"),
        ),
    )


ENTITY_BODY = (
    "STRUCT<organisasjonsnummer: STRING, navn: STRING, organisasjonsform: STRUCT<kode: STRING>, antallAnsatte: INT,"
    " konkurs: BOOLEAN, underAvvikling: BOOLEAN, hjemmeside: STRING,"
    f" naeringskode1: {_INDUSTRY}, forretningsadresse: {_ADDRESS}, postadresse: {_ADDRESS}, sisteInnsendteAarsregnskap: STRING>"
)


def live_entity(body: Column | str) -> Column:
    e = F.from_json(body, ENTITY_BODY)
    return F.struct(
        e["organisasjonsnummer"].alias("organisation_number"),
        e["navn"].alias("name"),
        e["organisasjonsform"]["kode"].alias("legal_form"),
        e["antallAnsatte"].alias("employees"),
        e["konkurs"].alias("bankrupt"),
        e["underAvvikling"].alias("liquidating"),
        e["hjemmeside"].alias("website"),
        e["naeringskode1"].alias("industry"),
        e["forretningsadresse"].alias("business_address"),
        e["postadresse"].alias("postal_address"),
        e["sisteInnsendteAarsregnskap"].alias("latest_submitted_accounts"),
    )


def obligation_class(legal_form: Column | str, latest: Column | str) -> Column:
    """How far the open registry row decides the duty to file accounts."""
    form = F.upper(text(legal_form))
    return (
        F.when(text(latest) != "", "filing_observed")
        .when(form.isin(*K.FORMS_ALWAYS_OBLIGED), "required_by_legal_form")
        .when(form.isin(*K.FORMS_CONDITIONAL), "threshold_or_activity_dependent")
        .otherwise("special_rule_or_review_required")
    )


def address(df: DataFrame, prefix: str) -> Column:
    """Street, post code and place, country; absent parts leave no separator."""
    part = lambda name: blank_to_null(raw_col(df, f"{prefix}.{name}"))
    town = F.nullif(F.concat_ws(" ", part("postnummer"), part("poststed")), F.lit(""))
    return F.nullif(F.concat_ws(", ", part("adresse"), town, part("land")), F.lit(""))


def _json_text(value: Column) -> Column:
    """A string claim value as JSON text. Most need quotes only."""
    quoted = F.to_json(F.array(value))
    escaped = F.substring(quoted, 2, F.length(quoted) - 2)
    return F.when(value.rlike(r'["\\\x00-\x1f\x7f]'), escaped).otherwise(F.concat(F.lit('"'), value, F.lit('"')))


def registry_claims(df: DataFrame, source_url: str = BULK_SOURCE) -> DataFrame:
    """Long table of registry claims; ``value`` is JSON text.

    ``df`` is a registry extract with its own column names, optionally with ``status``,
    ``retrieved_at`` and ``content_sha256`` of the extract. Blank fields give no claim, and of
    two sources of one field the named one wins. The rows leave in one pass without a shuffle:
    precedence is settled inside each row.
    """
    raw = lambda name: blank_to_null(raw_col(df, name))
    true_flag = lambda name: F.when(F.lower(raw(name)) == "true", F.lit("true"))
    org = first_filled(*[raw_col(df, n) for n in REGISTRY_ALIASES["organisation_number"]])
    none = F.lit(None).cast("string")
    staff, capital = raw("antallAnsatte"), raw("kapital.belop")
    share_capital = F.to_json(
        F.struct(capital.alias("amount"), F.coalesce(raw("kapital.valuta"), F.lit("NOK")).alias("currency"))
    )
    named: list[tuple[str, Column, Column]] = [
        ("legal_name", _json_text(raw("navn")), none),
        ("legal_form", _json_text(raw("organisasjonsform.beskrivelse")), none),
        ("industry", _json_text(raw("naeringskode1.beskrivelse")), none),
        ("institutional_sector", _json_text(raw("institusjonellSektorkode.beskrivelse")), none),
        ("statutory_purpose", _json_text(raw("vedtektsfestetFormaal")), none),
        ("business_address", _json_text(address(df, "forretningsadresse")), none),
        ("postal_address", _json_text(address(df, "postadresse")), none),
        ("founding_date", _json_text(raw("stiftelsesdato")), none),
        ("registered_at", _json_text(raw("registreringsdatoenhetsregisteret")), none),
        ("share_capital", F.when(capital.isNotNull(), share_capital), none),
        ("email", _json_text(raw("epostadresse")), none),
        ("phone", _json_text(F.coalesce(raw("telefon"), raw("mobil"))), none),
        ("website_registered", _json_text(raw("hjemmeside")), none),
        ("employees_registered", _json_text(F.when(staff.rlike("^[0-9]+$"), staff)), none),
        ("vat_registered", true_flag("registrertIMvaRegisteret"), raw("registreringsdatoMerverdiavgiftsregisteret")),
        ("in_group", true_flag("erIKonsern"), none),
        ("parent_entity", _json_text(raw("overordnetEnhet")), none),
        ("bankrupt", true_flag("konkurs"), none),
        ("under_liquidation", true_flag("underAvvikling"), none),
    ]
    settled = {name: value for name, value, _ in named}
    for source, name in K.REGISTRY_EXTRA_CLAIMS:
        v = raw(source)
        parsed = F.when(F.lower(v).isin("true", "false"), F.lower(v)).otherwise(_json_text(v))
        if name in settled:
            named = [(n, F.coalesce(c, parsed) if n == name else c, p) for n, c, p in named]
        else:
            settled[name] = parsed
            named.append((name, parsed, none))
    named.sort(key=lambda item: item[0])
    has = lambda name: F.col(name) if name in df.columns else none
    rows = F.array(*[F.struct(F.lit(n).alias("field"), c.alias("value"), p.alias("reporting_period")) for n, c, p in named])
    base = df.where(F.col("status") == "available") if "status" in df.columns else df
    keep = [
        org.alias("organisation_number"), F.lit(source_url).alias("source_url"), has("retrieved_at").alias("retrieved_at"),
        has("content_sha256").alias("content_sha256"),
    ]
    return unfold(base, keep, rows, "c").where("c.value IS NOT NULL").select("organisation_number", "c.field", "c.value", "c.reporting_period", F.lit("available").alias("availability"), "source_url", "retrieved_at", "content_sha256")


def coverage_flags(profiles: DataFrame, obs: DataFrame) -> DataFrame:
    """Per entity: accounts, verified site, observations, activity signals.

    ``profiles`` has financials_status, website_status and website_publishable.
    """
    active = F.col("signal_type").isin("job_posting", "public_post", "review", "review_summary")
    counts = obs.groupBy("organisation_number").agg(
        F.count("*").alias("external"), F.count_if(F.coalesce(active, F.lit(False))).alias("signals")
    )
    return profiles.join(counts, "organisation_number", "left").select(
        "organisation_number",
        F.col("financials_status").eqNullSafe("available").alias("financials"),
        verified_site().alias("website"),
        F.coalesce("external", F.lit(0)).alias("external"),
        F.coalesce("signals", F.lit(0)).alias("signals"),
    )


def verified_site() -> Column:
    return F.col("website_status").eqNullSafe("available") & F.coalesce(F.col("website_publishable"), F.lit(False))


def coverage_tier() -> Column:
    return (
        F.when(verified_site(), "website")
        .when(F.col("financials_status").eqNullSafe("available"), "financials")
        .otherwise("basic")
    )


def availability(status: Column | str) -> Column:
    """Six-value availability of an evidence status; unknown means not available."""
    pairs = [F.lit(x) for pair in K.AVAILABILITY.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), text(status)), F.lit("not_available"))


OVERLAY_COLUMNS = ("name", "legal_form", "employees", "website", "latest_submitted_accounts")


def overlay_live(profiles: DataFrame, live: DataFrame) -> DataFrame:
    """Profiles with the registry's live values laid over five columns.

    ``live`` has organisation_number, status, ``present`` (names of fields the body held) and the
    values; a field the body lacks keeps the old value, one it holds as null becomes null.
    """
    ok = F.col("l.status").eqNullSafe("available")
    out = [
        F.when(ok & F.array_contains("l.present", c), F.col(f"l.{c}")).otherwise(F.col(f"p.{c}")).alias(c)
        if c in OVERLAY_COLUMNS
        else F.col(f"p.{c}")
        for c in profiles.columns
    ]
    joined = profiles.alias("p").join(live.alias("l"), F.col("p.organisation_number") == F.col("l.organisation_number"), "left")
    return joined.select(*out)


def fold_bindings(bindings: DataFrame, order: str = "seq") -> DataFrame:
    """Knowledge-base result rows folded to one row per organisation, first filled value each."""

    def first(name: str) -> Column:
        filled = F.col(name).isNotNull() & (F.col(name) != "")
        return F.min_by(F.when(filled, F.col(name)), F.when(filled, F.col(order))).alias(name)

    fields = [c for c in bindings.columns if c not in ("organisation_number", order)]
    return bindings.where(text("organisation_number") != "").groupBy("organisation_number").agg(*[first(c) for c in fields])


FEED_ENTRY = (
    "STRUCT<id: STRING, url: STRING, title: STRING, date_modified: STRING, _feed_entry: STRUCT<uuid: STRING,"
    " status: STRING, title: STRING, businessName: STRING, orgnr: STRING, published: STRING, publishedByAdmin: STRING,"
    " updated: STRING, sistEndret: STRING, municipal: STRING, employer: STRUCT<name: STRING, orgnr: STRING>,"
    " workLocations: ARRAY<STRUCT<municipal: STRING, city: STRING>>, locationList: ARRAY<STRUCT<municipal: STRING, city: STRING>>>>"
)


def parse_feed(entries: DataFrame, column: str = "entry") -> DataFrame:
    """Job-feed entries (JSON text) as job rows; ``active`` is false for what counts as a deletion.

    An entry is parsed once: filters on its fields stay above the explode, below which each field they name would
    parse it again. What is no JSON object, or has a key twice, gives a row without fields.
    """
    parsed = entries.withColumn("__v", F.explode_outer(F.array(F.try_parse_json(column))))
    at = lambda path: F.nullif(F.try_variant_get("__v", f"$.{path}", "string"), F.lit(""))
    d = lambda path: at(f"_feed_entry.{path}")
    first = lambda name, field: d(f"{name}[0].{field}")
    listed = F.try_variant_get("__v", "$._feed_entry.workLocations[0]", "variant").isNotNull()
    town = F.when(listed, F.coalesce(first("workLocations", "municipal"), first("workLocations", "city"))).otherwise(F.coalesce(first("locationList", "municipal"), first("locationList", "city")))
    orgnr = digits(F.coalesce(d("employer.orgnr"), d("orgnr")))
    return parsed.select(
        *[c for c in entries.columns if c != column],
        F.coalesce(at("id"), d("uuid")).alias("job_id"),
        ((F.upper(text(d("status"))) == "ACTIVE") & (F.length(orgnr) == 9)).alias("active"),
        orgnr.alias("organisation_number"),
        F.coalesce(d("employer.name"), d("businessName")).alias("employer_name"),
        F.coalesce(d("title"), at("title")).alias("title"),
        F.coalesce(at("url"), F.concat(F.lit("/api/v1/feedentry/"), d("uuid"))).alias("url"),
        F.coalesce(d("published"), d("publishedByAdmin")).alias("published"),
        F.coalesce(d("updated"), d("sistEndret"), at("date_modified")).alias("updated"),
        F.coalesce(town, d("municipal")).alias("municipal"),
        F.sha2(F.to_json(F.try_variant_get("__v", "$._feed_entry", "variant")), 256).alias("content_sha256"),
    )


DETAIL_BODY = (
    "STRUCT<status: STRING, sistEndret: STRING, ad_content: STRUCT<uuid: STRING, title: STRING, published: STRING,"
    " updated: STRING, workLocations: ARRAY<STRUCT<municipal: STRING, city: STRING>>,"
    " employer: STRUCT<name: STRING, orgnr: STRING, homepage: STRING>>>"
)


def feed_from_details(details: DataFrame) -> DataFrame:
    """Search details (JSON ``detail`` plus the search stub) as feed rows of active, org-bound ads."""
    d = F.from_json("detail", DETAIL_BODY)
    row = details.withColumn("__d", d).withColumn("__org", digits(F.col("__d.ad_content.employer.orgnr")))
    ad = F.col("__d.ad_content")
    uuid = F.coalesce(ad["uuid"], F.col("stub_uuid"))
    return row.where((F.upper(text(F.col("__d.status"))) == "ACTIVE") & (F.length("__org") == 9)).select(
        "seq",
        uuid.alias("job_id"),
        F.col("__org").alias("organisation_number"),
        F.coalesce(ad["title"], F.col("stub_title")).alias("title"),
        F.coalesce(ad["employer"]["name"], F.col("stub_business")).alias("employer_name"),
        ad["published"].alias("published"),
        F.coalesce(ad["updated"], F.col("__d.sistEndret")).alias("updated"),
        F.concat(F.lit("/api/v1/feedentry/"), uuid).alias("url"),
        blank_to_null(ad["employer"]["homepage"]).alias("homepage"),
    )


def first_homepages(feed: DataFrame) -> DataFrame:
    """First stated home page of each employer."""
    return (
        feed.where("homepage IS NOT NULL").groupBy("organisation_number").agg(F.min_by("homepage", "seq").alias("homepage"))
    )


def search_query_text(name: Column | str, org: Column | str, municipality: Column | str) -> Column:
    """Search text of an entity; name and number are required."""
    n, o, m = squash(name), digits(org), squash(municipality)
    query = F.concat(F.lit('"'), n, F.lit('" '), o, F.when(m != "", F.concat(F.lit(" "), m)).otherwise(F.lit("")))
    missing = F.raise_error(F.lit("search needs a legal name and an organisation number")).cast("string")
    return F.when((n == "") | (o == ""), missing).otherwise(query)


SEARCH_BODY = "STRUCT<web: STRUCT<results: ARRAY<STRUCT<url: STRING, title: STRING, description: STRING>>>>"


def search_results(pages: DataFrame, provider: str = "web_search") -> DataFrame:
    """Ranked results of stored search bodies; the rank counts results without a URL too."""
    body = F.from_json("body", SEARCH_BODY)["web"]["results"]
    keep = [c for c in pages.columns if c != "body"]
    return (
        pages.select(*keep, F.posexplode(body).alias("pos", "r"))
        .where(text("r.url") != "")
        .select(
            *keep, F.col("r.url").alias("url"), text("r.title").alias("title"), text("r.description").alias("snippet"),
            (F.col("pos") + 1).alias("rank"), F.lit(provider).alias("provider"),
        )
    )


def fill_budget_exhausted(profiles: DataFrame, have: DataFrame, modules: Sequence[str], note: str) -> DataFrame:
    """A source_error record for each requested module an entity has no record of."""
    wanted = profiles.select("organisation_number", F.explode(F.array(*[F.lit(m) for m in modules])).alias("module"))
    return wanted.join(have.select("organisation_number", "module"), ["organisation_number", "module"], "left_anti").select(
        "organisation_number", "module", F.lit("source_error").alias("status"), F.lit(f"budget_exhausted: {note}").alias("note"),
    )


def entity_card(profiles: DataFrame, obs: DataFrame) -> DataFrame:
    """Compact view of each entity: registry facts, latest network profile and counts by kind.

    Observations are reduced to one row per entity first; the newest posts and jobs of the card
    come from ``card_items``.
    """
    on_network = (F.col("platform") == "linkedin") & F.col("exact_entity")
    kind = lambda s: on_network & (F.col("signal_type") == s)
    seen = F.struct("retrieved_at", "id")
    facts = obs.groupBy("organisation_number").agg(
        F.count_if(F.coalesce(kind("profile_metrics"), F.lit(False))).alias("network_profiles"),
        F.max_by(F.when(kind("profile_metrics"), F.col("source_url")), F.when(kind("profile_metrics"), seen)).alias("network_profile_url"),
        F.max_by(F.when(kind("workforce_snapshot"), F.col("source_url")), F.when(kind("workforce_snapshot"), seen)).alias("network_workforce_url"),
        F.count_if(F.coalesce(kind("public_post"), F.lit(False))).alias("network_posts"),
        F.count_if(F.coalesce(kind("job_posting"), F.lit(False))).alias("network_jobs"),
        F.count_distinct(
            F.when((F.col("signal_type") == "profile_handle") & F.col("exact_entity") & (text("source_url") != ""), F.struct("platform", "source_url"))
        ).alias("verified_handles"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return profiles.join(facts, "organisation_number", "left").select(
        F.col("organisation_number").alias("org"), "name", F.col("legal_form").alias("form"), "employees", "municipality",
        F.col("industry_code").alias("industry_code"), F.col("industry_label").alias("industry"), "website",
        (F.col("bankrupt") | F.col("liquidating")).alias("adverse"),
        (F.coalesce("network_profiles", F.lit(0)) > 0).alias("network_available"),
        "network_profile_url", "network_workforce_url", zero("network_posts"), zero("network_jobs"), zero("verified_handles"),
    )


def card_items(obs: DataFrame, signal: str, items: int | None = None) -> DataFrame:
    """Posts or jobs of each entity's network page, as the card lists them."""
    chosen = obs.where((F.col("platform") == "linkedin") & (F.col("signal_type") == signal) & F.col("exact_entity"))
    return top_per_key(chosen, ["organisation_number"], ["retrieved_at", "id"], items, "position")


def check_known(orgs: DataFrame, profiles: DataFrame, message: str) -> None:
    require_empty(orgs.join(profiles.select("organisation_number"), "organisation_number", "left_anti"), message, "organisation_number")
