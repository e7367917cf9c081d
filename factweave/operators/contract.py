"""Output contract: terminal states, envelopes, claims with evidence references, and summaries.

Claims and evidence references are two long tables. Nesting them per entity is left to whoever
exports a document, so an entity with many observations never becomes one huge row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


from ..functions.text import as_col, period_label, text
from ..session import written
from . import footprint as P, gates as G, normalise as N
from .blocks import number_rows
from .rows import any_of, first_per_key, unfold, union_all

ORG = "organisation_number"


def terminal_state(status: Column | str, note: Column | str) -> Column:
    """Terminal state of an evidence record; no record at all is a submission error."""
    s, n = as_col(status), F.lower(text(note))
    return (
        F.when(n.contains("budget_exhausted"), "budget_exhausted")
        .when(s == "available", "complete")
        .when(s.isin("not_applicable", "not_found", "source_error"), s)
        .when(s == "blocked", F.when(n.contains("robot"), "blocked_robots").otherwise("blocked_policy"))
        .otherwise("submission_error")
    )


def envelopes(profiles: DataFrame, evidence: DataFrame, modules: Sequence[str], run_id: str, started_at: str, completed_at: str) -> DataFrame:
    """One envelope per entity with the terminal state of each module.

    ``evidence``: organisation_number, module, status, note, retry_count, retrieved_at. One record per
    module is kept, so the map of an entity has as many entries as there are modules.
    """
    record = evidence.where(F.col("module").isin(*modules)).groupBy(ORG, "module").agg(
        F.max_by(F.struct("status", "note", "retry_count", "retrieved_at"), text("retrieved_at")).alias("e")
    )
    wanted = profiles.select(ORG, F.explode(F.array(*[F.lit(m) for m in modules])).alias("module"))
    state = terminal_state("e.status", "e.note")
    rows = wanted.join(record, [ORG, "module"], "left").select(
        ORG, "module",
        F.struct(
            F.when(F.col("e").isNull(), "submission_error").otherwise(state).alias("state"),
            F.coalesce(F.col("e.retry_count"), F.lit(0)).alias("retry_count"),
            F.coalesce(F.col("e.retrieved_at"), F.lit(completed_at)).alias("final_timestamp"),
        ).alias("s"),
    )
    return rows.groupBy(ORG).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("module", "s")))).alias("modules"),
        F.when(F.max(F.col("s.state") == "submission_error"), "submission_error").otherwise("complete").alias("state"),
    ).select(F.lit(run_id).alias("run_id"), ORG, "state", F.lit(started_at).alias("started_at"), F.lit(completed_at).alias("completed_at"), "modules")


# ---- claims ----------------------------------------------------------------------------
# fixed values: families in contract order and the id prefix of their evidence
FAMILIES = {
    "registry": ("ev-registry", "Official Brønnøysund registry record"),
    "financials": ("ev-fin", "Official annual accounts (Regnskapsregisteret)"),
    "roles": ("ev-role", "Official roles"),
    "locations": ("ev-loc", "Official locations"),
    "financial_history": ("ev-fh", "Filed annual-account years"),
    "website": ("ev-web", None),
}
_ORDER = {name: i for i, name in enumerate(FAMILIES)}
#: Place of the claim that a website is proven to be the entity's, and the places (as a power of two) that a block of the numbering covers.
_PROVEN, _BLOCK_BITS = 50, 12


def _row(family: str, sub: Column, field: Column, value: Column, availability: Column, confidence: Column, span: Column, period: Column, kind: str, needs: str | None = None, part: Column | None = None) -> Column:
    text_ = lambda c: (F.lit(None) if c is None else c).cast("string")
    return F.struct(
        F.lit(_ORDER[family]).alias("family"), sub.cast("int").alias("sub"), field.alias("field"), text_(value).alias("value"),
        availability.alias("availability"), confidence.cast("double").alias("confidence"), text_(span).alias("span"),
        text_(period).alias("reporting_period"), F.lit(kind).alias("kind"), F.lit(needs).cast("string").alias("needs"), text_(part).alias("part"),
    )


def _fact(family: str, sub: Column, field: Column | str, value: Column, span: Column, confidence: float = 0.97, period: Column | None = None, **more) -> Column:
    f = F.lit(field) if isinstance(field, str) else field
    return _row(family, sub, f, value, F.lit("available"), F.lit(confidence), span, period, "fact", **more)


def _shared(family: str, field: str, value: Column, availability: Column, confidence: Column | float, sub: int = 0, needs: str | None = None) -> Column:
    c = F.lit(confidence) if isinstance(confidence, float) else confidence
    return _row(family, F.lit(sub), F.lit(field), value, availability, c, None, None, "shared", needs)


def _sub(at: Column, i: int = 0) -> Column:
    """Order key inside a family: list position first, then the place of the field."""
    return (at * 16 + i + 100).cast("int")


def _rows(
    profiles: DataFrame, registry: DataFrame | None, records: DataFrame | None, roles: DataFrame | None, locations: DataFrame | None,
    years: DataFrame | None, site_items: DataFrame | None, socials: DataFrame | None,
) -> DataFrame:
    """All rows that may become claims, each from its own table; ``needs`` says on what of its entity a row depends."""
    parts: list[DataFrame] = []
    add = lambda df, column: parts.append(df.select(ORG, column.alias("c")).select(ORG, "c.*"))
    many = lambda df, items: parts.append(unfold(df, [ORG], F.array(*items), "c").select(ORG, "c.*"))
    quote = lambda *bits: F.concat(*[F.lit(b) if isinstance(b, str) else F.coalesce(b.cast("string"), F.lit("None")) for b in bits])
    only = lambda on, row: F.when(on, row)

    if registry is not None:
        span = quote('"', F.col("field"), '": ', F.col("value"))
        add(registry, _fact("registry", F.lit(100), F.col("field"), F.col("value"), span, period=F.col("reporting_period")))
    if records is not None:
        fields = [f for f in ("revenue", "operating_result", "annual_result", "assets", "equity", "debt") if f in records.columns]
        stated = [
            only(F.col(f).isNotNull(), _fact("financials", _sub(F.col("seq"), i), f"financials.{f}", F.col(f), quote(F.col("period"), f" {f}: ", F.col(f)), period=F.col("period")))
            for i, f in enumerate(fields)
        ]
        none = F.lit(None)
        many(records, [*stated, only(F.coalesce(*[F.col(f) for f in fields]).isNull(), _row("financials", F.lit(0), none, none, none, none, none, none, "mark"))])
    if roles is not None:
        few = roles.where(~F.col("inactive"))
        who = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("holder_number") if "holder_number" in roles.columns else F.lit(None))
        code = F.lower(F.coalesce(F.nullif(F.col("role_code"), F.lit("")), F.lit("role")))
        listed = few.groupBy(ORG).agg(F.to_json(F.array_sort(F.collect_list(F.struct("seq", who.alias("name"), "role")))).alias("list"))  # the roles one entity states in one claim
        add(listed, _shared("roles", "roles", F.col("list"), F.lit("available"), 0.97, 50))
        add(few.where(who.isNotNull()), _fact("roles", _sub(F.col("seq")), F.concat(F.lit("role."), code), who, quote(who, " — ", F.coalesce(F.col("role"), code)), period=F.col("last_changed")))
    if locations is not None:
        listed = locations.groupBy(ORG).agg(F.to_json(F.array_sort(F.collect_list(F.struct("seq", "name", "address")))).alias("list"))  # the places one entity states in one claim
        add(listed, _shared("locations", "locations", F.col("list"), F.lit("available"), 0.97, 50))
        place = F.regexp_replace(F.concat(text("name"), F.lit(" — "), text("address")), "^[ —]+|[ —]+$", "")
        add(locations.where(text("name") != ""), _fact("locations", _sub(F.col("seq")), "location", F.to_json(F.struct("name", "address")), place))
    if years is not None:
        one = years.select(ORG, F.col("year").cast("string").alias("year")).distinct()
        listed = one.groupBy(ORG).agg(F.array_join(F.array_sort(F.collect_list("year")), ",").alias("list"))  # bounded by the calendar
        add(listed, _shared("financial_history", "financial_history.years", F.col("list"), F.lit("available"), 0.97, 50))
        add(one, _fact("financial_history", _sub(F.col("year").try_cast("int")), "financial_history.year", F.col("year"), quote("Filed year ", F.col("year")), period=F.col("year")))

    # what the profile alone says: a reference ahead of each recorded module's facts, modules recorded without facts, the website
    recorded = [m for m in FAMILIES if f"{m}_status" in profiles.columns]
    none = F.lit(None)
    said = [only(F.col(f"{m}_status").isNotNull(), _row(m, F.lit(0), none, none, none, none, none, none, "head")) for m in recorded]
    said += [only(F.col(f"{m}_status").isNotNull(), _shared(m, m, none, N.availability(f"{m}_status"), 0.5, 60, f"no {m}")) for m in ("financials", "roles", "locations") if m in recorded]
    if "website_status" in profiles.columns:
        status, pub = F.col("website_status"), F.coalesce(F.col("website_publishable"), F.lit(False))
        seen = status.eqNullSafe("available")
        site = F.nullif(F.trim(text("registry_site")), F.lit(""))
        url, score = F.col("website_url"), F.coalesce(F.col("website_score"), F.lit(0.95))
        described = F.col("website_description") if "website_description" in profiles.columns else F.lit("")
        said += [
            only(seen & pub, _shared("website", "official_website", url, F.lit("available"), score, _PROVEN)),
            only(seen & pub & (text(described) != ""), _fact("website", F.lit(70), "website_description", described, described, 0.9)),
            only(~(seen & pub) & site.isNotNull(), _shared("website", "official_website", site, F.lit("available"), 0.9, 51)),
            only(~pub & seen & site.isNotNull(), _shared("website", "official_website_crawl_unverified", url, F.lit("ambiguous"), 0.5, 52)),
            only(~pub & seen & site.isNull(), _shared("website", "official_website", url, F.lit("ambiguous"), 0.5, 53)),
            only(~seen & status.isNotNull() & site.isNull(), _shared("website", "official_website", none, N.availability(status), 0.5, 54)),
        ]
        if site_items is not None:
            # any kind beside these lists is a fact the site states once
            lists = {"job_posting": "job_posting", "careers_page": "job_posting", "news": "news"}
            own = site_items.where(F.col("kind").isin(*lists))
            place = F.array_position(F.array(*[F.lit(k) for k in lists]), F.col("kind"))
            field = F.element_at(F.create_map(*[F.lit(x) for pair in lists.items() for x in pair]), F.col("kind"))
            add(own, _fact("website", F.col("seq") + 10_000_000 * place, field, F.col("value"), F.col("quote"), 0.9, needs="proven"))
            stated = first_per_key(site_items.where(~F.col("kind").isin(*lists)), [ORG, "kind"], ["seq"])
            add(stated, _fact("website", F.lit(90_000_000), F.concat(F.lit("website."), "kind"), F.col("value"), F.col("quote"), 0.9, needs="proven"))
    if said:
        many(profiles, said)
    if socials is not None:
        linked = socials.where((text("platform") != "") & (text("url") != ""))
        part = F.concat(F.col("platform"), F.lit("\0"), F.substring("url", 1, 32))  # places by platform and address, in parts of these
        add(linked, _fact("website", F.lit(100_000_000), F.concat(F.lit("social."), "platform"), F.col("url"), quote(F.col("platform"), ": ", F.col("url")), 0.9, part=part))
    return union_all(*parts)


def ledger(
    profiles: DataFrame, registry: DataFrame | None = None, records: DataFrame | None = None, roles: DataFrame | None = None,
    locations: DataFrame | None = None, years: DataFrame | None = None, site_items: DataFrame | None = None, socials: DataFrame | None = None,
) -> DataFrame:
    """What an entity's contract consists of, a row each: kind (head, fact or shared), module, the claim's columns and evidence_id.

    A head is the reference to a recorded module, a fact is a claim with a reference of its own, a shared claim
    cites its module's. Heads and facts are numbered through the entity in the order of family, place, field and
    value: in blocks of places, each with the sizes of the blocks before it, so that one entity may span
    many tasks. The rows are written once and read twice: for the sizes of the blocks, from which also
    follows which rows of the entity are met, and for the numbers inside the blocks.

    ``profiles`` has a status column per module (registry_status, financials_status, roles_status,
    locations_status, financial_history_status, website_status; NULL if there is no record), and
    website_publishable, website_score, website_url, website_description, registry_site. The other
    tables are keyed by entity and, where they are lists, carry ``seq``:
    registry(field, value, reporting_period), records(period, revenue, ...), roles(name, role_code,
    role, last_changed, inactive), locations(name, address), years(year), site_items(kind, value,
    quote), socials(platform, url).
    """
    rows = written(_rows(profiles, registry, records, roles, locations, years, site_items, socials), "contract-rows")
    # rows by blocks of places; a place that is not known comes first in its family
    keys = [ORG, "family", "block", "part"]
    placed = rows.withColumn("block", F.coalesce(F.shiftright("sub", _BLOCK_BITS), F.lit(-(2**20)))).withColumn("part", F.coalesce("part", F.lit("")))
    free, own = F.col("needs").isNull(), F.col("kind").isin("head", "fact")
    counted = {"plain": (free & own).cast("int"), "if_proven": (F.col("needs").eqNullSafe("proven") & own).cast("int")}
    stated, proves = free & (F.col("kind") != "head"), (F.col("family") == _ORDER["website"]) & (F.col("sub") == _PROVEN)
    sizes = placed.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in counted.items()], F.max(stated).alias("stated"), F.max(stated & proves).alias("proves"))

    # one row a block: what of its entity lies before it, and what the entity has
    blocks = Window.partitionBy(ORG).orderBy("family", "block", "part")
    earlier, all_ = blocks.rowsBetween(Window.unboundedPreceding, -1), blocks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    has = {m: F.max(F.col("stated") & (F.col("family") == _ORDER[m])).over(all_) for m in ("financials", "roles", "locations")} | {"proven": F.max("proves").over(all_)}
    known = sizes.select(
        *keys, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_before") for n in counted], *[F.coalesce(c, F.lit(False)).alias(f"has_{m}") for m, c in has.items()]
    )
    within = Window.partitionBy(*keys).orderBy("sub", "field", "value").rowsBetween(Window.unboundedPreceding, 0)
    runs = placed.select("*", *[F.sum(c).over(within).alias(f"{n}_run") for n, c in counted.items()]).join(known, keys)
    met = any_of(free, (F.col("needs") == "proven") & F.col("has_proven"), *[(F.col("needs") == f"no {m}") & ~F.col(f"has_{m}") for m in ("financials", "roles", "locations")])
    numbered = runs.where(met & (F.col("kind") != "mark"))
    place = F.col("plain_before") + F.col("plain_run") + F.when(F.col("has_proven"), F.col("if_proven_before") + F.col("if_proven_run")).otherwise(0)

    module = F.element_at(F.array(*[F.lit(m) for m in FAMILIES]), F.col("family") + 1)
    prefix = F.element_at(F.array(*[F.lit(p) for p, _ in FAMILIES.values()]), F.col("family") + 1)
    # the registry's own website field cites the registry
    cited = F.when((F.col("family") == _ORDER["website"]) & (F.col("sub") == 51), F.lit("registry")).otherwise(module)
    number = F.concat(prefix, F.lit("-"), (place - 1).cast("string"))
    evidence_id = F.when(F.col("kind") == "fact", number).otherwise(F.concat(F.lit("ev-"), cited))
    return numbered.select(ORG, "kind", module.alias("module"), "field", "value", "availability", "confidence", evidence_id.alias("evidence_id"), "reporting_period", "span")


def ledger_claims(entries: DataFrame) -> DataFrame:
    """The claims of a ledger: field, value, availability, confidence, evidence id, period and quote."""
    return entries.where(F.col("kind") != "head").drop("kind", "module")


def claims(profiles: DataFrame, obs: DataFrame | None = None, **tables: DataFrame | None) -> DataFrame:
    """Claims of every entity, with those of observations if given. tables: as for ledger."""
    out = ledger_claims(ledger(profiles, **tables))
    return out if obs is None else out.unionByName(observation_claims(obs))


def _numbered(obs: DataFrame) -> DataFrame:
    return number_rows(obs.where(G.publishable()), [ORG], F.substring(text("retrieved_at"), 1, 10), ["retrieved_at", "id"])


def observation_claims(obs: DataFrame) -> DataFrame:
    """One claim per published observation, numbered in the entity's order of retrieval."""
    numbered = _numbered(obs)
    body = F.to_json("metrics") if "metrics" in obs.columns else F.lit(None).cast("string")
    return numbered.select(
        ORG, F.concat_ws(".", "platform", "signal_type").alias("field"), F.coalesce(F.nullif(body, F.lit("{}")), F.col("source_url")).alias("value"),
        F.lit("available").alias("availability"), F.lit(0.97).alias("confidence"), F.concat(F.lit("ev-obs-"), F.col("position").cast("string")).alias("evidence_id"),
        (F.col("effective_at") if "effective_at" in obs.columns else F.lit(None).cast("string")).alias("reporting_period"),
        F.nullif(text("evidence_span"), F.lit("")).alias("span"),
    )


_SOURCE = ("source_url", "source_class", "retrieved_at", "content_sha256")


def _sourced(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """rows (entity, module, ...) with the source of their module, from columns named module_column; what is absent is NULL.

    A profile is one row of all its modules in the join, and each row takes its own module's.
    """
    known = lambda m, c: (F.col(f"{m}_{c}") if f"{m}_{c}" in profiles.columns else F.lit(None)).cast("string").alias(c)
    every = profiles.select(F.col(ORG).alias("__of"), *[F.struct(*[known(m, c) for c in _SOURCE]).alias(f"__{m}") for m in FAMILIES])
    joined = rows.join(every, (F.col(ORG) == F.col("__of")) & F.col("module").isin(*FAMILIES), "left")
    said = lambda c: F.coalesce(*[F.when(F.col("module") == m, F.col(f"__{m}")[c]) for m in FAMILIES]).alias(c)
    return joined.select(*rows.columns, *[said(c) for c in _SOURCE])


def _observed(obs: DataFrame) -> DataFrame:
    return _numbered(obs).select(ORG, F.concat(F.lit("ev-obs-"), F.col("position").cast("string")).alias("evidence_id"), *_SOURCE, F.nullif(text("evidence_span"), F.lit("")).alias("span"))


def evidence(claimed: DataFrame, profiles: DataFrame, obs: DataFrame | None = None) -> DataFrame:
    """What the claims cite: evidence_id, source_url, source_class, retrieved_at, content_sha256 and quote.

    ``profiles`` has for each module its source_url, source_class, retrieved_at and content_sha256, named
    module_column; what is absent is NULL. Observations bring their own.
    """
    stems = {prefix: m for m, (prefix, _) in FAMILIES.items()} | {f"ev-{m}": m for m in FAMILIES}
    table = F.create_map(*[F.lit(x) for pair in stems.items() for x in pair])
    module = F.element_at(table, F.regexp_replace("evidence_id", "-[0-9]+$", ""))
    # most ids are cited once: the claims are dealt as they are, and sorted once for the last quote of an id
    dealt = claimed.where(~F.col("evidence_id").startswith("ev-obs-")).select(ORG, "evidence_id", "span").repartition(ORG, "evidence_id")
    cited = dealt.groupBy(ORG, "evidence_id").agg(F.max("span").alias("span"))
    out = _sourced(cited.withColumn("module", module), profiles).select(ORG, "evidence_id", *_SOURCE, "span")
    return out if obs is None else out.unionByName(_observed(obs))


def references(entries: DataFrame, profiles: DataFrame, obs: DataFrame | None = None) -> DataFrame:
    """The evidence there is, whatever the claims cite: a reference for each recorded module, each fact and each published observation."""
    own = entries.where(F.col("kind") != "shared").select(ORG, "module", "evidence_id", "span")
    out = _sourced(own, profiles).select(ORG, "evidence_id", *_SOURCE, "span")
    return out if obs is None else out.unionByName(_observed(obs))


def unresolved(claimed: DataFrame, entries: DataFrame) -> DataFrame:
    """Claims whose evidence is not in the table of evidence."""
    return claimed.join(entries.select(ORG, "evidence_id"), [ORG, "evidence_id"], "left_anti")


# ---- summaries -------------------------------------------------------------------------

def synthesis(profiles: DataFrame) -> DataFrame:
    """Template summary over verified facts: statements with their evidence field, and what is unknown.

    ``profiles``: name, legal_form, industry_label, municipality, bankrupt, liquidating; latest record as
    currency, revenue, operating_result, annual_result, period_start, period_end, has_record; lead_name,
    lead_role, active_roles; location_count; website_status, website_publishable, website_url,
    job_count, news_count, social_count; workforce_year, workforce_value, workforce_measure.
    """
    col, filled = F.col, lambda c: text(c) != ""
    say = lambda *bits: F.concat(*[F.lit(b) if isinstance(b, str) else b.cast("string") for b in bits])
    name = F.nullif(text("name"), F.lit(""))
    bits = F.array_compact(F.array(
        F.when(filled("legal_form"), say("a ", col("legal_form"), " company")),
        F.when(filled("industry_label") & (col("industry_label") != "Uoppgitt"), say("operating in ", F.lower("industry_label"))),
        F.when(filled("municipality"), say("registered in ", F.initcap("municipality"))),
    ))
    identity = F.when(F.size(bits) > 0, say(name, " is ", F.array_join(bits, ", "), ".")).otherwise(say(name, " is a registered Norwegian entity."))
    money = F.coalesce(F.nullif(text("currency"), F.lit("")), F.lit("NOK"))
    figures = F.array_compact(F.array(*[
        F.when(col(c).isNotNull(), say(f"{label} ", col(c), " ", money)) for label, c in (("revenue", "revenue"), ("operating result", "operating_result"), ("annual result", "annual_result"))
    ]))
    accounts = F.when(F.size(figures) > 0, say("Latest filed accounts (", period_label("period_start", "period_end"), "): ", F.array_join(figures, ", "), "."))
    others = F.when(col("active_roles") > 1, say(" and ", col("active_roles") - 1, " other registered role(s)")).otherwise(F.lit(""))
    lead = say("Registered leadership includes ", col("lead_name"), " (", F.coalesce(F.nullif(text("lead_role"), F.lit("")), F.lit("role")), ")", others, ".")
    verified = N.verified_site()
    owned = F.array_compact(F.array(
        say("verified official website ", col("website_url")),
        F.when(col("job_count") > 0, say(col("job_count"), " open job posting(s)")),
        F.when(col("news_count") > 0, say(col("news_count"), " dated news item(s)")),
        F.when(col("social_count") > 0, say(col("social_count"), " company-linked social profile(s)")),
    ))
    has_roles, has_places, has_record = F.coalesce(col("active_roles"), F.lit(0)) > 0, F.coalesce(col("location_count"), F.lit(0)) > 0, F.coalesce(col("has_record"), F.lit(False))
    statement = lambda field, on, words: F.when(on, F.struct(F.lit(field).alias("evidence_field"), words.alias("text")))
    statements = F.filter(
        F.array(
            statement("registry", name.isNotNull(), identity),
            statement("registry", F.coalesce(col("bankrupt"), F.lit(False)), F.lit("The registry marks the entity as bankrupt.")),
            statement("registry", F.coalesce(col("liquidating"), F.lit(False)), F.lit("The registry marks the entity as under liquidation.")),
            statement("financials", has_record, accounts),
            statement("roles", has_roles, lead),
            statement("locations", has_places, say(col("location_count"), " registered subunit(s)/workplace(s).")),
            statement("website", verified, say("Company-owned sources: ", F.array_join(owned, ", "), ".")),
            statement("external_footprint", col("workforce_value").isNotNull(), say("Workforce reported in the ", col("workforce_year"), " annual report: ", col("workforce_value"), " (", col("workforce_measure"), ").")),
        ),
        lambda s: s.isNotNull() & s["text"].isNotNull(),
    )
    unknown = F.array_compact(F.array(
        F.when(~has_record, F.lit("filed financial figures")), F.when(~has_roles, F.lit("registered leadership/roles")),
        F.when(~has_places, F.lit("registered subunits/locations")), F.when(~verified, F.lit("verified company website")),
    ))
    out = profiles.select(ORG, F.coalesce(name, col(ORG)).alias("headline"), statements.alias("statements"), unknown.alias("unknowns"))
    told = F.array_join(F.transform("statements", lambda s: s["text"]), " ")
    none = F.lit("No verified public facts were found for this organisation number in this run.")
    return out.withColumn("narrative", F.coalesce(F.nullif(told, F.lit("")), none))


def derive(profiles: DataFrame, registry: DataFrame, families: Sequence[DataFrame], as_of: str) -> DataFrame:
    """Recompute what follows from evidence for all entities, resumed ones included: claim count,
    published observations and footprint status, and the summary.

    ``registry`` is a registry extract with its own column names; ``families`` are observation tables.
    """
    claim_counts = N.registry_claims(registry).groupBy(ORG).agg(F.count("*").alias("registry_claims"))
    obs = union_all(*families)
    for c in ("likes", "comments", "shares"):
        if c not in obs.columns:
            obs = obs.withColumn(c, F.lit(None).cast("long"))
    prints = P.footprint(obs, as_of).select(ORG, F.col("status").alias("footprint_status"), "accepted_observations", "sentiment_status")
    told = synthesis(profiles).select(ORG, F.size("statements").alias("statements"), F.size("unknowns").alias("unknowns"), "narrative")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return profiles.select(ORG).join(claim_counts, ORG, "left").join(prints, ORG, "left").join(told, ORG, "left").select(
        ORG, zero("registry_claims"), zero("accepted_observations"), F.coalesce("footprint_status", F.lit("not_available")).alias("footprint_status"),
        F.coalesce("sentiment_status", F.lit("abstain")).alias("sentiment_status"), "statements", "unknowns", "narrative",
    )


