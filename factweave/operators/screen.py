"""Screens, facts and comparisons over profiles.

A screen is a plan of filters and an optional sort. It becomes Column expressions, so the filters
reach the scan and the top of a sort is a top-k, not a full sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import text
from .feed import latest_record
from .rows import beside, top_per_key, unfold, union_all

ORG = "organisation_number"


@dataclass(frozen=True)
class Filter:
    field: str
    operator: str
    value: object
    evidence_module: str


@dataclass(frozen=True)
class Sort:
    field: str
    limit: int = 10
    direction: str = "desc"


@dataclass(frozen=True)
class ScreenPlan:
    """Filters joined by AND, an optional sort, and what of the request is not supported."""

    filters: tuple[Filter, ...] = ()
    sort: Sort | None = None
    unsupported: tuple[str, ...] = field(default=())

    @property
    def executable(self) -> bool:
        return bool(self.filters or self.sort) and not self.unsupported


def screen_value(name: str) -> Column:
    """Column a screen field stands for; a site without an identity grade counts as the entity's."""
    if name == "website":
        return F.col("website_status").eqNullSafe("available") & F.coalesce(F.col("website_publishable"), F.lit(True))
    if name == "financials":
        return F.col("financials_status").eqNullSafe("available")
    if name == "industry":
        return F.concat_ws(" ", F.nullif(text("industry_code"), F.lit("")), F.nullif(text("industry_label"), F.lit("")))
    if name in ("municipality", "legal_form", "employees", "revenue", "annual_result"):
        return F.col(name)
    return F.lit(None).cast("string")


def predicate(f: Filter) -> Column:
    """Filter as a Boolean column. NULL fails every numeric comparison."""
    actual = screen_value(f.field)
    if f.operator == "eq":
        return F.lower(text(actual)) == str(f.value or "").lower()
    if f.operator in ("present", "available"):
        truth = actual if f.field in ("website", "financials") else F.coalesce(text(actual) != "", F.lit(False))
        return truth == bool(f.value)
    if f.operator == "contains":
        return F.lower(text(actual)).contains(str(f.value).lower())
    compare = {">": actual > f.value, ">=": actual >= f.value, "<": actual < f.value, "<=": actual <= f.value, "=": actual == f.value}
    return F.coalesce(compare[f.operator], F.lit(False))


def citations(modules: Sequence[str]) -> Column:
    """``array<struct>`` with source, time and hash of each evidence module used."""
    return F.array(*[
        F.struct(
            F.lit(m).alias("module"), F.col(f"{m}_source_url").alias("source_url"), F.col(f"{m}_retrieved_at").alias("retrieved_at"),
            F.col(f"{m}_content_sha256").alias("content_sha256"),
        )
        for m in sorted(set(modules))
    ])


def screen(profiles: DataFrame, plan: ScreenPlan) -> DataFrame:
    """Entities that pass a plan, in its order, with citations. A plan that cannot run gives no rows."""
    kept = profiles if plan.executable else profiles.where(F.lit(False))
    for f in plan.filters:
        kept = kept.where(predicate(f))
    modules = [f.evidence_module for f in plan.filters]
    if plan.sort:
        modules.append("financials" if plan.sort.field == "revenue" else "registry")
    out = kept.select(ORG, "name", "municipality", "employees", "revenue", "annual_result", citations(modules or ["registry"]).alias("citations"))
    if plan.sort:
        ranked = out.orderBy(F.col(plan.sort.field).desc_nulls_last(), F.col(ORG).asc())
        return ranked if plan.sort.limit is None else ranked.limit(plan.sort.limit)
    return out.orderBy(ORG)


def latest_accounts(accounts: DataFrame) -> DataFrame:
    """Latest filed record of each entity, by a mergeable maximum."""
    return latest_record(accounts, [ORG], ["year"])


def search(profiles: DataFrame, query: str = "", municipality: str | None = None, industry: str | None = None, coverage: str | None = None) -> DataFrame:
    """Free search: part of a name or number, and optional municipality, industry and coverage.

    ``profiles`` carries the flags website, financials and the count signals of ``coverage_flags``
    under the names has_website, has_financials and signals.
    """
    out = profiles
    wanted = query.strip().lower()
    if wanted:
        out = out.where(F.lower(F.concat_ws(" ", text("name"), text(ORG))).contains(wanted))
    if municipality is not None:
        out = out.where(text("municipality") == municipality)
    if industry is not None:
        out = out.where(text("industry_label") == industry)
    tests = {"website": F.col("has_website"), "financials": F.col("has_financials"), "activity": F.col("signals") > 0} if coverage else {}
    return out.where(tests[coverage]) if coverage else out


# ---- facts -----------------------------------------------------------------------------
# fixed values: words of a question and the topic they ask for
FINANCIAL_WORDS = ("financial", "finance", "account", "revenue", "income", "profit", "result", "debt", "asset", "regnskap")
OTHER_WORDS = ("lead", "role", "location", "where", "social", "sentiment", "employee")
WEBSITE_WORDS = ("social", "job", "hiring", "career", "vacan", "contact", "phone", "email", "address", "founded", "news", "activity")
WORKFORCE_WORDS = ("employee", "workforce", "staff", "headcount")


def topics(question: Column | str) -> Column:
    """Topics a question asks for; one without any known word asks for all."""
    q = F.lower(text(question))
    any_word = lambda words: q.rlike("|".join(words))
    everything = ~any_word(FINANCIAL_WORDS + OTHER_WORDS)
    wanted = {
        "registry": any_word(("employee",)), "financials": any_word(FINANCIAL_WORDS), "roles": any_word(("lead", "role")),
        "locations": any_word(("location", "where")), "website": any_word(WEBSITE_WORDS), "workforce": any_word(WORKFORCE_WORDS),
    }
    return F.array_compact(F.array(*[F.when(everything | on, F.lit(t)) for t, on in wanted.items()]))


def _facts(df: DataFrame, topic: str, module: str, rows: Sequence[tuple[str | Column, Column, str]], provenance: bool = True) -> DataFrame:
    made = F.array(*[
        F.when(text(v) != "", F.struct((F.lit(label) if isinstance(label, str) else label).alias("claim"), v.cast("string").alias("value"), F.lit(kind).alias("classification")))
        for label, v, kind in rows
    ])
    source = [F.col(f"{module}_{c}").alias(c) if provenance else F.col(c) for c in ("source_url", "retrieved_at", "content_sha256")]
    return unfold(df, [ORG, F.lit(topic).alias("topic"), *source], made, "f").select(ORG, "topic", "f.*", "source_url", "retrieved_at", "content_sha256")


def facts(profiles: DataFrame, roles: DataFrame | None = None, locations: DataFrame | None = None, site_items: DataFrame | None = None, workforce: DataFrame | None = None, cap: int | None = None) -> DataFrame:
    """Every source-linked fact of every entity, by topic.

    ``profiles`` is screen input with period; roles(seq, name, role, group, inactive),
    locations(seq, name, address), site_items(kind, seq, value) and workforce observations are
    optional. A site graded as not the entity's gives none.
    """
    official = "official_registry_fact"
    parts = [
        _facts(profiles, "registry", "registry", [
            ("Registered name", F.col("name"), official), ("Organisation number", F.col(ORG), official), ("Legal form", F.col("legal_form"), official),
            ("Municipality", F.col("municipality"), official), ("Registry employee count", F.col("employees"), official),
        ]),
        _facts(profiles, "financials", "financials", [
            (label, F.col(c), "official_annual_account")
            for label, c in (("Reporting period", "period"), ("Revenue", "revenue"), ("Operating result", "operating_result"), ("Annual result", "annual_result"), ("Assets", "assets"), ("Debt", "debt"))
            if c in profiles.columns
        ]),
    ]
    cited = lambda module: profiles.select(ORG, *[f"{module}_{c}" for c in ("source_url", "retrieved_at", "content_sha256")])
    if roles is not None:
        few = top_per_key(roles.where(~F.col("inactive")), [ORG], ["seq"], cap).join(cited("roles"), ORG)
        label = F.coalesce(F.nullif(text("role"), F.lit("")), F.nullif(text("group"), F.lit("")), F.lit("Registered role"))
        parts.append(_facts(few, "roles", "roles", [(label, F.col("name"), "official_role_record")]))
    if locations is not None:
        few = top_per_key(locations, [ORG], ["seq"], cap).join(cited("locations"), ORG)
        parts.append(_facts(few, "locations", "locations", [("Registered subunit", F.to_json(F.struct("name", "address")), "official_subunit_record")]))
    if site_items is not None:
        ok = profiles.where(F.col("website_status").eqNullSafe("available") & F.coalesce(F.col("website_publishable"), F.lit(True))).select(ORG)
        few = top_per_key(site_items.join(ok, ORG, "left_semi"), [ORG, "kind"], ["seq"], cap).join(cited("website"), ORG)
        parts.append(_facts(few, "website", "website", [(F.col("kind"), F.col("value"), "company_reported_claim")]))
    if workforce is not None:
        told = F.to_json(F.struct(F.col("metrics")["workforce_value"].alias("value"), F.col("metrics")["measure"].alias("measure"), F.col("metrics")["year"].alias("year")))
        parts.append(_facts(workforce, "workforce", "", [("Workforce (from official annual report)", told, "official_annual_account_copy")], provenance=False))
    return union_all(*parts)


def facts_for_questions(questions: DataFrame, known: DataFrame) -> DataFrame:
    """Facts each question (question_id, organisation_number, question) asks for."""
    asked = questions.select("question_id", ORG, F.explode(topics("question")).alias("topic"))
    return asked.join(known, [ORG, "topic"])


def unsupported_notes(questions: DataFrame, profiles: DataFrame, have: dict[str, DataFrame]) -> DataFrame:
    """What a question asks for and the evidence cannot answer.

    ``have`` maps financials, roles and locations to tables of the entities that have any.
    """
    # fixed values: the notes
    notes = {
        "financials": "No normalized annual-account record was returned; missing values are not interpreted as zero.",
        "roles": "No active public role holder was returned.",
        "locations": "No registered subunit was returned; this does not prove the company has no physical presence.",
    }
    quarantined = "A registry-linked website was fetched, but exact legal-entity identity was not established; its claims and social links are quarantined."
    absent = "The registry-linked company website was not available to this run."
    asked = questions.select("question_id", ORG, "question", topics("question").alias("topics"))
    out = [
        asked.where(F.array_contains("topics", t)).join(have[t].select(ORG), ORG, "left_anti").select("question_id", F.lit(note).alias("note"))
        for t, note in notes.items() if t in have
    ]
    site = asked.where(F.array_contains("topics", "website")).join(profiles.select(ORG, "website_status", "website_publishable"), ORG)
    there = F.col("website_status").eqNullSafe("available")
    note = F.when(~there, absent).when(~F.coalesce(F.col("website_publishable"), F.lit(True)), quarantined)
    out.append(site.select("question_id", note.alias("note")).where("note IS NOT NULL"))
    moody = asked.where(F.lower("question").contains("sentiment"))
    out.append(moody.select("question_id", F.lit("Sentiment is not scored: no labelled Norwegian news/social evaluation corpus has been run, and company-owned pages are structurally promotional.").alias("note")))
    return union_all(*out)


def compare(profiles: DataFrame, orgs: Sequence[str]) -> DataFrame:
    """Facts by entity for two to four entities, one column each."""
    if not 2 <= len(orgs) <= 4:
        raise ValueError("compare two to four entities")
    columns = {
        "Municipality": "municipality", "Legal form": "legal_form", "Industry": "industry_label", "Latest accounts year": "latest_submitted_accounts",
        "Employees": "employees", "Website": "website_url",
    }
    rows = F.array(*[F.struct(F.lit(n).alias("fact"), F.col(c).cast("string").alias("value")) for n, c in columns.items()])
    long = profiles.where(F.col(ORG).isin(*orgs)).select(ORG, F.explode(rows).alias("r")).select(ORG, "r.fact", "r.value")
    return long.groupBy("fact").pivot(ORG, list(orgs)).agg(F.max("value"))


def suite_eval(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Per query: do the results match the expected entities in membership and order, and are all cited?

    Both have query_id, position (from zero) and organisation_number; ``results`` has citations. A
    row-by-row outer join decides, so a result list of any length needs no gathering.
    """
    cited = F.forall("citations", lambda c: c["source_url"].isNotNull() & c["retrieved_at"].isNotNull() & c["content_sha256"].isNotNull())
    a = results.select("query_id", "position", F.col(ORG).alias("actual"), cited.alias("cited"))
    e = expected.select("query_id", "position", F.col(ORG).alias("wanted"))
    return a.join(e, ["query_id", "position"], "full_outer").groupBy("query_id").agg(
        F.min(F.col("actual").eqNullSafe(F.col("wanted"))).alias("exact_membership_and_order"),
        F.coalesce(F.min(F.coalesce("cited", F.lit(True))), F.lit(True)).alias("citations_complete"),
        F.count("actual").alias("results"), F.count("wanted").alias("expected"),
    )


def suite_points(evaluated: DataFrame, plans: DataFrame, single_supported: bool, abstained: bool, saved: bool) -> DataFrame:
    """Points of a research suite. ``plans``: query_id, filter_fields, expected_fields."""
    plan_rate = plans.agg(F.avg((F.col("filter_fields") == F.col("expected_fields")).cast("double")).alias("plan_rate"))
    screens = evaluated.agg(
        F.avg(F.col("exact_membership_and_order").cast("double")).alias("screen_rate"), F.min("citations_complete").alias("export")
    )
    row = beside(screens, plan_rate)
    parts = {
        "cited_single_company_qa": F.lit(4.0 if single_supported else 0.0), "cross_company_screening": 3 * F.col("screen_rate"),
        "exact_inspectable_filters": 2 * F.col("plan_rate"), "unsupported_abstention": F.lit(1.0 if abstained else 0.0),
        "saved_history": F.lit(1.0 if saved else 0.0), "provenance_export": F.when(F.col("export"), 1.0).otherwise(0.0),
    }
    return row.select(*[c.alias(n) for n, c in parts.items()], sum(parts.values(), F.lit(0.0)).alias("score"))
