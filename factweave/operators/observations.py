"""Builders that fan source rows out into observations.

Each source row emits its observations in one pass: an array of optional structs, exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K
from ..functions.ids import sha64
from ..functions.numeric import half_up, rating5, star_label
from ..functions.text import clean, digits, slug, text
from ..functions.url import depth, is_news_path
from . import gates as G
from .joins import title_mentions
from .normalise import BULK_SOURCE
from .rows import first_per_key, top_per_key, unfold, union_all

ORG = "organisation_number"
FEED_BASE = "https://pam-stilling-feed.nav.no"
FIELDS = (
    "id", "platform", "signal_type", "source_url", "retrieved_at", "effective_at", "content_sha256", "exact_entity", "identity_proof",
    "acquisition_mode", "rights_status", "source_class", "evidence_span", "metrics", "sentiment_label", "sentiment_model_version",
    "reviewer_id", "strategy",
)


def proof(*pairs: tuple[str, Column | str]) -> Column:
    return F.array(*[F.struct(F.lit(kind).alias("type"), (F.col(v) if isinstance(v, str) else v).cast("string").alias("value")) for kind, v in pairs])


def metrics(**values: Column) -> Column:
    """Metric map of text values; a NULL value leaves its key out."""
    entries = F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in values.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))


def observation(**given: Column | str) -> Column:
    """An observation struct; text arguments are literals, what is not given is NULL."""
    out = []
    for name in FIELDS:
        v = given.get(name)
        v = F.lit(v) if isinstance(v, (str, bool)) else v
        if v is None:
            kind = {"metrics": "map<string,string>", "exact_entity": "boolean", "identity_proof": "array<struct<type:string,value:string>>"}.get(name, "string")
            v = F.lit(None).cast(kind)
        out.append(v.alias(name))
    return F.struct(*out)


def fan_out(df: DataFrame, *items: tuple[Column | None, Column], keys: tuple[str, ...] = (ORG,)) -> DataFrame:
    """Rows of the structs whose condition holds."""
    made = F.array(*[s if on is None else F.when(on, s) for on, s in items])
    return unfold(df, keys, made, "o").select(*keys, "o.*").select("id", *keys, *FIELDS[1:])


def _span(value: Column) -> Column:
    return F.nullif(text(value), F.lit(""))


def registry_observations(registry: DataFrame, run_ts: str, content_sha256: str | None = None, url: str = BULK_SOURCE) -> DataFrame:
    """Profile of each registry row, and its head count where the registry states one."""
    common = {
        "platform": "brreg", "source_url": url, "retrieved_at": run_ts, "effective_at": run_ts,
        "content_sha256": sha64(F.lit(content_sha256).cast("string"), F.concat(F.col(ORG), F.lit("brreg"))),
        "exact_entity": True, "identity_proof": proof(("official_registry_exact_match", ORG)),
        "acquisition_mode": "official_api", "rights_status": "approved", "source_class": "official_registry",
    }
    staff = F.col("employees").cast("string")
    named = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col(ORG))
    return fan_out(
        registry,
        (None, observation(**common, id=F.concat(F.lit("brreg-entity-"), ORG), signal_type="company_profile",
                           metrics=metrics(name=F.col("name"), legal_form=F.col("legal_form")), evidence_span=_span(F.col("name")))),
        (staff.isNotNull(), observation(**common, id=F.concat(F.lit("brreg-workforce-"), ORG), signal_type="workforce_snapshot",
                                        metrics=metrics(employees_registered=staff), evidence_span=F.concat(named, F.lit(": "), staff, F.lit(" registered employees")))),
    )


def site_observations(sites: DataFrame) -> DataFrame:
    """Everything a gated site publishes: profile, handles, jobs, careers pages, news and ratings.

    ``sites``: organisation_number, final_url, retrieved_at, content_sha256, title, registered_domain,
    site_publishable, site_status, site_score, social_links(platform, url), job_postings(title,
    date_posted, url), careers_pages(title, url), news_articles(headline, date_published, url),
    ratings(rating, review_count, best), reviews(body, date, author, rating, best). Handles stand on
    their own proof; the rest needs the site to be proven. Only publishable rows leave.
    """
    org, url, at = F.col(ORG), F.col("final_url"), F.col("retrieved_at")
    common = {
        "retrieved_at": at, "content_sha256": sha64("content_sha256", F.concat(org, text("final_url"))), "exact_entity": True,
        "identity_proof": proof(("website_identity_gate", F.col("site_status"))), "rights_status": "approved",
    }
    page = {**common, "platform": "company_site", "acquisition_mode": "permitted_public_page", "source_class": "company_owned"}
    ok = F.coalesce(F.col("site_publishable"), F.lit(False))
    oid = lambda kind, *rest: F.concat_ws("-", F.lit(kind), org, *rest)
    at_or = lambda c: F.coalesce(F.nullif(c, F.lit("")), at)
    url_or = lambda c: F.coalesce(F.nullif(c, F.lit("")), url)

    profile = F.array(F.when(ok, observation(**page, id=oid("company-profile"), signal_type="company_profile", source_url=url, effective_at=at,
                                            metrics=metrics(registered_domain=F.col("registered_domain")), evidence_span=_span(F.col("title")))))
    handles = F.transform("social_links", lambda s: observation(
        **common, id=oid("handle", s["platform"]), platform=s["platform"], signal_type="profile_handle", source_url=s["url"], effective_at=at,
        acquisition_mode="company_authorized_export", source_class="company_owned"))
    jobs = F.transform("job_postings", lambda j, i: F.when(ok, observation(
        **page, id=oid("job", i.cast("string")), signal_type="job_posting", source_url=url_or(j["url"]), effective_at=at_or(j["date_posted"]),
        evidence_span=_span(j["title"]), metrics=metrics(title=j["title"], date_posted=j["date_posted"]))))
    careers = F.transform("careers_pages", lambda c, i: F.when(ok, observation(
        **page, id=oid("careers", i.cast("string")), signal_type="job_posting", source_url=url_or(c["url"]), effective_at=at,
        evidence_span=_span(c["title"]), metrics=metrics(kind=F.lit("careers_page"), title=c["title"]))))
    news = F.transform("news_articles", lambda a, i: F.when(ok & (clean(a["headline"]) != ""), observation(
        **page, id=oid("news", i.cast("string")), signal_type="public_post", source_url=url_or(a["url"]), effective_at=at_or(a["date_published"]),
        evidence_span=_span(clean(a["headline"])), metrics=metrics(headline=clean(a["headline"]), date_published=a["date_published"]))))

    customer = {**page, "source_class": "customer_review"}

    def rated(r: Column, i: Column) -> Column:
        score = rating5(r["rating"], r["best"])
        return F.when(ok & score.isNotNull() & (r["review_count"] > 0), observation(
            **customer, id=oid("rating", i.cast("string")), signal_type="review_summary", source_url=url, effective_at=at,
            evidence_span=F.format_string("Customer rating %.1f/5 from %d reviews on the verified company site.", score, r["review_count"]),
            metrics=metrics(rating=score, review_count=r["review_count"], rating_scale=F.lit(5))))

    def reviewed(r: Column, i: Column) -> Column:
        return F.when(ok & (clean(r["body"]) != ""), observation(
            **customer, id=oid("review", i.cast("string")), signal_type="review", source_url=url, effective_at=at_or(r["date"]),
            evidence_span=clean(r["body"]), reviewer_id=F.coalesce(r["author"], F.concat(F.lit("reviewer-"), i.cast("string"))),
            metrics=metrics(rating=rating5(r["rating"], r["best"]))))

    parts = [profile, handles, jobs, careers, news]
    if "ratings" in sites.columns:
        parts.append(F.transform("ratings", rated))
    if "reviews" in sites.columns:
        parts.append(F.transform("reviews", reviewed))
    none = F.array().cast(sites.select(profile.alias("p")).schema["p"].dataType)
    everything = F.concat(*[F.coalesce(p, none) for p in parts])
    rows = unfold(sites, [ORG], everything, "o").select(ORG, "o.*").select("id", ORG, *FIELDS[1:])
    return rows.where(G.publishable())


def job_observations(jobs: DataFrame, run_ts: str) -> DataFrame:
    """A posting per job; its time is the publication, never the retrieval."""
    org = digits(ORG)
    published = F.coalesce(F.nullif(F.col("published"), F.lit("")), F.col("updated"))
    rows = jobs.withColumn(ORG, org)
    url = F.when(F.col("url").startswith("/"), F.concat(F.lit(FEED_BASE), "url")).otherwise(F.col("url"))
    return fan_out(rows, (None, observation(
        id=F.concat_ws("-", F.lit("navjob"), ORG, "job_id"), platform="job_board", signal_type="job_posting", source_url=url,
        retrieved_at=run_ts, effective_at=published, content_sha256=F.col("content_sha256"), exact_entity=True,
        identity_proof=proof(("nav_feed_employer_orgnr", ORG)), acquisition_mode="official_api", rights_status="approved",
        source_class="official_job_board", evidence_span=_span(F.col("title")),
        metrics=metrics(title=F.col("title"), published=F.col("published"), municipal=F.col("municipal")))))


def kb_observations(kb: DataFrame, run_ts: str) -> DataFrame:
    """Profile, encyclopedia article and handles of each knowledge-base entity.

    ``kb``: organisation_number, item, label, website, employees, inception, article, and a column per
    social property.
    """
    org, item = F.col(ORG), F.col("item")

    def row(suffix: str, platform: str, signal: str, url: Column, values: Column | None = None) -> Column:
        return observation(
            id=F.concat_ws("-", F.lit("wikidata"), org, F.lit(suffix)), platform=platform, signal_type=signal, source_url=url, retrieved_at=run_ts,
            effective_at=F.col("inception"), content_sha256=F.sha2(F.concat_ws("|", org, item, F.lit(suffix)), 256), exact_entity=True,
            identity_proof=proof(("wikidata_p2333_organisation_number", ORG)), acquisition_mode="official_api", rights_status="approved",
            source_class="wikidata", evidence_span=_span(F.col("label")), metrics=values)

    filled = lambda c: text(c) != ""
    items = [
        (None, row("profile", "wikidata", "company_profile", item, metrics(website=F.col("website"), employees=F.col("employees"), inception=F.col("inception")))),
        (filled("article"), row("wikipedia", "wikipedia", "company_profile", F.col("article"))),
    ]
    for prop, (platform, prefix) in K.KB_SOCIAL.items():
        if prop in kb.columns:
            items.append((filled(prop), row(f"handle-{platform}", platform, "profile_handle", F.concat(F.lit(prefix), prop))))
    return fan_out(kb.where(filled("item")), *items)


def place_observations(places: DataFrame, run_ts: str) -> DataFrame:
    """Summary of each matched place, and its rating if it has one.

    ``places``: organisation_number, place_id, display_name, formatted_address, website, rating,
    rating_count, primary_type, business_status.
    """
    org, pid = F.col(ORG), F.col("place_id")
    common = {
        "platform": "google_places", "source_url": F.concat(F.lit("https://www.google.com/maps/place/?q=place_id:"), pid), "retrieved_at": run_ts,
        "effective_at": run_ts, "exact_entity": True, "identity_proof": proof(("google_places_name_municipality_match", "display_name")),
        "acquisition_mode": "licensed_api", "rights_status": "approved",
    }
    rated = (F.coalesce(F.col("rating"), F.lit(0.0)) != 0) & (F.coalesce(F.col("rating_count"), F.lit(0)) != 0)
    ok = places.where(org.rlike("^[0-9]+$") & (text("place_id") != ""))
    return fan_out(
        ok,
        (None, observation(**common, id=F.concat(F.lit("places-"), org), signal_type="place_summary", source_class="google_places",
                           content_sha256=F.sha2(F.concat_ws("|", org, pid), 256),
                           evidence_span=_span(F.coalesce(F.nullif(F.col("formatted_address"), F.lit("")), F.col("display_name"))),
                           metrics=metrics(primary_type=F.col("primary_type"), business_status=F.col("business_status"), website=F.col("website")))),
        (rated, observation(**common, id=F.concat(F.lit("places-rating-"), org), signal_type="review_summary", source_class="customer_review",
                            content_sha256=F.sha2(F.concat_ws("|", org, pid, F.lit("rating")), 256),
                            evidence_span=F.concat(F.lit("Google Places rating "), F.col("rating").cast("string"), F.lit("/5 from "), F.col("rating_count").cast("string"), F.lit(" reviews.")),
                            metrics=metrics(rating=F.col("rating"), review_count=F.col("rating_count"), rating_scale=F.lit(5)))),
    )


def listing_observations(matched: DataFrame, run_ts: str) -> DataFrame:
    """Up to five kinds of observation per accepted map listing, and one per starred review.

    ``matched``: organisation_number, place_id, title, address, phone, web_site, link, rating,
    review_count, content_sha256, name_score, reviews(review_id, stars, body, author).
    """
    org = F.col(ORG)
    place = F.coalesce(F.nullif(F.col("place_id"), F.lit("")), F.substring("content_sha256", 1, 16))
    span = F.concat_ws("; ", "title", "address", "phone", F.concat(F.lit("rating="), F.col("rating").cast("string")), F.concat(F.lit("reviews="), F.col("review_count").cast("string")))
    common = {
        "platform": "google_places", "source_url": F.col("link"), "retrieved_at": run_ts, "content_sha256": F.col("content_sha256"), "exact_entity": True,
        "identity_proof": proof(("maps_title_name_score", F.col("name_score"))), "acquisition_mode": "unofficial_api_experiment", "rights_status": "review_required",
    }
    oid = lambda kind: F.concat_ws("-", F.lit(f"gmaps-{kind}"), org, place)
    rated = (F.col("review_count") > 0) & (F.col("rating") > 0) & (F.col("rating") <= 5)
    stars = metrics(rating=F.col("rating"), rating_scale=F.lit(5), review_count=F.col("review_count"), place_id=F.col("place_id"))
    listing, summary = "public_business_listing", "customer_review_summary"
    kinds = fan_out(
        matched,
        (None, observation(**common, id=oid("place"), signal_type="place_summary", source_class=listing, evidence_span=span, strategy="places_identity_resolution",
                           metrics=metrics(title=F.col("title"), address=F.col("address"), phone=F.col("phone"), website=F.col("web_site"), place_id=F.col("place_id")))),
        (text("web_site") != "", observation(**common, id=oid("company-profile"), signal_type="company_profile", source_class=listing, evidence_span=span, strategy="company_site_identity",
                                             metrics=metrics(official_website_candidate=F.col("web_site"), title=F.col("title"), place_id=F.col("place_id")))),
        (rated, observation(**common, id=oid("review-summary"), signal_type="review_summary", source_class=summary, evidence_span=span, strategy="places_rating_reviews", metrics=stars)),
        (rated, observation(**common, id=oid("profile-metrics"), signal_type="profile_metrics", source_class=listing, evidence_span=span, strategy="social_profile_metrics", metrics=stars)),
        (rated, observation(**common, id=oid("buzz"), signal_type="buzz_metrics", source_class=summary, evidence_span=span, strategy="buzz_peer_normalization", metrics=stars)),
    )
    each = matched.select("*", F.posexplode("reviews").alias("at", "r")).where((F.col("r.stars") > 0) & (F.col("r.stars") <= 5))
    body = clean("r.body")
    reviews = fan_out(each, (None, observation(
        **common, id=F.concat_ws("-", F.lit("gmaps-review"), org, F.col("r.review_id")), signal_type="review", source_class="customer_review",
        evidence_span=F.when(body != "", body).otherwise(F.concat(F.lit("Explicit customer rating: "), F.col("r.stars").cast("string"), F.lit("/5"))),
        reviewer_id=F.coalesce(F.nullif(F.col("r.author"), F.lit("")), F.concat(F.lit("anonymous-"), F.col("at").cast("string"))),
        metrics=metrics(rating=F.col("r.stars"), rating_scale=F.lit(5), review_id=F.col("r.review_id")),
        sentiment_label=star_label(F.col("r.stars")), sentiment_model_version="explicit_star_rating_v1", strategy="independent_sentiment")))
    return kinds.unionByName(reviews)


def site_activity(sites: DataFrame) -> DataFrame:
    """Surface metrics of proven sites: pages, links and structured records captured.

    ``sites``: organisation_number, status, site_publishable, site_status, final_url, retrieved_at,
    content_sha256, extraction_state and the counts pages, socials, structured.
    """
    ok = sites.where((F.col("status") == "available") & F.col("site_publishable") & (text("final_url") != "") & (F.length(text("content_sha256")) == 64))
    return fan_out(ok, (None, observation(
        id=F.concat_ws("-", F.lit("company-site-activity"), ORG, F.substring("content_sha256", 1, 16)), platform="company_site", signal_type="profile_metrics",
        source_url=F.col("final_url"), retrieved_at=F.col("retrieved_at"), content_sha256=F.col("content_sha256"), exact_entity=True,
        identity_proof=proof(("website_identity_gate", "site_status")), acquisition_mode="permitted_public_page", rights_status="approved", source_class="company_site",
        evidence_span=F.format_string("Exact company site snapshot with %d bounded pages and %d verified social links.", F.col("pages"), F.col("socials")),
        metrics=metrics(bounded_pages_captured=F.col("pages"), verified_social_links=F.col("socials"), structured_organisation_records=F.col("structured"), extraction_state=F.col("extraction_state")),
        strategy="company_site_activity")))


def site_news(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """One post per proven site: its deepest page under a news path.

    ``pages``: organisation_number, url, title, content_sha256. The choice is a mergeable minimum.
    """
    proven = sites.where((F.col("status") == "available") & F.col("site_publishable")).select(ORG, F.col("retrieved_at").alias("__at"), "site_score")
    news = pages.where(is_news_path("url"))
    best = news.groupBy(ORG).agg(
        F.min_by(F.struct("url", "title", "content_sha256"), F.struct((-depth("url")).alias("d"), F.col("url"))).alias("p"), F.count("*").alias("captured")
    )
    chosen = best.join(proven, ORG).where(F.col("p.url").rlike("^https?://") & (F.length(text("p.content_sha256")) == 64))
    url = F.col("p.url")
    title = F.trim(F.coalesce(F.nullif(F.col("p.title"), F.lit("")), F.lit("Company news/activity page")))
    return fan_out(chosen, (None, observation(
        id=F.concat(F.lit("company-site-news-"), F.substring(F.sha2(F.concat_ws("|", ORG, url), 256), 1, 24)), platform="company_site", signal_type="public_post",
        source_url=url, retrieved_at=F.col("__at"), content_sha256=F.col("p.content_sha256"), exact_entity=True, identity_proof=proof(("website_identity_gate", F.col("site_score"))),
        acquisition_mode="permitted_public_page", rights_status="approved", source_class="company_site", evidence_span=title,
        metrics=metrics(captured_news_pages=F.col("captured")), strategy="company_site_activity")))


def mention_observations(entities: DataFrame, titles: DataFrame, run_ts: str, k: int | None = None) -> DataFrame:
    """News titles naming an entity in full, once per (title, publisher), or the first ``k`` per entity.

    ``titles``: title_id, title, link, publisher, published_at. Hits carry digests of their title until the rows
    to keep are picked; whole titles are dealt once, however many entities they name.
    """
    told = F.to_json(F.struct(*[F.col(c) for c in titles.columns]), {"ignoreNullFields": "false"})
    keyed = titles.withColumn("__row", F.sha2(told, 256))
    narrow = keyed.select("title_id", "__row", F.sha2(F.lower("title"), 256).alias("__t"), F.sha2(F.lower(text("publisher")), 256).alias("__p"))
    hits = title_mentions(entities, titles.where(text("link") != "")).join(narrow, "title_id")
    one = first_per_key(hits, [ORG, "__t", "__p"], ["title_id", "__row"])
    picked = one.select(ORG, "legal_name", "title_id", "__row").join(keyed.dropDuplicates(["title_id", "__row"]), ["title_id", "__row"]).drop("__row")
    few = top_per_key(picked, [ORG], ["title_id"], k)
    return fan_out(few, (None, observation(
        id=F.concat(F.lit("google-news-title-"), F.substring(F.sha2(F.concat_ws("|", ORG, "title", "publisher"), 256), 1, 24)), platform="news", signal_type="public_mention",
        source_url=F.col("link"), retrieved_at=run_ts, effective_at=F.col("published_at"), content_sha256=F.sha2(F.concat_ws("|", "title", "publisher"), 256), exact_entity=True,
        identity_proof=proof(("exact_legal_name_in_news_title", "legal_name"), ("publisher_label", "publisher")), acquisition_mode="rights_review_experiment",
        rights_status="review_required", source_class="public_news", evidence_span=F.col("title"), strategy="independent_news_discovery")))


def rating_observations(pages: DataFrame, run_ts: str) -> DataFrame:
    """Three observations per rated directory page that shows both name and number.

    ``pages``: organisation_number, name, page_text, content_sha256, rating, review_count.
    """
    shown = F.lower(text("page_text")).contains(F.lower(F.col("name"))) & digits("page_text").contains(F.col(ORG))
    ok = pages.where(shown & (F.col("rating") > 0) & (F.col("rating") <= 5) & (F.col("review_count") > 0))
    url = F.concat(F.lit("https://www.fagfolkguiden.no/bedrift/"), slug("name"), F.lit("-"), ORG)
    common = {
        "platform": "company_directory", "source_url": url, "retrieved_at": run_ts, "content_sha256": F.col("content_sha256"), "exact_entity": True,
        "identity_proof": proof(("exact_legal_name_on_directory_page", "name"), ("exact_organisation_number_on_directory_page", ORG)),
        "acquisition_mode": "rights_review_experiment", "rights_status": "review_required", "source_class": "customer_review",
        "evidence_span": F.concat(F.lit("Aggregate rating "), F.col("rating").cast("string"), F.lit("/5 based on "), F.col("review_count").cast("string"), F.lit(" reviews.")),
        "metrics": metrics(rating=F.col("rating"), review_count=F.col("review_count"), scale=F.lit(5)),
    }
    kinds = (("review", "review_summary", "places_rating_reviews"), ("metrics", "profile_metrics", "social_profile_metrics"), ("buzz", "buzz_metrics", "buzz_peer_normalization"))
    return fan_out(ok, *[
        (None, observation(**common, id=F.concat_ws("-", F.lit(f"fagfolk-{n}"), ORG, F.substring("content_sha256", 1, 16)), signal_type=s, strategy=t)) for n, s, t in kinds
    ])


def workforce_observations(filings: DataFrame, run_ts: str) -> DataFrame:
    """Head counts read from filed reports, only where the registry has none.

    ``filings``: organisation_number, employees_registered, year, url, body, content_sha256. The
    latest report of an entity decides; it must carry the entity's number.
    """
    from .extract import workforce

    missing = filings.where(~text("employees_registered").rlike("^[0-9]+$"))
    numbered = digits("body").contains(F.col(ORG))
    # read where the report lies, so that no body is shuffled; the latest report decides, read or not
    kept = [ORG, "year", "url", "content_sha256"]
    read = workforce(missing.select(F.struct(*kept, numbered.alias("numbered")).alias("f"), "body"), "f", "body").select("f.*", "status", "value", "span", "measure")
    fields = F.struct(*[c for c in read.columns if c != ORG])
    latest = read.groupBy(ORG).agg(F.max_by(fields, F.struct(text("year"), text("url"), text("content_sha256"))).alias("r")).select(ORG, "r.*")
    rows = latest.where("numbered AND status = 'accepted'")
    value = F.when(F.col("value") == F.floor("value"), F.col("value").cast("long").cast("string")).otherwise(F.col("value").cast("string"))
    key = F.concat_ws("|", ORG, "year", value, "content_sha256")
    return fan_out(rows, (None, observation(
        id=F.concat(F.lit("annual-workforce-"), F.substring(F.sha2(key, 256), 1, 24)), platform="brreg", signal_type="workforce_snapshot", source_url=F.col("url"), retrieved_at=run_ts,
        effective_at=F.col("year").cast("string"), content_sha256=F.col("content_sha256"), exact_entity=True,
        identity_proof=proof(("official_report_url_organisation_number", ORG), ("organisation_number_in_pdf", ORG)), acquisition_mode="official_api", rights_status="approved",
        source_class="official_annual_account_copy", evidence_span=F.col("span"), metrics=metrics(workforce_value=value, measure=F.col("measure"), year=F.col("year"), scope=F.lit("company_phrase")),
        strategy="annual_report_workforce_snapshot")))


def channel_observations(channels: DataFrame, hits: DataFrame, run_ts: str) -> DataFrame:
    """Handle, posts and view metrics of accepted channels.

    ``channels`` is the result of ``match_channels``; ``hits`` are its search rows with url, view_count.
    """
    ok = channels.where("accepted").select(ORG, "channel_url")
    mine = hits.join(ok, [ORG, "channel_url"], "left_semi")
    video = F.col("url").startswith("http") & (F.col("url").contains("youtube.com/watch") | F.col("url").contains("youtu.be/"))
    totals = mine.groupBy(ORG, "channel_url").agg(
        F.count("*").alias("matched"), F.sum(F.when(video, F.col("view_count"))).alias("views"), F.count(F.when(video, F.col("view_count"))).alias("viewed")
    )
    digest = F.sha2(F.concat_ws("|", ORG, "channel_url", F.col("matched").cast("string"), F.col("views").cast("string")), 256)
    common = {
        "platform": "youtube", "retrieved_at": run_ts, "exact_entity": True, "identity_proof": proof(("exact_normalized_youtube_channel_name", "channel_url")),
        "acquisition_mode": "unofficial_api_experiment", "rights_status": "review_required", "source_class": "company_social",
    }
    per_channel = fan_out(
        totals,
        (None, observation(**common, id=F.concat_ws("-", F.lit("youtube-search-handle"), ORG, F.substring(digest, 1, 16)), signal_type="profile_handle", source_url=F.col("channel_url"),
                           content_sha256=digest, strategy="verified_handle_extraction")),
        (F.col("viewed") > 0, observation(**common, id=F.concat_ws("-", F.lit("youtube-search-metrics"), ORG, F.substring(digest, 1, 16)), signal_type="profile_metrics", source_url=F.col("channel_url"),
                                          content_sha256=digest, strategy="social_profile_metrics",
                                          metrics=metrics(matched_recent_posts=F.col("matched"), recent_views_total=F.col("views"), recent_views_mean=half_up(F.col("views") / F.col("viewed"), 1)))),
    )
    post_key = F.sha2(F.concat_ws("|", ORG, "url"), 256)
    posts = fan_out(mine.where(video), (None, observation(
        **common, id=F.concat(F.lit("youtube-search-post-"), F.substring(post_key, 1, 24)), signal_type="public_post", source_url=F.col("url"), content_sha256=post_key,
        evidence_span=F.coalesce(F.nullif(F.col("video_title"), F.lit("")), F.lit("public YouTube post")),
        metrics=metrics(view_count=F.col("view_count")), strategy="youtube_channel_feed")))
    return per_channel.unionByName(posts)


TASKS = (("google_places_api", "resolve_places_and_public_rating"), ("licensed_news_search", "discover_independent_mentions"), ("jobs_provider", "discover_active_jobs"))


def plan_tasks(profiles: DataFrame) -> DataFrame:
    """Acquisition tasks of each entity: three fixed ones, one per verified social page, or a search for any.

    ``profiles``: organisation_number, name, municipality, social_links(platform, url). Task ids are
    hashes of the task's fields in a fixed order, so planning again gives the same ids.
    """
    none = F.lit(None).cast("string")

    def task(connector: Column, purpose: str, url: Column) -> Column:
        return F.struct(connector.alias("connector"), F.lit(purpose).alias("purpose"), url.alias("candidate_url"))

    links = F.coalesce("social_links", F.array().cast("array<struct<platform:string,url:string>>"))
    usable = F.filter(links, lambda s: (text(s["platform"]) != "") & (text(s["url"]) != ""))
    fixed = F.array(*[task(F.lit(c), p, none) for c, p in TASKS])
    social = F.transform(usable, lambda s: task(F.concat(s["platform"], F.lit("_connector")), "refresh_verified_profile_metrics", s["url"]))
    search = F.when(F.size(links) == 0, F.array(task(F.lit("permitted_search_api"), "discover_social_handles", none)))
    empty = F.filter(fixed, lambda t: F.lit(False))
    tasks = F.concat(fixed, social, F.coalesce(search, empty))
    from ..functions.ids import short_id

    rows = unfold(profiles.where((text(ORG) != "") & (text("name") != "")), [ORG, "name", text("municipality").alias("municipality")], tasks, "t").select(ORG, "name", "municipality", "t.*")
    return rows.withColumn("task_id", short_id(ORG, "name", "municipality", "connector", "purpose", "candidate_url")).withColumn("state", F.lit("pending"))


def union_families(*families: DataFrame) -> DataFrame:
    """All observation families, reduced to what may be published."""
    return union_all(*families).where(G.publishable())


