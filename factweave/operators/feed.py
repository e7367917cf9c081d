"""Job feed, crawl log and refresh: latest-wins folds and keyed clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import clean, text
from ..functions.timefn import is_fresh, iso_ts
from .rows import first_per_key, top_per_key

ORG = "organisation_number"
JOB_FIELDS = ("employer_name", "title", "url", "published", "updated", "municipal", "content_sha256")


def fold_feed(jobs: DataFrame) -> DataFrame:
    """One row per (job, organisation): its latest active version and its last event.

    Both are mergeable maxima, so the same fold serves a batch, a stream's state and a merge of
    folds. A map task sends one row per key, however often a job repeats.
    """
    fields = [c for c in JOB_FIELDS if c in jobs.columns]
    version = F.struct(text("updated").alias("updated_key"), "seq")
    return (
        jobs.where(text("job_id") != "")
        .groupBy("job_id", ORG)
        .agg(
            F.max_by(F.when(F.col("active"), F.struct(*fields)), F.when(F.col("active"), version)).alias("job"),
            F.max(F.struct("seq", "active")).alias("last_event"),
        )
    )


def index_from_fold(folded: DataFrame) -> DataFrame:
    """Published jobs: those whose last event anywhere is active."""
    last = F.max("last_event").over(Window.partitionBy("job_id"))
    return (
        folded.withColumn("__last", last)
        .where(F.col("__last.active") & F.col("job").isNotNull())
        .select(ORG, "job_id", "job.*")
    )


def job_index(jobs: DataFrame) -> DataFrame:
    """Latest version of each live job per organisation; a job whose last event is no active ad is gone."""
    return index_from_fold(fold_feed(jobs))


def fresh_coverage(entities: DataFrame, jobs: DataFrame, as_of: str, days: int = 45) -> DataFrame:
    """Share of entities with a job published within ``days`` days of ``as_of``."""
    fresh = jobs.where(is_fresh(iso_ts("published"), as_of, days)).select(ORG).distinct().withColumn("__fresh", F.lit(1))
    return entities.select(ORG).join(fresh, ORG, "left").agg(
        F.count("*").alias("entities"),
        F.count("__fresh").alias("fresh_entities"),
        F.coalesce(F.count("__fresh") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("fresh_coverage"),
    )


EVENT_KEY = (ORG, "page_kind", "final_url", "content_sha256", "status")


def dedupe_events(events: DataFrame, order: Sequence[Column | str] = ("seq",)) -> DataFrame:
    """First event of each (entity, kind, address, content, status)."""
    return first_per_key(events, EVENT_KEY, order)


SITE_FIELDS = ("requested_url", "final_url", "title", "description", "main_text", "identity_text", "extraction_state", "content_sha256", "retrieved_at")


def merge_events(events: DataFrame, socials: DataFrame | None = None, organisations: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame, DataFrame | None]:
    """Crawl log folded to sites, pages, social links, errors and structured organisations, as tables.

    A site is its entity's latest homepage event; pages, links and errors count only where that is available.
    Pages are unique by address; of two with one address the later in (kind, arrival) order wins.
    socials (seq, platform, url) and organisations (seq, name, ...) come from the pages' events by seq;
    a site has the organisations of its homepage. The lists of the reference's nested record stay long tables,
    so an entity with a million pages is many rows and not one. Rows are picked by their number first; texts
    are joined to the picked rows and pass through no aggregate.
    """
    home = events.where(F.col("page_kind") == "homepage").groupBy(ORG).agg(F.max_by(F.struct("seq", "status"), F.struct(text("retrieved_at"), "seq")).alias("h"))
    chosen = events.select(ORG).distinct().join(home, ORG, "left").select(ORG, F.col("h.seq").alias("seq"), F.col("h.status").alias("home_status"))
    live = chosen.where("home_status = 'available'").select(ORG, F.col("seq").alias("home_seq"))
    fields = [c for c in events.columns if c not in (ORG, "seq")]
    bodies = events.select("seq", F.struct(*fields).alias("h"))
    shown = lambda c: F.when(F.col("home_status") == "available", F.col(f"h.{c}")).alias(c)
    sites = chosen.join(bodies, "seq", "left").select(
        ORG,
        F.coalesce("home_status", F.lit("not_found")).alias("status"),
        F.coalesce("h.final_url", "h.requested_url").alias("source_url"),
        *[shown(c) for c in SITE_FIELDS if c in fields and c not in ("content_sha256", "retrieved_at")],
        F.col("h.content_sha256").alias("content_sha256"),
        F.col("h.retrieved_at").alias("retrieved_at"),
        F.when(F.col("home_status").isNull(), F.lit("No homepage crawl event was produced"))
        .when(F.col("home_status") != "available", F.coalesce(F.col("h.error"), F.lit("Homepage fetch failed")))
        .alias("note"),
    )
    told = events.join(live, ORG)
    ok = told.where("status = 'available'")
    best = first_per_key(ok.select(ORG, "final_url", "page_kind", "seq"), [ORG, "final_url"], [(F.col("page_kind") == "homepage"), F.col("seq").desc()])
    texts = [c for c in ("title", "main_text", "identity_text", "content_sha256") if c in fields]
    pages = best.select(ORG, F.col("final_url").alias("url"), "seq").join(events.select("seq", *texts), "seq").select(ORG, "url", *texts)
    linked = None
    if socials is not None:
        linked = ok.select(ORG, "seq").join(socials, "seq").select(ORG, "platform", "url").distinct()
    named = None
    if organisations is not None:
        named = live.withColumnRenamed("home_seq", "seq").join(organisations.withColumnRenamed("seq", "__page"), F.col("seq") == F.col("__page")).drop("__page", "seq")
    errors = told.where(F.col("status") != "available").select(ORG, F.coalesce("final_url", "requested_url").alias("url"), "error")
    return sites, pages, linked, errors, named


def dedupe_articles(articles: DataFrame, cap: int | None = None) -> DataFrame:
    """Distinct (headline, date) per entity in date and headline order (the first ``cap`` of them)."""
    a = articles.withColumn("__h", F.lower(text("headline"))).withColumn("__d", text("date_published"))
    one = first_per_key(a, [ORG, "__h", "__d"], ["seq"])
    return top_per_key(one, [ORG], ["__d", "__h", "seq"], cap, "position").drop("__h", "__d")


def dedupe_postings(postings: DataFrame, cap: int | None = None) -> DataFrame:
    """Distinct (title, url) per entity in date, title and url order (the first ``cap`` of them)."""
    p = postings.withColumn("__t", F.lower(text("title"))).withColumn("__u", F.lower(text("url")))
    one = first_per_key(p, [ORG, "__t", "__u"], ["seq"])
    return top_per_key(one, [ORG], [text("date_posted"), "__t", text("url"), "seq"], cap, "position").drop("__t", "__u")


def latest_record(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row with the greatest ``order`` per key, by a mergeable maximum."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def in_manifest_order(results: DataFrame, manifest: DataFrame) -> DataFrame:
    """Results in the order of the manifest (range-partitioned sort on its position)."""
    return results.join(manifest.select(ORG, "position"), ORG).orderBy("position")


def seeded(profiles: DataFrame) -> DataFrame:
    return profiles.where(clean("website") != "")
