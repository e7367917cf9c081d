"""Joins between manifests, registry, observations, labels, seeds and captures.

No side is broadcast by hint: sides that grow with the data are left to the size-checked
choice of the optimiser, and skewed sort-merge partitions are split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K
from ..functions.ids import short_id
from ..functions.text import as_col, clean, digits, full_name_tokens, text
from ..functions.url import company_url, homepage
from .rows import first_per_key, insist, unfold, unique_rows

ORG = "organisation_number"


def anchor_manifest(manifest: DataFrame, registry: DataFrame) -> DataFrame:
    """Every requested entity in request order; one absent from the registry keeps a not_found record."""
    known = registry.withColumn("__known", F.lit(True))
    out = manifest.join(known, ORG, "left")
    found = F.coalesce(F.col("__known"), F.lit(False))
    return out.select(
        *[c for c in out.columns if c != "__known"],
        F.when(found, "available").otherwise("not_found").alias("registry_status"),
        F.when(~found, F.lit("absent from the registry snapshot; live modules are still attempted")).alias("registry_note"),
    )


def present_universe(universe: DataFrame, registry: DataFrame) -> DataFrame:
    """Entities of the universe that the registry still holds."""
    return universe.join(registry.select(ORG), ORG, "left_semi")


def universe_counts(universe: DataFrame, registry: DataFrame) -> DataFrame:
    """Total, kept and missing in one pass over one join."""
    held = registry.select(ORG).distinct().withColumn("__held", F.lit(1))
    return universe.join(held, ORG, "left").agg(
        F.count("*").alias("total"), F.count("__held").alias("kept"), (F.count("*") - F.count("__held")).alias("missing")
    )


def missing_seed_events(profiles: DataFrame, events: DataFrame, complete: bool = True) -> DataFrame:
    """Error event for each seeded entity without any event, once the crawl is complete."""
    page = homepage("website")
    seeds = profiles.where((clean("website") != "") & page.isNotNull()).select(ORG, page.alias("requested_url"))
    if not complete:
        seeds = seeds.where(F.lit(False))
    return seeds.join(events.select(ORG), ORG, "left_anti").select(
        ORG, "requested_url", F.col("requested_url").alias("final_url"), F.lit(0).alias("status_code"),
        F.lit("homepage").alias("page_kind"), F.lit("source_error").alias("status"),
        F.sha2(F.lit(""), 256).alias("content_sha256"),
        F.lit("No page event emitted; request was rejected before download (for example by robots.txt).").alias("error"),
    )


def jobs_for(jobs: DataFrame, entities: DataFrame) -> DataFrame:
    """Jobs of the given entities by exact organisation number, written any way."""
    wanted = entities.select(digits(ORG).alias(ORG)).distinct()
    return jobs.withColumn(ORG, digits(ORG)).join(wanted, ORG, "left_semi")


def observations_by_entity(profiles: DataFrame, obs: DataFrame) -> DataFrame:
    """Profiles with the counts and last times of their observations; reduced before the join."""
    facts = obs.groupBy(ORG).agg(
        F.count("*").alias("observations"),
        F.count_distinct("platform").alias("platforms"),
        F.max("retrieved_at").alias("last_retrieved_at"),
    )
    return profiles.join(facts, ORG, "left").withColumn("observations", F.coalesce("observations", F.lit(0)))


def pending(batch: DataFrame, done: DataFrame, check: bool = True) -> DataFrame:
    """Entities of a batch not finished yet; finished entities outside the batch fail the job."""
    if not check:
        return batch.join(done.select(ORG), ORG, "left_anti")
    finished = done.select(ORG).distinct().withColumn("__done", F.lit(True))
    both = batch.withColumn("__batch", F.lit(True)).join(finished, ORG, "full_outer")
    known = insist(both, F.col("__batch").isNotNull() | F.col("__done").isNull(), F.concat(F.lit("completed entities outside the batch: "), F.col(ORG)))
    return known.where("__done IS NULL").select(*batch.columns)


def audit_join(obs: DataFrame, labels: DataFrame, check: bool = True) -> DataFrame:
    """Observations with their audit labels; label ids must be unique."""
    known = unique_rows(labels, ["id"], "label ids must be unique") if check else labels
    return obs.join(known, "id", "inner")


def gold_join(gold: DataFrame, predictions: DataFrame, check: bool = True) -> DataFrame:
    """Gold items with their prediction, if any; ids are unique on both sides, gold labels known."""
    if check:
        gold = insist(unique_rows(gold.select("id", "label"), ["id"], "gold item ids must be unique"), F.col("label").isin(*K.SENTIMENT_LABELS) | F.col("label").isNull(), F.concat(F.lit("unknown gold label: "), F.col("label")))
        predictions = unique_rows(predictions, ["id"], "prediction item ids must be unique")
    return gold.select("id", F.col("label").alias("gold_label")).join(
        predictions.withColumnRenamed("label", "predicted_label"), "id", "left"
    )


def aligned(old: DataFrame, new: DataFrame, check: bool = True) -> DataFrame:
    """Old and new rows side by side as ``o`` and ``n``; the two must hold the same entities."""
    both = old.select(ORG, F.struct(*old.columns).alias("o")).join(new.select(ORG, F.struct(*new.columns).alias("n")), ORG, "full_outer")
    return insist(both, F.col("o").isNotNull() & F.col("n").isNotNull(), F.concat(F.lit("datasets differ in membership: "), F.col(ORG))) if check else both


def apply_seeds(profiles: DataFrame, seeds: DataFrame, check: bool = True) -> DataFrame:
    """Verified websites laid over profiles. Both URLs of a seed must be absolute, its entity known."""
    if check:
        absolute = lambda c: clean(c).rlike("^https?://")
        seeds = insist(seeds, absolute("website") & absolute("proof_url"), F.concat(F.lit("seed needs absolute website and proof_url: "), F.col(ORG)))
    s = seeds.select(ORG, clean("website").alias("__site"), clean("proof_url").alias("__proof_url"), text("proof").alias("__proof"))
    applied = F.col("__site").isNotNull()
    if check:
        both = profiles.withColumn("__known", F.lit(True)).join(s, ORG, "full_outer")
        joined = insist(both, F.col("__known").isNotNull() | F.col("__site").isNull(), F.concat(F.lit("verified seeds contain unknown organisations: "), F.col(ORG)))
    else:
        joined = profiles.join(s, ORG, "left")
    return joined.select(
        *[F.coalesce("__site", "website").alias("website") if c == "website" else F.col(c) for c in profiles.columns],
        F.when(applied, "independently_verified_exact_entity").alias("website_seed_source"),
        F.col("__proof_url").alias("website_seed_proof_url"),
        F.when(applied, F.col("__proof")).alias("website_seed_proof"),
    )


def seed_errors(seeds: DataFrame, profiles: DataFrame) -> DataFrame:
    """Seeds that may not be applied, with the reason."""
    known = profiles.select(ORG).distinct().withColumn("__known", F.lit(True))
    absolute = lambda c: clean(c).rlike("^https?://")
    reason = F.when(F.col("__known").isNull(), "unknown organisation").when(~absolute("website") | ~absolute("proof_url"), "website and proof_url must be absolute")
    return seeds.join(known, ORG, "left").select(ORG, reason.alias("reason")).where("reason IS NOT NULL")


def reviewed_observations(config: DataFrame, profiles: DataFrame, retrieved_at: str, check: bool = True) -> DataFrame:
    """Observations from hand-reviewed sources, ids derived from what they state."""
    names = profiles.select(ORG, F.col("name").alias("legal_name"), F.lit(True).alias("__known"))
    if check:
        hashed = insist(config, text("content_sha256").rlike("^[0-9a-f]{64}$"), F.concat(F.lit("invalid content hash: "), F.col(ORG)))
        joined = insist(hashed.join(names, ORG, "left"), F.col("__known") | F.col(ORG).isNull(), F.concat(F.lit("unknown organisation number: "), F.col(ORG)))
    else:
        joined = config.join(names, ORG)
    default = lambda c, v: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v)).alias(c)
    key = F.concat_ws("|", ORG, "source_url", "signal_type")
    return joined.select(
        F.concat(F.lit("verified-observation-"), F.substring(F.sha2(key, 256), 1, 24)).alias("id"),
        ORG, "platform", "signal_type", "source_url", F.lit(retrieved_at).alias("retrieved_at"), "content_sha256",
        F.lit(True).alias("exact_entity"),
        F.array(F.struct(F.lit("manual_exact_entity_review").alias("type"), F.col("legal_name").alias("value"), F.col("proof").alias("basis"))).alias("identity_proof"),
        default("acquisition_mode", "rights_review_experiment"), default("rights_status", "review_required"),
        default("source_class", "public_news"), default("strategy", "independent_news_discovery"), "evidence_span",
    )


def exact_handle_jobs(cards: DataFrame, handles: DataFrame) -> DataFrame:
    """Job cards of verified company pages, matched on the canonical page URL, one per entity and job."""
    cards = cards.withColumn("company_url", company_url("company_link"))
    job_id = F.coalesce(
        F.nullif(F.regexp_extract("urn", r"(\d{6,})", 1), F.lit("")),
        F.nullif(F.regexp_extract("job_link", r"-(\d{6,})(?:[/?]|$)", 1), F.lit("")),
    )
    handles = handles.select(ORG, company_url("profile_url").alias("company_url")).where("company_url IS NOT NULL").distinct()
    jobs = cards.withColumn("job_id", job_id).where("job_id IS NOT NULL AND company_url IS NOT NULL").join(handles, "company_url")
    return first_per_key(
        jobs.withColumn("job_url", F.concat(F.lit("https://www.linkedin.com/jobs/view/"), "job_id")), [ORG, "job_id"], ["seq"]
    )


def _run(tokens: Column, start: Column, n: Column | int) -> Column:
    return F.array_join(F.slice(tokens, start, n), " ")


def mention_title(title: Column | str) -> Column:
    """Title without the publisher after its last dash."""
    return F.regexp_replace(text(title), r"(?s) - (?!.* - ).*$", "")


def title_mentions(entities: DataFrame, titles: DataFrame, name: str = "name", title: str = "title", key: str = "title_id", carried: int = 32) -> DataFrame:
    """Titles that hold a full legal name at their start or after a common headline word.

    Containment is one equi join. A title is taken apart once and emits, only at places where a name may start,
    its runs of one to three words; a run of three carries the next words. A name meets the run of its
    first three words at most, and its other words are compared with those carried. Only for names of more
    than carried + 3 words do the pairs found so far go back to the titles.
    """
    names = entities.select(ORG, F.col(name).alias("legal_name"), full_name_tokens(name).alias("__name")).where(F.size("__name") > 0)
    keyed = names.select(ORG, "legal_name", _run(F.col("__name"), F.lit(1), 3).alias("__key"), F.expr("slice(__name, 4, greatest(size(__name) - 3, 0))").alias("__rest"))
    words = titles.select(key, full_name_tokens(mention_title(title)).alias("__words"))
    starts = F.filter(
        F.when(F.size("__words") > 0, F.sequence(F.lit(1), F.size("__words"))),
        lambda i: (i == 1) | F.get(F.col("__words"), i - 2).isin(*K.MENTION_PREDECESSORS),
    )
    placed = words.withColumn("__starts", starts)  # no filter here: one pushed down would take the title apart again for each word

    def runs(n: int) -> Column:
        fits = F.filter(F.col("__starts"), lambda i: i + (n - 1) <= F.size("__words"))

        def one(i: Column) -> Column:
            after = F.slice(F.col("__words"), i + 3, carried) if n == 3 else F.array().cast("array<string>")
            return F.struct(_run(F.col("__words"), i, n).alias("run"), after.alias("after"), F.when(F.size(after) == carried, i).alias("at"))

        return F.transform(fits, one)

    met = unfold(placed, [key], F.flatten(F.array(runs(1), runs(2), runs(3))), "e").select(key, F.col("e.run").alias("__key"), "e.after", "e.at").join(keyed, "__key")
    n = F.size("__rest")
    near = met.where((n == 0) | (F.expr("slice(after, 1, least(size(__rest), {0}))".format(carried)) == F.expr("slice(__rest, 1, {0})".format(carried))))
    found = near.where(n <= carried).select(ORG, "legal_name", key)
    open_ = near.where(n > carried).select(ORG, "legal_name", key, "at", "__rest")
    whole = F.expr("slice(__words, at + 3, size(__rest))") == F.col("__rest")
    far = open_.join(titles.select(key, F.col(title).alias("__title")), key).withColumn("__words", full_name_tokens(mention_title("__title"))).where(whole)
    return found.unionByName(far.select(ORG, "legal_name", key)).distinct()


def resolved_handles(handles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First handle per entity and resolved page, and the handles that resolve to a page again."""
    first = F.struct("seq")
    grouped = handles.groupBy(ORG, "resolved_url").agg(
        F.min_by("requested_url", first).alias("requested_url"), (F.count("*") - 1).alias("duplicates")
    )
    return grouped.select(ORG, "resolved_url", "requested_url"), grouped.where("duplicates > 0")


def task_key(*parts: Column | str) -> Column:
    return short_id(*[as_col(p) for p in parts])
