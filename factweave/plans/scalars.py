"""Queries over the scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K, ids, numeric as M, text as T, timefn as D, url as U
from ..operators import domains
from . import base, sqltext as S
from .catalog import load, query

ORG = "organisation_number"
_hash = lambda c: F.sha2(F.array_join(c, " "), 256)
_HASH = lambda t: f"sha256(array_to_string({t}, ' '))"
_LW = lambda x: f"regexp_extract_all(replace(replace(replace(lower({x}), 'æ', 'ae'), 'ø', 'o'), 'å', 'a'), '[a-z0-9]+')"


@query(
    "scl_01_fold_tokens",
    f"""SELECT doc_id, {_HASH(S.tokens('text', K.STOP_IDENTITY))} AS identity, {_HASH(S.tokens('text'))} AS search, {_HASH(S.tokens('text', K.STOP_SEARCH_NAME))} AS search_name,
    {_HASH(f"list_sort(list_distinct(list_filter({_LW('text')}, lambda w: length(w) > 1 AND w NOT IN {K.STOP_PLACES})))")} AS place,
    {_HASH(f"list_filter({_LW('text')}, lambda w: w NOT IN {K.STOP_LISTING} AND (length(w) >= 3 OR regexp_full_match(w, '[0-9]+')))")} AS listing,
    {_HASH("regexp_extract_all(lower(text), '[a-z0-9æøå]+')")} AS full_name, len({S.tokens('text')}) AS n FROM documents""",
)
def fold_tokens(spark, folder):
    """Every rule over one folding of the text, and one of its Nordic letters."""
    words = load(spark, folder, "documents").select("doc_id", "text", T.folded_words("text").alias("w"), T.listing_words("text").alias("n"))
    kept = words.select("doc_id", "text", "w", "n", T.kept_words(F.col("w")).alias("search"))
    return kept.select(
        "doc_id", _hash(T.kept_words(F.col("search"), K.STOP_IDENTITY)).alias("identity"), _hash(F.col("search")).alias("search"), _hash(T.kept_words(F.col("search"), K.STOP_SEARCH_NAME)).alias("search_name"),
        _hash(F.array_sort(T.place_words(F.col("n")))).alias("place"), _hash(T.listing_kept(F.col("n"))).alias("listing"), _hash(T.full_name_tokens("text")).alias("full_name"),
        F.size("search").cast("long").alias("n"),
    )


@query(
    "scl_02_strip_legal",
    base.oracle("entities", f"""SELECT organisation_number, CASE WHEN upper(legal_form) = 'KBO' THEN {S.full('name')} ELSE array_to_string(regexp_extract_all(lower(name), '[a-z0-9æøå]+')[:-2], ' ') END AS core FROM entities"""),
)
def strip_legal(spark, folder):
    return base.entities(spark, folder).select(ORG, T.strip_legal(F.concat("name", F.when(F.upper("legal_form") == "KBO", "").otherwise(" AS."))).alias("core"))


@query("scl_03_slug", f"SELECT doc_id, sha256(array_to_string({S.tokens('text', (), 1)}, '-')) AS slug FROM documents")
def slug(spark, folder):
    return load(spark, folder, "documents").select("doc_id", F.sha2(T.slug("text"), 256).alias("slug"))


_RAW = "CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN ' ' || substr(url, position('//' IN url) + 2) WHEN 2 THEN regexp_extract(url, '^([a-z]+://[^/]+)', 1) ELSE '' END"


@query(
    "scl_04_homepage",
    f"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_extract(url, '^[^?#]*') WHEN 1 THEN 'https://' || regexp_extract(substr(url, position('//' IN url) + 2), '^[^?#]*') WHEN 2 THEN regexp_extract(url, '^([a-z]+://[^/]+)', 1) || '/' END AS homepage FROM pages""",
)
def homepage(spark, folder):
    return load(spark, folder, "pages").select("page_id", U.homepage(F.expr(_RAW)).alias("homepage"))


@query("scl_05_host", "SELECT page_id, CASE WHEN split_part(url, '/', 3) LIKE 'www.%' THEN substr(split_part(url, '/', 3), 5) ELSE split_part(url, '/', 3) END AS host FROM pages")
def host(spark, folder):
    return load(spark, folder, "pages").select("page_id", U.host(F.regexp_replace("url", "(?i)WWW", "WWW")).alias("host"))


_SUF = ("example.net", "example.org")


@query(
    "scl_06_registered_domain",
    """SELECT page_id, array_to_string(h[CASE WHEN array_to_string(h[-2:], '.') IN ('example.net', 'example.org') THEN -3 ELSE -2 END:], '.') AS domain FROM (SELECT page_id, string_split(split_part(url, '/', 3), '.') AS h FROM pages)""",
)
def registered_domain(spark, folder):
    return load(spark, folder, "pages").select("page_id", U.registered_domain("url", _SUF).alias("domain"))


_LABELS = "(SELECT page_id, url, string_split(split_part(url, '/', 3), '.') AS h FROM pages)"
_SPARED = f"(SELECT DISTINCT array_to_string(h[-3:], '.') FROM {_LABELS} WHERE array_to_string(h[-2:], '.') = 'example.org' AND starts_with(h[-3], 'thth'))"
#: Registered domain by the rules that rule_lines reads off the hosts.
RULED_SQL = f"""CASE WHEN array_to_string(h[-2:], '.') = 'example.net' THEN CASE WHEN len(h) > 2 THEN array_to_string(h[-3:], '.') ELSE '' END
    WHEN array_to_string(h[-2:], '.') = 'example.org' AND len(h) > 2 THEN CASE WHEN array_to_string(h[-3:], '.') IN {_SPARED} THEN array_to_string(h[-3:], '.') WHEN len(h) > 3 THEN array_to_string(h[-4:], '.') ELSE '' END
    ELSE array_to_string(h[-2:], '.') END"""


def rule_lines(spark, folder):
    """Suffix rules read off the hosts of the pages: a plain two-label suffix, a wildcard and its exceptions, all last labels, a comment."""
    labels = F.split(U.raw_host("url"), r"\.")
    last = lambda k: F.array_join(F.slice(labels, -k, k), ".")
    org = last(2) == "example.org"
    lines = F.array(
        F.lit("// rules of the pages' hosts"), F.element_at(labels, -1), F.when(last(2) == "example.net", last(2)), F.when(org, F.concat(F.lit("*."), last(2))),
        F.when(org & F.startswith(F.element_at(labels, -3), F.lit("thth")), F.concat(F.lit("!"), last(3), F.lit(" spared"))),
    )
    return load(spark, folder, "pages").select(F.explode(lines).alias("rule")).where("rule IS NOT NULL").distinct()


@query("scl_06_suffix_rules", f"SELECT page_id, {RULED_SQL} AS domain FROM {_LABELS}")
def registered_domain_by_rules(spark, folder):
    pages = load(spark, folder, "pages").select("page_id", "url")
    return domains.with_domains(pages, ["url"], domains.suffix_rules(rule_lines(spark, folder))).select("page_id", F.col("url_domain").alias("domain"))


_SOCIAL = (
    ("https://www.facebook.com/Ex{0}/", "facebook", "https://facebook.com/Ex{0}"), ("https://no.linkedin.com/company/ex{0}/admin/feed", "linkedin", "https://linkedin.com/company/ex{0}"),
    ("https://facebook.com/sharer.php?u={0}", None, None), ("https://facebook.com/events/{0}", None, None), ("https://www.linkedin.com/in/p{0}", None, None),
    ("https://instagram.com/p/{0}", None, None), ("https://instagram.com/ex{0}", "instagram", "https://instagram.com/ex{0}"), ("https://twitter.com/ex{0}", "x", "https://x.com/ex{0}"),
    ("https://x.com/ex{0}/status/1", None, None), ("https://youtube.com/@ex{0}/videos", "youtube", "https://youtube.com/@ex{0}"), ("https://www.youtube.com/channel/UC{0}/about", "youtube", "https://youtube.com/channel/UC{0}"),
    ("https://youtu.be/{0}", None, None), ("https://www.tiktok.com/@ex{0}", "tiktok", "https://tiktok.com/@ex{0}"), ("https://tiktok.com/ex{0}", None, None), ("https://notfacebook.com/{0}", None, None),
)


def _case(items, key: str, total: int) -> str:
    arms = " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("{0}", "' || CAST(c_custkey AS STRING) || '") + "'") for i, v in enumerate(items))
    return f"CASE {key} % {total} {arms} END"


@query(
    "scl_07_canonical_social",
    f"SELECT c_custkey, {_case([p for _, p, _ in _SOCIAL], 'c_custkey', len(_SOCIAL))} AS platform, {_case([u for _, _, u in _SOCIAL], 'c_custkey', len(_SOCIAL))} AS url FROM customer",
)
def canonical_social(spark, folder):
    raw = F.expr(_case([u for u, _, _ in _SOCIAL], "c_custkey", len(_SOCIAL)))
    return load(spark, folder, "customer").select("c_custkey", U.canonical_social(raw).alias("s")).select("c_custkey", "s.platform", "s.url")


_PAGE = ("https://no.linkedin.com/company/Ex-{0}/jobs?x=1", "https://linkedin.com/in/a{0}", "https://linkedin.com.evil.no/company/a{0}", "http://www.LinkedIn.com/Company/b{0}")


@query(
    "scl_08_company_url",
    "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'https://linkedin.com/company/ex-' || CAST(c_custkey AS VARCHAR) WHEN 3 THEN 'https://linkedin.com/company/b' || CAST(c_custkey AS VARCHAR) END AS url FROM customer",
)
def company_url(spark, folder):
    return load(spark, folder, "customer").select("c_custkey", U.company_url(F.expr(_case(_PAGE, "c_custkey", 4))).alias("url"))


@query(
    "scl_09_phone",
    base.oracle("registry", """SELECT organisasjonsnummer AS org, right(regexp_replace(telefon || mobil, '[^0-9]', '', 'g'), 8) AS phone, right('47' || c_custkey, 8) AS short FROM registry"""),
)
def phone(spark, folder):
    return base.registry_raw(spark, folder).select(
        F.col("organisasjonsnummer").alias("org"), T.phone8(F.concat("telefon", "mobil")).alias("phone"), T.phone8(F.concat(F.lit("47-"), F.col("c_custkey").cast("string"))).alias("short")
    )


@query(
    "scl_10_hash_ids",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN sha256(CAST(o_orderkey AS VARCHAR)) WHEN o_orderkey % 3 = 1 THEN sha256(o_orderpriority) ELSE sha256(CAST(o_custkey AS VARCHAR) || 'seed') END AS sha,
    substr(sha256(CAST(o_orderkey AS VARCHAR) || '|' || COALESCE(CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END, chr(0))), 1, 24) AS task FROM orders""",
)
def hash_ids(spark, folder):
    k = F.col("o_orderkey")
    value = F.when(k % 3 == 0, F.upper(F.sha2(k.cast("string"), 256))).when(k % 3 == 1, F.col("o_orderpriority"))
    return load(spark, folder, "orders").select(
        k, ids.sha64(value, F.concat(F.col("o_custkey").cast("string"), F.lit("seed"))).alias("sha"), ids.short_id(k, F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus"))).alias("task")
    )


@query(
    "scl_11_iso_time",
    "SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL WHEN 2 THEN epoch_us(date_trunc('second', ts)) - 7200000000 ELSE epoch_us(date_trunc('second', ts)) END AS micros FROM events",
)
def iso_time(spark, folder):
    k = F.col("event_id") % 4
    body = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(k == 0, F.concat(body, F.lit("Z"))).when(k == 1, body).when(k == 2, F.concat(body, F.lit("+02:00"))).otherwise(F.concat(F.lit("on "), body))
    return load(spark, folder, "events").select("event_id", F.unix_micros(D.iso_ts(raw)).alias("micros"))


@query(
    "scl_12_feed_date",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00' WHEN 2 THEN strftime(ts, '%Y-%m-%d') WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M') || ':00-05:00' ELSE 'soon' END AS published FROM events""",
)
def feed_date(spark, folder):
    k = F.col("event_id") % 5
    raw = (
        F.when(k == 0, F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss 'GMT'")).when(k == 1, F.date_format("ts", "dd MMM yyyy HH:mm:ss '+0200'"))
        .when(k == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 3, F.date_format("ts", "EEE, dd MMM yyyy HH:mm 'EST'")).otherwise(" soon ")
    )
    return load(spark, folder, "events").select("event_id", D.feed_date(raw).alias("published"))


@query("scl_13_dated_text", f"SELECT doc_id, regexp_extract(text || ' 12.3.' || CAST(doc_id AS VARCHAR), '({D.DATE_TEXT})', 1) AS found FROM documents")
def dated_text(spark, folder):
    return load(spark, folder, "documents").select("doc_id", D.dated(F.concat("text", F.lit(" 12.3."), F.col("doc_id").cast("string"))).alias("found"))


@query(
    "scl_14_headline",
    """SELECT page_id, trim(regexp_replace(regexp_extract(rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), '([^/]*)$', 1), '[-_]+', ' ', 'g')) AS headline FROM (SELECT page_id, replace(url, '/en/', '/en/ny-rigg_') AS url FROM pages)""",
)
def headline(spark, folder):
    return load(spark, folder, "pages").select("page_id", U.headline(F.replace("url", F.lit("/en/"), F.lit("/en/ny-rigg_"))).alias("headline"))


@query(
    "scl_15_ocr_number",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(c AS DOUBLE) WHEN 1 THEN CASE WHEN c * 1000 <= 100000 THEN c * 1000.0 END WHEN 2 THEN c + 0.5 WHEN 3 THEN c + 0.25 END AS number FROM (SELECT o_orderkey, o_custkey % 900 + 1 AS c FROM orders)""",
)
def ocr_number(spark, folder):
    k, c = F.col("o_orderkey") % 5, (F.col("o_custkey") % 900 + 1).cast("string")
    raw = (
        F.when(k == 0, F.concat(F.replace(c, F.lit("0"), F.lit("O")), F.lit(" ."))).when(k == 1, F.concat(c, F.lit(".OOO"))).when(k == 2, F.concat(c, F.lit(",5")))
        .when(k == 3, F.concat(c, F.lit(".25"))).otherwise(F.concat(c, F.lit("x")))
    )
    return load(spark, folder, "orders").select("o_orderkey", T.ocr_number(raw).alias("number"))


@query(
    "scl_16_ratings",
    """SELECT event_id, CASE WHEN r > 0 AND r <= 5 THEN r END AS rating, CASE WHEN value / 50 <= 2 THEN 'negative' WHEN value / 50 >= 4 THEN 'positive' ELSE 'neutral' END AS label
    FROM (SELECT *, floor(value / 40 * (5.0 / CASE WHEN event_type = 'view' THEN 10.0 ELSE 5.0 END) * 100 + 0.5) / 100 AS r FROM events)""",
)
def ratings(spark, folder):
    best = F.when(F.col("event_type") == "view", 10.0).when(F.col("event_type") == "error", 0.0)
    return load(spark, folder, "events").select("event_id", M.rating5(F.col("value") / 40, best).alias("rating"), M.star_label(F.col("value") / 50).alias("label"))


@query(
    "scl_18_period_label",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN d || ' to ' || d WHEN 1 THEN d WHEN 2 THEN d ELSE 'the latest filed year' END AS period FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)""",
)
def period_label(spark, folder):
    k, d = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd")
    return load(spark, folder, "orders").select("o_orderkey", T.period_label(F.when(k < 2, d).otherwise(""), F.when((k == 0) | (k == 2), d)).alias("period"))


ERF_SQL = "sign({x}) * CASE WHEN abs({x}) < 1e-300 THEN 0 ELSE least(1.0, list_sum(list_transform(range(0, 160), lambda n: exp((2 * n + 1) * ln(greatest(least(abs({x}), 6.0), 1e-300)) - lgamma(n + 1.5) - least(abs({x}), 6.0) * least(abs({x}), 6.0))))) END"
_FP = "SELECT event_id, value + 1 AS price, CASE WHEN k % 10 = 0 THEN value + 1 ELSE value + (k - 50) / 200.0 + 1.2 END AS target, k * 7.0 AS seconds, 0.2 + k / 100.0 AS vol FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)"
_D = "(ln(price / target) - 0.5 * s * s) / s / sqrt(2.0)"


@query(
    "scl_19_fair_prob",
    f"""SELECT event_id, floor(CASE WHEN seconds <= 0 THEN CASE WHEN price > target THEN 1.0 ELSE 0.0 END ELSE 0.5 * (1 + ({ERF_SQL.format(x='d')})) END * 1e8 + 0.5) / 1e8 AS prob
    FROM (SELECT *, CASE WHEN seconds > 0 THEN {_D} ELSE 0 END AS d FROM (SELECT *, vol * sqrt(seconds / 31536000.0) AS s FROM ({_FP}) WHERE target > 0)) """,
)
def fair_prob(spark, folder):
    k = F.expr(base._K)
    e = load(spark, folder, "events").withColumn("k", k)
    target = F.when(F.col("k") % 10 == 0, F.col("value") + 1).otherwise(F.col("value") + (F.col("k") - 50) / 200.0 + 1.2)
    rows = e.select("event_id", (F.col("value") + 1).alias("price"), target.alias("target"), (F.col("k") * 7.0).alias("seconds"), (0.2 + F.col("k") / 100.0).alias("vol"))
    return rows.where("target > 0").select("event_id", M.half_up(M.fair_prob(F.col("price"), F.col("target"), F.col("seconds"), F.col("vol")), 8).alias("prob"))


LEVELS_SQL = """SELECT l_orderkey, CAST(l_discount AS DECIMAL(4,2)) + 0.50 AS price, sum(CAST(l_quantity AS DECIMAL(18,2))) AS size FROM lineitem GROUP BY 1, 2"""
base.VIEWS["levels"] = ((), LEVELS_SQL)


def books(spark, folder):
    """One book per order: price levels (at most eleven) with their summed sizes, asks ascending."""
    price = (F.col("l_discount").cast("decimal(4,2)") + F.lit(0.5).cast("decimal(4,2)")).cast("double")
    levels = load(spark, folder, "lineitem").groupBy("l_orderkey", price.alias("price")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("size"))
    return levels.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("price", "size"))).alias("levels"))


@query(
    "scl_20_side_fees",
    base.oracle("levels", """SELECT l_orderkey, floor((sum(0.07 * size * price * (1 - price) ORDER BY price) + 1e-12) * 100000 + 0.5) / 100000 + floor((sum(price * size ORDER BY price) * 0.01 + 1e-12) * 100000 + 0.5) / 100000 AS fees
    FROM (SELECT l_orderkey, CAST(price AS DOUBLE) AS price, CAST(size AS DOUBLE) AS size FROM levels) GROUP BY 1"""),
)
def side_fees(spark, folder):
    return books(spark, folder).select("l_orderkey", M.side_fees(F.col("levels")).alias("fees"))


@query(
    "scl_21_closed_label",
    "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'mixed' WHEN 2 THEN NULL ELSE 'neutral' END AS label FROM orders",
)
def closed_label(spark, folder):
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, " Positive. ").when(k == 1, '"MIXED"').when(k == 2, "bullish").otherwise("neutral!")
    return load(spark, folder, "orders").select("o_orderkey", T.closed_label(raw).alias("label"))
