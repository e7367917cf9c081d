"""Queries over content extraction from captures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extract as X
from ..operators.domains import suffix_rules
from . import base
from .catalog import load, query, spread
from .scalars import rule_lines

ORG = "organisation_number"
_UN = "replace(replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&#x27;', chr(39)), '&nbsp;', ' '), '&amp;', '&')"
_SQUASH = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_TEXT = _SQUASH.format(_UN.format("regexp_replace({}, '<[^>]*>', ' ', 'g')"))


@query(
    "ext_01_page_events",
    base.oracle("crawl_events", f"""SELECT page_id, status, strlen(html) AS bytes, sha256(html) AS content_sha256, CASE WHEN status = 'available' THEN {_TEXT.format("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")} END AS title,
    CASE WHEN status = 'available' THEN {_TEXT.format("regexp_extract(html, '(?is)(<footer>.*?</footer>)', 1)")} END AS identity_text, CASE WHEN status = 'available' THEN {_TEXT.format("regexp_extract(html, '(?is)<article>(.*?)</article>', 1)")} END AS main_text FROM crawl_events"""),
)
def page_events(spark, folder):
    return X.page_events(base.captures(spark, folder)).select(
        "page_id", "status", F.col("bytes").cast("long").alias("bytes"), "content_sha256", "title", "identity_text", "main_text"
    )


@query(
    "ext_02_page_socials",
    """SELECT page_id, 'facebook' AS platform, 'https://facebook.com/Pa' || CAST(page_id AS VARCHAR) AS url FROM pages UNION ALL SELECT page_id, 'x', 'https://x.com/p' || CAST(page_id % 7 AS VARCHAR) FROM pages
    UNION ALL SELECT page_id, 'instagram', 'https://instagram.com/i' || CAST(page_id AS VARCHAR) FROM pages UNION ALL SELECT page_id, 'tiktok', 'https://tiktok.com/@t' FROM pages""",
)
def page_socials(spark, folder):
    k = F.col("page_id").cast("string")
    extra = F.concat(
        F.lit('<a class="s" href="https://www.facebook.com/Pa'), k, F.lit('/">f</a><a href=\'//twitter.com/p'), (F.col("page_id") % 7).cast("string"),
        F.lit('\'>x</a><div data-href="https://instagram.com/i'), k, F.lit('"></div><iframe src="https://www.facebook.com/plugins/page.php?href=https%3A%2F%2Fwww.tiktok.com%2F%40t&amp;w=1"></iframe><a href="https://facebook.com/groups/g">g</a>'),
    )
    return X.page_socials(load(spark, folder, "pages").select("page_id", F.col("url").alias("final_url"), F.concat("html", extra).alias("html")))


def jsonld_pages(spark, folder):
    """One page per customer whose structured data is made of the customer's columns."""
    q, key = F.lit('"'), F.col("c_custkey").cast("string")
    body = F.concat(
        F.lit('{"@context":"https://schema.org","@graph":[{"@type":"Corporation","name":"'), "c_name", F.lit('","telephone":" 22 '), key, F.lit(' ","email":"mailto:a'), key,
        F.lit('@b.no","numberOfEmployees":{"@type":"QuantitativeValue","value":"'), key, F.lit('"},"foundingDate":"","address":{"streetAddress":"Gata 1","addressLocality":"'), "c_mktsegment",
        F.lit('"},"sameAs":["https://www.facebook.com/F'), key, F.lit('/","https://x.com/intent"],"aggregateRating":{"ratingValue":"8.0","reviewCount":'), key,
        F.lit(',"bestRating":10},"department":[{"@type":"Store","telephone":"999","foundingDate":"1999-01-01"}]},{"@type":["JobPosting"],"title":"Clerk '), key,
        F.lit('","hiringOrganization":{"name":"'), "c_name", F.lit('"},"datePosted":"2026-01-02"},{"@type":"JobPosting","datePosted":"2026"},{"@type":"NewsArticle","headline":["",'), q,
        F.lit("News "), key, F.lit('"],"datePublished":"2026-02-02","mainEntityOfPage":"https://n.no/'), key, F.lit('"},{"@type":"BlogPosting","name":"No date"}]}'),
    )
    html = F.concat(F.lit("<html><script type='application/ld+json'>"), body, F.lit('</script><script type="application/ld+json">{broken</script></html>'))
    return spread(load(spark, folder, "customer")).select(F.col("c_custkey").alias("page_id"), F.concat(F.lit("https://s"), key, F.lit(".no/")).alias("final_url"), html.alias("html"))


def nodes(spark, folder):
    return X.jsonld_nodes(jsonld_pages(spark, folder))


@query(
    "ext_03_jsonld_organisations",
    "SELECT c_custkey AS page_id, t AS kind, CASE t WHEN 'Store' THEN NULL ELSE c_name END AS name FROM customer, (VALUES ('Corporation'), ('Store')) v(t)",
)
def jsonld_organisations(spark, folder):
    return X.organisation_nodes(nodes(spark, folder)).select("page_id", F.col("kinds")[0].alias("kind"), "name")


@query("ext_04_sameas_socials", "SELECT c_custkey AS page_id, 'facebook' AS platform, 'https://facebook.com/F' || CAST(c_custkey AS VARCHAR) AS url FROM customer")
def sameas_socials(spark, folder):
    return X.sameas_socials(nodes(spark, folder))


@query(
    "ext_05_org_facts",
    """SELECT c_custkey AS page_id, '22 ' || CAST(c_custkey AS VARCHAR) AS telephone, 'a' || CAST(c_custkey AS VARCHAR) || '@b.no' AS email, '1999-01-01' AS founding_date, CAST(c_custkey AS VARCHAR) AS employees_reported, 'Gata 1, ' || c_mktsegment AS address FROM customer""",
)
def org_facts(spark, folder):
    return X.org_facts(nodes(spark, folder))


@query("ext_06_job_postings", "SELECT c_custkey AS page_id, 'Clerk ' || CAST(c_custkey AS VARCHAR) AS title, '2026-01-02' AS date_posted, c_name AS hiring_organization FROM customer")
def job_postings(spark, folder):
    return X.job_postings(nodes(spark, folder)).select("page_id", "title", "date_posted", "hiring_organization")


@query("ext_07_articles", "SELECT c_custkey AS page_id, 'News ' || CAST(c_custkey AS VARCHAR) AS headline, '2026-02-02' AS date_published, 'https://n.no/' || CAST(c_custkey AS VARCHAR) AS url FROM customer")
def articles(spark, folder):
    return X.articles(nodes(spark, folder)).drop("seq")


@query(
    "ext_08_dated_items",
    """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Ny rigg' ELSE 'Sak to' END AS headline, CASE WHEN page_id % 2 = 0 THEN '2025-09-22' ELSE '12.03.2025' END AS date_published,
    regexp_extract(url, '^([a-z]+://[^/]+)', 1) || CASE WHEN page_id % 2 = 0 THEN '/n/1' ELSE '/aktuelt/a' END AS url FROM pages""",
)
def dated_items(spark, folder):
    extra = F.when(F.col("page_id") % 2 == 0, '<ul><li><a href="/n/1">Ny <b>rigg</b></a> <time datetime="2025-09-22">22. sep</time></li></ul>').otherwise(
        '<div class="k"><a href="/aktuelt/a">Sak to</a> publisert 12.03.2025</div>'
    )
    pages = load(spark, folder, "pages").select("page_id", F.col("url").alias("final_url"), F.concat("html", extra).alias("html"))
    return X.dated_items(pages).select("page_id", "headline", "date_published", "url")


@query(
    "ext_09_feed_items",
    """SELECT event_id AS page_id, 'Item ' || event_type AS headline, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS date_published, 'https://f.no/a/' || CAST(event_id AS VARCHAR) AS url FROM events WHERE event_id % 3 <> 2
    UNION ALL SELECT event_id, 'Two', strftime(ts, '%Y-%m-%d'), 'https://f.no/feed' FROM events WHERE event_id % 3 = 0""",
)
def feed_items(spark, folder):
    key = F.col("event_id").cast("string")
    mail = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    rss = F.concat(
        F.lit("<rss><channel><title>T</title><item><title>Item "), "event_type", F.lit("</title><link>/a/"), key, F.lit("</link><pubDate>"), mail,
        F.lit("</pubDate></item><item><title>Two</title><pubDate>"), F.date_format("ts", "yyyy-MM-dd"), F.lit("</pubDate></item><item><title>Undated</title></item></channel></rss>"),
    )
    atom = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Item '), "event_type", F.lit('</title><link href="https://f.no/a/'), key, F.lit('"/><updated>'), mail, F.lit("</updated></entry></feed>")
    )
    body = F.when(F.col("event_id") % 3 == 0, rss).when(F.col("event_id") % 3 == 1, atom).otherwise("<rss><broken")
    return X.feed_items(load(spark, folder, "events").select(F.col("event_id").alias("page_id"), F.lit("https://f.no/feed").alias("url"), body.alias("body"))).drop("seq")


@query(
    "ext_09_feed_links",
    "SELECT page_id, regexp_extract(url, '^([a-z]+://[^/]+)', 1) || '/rss.xml' AS url FROM pages WHERE page_id % 2 = 0",
)
def feed_links(spark, folder):
    head = F.when(F.col("page_id") % 2 == 0, '<link rel="alternate" type="application/rss+xml" href="https://other.org/f"><link href="/rss.xml" type="application/atom+xml" rel="alternate">').otherwise('<link rel="alternate" href="/x">')
    return X.feed_links(load(spark, folder, "pages").select("page_id", F.col("url").alias("final_url"), F.concat(head, F.col("html")).alias("html")))


@query(
    "ext_09_feed_links_by_rules",
    """SELECT page_id, CASE WHEN url LIKE '%.example.com/%' THEN 'https://other.example.com/f' ELSE regexp_extract(url, '^([a-z]+://[^/]+)', 1) || '/rss.xml' END AS url FROM pages""",
)
def feed_links_by_rules(spark, folder):
    """A feed on a sister host comes first; under the rules it is the page's own only where one label stands under the suffix."""
    sister = F.concat(F.lit('<link rel="alternate" type="application/rss+xml" href="https://other.'), F.regexp_extract("url", r"://[^/]*?([^./]+\.[^./]+)(?:/|$)", 1), F.lit('/f"><link rel="alternate" type="application/atom+xml" href="/rss.xml">'))
    pages = load(spark, folder, "pages").select("page_id", F.col("url").alias("final_url"), F.concat(sister, F.col("html")).alias("html"))
    return X.feed_links(pages, suffixes=suffix_rules(rule_lines(spark, folder)))


@query(
    "ext_10_sitemap_items",
    """SELECT o_custkey AS page_id, 'ny rigg ' || CAST(o_orderkey AS VARCHAR) AS headline, strftime(o_orderdate, '%Y-%m-%d') AS date_published, 'https://s.no/ny-rigg_' || CAST(o_orderkey AS VARCHAR) AS url FROM
    (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders)""",
)
def sitemap_items(spark, folder):
    # a site's map is written from its orders; the map of one site is a stored body like any other
    entry = F.concat(F.lit("<url><loc>https://s.no/ny-rigg_"), F.col("o_orderkey").cast("string"), F.lit("/</loc><lastmod>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T01:02:03Z</lastmod></url>"))
    body = load(spark, folder, "orders").groupBy(F.col("o_custkey").alias("page_id")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("o_orderkey", entry.alias("e"))))["e"], "").alias("b"))
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "b", F.lit("<url><loc>https://s.no/</loc><lastmod>2099-01-01</lastmod></url></urlset>"))
    out = X.sitemap_items(body.select("page_id", F.lit("https://s.no/").alias("url"), xml.alias("body")))
    return out.select("page_id", "headline", "date_published", F.regexp_replace("url", "/$", "").alias("url"))


@query("ext_10_sitemap_links", "SELECT page_id, regexp_extract(url, '^([a-z]+://[^/]+)', 1) || CASE WHEN page_id % 2 = 0 THEN '/map.xml' ELSE '/sitemap.xml' END AS url FROM pages")
def sitemap_links(spark, folder):
    head = F.when(F.col("page_id") % 2 == 0, '<link rel="sitemap" href="/map.xml">').otherwise("")
    return X.sitemap_links(load(spark, folder, "pages").select("page_id", F.col("url").alias("final_url"), F.concat(head, F.col("html")).alias("html")))


@query("ext_11_js_shell", "SELECT page_id, page_id % 3 = 0 AS shell FROM pages")
def js_shell(spark, folder):
    scripts = F.lit('<script src="a.js"></script><SCRIPT defer SRC="b.js"></SCRIPT>')
    html = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<body><div id=root></div>"), scripts)).when(F.col("page_id") % 3 == 1, F.concat(F.col("html"), scripts)).otherwise('<body>x<script src="a.js"></script>')
    return load(spark, folder, "pages").select("page_id", X.js_shell(X.main_text(html), html).alias("shell"))


@query("ext_12_aggregate_ratings", "SELECT c_custkey AS page_id, 8.0::DOUBLE AS rating, c_custkey AS review_count, 4.0::DOUBLE AS rating5 FROM customer")
def aggregate_ratings(spark, folder):
    return X.aggregate_ratings(nodes(spark, folder))


_PHRASES = (
    ("Antall aarsverk i regnskapsaret: 3", "accepted", 3.0, "full_time_equivalents"), ("Det er to ansatte i sameiet.", "accepted", 2.0, "employees"),
    ("Stiftelsen har ingen ansatte og ingen arsverk.", "accepted", 0.0, "employees"), ("Antall ansatte 5\nAntall ansatte 7", "conflicting_employee_counts", None, None),
    ("Konsernet: antall ansatte 900", "no_employee_phrase", None, None), ("Gjennomsnittlig antall ansatte er 1.2O4\nSelskapet har 12,5 årsverk", "accepted", 12.5, "full_time_equivalents"),
    ("intet", "no_employee_phrase", None, None),
)


def _arms(i):
    return "CASE doc_id % 7 " + " ".join(f"WHEN {n} THEN " + ("NULL" if p[i] is None else f"'{p[i]}'" if isinstance(p[i], str) else str(p[i])) for n, p in enumerate(_PHRASES)) + " END"


@query("ext_13_workforce", f"SELECT doc_id, {_arms(1)} AS status, CAST({_arms(2)} AS DOUBLE) AS value, {_arms(3)} AS measure FROM documents")
def workforce(spark, folder):
    phrase = F.expr(_arms(0).replace("\n", "\\n"))
    return X.workforce(spread(load(spark, folder, "documents")).select("doc_id", F.concat("text", F.lit("\n"), phrase, F.lit("\n"), "text").alias("text")), "doc_id").drop("span")


@query("ext_14_needs_ocr", "SELECT doc_id, length(trim(t)) < 100 OR NOT regexp_matches(t, '(?i)ansatt|aarsverk|arsverk|årsverk|sysselsatt') AS ocr FROM (SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN ' ANSATTE' ELSE '' END AS t FROM documents)")
def needs_ocr(spark, folder):
    t = F.concat("text", F.when(F.col("doc_id") % 2 == 0, " ANSATTE").otherwise(""))
    return load(spark, folder, "documents").select("doc_id", T.needs_ocr(t).alias("ocr"))


@query(
    "ext_15_org_page_profiles",
    """SELECT c_custkey AS page_id, c_name AS name, 'https://linkedin.com/company/c' || CAST(c_custkey AS VARCHAR) AS page_url, 1000 + c_custkey AS followers, c_custkey AS visible_employees, '11-50 employees' AS size_label, 1 AS posts, c_custkey AS likes FROM customer WHERE c_custkey % 4 <> 3""",
)
def org_page_profiles(spark, folder):
    key = F.col("c_custkey").cast("string")
    page = F.concat(F.lit("https://no.linkedin.com/company/C"), key)
    spaced = F.concat(F.lit("1 "), F.substring((F.col("c_custkey") + 1000).cast("string"), 2, 9))
    followers = F.when(F.col("c_custkey") < 1000, spaced).otherwise((F.col("c_custkey") + 1000).cast("string"))
    html = F.concat(
        F.lit('<meta name="description" content="X | '), followers, F.lit(' followers on net"><dl data-test-id="about-us__size"><dt>Size</dt><dd> 11-50 employees </dd></dl>'),
        F.lit('<script type="application/ld+json">{"@graph":[{"@type":"Organization","name":"'), "c_name", F.lit('","url":"'), page, F.lit('","numberOfEmployees":{"value":'), key,
        F.lit('}},{"@type":"DiscussionForumPosting","url":"https://net/posts/x-activity-7'), key, F.lit('-z","text":"hi","author":{"url":"'), page,
        F.lit('"}},{"@type":"DiscussionForumPosting","url":"u","author":{"url":"https://linkedin.com/company/other"}}]}</script><article class="a" data-activity-urn="urn:li:activity:7'), key,
        F.lit('"><a data-num-reactions="'), key, F.lit('"></a></article>'),
    )
    expected = F.concat(F.lit("https://linkedin.com/company/"), F.when(F.col("c_custkey") % 4 == 3, "wrong").otherwise(F.concat(F.lit("c"), key)))
    profiles, posts = X.org_page_profiles(spread(load(spark, folder, "customer")).select(F.col("c_custkey").alias("page_id"), expected.alias("expected_url"), html.alias("html")))
    counts = posts.groupBy("page_id").agg(F.count("*").alias("posts"), F.sum("likes").alias("likes"))
    return profiles.join(counts, "page_id").select("page_id", "name", "page_url", "followers", "visible_employees", F.col("employee_size_label").alias("size_label"), "posts", "likes")
