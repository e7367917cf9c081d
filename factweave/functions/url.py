"""URL functions as Column builders."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from . import constants as K
from .text import clean, let, text

_HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_NETLOC = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)"
_PATH = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)"


def raw_host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(text(url), _HOST, 1))


def host(url: Column | str) -> Column:
    """Host in lower case without a leading www; empty if the URL has none."""
    return F.regexp_replace(raw_host(url), r"^www\.", "")


def netloc(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(text(url), _NETLOC, 1))


def path(url: Column | str) -> Column:
    return F.regexp_extract(text(url), _PATH, 1)


def segments(url: Column | str) -> Column:
    return F.filter(F.transform(F.split(path(url), "/"), lambda s: F.trim(s)), lambda s: s != "")


def with_scheme(value: Column | str) -> Column:
    v = clean(value)
    return F.when(v.contains("://"), v).otherwise(F.concat(F.lit("https://"), v))


def homepage(value: Column | str) -> Column:
    """Absolute http(s) home page without query and fragment, or NULL."""
    v = clean(value)
    full = F.when(v.rlike("(?i)^https?://"), v).otherwise(F.concat(F.lit("https://"), v))
    scheme = F.lower(F.regexp_extract(full, r"^([a-zA-Z]+)://", 1))
    place = F.regexp_extract(full, _NETLOC, 1)
    p = path(full)
    return F.when(
        (v != "") & (raw_host(full) != ""),
        F.concat(scheme, F.lit("://"), place, F.when(p == "", F.lit("/")).otherwise(p)),
    )


def site_host(value: Column | str) -> Column:
    """Host of a value that may lack a scheme; empty if blank."""
    return F.when(clean(value) == "", F.lit("")).otherwise(host(with_scheme(value)))


def registered_domain(url: Column | str, suffixes: Iterable[str] = K.TWO_LABEL_SUFFIXES) -> Column:
    """Registrable domain: one label more than the longest listed public suffix (else the last label)."""
    labels = F.split(raw_host(url), r"\.")
    n = F.size(labels)

    def last(k: int) -> Column:
        return F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), F.lit(k)), ".")

    suffixes = tuple(suffixes)
    longest = max((s.count(".") + 1 for s in suffixes), default=1)
    suffix_len = F.lit(1)
    for k in range(2, longest + 1):
        group = [s for s in suffixes if s.count(".") + 1 == k]
        if group:
            suffix_len = F.when(last(k).isin(*group), F.lit(k)).otherwise(suffix_len)
    out = F.array_join(F.slice(labels, F.greatest(n - suffix_len, F.lit(1)), suffix_len + 1), ".")
    return F.when(n > suffix_len, out).otherwise(F.lit(""))


def canonical_social(url: Column | str) -> Column:
    """``struct(platform, url)`` of a public profile, or NULL for anything that is not one."""
    parsed = F.struct(host(url).alias("host"), segments(url).alias("parts"))
    return let(parsed, lambda u: _profile(u["host"], u["parts"]))


def _profile(h: Column, parts: Column) -> Column:
    first = F.lower(F.get(parts, F.lit(0)))
    handle = F.get(parts, F.lit(0)).startswith("@")
    platform = F.lit(None).cast("string")
    for name, label in K.SOCIAL_HOSTS.items():
        platform = F.when((h == name) | h.endswith("." + name), F.lit(label)).otherwise(platform)
    rejected = F.lit(False)
    for label, names in K.SOCIAL_REJECTED_SEGMENTS.items():
        rejected = rejected | ((platform == label) & first.isin(*names))
    valid = (
        F.when(platform == "linkedin", (first == "company") & (F.size(parts) >= 2))
        .when(platform == "youtube", (first.isin("channel", "user", "c") | handle) & (h != "youtu.be"))
        .when(platform == "tiktok", handle)
        .when(platform == "x", F.size(parts) == 1)
        .otherwise(F.lit(True))
    )
    kept = (
        F.when(platform == "linkedin", F.slice(parts, 1, 2))
        .when((platform == "youtube") & handle, F.slice(parts, 1, 1))
        .when(platform == "youtube", F.slice(parts, 1, 2))
        .otherwise(parts)
    )
    address = F.concat(F.lit("https://"), platform, F.lit(".com/"), F.array_join(kept, "/"))
    ok = platform.isNotNull() & (F.size(parts) > 0) & ~rejected & valid
    return F.when(ok, F.struct(platform.alias("platform"), address.alias("url")))


def company_url(url: Column | str) -> Column:
    """Canonical company page of the professional network, or NULL."""
    h = raw_host(url)
    parts = segments(url)
    ok = (
        ((h == "linkedin.com") | h.endswith(".linkedin.com"))
        & (F.size(parts) >= 2)
        & (F.lower(F.get(parts, F.lit(0))) == "company")
    )
    return F.when(ok, F.concat(F.lit("https://linkedin.com/company/"), F.lower(F.get(parts, F.lit(1)))))


def absolute(base: Column | str, href: Column | str) -> Column:
    """Link target against its page: absolute, scheme-relative, rooted, fragment, query or relative."""
    b, h = text(base), clean(href)
    scheme = F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1)
    root = F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    base_path = path(b)
    folder = F.regexp_extract(base_path, r"^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    no_fragment = F.regexp_replace(b, "#.*$", "")
    return (
        F.when(h == "", b)
        .when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(h.startswith("/"), F.concat(root, h))
        .when(h.startswith("#"), F.concat(no_fragment, h))
        .when(h.startswith("?"), F.concat(root, base_path, h))
        .otherwise(F.concat(root, folder, h))
    )


def headline(url: Column | str) -> Column:
    """Readable words of the last path segment."""
    tail = F.regexp_extract(F.regexp_replace(path(url), "/+$", ""), r"([^/]*)$", 1)
    return F.trim(F.regexp_replace(tail, "[-_]+", " "))


def is_blocked(h: Column, blocked: Iterable[str] = K.BLOCKED_SITE_HOSTS) -> Column:
    out = F.lit(False)
    for name in blocked:
        out = out | (h == name) | h.endswith("." + name)
    return out


def is_skipped(h: Column, parts: Iterable[str] = K.SKIPPED_HOST_PARTS) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | h.contains(part)
    return out


def is_careers(url: Column | str, title: Column | str) -> Column:
    hay = F.lower(F.concat_ws(" ", text(url), text(title)))
    out = F.lit(False)
    for term in K.CAREERS_TERMS:
        out = out | hay.contains(term)
    return out


def is_news_path(url: Column | str) -> Column:
    return path(url).rlike(K.NEWS_PATH)


def is_article_path(url: Column | str) -> Column:
    p = F.lower(path(url))
    out = F.lit(False)
    for term in K.ARTICLE_PATH_TERMS:
        out = out | p.contains(term)
    return out


def depth(url: Column | str) -> Column:
    return F.size(F.filter(F.split(path(url), "/"), lambda s: s != ""))
