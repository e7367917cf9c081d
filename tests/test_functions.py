import difflib
import math
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from factweave.functions import ids, numeric as M, text as T, timefn as D, url as U
from factweave.functions.registry import register_functions


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("r")).first()["r"]


def test_fold_tokens(spark):
    assert one(spark, T.identity_tokens("x"), x="Blåbær Ærlig AS, Crème b/v!") == ["blabaer", "aerlig", "creme"]
    assert one(spark, T.slug("x"), x="Møbel & Tre A/S") == "mobel-tre-a-s"


@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=20), min_size=5, max_size=20))
@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_fold_matches_full_folding_on_letters(spark, values):
    """The accent table agrees with full compatibility folding wherever that gives one character."""
    def plain(s):
        s = s.translate(str.maketrans({"ø": "o", "Ø": "O", "å": "a", "Å": "A", "æ": "ae", "Æ": "AE"}))
        s = "".join(c for c in s if len(unicodedata.normalize("NFKD", c).encode("ascii", "ignore")) < 2)
        return unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower()

    values = ["".join(c for c in v if len(unicodedata.normalize("NFKD", c).encode("ascii", "ignore")) < 2) for v in values]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", T.fold("v").alias("f")).collect()
    assert all(r.f == plain(r.v) for r in rows)


def test_orgnr(spark):
    verdict = lambda org, t: one(spark, ids.orgnr_verdict(F.lit(org), F.col("t")), t=t)
    assert verdict("923609016", "Org.nr 923 609 016") == "match"
    assert verdict("923609016", "Org.nr 923.609.016 MVA") == "match"
    assert verdict("923609016", "org 974760673") == "conflict"
    assert verdict("923609016", "tlf 123456789") == "none"
    assert one(spark, ids.orgnr_valid(F.lit("123456789"))) is False


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://www.facebook.com/Example/", ("facebook", "https://facebook.com/Example")),
        ("https://linkedin.com/company/example/admin/feed/posts", ("linkedin", "https://linkedin.com/company/example")),
        ("https://facebook.com/sharer.php?u=x", None), ("https://facebook.com/events/1", None), ("https://facebook.com/groups/1", None),
        ("https://facebook.com/policy.php", None), ("https://facebook.com/privacy/x", None), ("https://linkedin.com/shareArticle?x", None),
        ("https://instagram.com/p/abc", None), ("https://linkedin.com/in/someone", None), ("notaurl", None), ("", None),
    ],
)
def test_social_urls(spark, url, want):
    got = one(spark, U.canonical_social("u"), u=url)
    assert (got if got is None else tuple(got)) == want


def test_urls(spark):
    assert one(spark, U.homepage("u"), u=" example.no/a?b#c ") == "https://example.no/a"
    assert one(spark, U.homepage("u"), u="   ") is None
    assert one(spark, U.registered_domain("u"), u="https://a.b.example.co.uk/x") == "example.co.uk"
    assert one(spark, U.registered_domain("u"), u="https://www.example.no") == "example.no"
    base = "https://x.no/a/b?q"
    for href, want in (("/c", "https://x.no/c"), ("c.html", "https://x.no/a/c.html"), ("//y.no/d", "https://y.no/d"), ("?z=1", "https://x.no/a/b?z=1"), ("mailto:a@b", "mailto:a@b")):
        assert one(spark, U.absolute(F.lit(base), "h"), h=href) == want


def test_numbers(spark):
    assert one(spark, T.ocr_number("x"), x="1O.5") == 10.5
    assert one(spark, T.ocr_number("x"), x="1.234") == 1234.0
    assert one(spark, T.ocr_number("x"), x="1.234,5") == 1234.5
    assert one(spark, T.ocr_number("x"), x="100001") is None
    fees = M.side_fees(F.array(F.struct(F.lit(0.5).alias("price"), F.lit(5.0).alias("size"))))
    assert one(spark, fees) == pytest.approx(0.1125)
    assert one(spark, T.closed_label("x"), x=" Positive. ") == "positive"
    assert one(spark, T.closed_label("x"), x="bullish") is None


def test_erf_and_fair_prob(spark):
    rows = spark.range(-700, 701).select((F.col("id") / 100.0).alias("x")).select("x", M.erf(F.col("x")).alias("e")).collect()
    assert max(abs(r.e - math.erf(r.x)) for r in rows) < 1e-15
    df = spark.createDataFrame([(100.0, 99.0, 60.0, 0.6), (100.0, 100.5, 0.0, 0.6), (101.0, 100.0, -1.0, 0.5)], "p double, t double, s double, v double")
    for r in df.select(M.fair_prob(F.col("p"), F.col("t"), F.col("s"), F.col("v")).alias("a"), M.fair_prob_exact("p", "t", "s", "v").alias("b")).collect():
        assert r.a == pytest.approx(r.b, abs=1e-14)


def test_fuzzy_ratio_and_sql_names(spark):
    pairs = [("norsk fiskeeksport", "norsk fiske eksport"), ("a", ""), ("abc", "abd")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r.r for r in df.select(T.fuzzy_ratio("a", "b").alias("r")).collect()]
    assert got == [difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in pairs]
    register_functions(spark)
    words = [("923609016", "Blå AS"), ("923609017", "Crème"), ("x", "Nguyễn Ｆｕｌｌ ﬁrma"), (None, None), ("12", "Ærlig Ødegård ǆ"), ("", "a b-c'd")]
    frame = spark.createDataFrame(words, "o string, t string")
    same = frame.selectExpr("*", "orgnr_valid(o) v", "fold_text(t) f", "fold_tokens(t) w").withColumns({"v2": F.coalesce(ids.orgnr_valid("o"), F.lit(False)), "f2": T.fold("t"), "w2": T.identity_tokens("t")}).collect()
    assert all((r.v, r.f, r.w) == (r.v2, r.f2, r.w2) for r in same)
    assert [r.f for r in same] == ["bla as", "creme", "nguyen full firma", "", "aerlig odegard dz", "a b-c'd"] and same[0].v


def test_feed_dates(spark):
    assert one(spark, D.feed_date("x"), x="Mon, 22 Sep 2025 08:00:00 +0200") == "2025-09-22T08:00:00+02:00"
    assert one(spark, D.feed_date("x"), x="2025-09-22T08:00:00Z") == "2025-09-22"
    assert one(spark, D.iso_ts("x"), x="not a time") is None
