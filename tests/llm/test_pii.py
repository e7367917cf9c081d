import hashlib
import re

from hypothesis import given, settings, strategies as st

from factweave.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    twice = [int(d) * 2 if i % 2 else int(d) for i, d in enumerate(digits[::-1])]
    return sum(n // 10 + n % 10 for n in twice) % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "b@c.d", "@", ".", "-", "x.y", "+1", "(555)", " ", "555-0100", "4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "256", "0001", "9", "é", "١", "\n", "_%"]), max_size=14).map("".join))
def test_formal_spans_match_the_patterns(text):
    assert pii.formal_spans(text) == brute(text)


def test_long_runs_are_linear():
    assert pii.formal_spans("a" * 300_000 + " " + "1" * 300_000 + "." * 1000 + "+1" + "(" * 100_000) == []


def rows():
    leak = [(i, f"filler{i} Zanzibarski wrote from quill{i} mail zan@corp.example today number{i} ok") for i in range(6)]
    return leak + [(100 + i, f"plain text of document {i} that wrote from mail today ok") for i in range(60)]


def test_terms_that_disclose_are_found_and_hidden(spark, docs_of):
    docs = docs_of(rows() + [(200, None), (201, ""), (0, rows()[0][1])])
    got = {r.doc_id: r for r in pii.digests(pii.personal_data(docs, generalise=0.6)).collect()}
    text = rows()[2][1]
    at = text.index("Zanzibarski")
    assert f"term:{at}:{at + 11}" in got[2].spans and got[2].n_email == 1
    assert "wrote" not in {text[int(a) : int(b)] for k, a, b in (s.split(":") for s in got[2].spans.split(",")) if k == "term"}
    base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in brute(text))
    assert got[2].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert got[100].spans == "" and got[200].spans == "" and got[201].n_email == 0
    clean = {r.doc_id: r.text for r in pii.sanitise(docs, generalise=0.6).collect()}
    assert "Zanzibarski" not in clean[2] and "zan@corp.example" not in clean[2] and "[EMAIL]" in clean[2]
    assert clean[100] == rows()[6][1] and clean[200] is None
    assert len(pii.personal_data(docs).collect()) == len(rows()) + 3
    assert pii.digests(pii.personal_data(docs_of([]))).collect() == []


def test_document_counts_match_counting(spark, docs_of):
    docs = docs_of(rows() + [(300, None)])
    terms = spark.createDataFrame([("wrote",), ("zanzibarski",), ("nowhere",), ("ok",)], "term string")
    assert {r.term: r.docs for r in pii.document_counts(docs, terms).collect()} == {"wrote": 66, "zanzibarski": 6, "ok": 66}


def test_one_passage_in_copies_is_one_witness(spark, docs_of):
    copies = [(i, "Secretname has mail z@corp.example") for i in range(9)] + [(50 + i, f"other {i}") for i in range(50)]
    assert all("term" not in r.spans for r in pii.digests(pii.personal_data(docs_of(copies))).collect())
