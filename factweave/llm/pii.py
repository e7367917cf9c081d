"""Personal data: formal identifiers, and terms that disclose them by co-occurrence (operator 8).

Formal identifiers (mail and IP addresses, card and phone numbers) are the protected entities. How
strongly a term reveals an entity is estimated over the whole corpus: the pointwise mutual
information of term and entity, as a share of the entity's own information,
``1 + log2 p(entity | term) / -log2 p(entity)``. Terms beside an entity in at least ``support``
different passages whose share reaches ``generalise`` are generalised, from ``remove`` on removed,
in every document that holds the entity.

Defined cases: a null or empty text has no spans. Every row gives a row, repeated ids included. Offsets
are code points. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import MEMO, bit_table, map_batches, passes, stored

KINDS = ("email", "ip", "card", "phone", "term")
#: Patterns of the formal identifiers. The mail pattern is the part from @ on; what stands
#: before it is found backwards, so that long runs without @ cost nothing.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_BEFORE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Words, as terms: letters, digits and what joins them.
_TERM = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def formal_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the formal identifiers, by kind and start; leftmost, not overlapping within a kind."""
    out, last = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _BEFORE:
            start -= 1
        if start < m.start():
            out.append((0, start, m.end()))
            last = m.end()
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) < 4 and int(p or 0) < 256 for part in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _hidden(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The spans merged."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _terms(text: str, hidden: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """The terms of a text outside the hidden spans: (lower case, start, end)."""
    out, at = [], 0
    for m in _TERM.finditer(text):
        while at < len(hidden) and hidden[at][1] <= m.start():
            at += 1
        if at == len(hidden) or m.end() <= hidden[at][0]:
            out.append((m[0].lower(), m.start(), m.end()))
    return out


def identifiers(docs: DataFrame, window: int = 8) -> DataFrame:
    """Per row: doc_id, h, spans (kind, start, end), entities (entity, hash of its passage, terms within
    window terms) and, where there are any, the text."""

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            spans, found, texts = [], [], []
            for text in batch["text"].to_pylist():
                base = formal_spans(text) if text else []
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
                texts.append(text if base else None)
                entities = []
                if base:
                    terms = _terms(text, _hidden(text, base))
                    starts = np.array([t[1] for t in terms], np.int64)
                    for k, a, b in base:
                        i = int(np.searchsorted(starts, a))
                        near = [t[0] for t in terms[max(0, i - window) : i + window]]
                        value = re.sub(r"[^0-9]", "", text[a:b]) if k > 1 else text[a:b].lower()
                        entities.append({"entity": f"{KINDS[k]}:{value}", "passage": xxhash.xxh3_64_intdigest(" ".join(near)) - (1 << 63), "terms": list(dict.fromkeys(near))})
                found.append(entities)
            return {
                "doc_id": batch["doc_id"], "h": batch["h"], "text": pa.array(texts, pa.string()),
                "spans": pa.array(spans, pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))),
                "entities": pa.array(found, pa.list_(pa.struct([("entity", pa.string()), ("passage", pa.int64()), ("terms", pa.list_(pa.string()))]))),
            }

        return run

    return map_batches(_rows(docs), make, "doc_id long, h long, text string, spans array<struct<kind:int,start:long,end:long>>, entities array<struct<entity:string,passage:long,terms:array<string>>>")


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64("doc_id", text).alias("h"))


def document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, docs): in how many rows of the corpus each of the terms stands.

    A worker drops the terms that a bit table of fixed size rules out, adds up the others by batch and
    sends the sums; the join with terms drops what the table let through by chance.
    """
    maybe = stored(terms.select("term").distinct(), "terms")
    bits = docs.sparkSession.sparkContext.broadcast(np.packbits(bit_table(maybe.select(F.xxhash64("term").alias("hash")))))

    def make():
        table, memo = np.unpackbits(bits.value).view(bool), {}

        def known(term: str) -> bool:
            got = memo.get(term)
            if got is None:
                if len(memo) > MEMO:
                    memo.clear()
                got = memo[term] = bool(passes(table, np.array([xxhash.xxh64_intdigest(term.encode(), 42)], np.uint64))[0])  # as xxhash64() gives it
            return got

        def run(batch: pa.RecordBatch) -> dict:
            sums: Counter[str] = Counter()
            for text in batch["text"].to_pylist():
                if text:
                    sums.update(filter(known, set(map(str.lower, _TERM.findall(text)))))
            return {"term": pa.array(list(sums), pa.string()), "n": pa.array(list(sums.values()), pa.int64())}

        return run

    part = map_batches(docs.select(F.col("text").cast("string").alias("text")), make, "term string, n long")
    return part.groupBy("term").agg(F.sum("n").alias("docs")).join(maybe, "term", "left_semi")


def disclosing_terms(docs: DataFrame, found: DataFrame, support: int, generalise: float) -> DataFrame:
    """(entity, term, share): terms whose share of disclosure reaches generalise."""
    each = found.select("doc_id", "h", F.explode("entities").alias("e")).select("doc_id", "h", "e.*")
    pairs = each.select("doc_id", "h", "entity", "passage", F.explode("terms").alias("term"))
    beside = pairs.groupBy("entity", "term").agg(F.count_distinct("passage").alias("passages"), F.count_distinct("doc_id", "h").alias("both")).where(F.col("passages") >= support)
    beside = stored(beside, "beside")
    if beside.isEmpty():
        return beside.select("entity", "term", F.lit(0.0).alias("share"))
    entity = each.groupBy("entity").agg(F.count_distinct("doc_id", "h").alias("entity_docs"))
    rows = docs.agg(F.count("*").alias("rows"))
    own = -F.log2(F.col("entity_docs") / F.col("rows"))
    known = beside.join(entity, "entity").join(document_counts(docs, beside), "term").crossJoin(F.broadcast(rows))  # one row
    share = F.when(own <= 0, F.lit(0.0)).otherwise(1 + F.log2(F.least(F.lit(1.0), F.col("both") / F.col("docs"))) / own)
    return known.select("entity", "term", share.alias("share")).where(F.col("share") >= generalise)


def personal_data(docs: DataFrame, window: int = 8, support: int = 2, generalise: float = 0.7, remove: float = 0.9) -> DataFrame:
    """doc_id, h, spans of each row: formal identifiers and disclosing terms (kind, start, end, removed)."""
    found = stored(identifiers(docs, window), "identifiers")
    terms = disclosing_terms(docs, found, support, generalise)
    holders = found.select("doc_id", "h", F.explode("entities.entity").alias("entity")).distinct().join(terms, "entity")
    best = holders.groupBy("doc_id", "h", "term").agg(F.max("share").alias("share"))
    listed = best.groupBy("doc_id", "h").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("shares"))  # terms beside one document's own entities
    text = found.where("text IS NOT NULL").dropDuplicates(["doc_id", "h"])
    same = [text.doc_id.eqNullSafe(listed.doc_id), text.h == listed.h]
    marked = text.join(listed, same).select(text.doc_id, text.h, "text", F.col("spans").alias("base"), "shares")

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            out = []
            for text, base, shares in zip(batch["text"].to_pylist(), batch["base"].to_pylist(), batch["shares"].to_pylist()):
                shares = dict(shares)
                hidden = _hidden(text, [(s["kind"], s["start"], s["end"]) for s in base])
                out.append([{"kind": 4, "start": a, "end": b, "removed": shares[t] >= remove} for t, a, b in _terms(text, hidden) if t in shares])
            return {"doc_id": batch["doc_id"], "h": batch["h"], "terms": pa.array(out, pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("removed", pa.bool_())])))}

        return run

    more = map_batches(marked, make, "doc_id long, h long, terms array<struct<kind:int,start:long,end:long,removed:boolean>>")
    base = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(True).alias("removed")))
    joined = found.join(more, [found.doc_id.eqNullSafe(more.doc_id), found.h == more.h], "left")
    return joined.select(found.doc_id, found.h, F.when(F.col("terms").isNull(), base).otherwise(F.concat(base, "terms")).alias("spans"))


def sanitise(docs: DataFrame, **limits: float) -> DataFrame:
    """docs with the text sanitised: identifiers and removed terms become [KIND], generalised terms
    their shape (A, a and 0 for upper case, lower case and digits)."""
    spans = personal_data(docs, **limits).dropDuplicates(["doc_id", "h"])
    h = F.xxhash64("doc_id", F.col("text").cast("string"))
    joined = docs.join(spans.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("spans").alias("__spans")), F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (h == F.col("__h")), "left")

    @F.pandas_udf("string")
    def hide(text, spans):
        out = []
        for t, s in zip(text, spans):
            if t is not None and s is not None:
                at, parts = 0, []
                for x in sorted(s, key=lambda x: (x["start"], -x["end"])):
                    if x["start"] >= at:
                        own = t[x["start"] : x["end"]]
                        shape = "".join("A" if c.isupper() else "0" if c.isdigit() else "a" if c.isalpha() else c for c in own)
                        parts += [t[at : x["start"]], f"[{KINDS[x['kind']].upper()}]" if x["removed"] else shape]
                        at = x["end"]
                    else:
                        at = max(at, x["end"])
                t = "".join(parts) + t[at:]
            out.append(t)
        return __import__("pandas").Series(out, dtype=object)

    return joined.withColumn("text", hide(F.col("text").cast("string"), "__spans")).select(*docs.columns)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and the spans as text."""
    said = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    base = said(F.filter("spans", lambda s: s["kind"] < 4))
    return found.select("doc_id", *map(count, range(4)), F.sha2(base, 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
