"""Text normalisers as Column builders. All stay in the JVM unless the name says exact."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from . import constants as K


def _accent_table() -> tuple[str, str, dict[str, str]]:
    """Characters of all of Unicode whose compatibility form is ASCII: those of one character, and letters
    of more (ligatures and digraphs). Nordic letters are spelled out."""
    src, dst, longer = ["ø", "Ø"], ["o", "O"], {"æ": "ae", "Æ": "AE"}
    for code in range(0x80, sys.maxunicode + 1):
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            src.append(chr(code))
            dst.append(plain)
        elif len(plain) > 1 and plain.isalpha() and unicodedata.category(chr(code))[0] == "L":
            longer[chr(code)] = plain
    return "".join(src), "".join(dst), longer


ACCENTED, PLAIN, LIGATURES = _accent_table()
_LIGATURE = "[" + "".join(sorted(LIGATURES)) + "]"


def _spelled(value: Column) -> Column:
    """Ligatures and digraphs spelled out, accents dropped. Texts without the former are translated only."""
    table = F.create_map(*[F.lit(x) for pair in LIGATURES.items() for x in pair])
    letters = F.transform(F.split(value, ""), lambda c: F.coalesce(F.element_at(table, c), c))
    return F.translate(F.when(value.rlike(_LIGATURE), F.array_join(letters, "")).otherwise(value), ACCENTED, PLAIN)


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A filter pushed through a projection copies the expression behind each name it mentions. A
    lambda variable is a value and not an expression, so what is bound here is not copied.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text(value: Column | str) -> Column:
    """The value as a string, NULL read as empty."""
    return F.coalesce(as_col(value).cast("string"), F.lit(""))


def clean(value: Column | str) -> Column:
    return F.trim(text(value))


def blank_to_null(value: Column | str) -> Column:
    return F.nullif(clean(value), F.lit(""))


def squash(value: Column | str) -> Column:
    """Whitespace runs become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(text(value), r"\s+", " "))


def digits(value: Column | str) -> Column:
    return F.regexp_replace(text(value), "[^0-9]", "")


#: Letters that Western texts use; replaced one by one, they cost less than a translation of every character.
_COMMON = "éèêëáàâäãåíìîïóòôöõøúùûüñçýÿÉÈÊËÁÀÂÄÃÅÍÌÎÏÓÒÔÖÕØÚÙÛÜÑÇÝ"


def fold(value: Column | str) -> Column:
    """Lower-case ASCII form: Nordic letters spelled out, accents dropped, other symbols removed.

    ASCII texts are lowered only, and the full table is used only for texts with other than the common letters.
    """
    plain = lambda v: ~v.rlike(r"[^\x00-\x7F]")
    table = dict(zip(ACCENTED, PLAIN))

    def spelled(v: Column) -> Column:
        for letter, ascii_ in [*((c, table[c]) for c in _COMMON), ("ß", ""), ("æ", "ae"), ("Æ", "AE")]:
            v = F.replace(v, F.lit(letter), F.lit(ascii_))
        return v

    rare = lambda v: F.when(plain(v), v).otherwise(F.regexp_replace(_spelled(v), r"[^\x00-\x7F]", ""))
    return F.lower(let(text(value), lambda v: F.when(plain(v), v).otherwise(let(spelled(v), rare))))


def ascii_lower(value: Column | str) -> Column:
    """Accents dropped and everything else outside ASCII removed, in lower case."""
    plain = F.translate(text(value), ACCENTED[2:], PLAIN[2:])  # without the Nordic letters
    return F.lower(F.regexp_replace(plain, r"[^\x00-\x7F]", ""))


def _words(folded: Column, pattern: str = "[a-z0-9]+") -> Column:
    return F.regexp_extract_all(folded, F.lit(pattern), F.lit(0))


def folded_words(value: Column | str) -> Column:
    """All words of the folded text, for several token rules over one text."""
    return _words(fold(value))


def kept_words(words: Column, stop: Iterable[str] = (), min_len: int = 2) -> Column:
    """The words without stop words and words shorter than ``min_len``."""
    stop = tuple(stop)

    def keep(word: Column) -> Column:
        ok = F.length(word) >= min_len
        return ok & ~word.isin(*stop) if stop else ok

    return F.filter(words, keep) if stop or min_len > 1 else words


def fold_tokens(value: Column | str, stop: Iterable[str] = (), min_len: int = 2) -> Column:
    """Folded word list without stop words and words shorter than ``min_len``."""
    return kept_words(folded_words(value), stop, min_len)


def identity_tokens(value: Column | str) -> Column:
    return fold_tokens(value, K.STOP_IDENTITY, 2)


def search_tokens(value: Column | str) -> Column:
    return fold_tokens(value, (), 2)


def search_name_tokens(value: Column | str) -> Column:
    return fold_tokens(value, K.STOP_SEARCH_NAME, 2)


def _nordic(value: Column | str) -> Column:
    out = F.lower(text(value))
    for letter, plain in (("æ", "ae"), ("ø", "o"), ("å", "a")):
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


def place_tokens(value: Column | str, stop: Iterable[str] = K.STOP_PLACES) -> Column:
    """Word set of a place name: only the Nordic letters are folded, other accents split words."""
    return place_words(listing_words(value), stop)


def place_words(words: Column, stop: Iterable[str] = K.STOP_PLACES) -> Column:
    return F.array_distinct(kept_words(words, stop))


def listing_words(value: Column | str) -> Column:
    return _words(_nordic(value))


def listing_name_tokens(value: Column | str) -> Column:
    """Listing names keep words of three letters or more, and any number."""
    return listing_kept(listing_words(value))


def listing_kept(words: Column) -> Column:
    return F.filter(words, lambda w: ((F.length(w) >= 3) | w.rlike("^[0-9]+$")) & ~w.isin(*K.STOP_LISTING))


def full_name_tokens(value: Column | str) -> Column:
    """Words of a name with the Nordic letters kept."""
    return _words(F.lower(text(value)), "[a-z0-9æøå]+")


def full_name(value: Column | str) -> Column:
    return F.array_join(full_name_tokens(value), " ")


def strip_legal(value: Column | str) -> Column:
    """Full name without the legal suffixes at its end (a name of suffixes only becomes empty)."""
    alternatives = "|".join(K.LEGAL_SUFFIXES)
    return F.trim(F.regexp_replace(full_name(value), f"(?:(?:^| )(?:{alternatives}))+$", ""))


def channel_name(value: Column | str) -> Column:
    return F.array_join(fold_tokens(value, K.STOP_CHANNEL, 1), " ")


def slug(value: Column | str) -> Column:
    return F.array_join(fold_tokens(value, (), 1), "-")


def phone8(value: Column | str) -> Column:
    """Last eight digits of a phone number, country code 47 removed first."""
    d = digits(value)
    return F.right(F.when(d.startswith("47") & (F.length(d) > 8), F.substr(d, F.lit(3))).otherwise(d), F.lit(8))


def closed_label(value: Column | str, labels: Iterable[str] = K.SENTIMENT_LABELS) -> Column:
    """One of ``labels`` or NULL; blanks and punctuation at the ends do not matter."""
    plain = F.regexp_replace(F.lower(clean(value)), r"^[^a-z]+|[^a-z]+$", "")
    return F.when(plain.isin(*labels), plain)


def period_label(start: Column | str, end: Column | str) -> Column:
    a, b = F.nullif(as_col(start), F.lit("")), F.nullif(as_col(end), F.lit(""))
    return F.coalesce(
        F.when(a.isNotNull() & b.isNotNull(), F.concat_ws(" to ", a, b)), a, b, F.lit("the latest filed year")
    )


def ocr_number(value: Column | str) -> Column:
    """Number read by OCR: letter O is zero, blanks and dots group thousands, comma is the decimal sign."""
    raw = F.replace(F.replace(text(value), F.lit(" "), F.lit("")), F.lit("O"), F.lit("0"))
    raw = F.regexp_replace(raw, r"^[.,\-]+|[.,\-]+$", "")
    number = (
        F.when(raw.contains(","), F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(raw.rlike(r"\.[0-9]{1,2}$"), raw)
        .otherwise(F.replace(raw, F.lit("."), F.lit("")))
        .try_cast("double")
    )
    # two decimals, half to even, as decimals do it
    return F.when(number.between(0, 100_000), F.bround(number.cast("decimal(18,8)"), 2).cast("double"))


def needs_ocr(value: Column | str) -> Column:
    return (F.length(clean(value)) < 100) | ~text(value).rlike(K.WORKFORCE_TERMS)


@F.pandas_udf(T.DoubleType())
def fuzzy_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Matching-block similarity of two strings; no SQL function computes it."""
    from difflib import SequenceMatcher

    return pd.Series(
        [SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in zip(left, right)], dtype="float64"
    )
