"""SQL fragments that spell out the text rules for the oracles."""

from __future__ import annotations

from ..functions.text import ACCENTED, PLAIN


def fold(x: str) -> str:
    out = f"coalesce({x}, '')"
    for a, b in (("æ", "ae"), ("Æ", "AE"), ("ø", "o"), ("Ø", "O"), ("å", "a"), ("Å", "A")):
        out = f"replace({out}, '{a}', '{b}')"
    src, dst = ACCENTED.replace("'", "''"), PLAIN.replace("'", "''")
    return f"lower(regexp_replace(translate({out}, '{src}', '{dst}'), '[^\\x00-\\x7F]', '', 'g'))"


def words(x: str, pattern: str = "[a-z0-9]+") -> str:
    return f"regexp_extract_all({x}, '{pattern}')"


def tokens(x: str, stop=(), min_len: int = 2) -> str:
    cond = f"length(w) >= {min_len}"
    if stop:
        cond += " AND w NOT IN (" + ", ".join(f"'{s}'" for s in stop) + ")"
    return f"list_filter({words(fold(x))}, lambda w: {cond})"


def full(x: str) -> str:
    return f"array_to_string({words(f'lower({x})', '[a-z0-9æøå]+')}, ' ')"


def within(a: str, b: str) -> str:
    return f"(len({a}) > 0 AND list_has_all({b}, {a}))"


def host(x: str) -> str:
    return f"regexp_replace(lower(regexp_extract({x}, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www\\.', '')"


def strip_tags(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"
