"""Time parsing as Column builders; the session time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import as_col, clean

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
DATE_TEXT = r"\d{4}-\d{2}-\d{2}|\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4}|\b(?:19|20)\d{2}\b"
_ISO_FORM = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,9})?)?)?)?(Z|[+\-]\d{2}:?\d{2})?$"


def iso_ts(value: Column | str) -> Column:
    """ISO time with Z or an offset; a naive time is UTC; anything else is NULL."""
    v = as_col(value).cast("string")
    return F.when(v.rlike(_ISO_FORM), v.try_cast("timestamp"))


def iso_text(value: Column | str) -> Column:
    return F.date_format(as_col(value), ISO)


def is_fresh(value: Column, as_of: Column | str, days: int) -> Column:
    """Age between nothing and ``days`` days, both ends included."""
    now = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    age = F.unix_micros(now) - F.unix_micros(value)
    return F.coalesce((age >= 0) & (age <= days * 86_400_000_000), F.lit(False))


def feed_date(value: Column | str) -> Column:
    """RFC 822 date as ISO text with offset; else a leading yyyy-MM-dd; else the text itself."""
    v = clean(value)
    # day and month names of the mail format, with or without the week day
    body = F.regexp_replace(v, r"^[A-Za-z]{3},?\s+", "")
    zone = F.regexp_extract(body, r"\s([+\-]\d{4}|GMT|UTC|Z|EST|EDT)\s*$", 1)
    offset = (
        F.when(zone.isin("GMT", "UTC", "Z"), "+0000").when(zone == "EST", "-0500").when(zone == "EDT", "-0400")
        .otherwise(zone)
    )
    stamp = F.regexp_extract(body, r"^(\d{1,2}\s+[A-Za-z]{3}\s+\d{4}\s+\d{2}:\d{2}(?::\d{2})?)", 1)
    stamp = F.regexp_replace(stamp, r"\s+", " ")
    seconds = F.when(stamp.rlike(r"\d{2}:\d{2}:\d{2}$"), stamp).otherwise(F.concat(stamp, F.lit(":00")))
    parsed = F.try_to_timestamp(seconds, F.lit("d MMM yyyy HH:mm:ss"))
    text_offset = F.concat(F.substring(offset, 1, 3), F.lit(":"), F.substring(offset, 4, 2))
    rfc = F.when(
        stamp != "",
        F.concat(
            F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss"),
            F.when(offset != "", text_offset).otherwise(F.lit("")),
        ),
    )
    day = F.regexp_extract(v, r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.coalesce(rfc, F.nullif(day, F.lit("")), v)


def dated(value: Column | str) -> Column:
    """First date-looking run of the text, or empty."""
    return F.regexp_extract(F.coalesce(as_col(value).cast("string"), F.lit("")), f"({DATE_TEXT})", 1)
