"""Dates in texts and wire formats, as expressions. An unknown or impossible date is null, never guessed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
MONTH_NAMES = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec"
ISO = r"\b(20[0-9]{2})-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])\b"
IN_PATH = r"/(20[0-9]{2})[/-](0[1-9]|1[0-2])[/-](0[1-9]|[12][0-9]|3[01])(?:[/-]|\b)"
WRITTEN = rf"(?i)\b(0?[1-9]|[12][0-9]|3[01])\s+({MONTH_NAMES})\.?\s+(20[0-9]{{2}})\b"
WRITTEN_US = rf"(?i)\b({MONTH_NAMES})\.?\s+(0?[1-9]|[12][0-9]|3[01]),\s*(20[0-9]{{2}})\b"


def month_number(name: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(name, 1, 3)))
    return F.when(at > 0, at)


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def _found(text: Column, pattern: str, y: int, m: int, d: int, named: bool = False) -> Column:
    t = F.coalesce(text, F.lit(""))
    month = F.regexp_extract(t, pattern, m)
    month = month_number(month).cast("string") if named else month
    return F.when(t.rlike(pattern), _date(F.regexp_extract(t, pattern, y), month, F.regexp_extract(t, pattern, d)))


def extract_date(text: Column, url: Column) -> Column:
    """(day, evidence): an ISO date in the text, a date in the URL's path, or a written one."""
    iso, path = _found(text, ISO, 1, 2, 3), _found(url, IN_PATH, 1, 2, 3)
    written, american = _found(text, WRITTEN, 3, 2, 1, True), _found(text, WRITTEN_US, 3, 1, 2, True)
    evidence = F.when(iso.isNotNull(), "snippet_iso").when(path.isNotNull(), "url_path").when(written.isNotNull() | american.isNotNull(), "snippet_written").otherwise("")
    return F.struct(F.coalesce(iso, path, written, american).alias("day"), evidence.alias("evidence"))


def normalize_timestamp(value: Column) -> Column:
    """The UTC date of a compact, ISO or mail timestamp; null for what is none of these."""
    v = F.trim(value)
    compact = r"^([0-9]{4})([0-9]{2})([0-9]{2})T[0-9]{6}Z?$"
    iso = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$"
    mail = r"([0-9]{1,2})\s+([A-Za-z]{3})[A-Za-z]*\s+([0-9]{4})"
    zoned = F.regexp_replace(F.regexp_replace(v, "Z$", "+00:00"), r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    bare = F.regexp_extract(v, "^[0-9-]{10}$", 0) != ""
    day = F.when(bare, F.try_to_date(v, "yyyy-MM-dd")).otherwise(F.to_date(F.to_utc_timestamp(F.try_to_timestamp(zoned), "UTC")))
    return (
        F.when(v.rlike(compact), _date(F.regexp_extract(v, compact, 1), F.regexp_extract(v, compact, 2), F.regexp_extract(v, compact, 3)))
        .when(v.rlike(iso), day)
        .when(v.rlike(mail), _date(F.regexp_extract(v, mail, 3), month_number(F.regexp_extract(v, mail, 2)).cast("string"), F.regexp_extract(v, mail, 1)))
    )


def epoch_date(seconds: Column) -> Column:
    """The UTC date of seconds since 1970; null beyond the years 1 to 9999."""
    days = F.floor(seconds / 86400)
    return F.when(days.between(-719162, 2932896), F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")))
