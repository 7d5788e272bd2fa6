"""Text-cell normalisation as Column expressions, applied to whole tables at once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: number pattern, magnitude letters, signs of a negative cell --------------
NUMBER = r"\d[\d,]*(?:\.\d+)?"
MAGNITUDE = {"K": 1e3, "M": 1e6, "B": 1e9, "T": 1e12}
NEGATIVE = r"(?is)^[\s\u00a0]*-|^[\s\u00a0]*\(.*\)[\s\u00a0]*$|downside"


def stripped(c: Column) -> Column:
    """Trim every kind of white space, not only the space character."""
    return F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")


def numeric_cell(c: Column) -> Column:
    """First number of a cell, scaled by the letter that follows it and signed by its context.

    Each pattern runs once per cell. Blank tokens hold no digit, so they need no test.
    """
    text = c.cast("string")
    digits = F.regexp_replace(F.regexp_extract(text, NUMBER, 0), ",", "").try_cast("double")
    suffix = F.upper(F.regexp_extract(text, r"^\D*" + NUMBER + r"[\s\u00a0]*([KMBTkmbt])", 1))
    letters = F.create_map(*[F.lit(x) for kv in [("", 1.0), *MAGNITUDE.items()] for x in kv])
    return digits * F.element_at(letters, suffix) * F.when(text.rlike(NEGATIVE), -1.0).otherwise(1.0)


def suspicious_number(c: Column) -> Column:
    """Data-quality flag: a word after the number starts with a magnitude letter ("12 bps")."""
    return F.coalesce(
        stripped(c.cast("string")).rlike(r"^\D*" + NUMBER + r"[\s ]*[KMBTkmbt][A-Za-z]"), F.lit(False)
    )


def text_cell(c: Column) -> Column:
    return F.nullif(stripped(c.cast("string")), F.lit(""))


def key_cell(c: Column) -> Column:
    """Upper-cased key; null where the key is blank or the text `nan`."""
    k = F.upper(stripped(c.cast("string")))
    return F.when(k.isin("", "NAN"), F.lit(None)).otherwise(k)


def rating_date_lenient(c: Column) -> Column:
    """Full month name, short month name or ISO; anything else is null."""
    s = stripped(c)
    return F.coalesce(
        *[F.try_to_date(s, f) for f in ("MMMM d, yyyy", "MMM d, yyyy", "yyyy-MM-dd")]
    )


# ---- fixed values: the strict date pattern -------------------------------------------------
STRICT_DATE = r"([A-Z][a-z]{2})\s+(\d{1,2}),\s+(\d{4})"


def rating_date_strict(c: Column) -> Column:
    """Short month form found anywhere in the text; impossible calendar dates are null."""
    part = [F.regexp_extract(c, STRICT_DATE, i) for i in (1, 2, 3)]
    return F.try_to_date(F.concat_ws(" ", *part), "MMM d yyyy")


def capture_key(name: Column) -> tuple[Column, Column]:
    """(as_of, hhmm) of a capture file name; as_of is null for names that do not parse."""
    stem = F.regexp_extract(name, r"(?:^|/)snapshot_([^/]*?)(?:\.[A-Za-z]+)?$", 1)
    as_of = F.try_to_date(F.substring(stem, 1, 10), "yyyy-MM-dd")
    return as_of, F.when(F.length(stem) > 10, F.substring(stem, 12, 100)).otherwise("")
