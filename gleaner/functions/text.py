"""Text, hash, score and date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_count(text: Column) -> Column:
    return F.size(F.split(F.trim(text), r"\s+"))


def for_hash(text: Column) -> Column:
    """Null as empty, white space as one space, small letters."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of normalised parts with bars between; null counts as empty, so that parts keep their places."""
    return F.sha2(F.concat_ws("|", *map(for_hash, parts)), 256)


def loose(text: Column) -> Column:
    """Small letters and digits, everything else one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def terms(text: Column) -> Column:
    """Words of letters, digits and + # . without repeats."""
    cleaned = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9+#.]+", " "))
    return F.when(cleaned == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(cleaned, " ")))


def has_term(text: Column, term: Column) -> Column:
    return F.concat(F.lit(" "), loose(text), F.lit(" ")).contains(F.concat(F.lit(" "), loose(term), F.lit(" "))) & (loose(term) != "")


def overlap(a: Column, b: Column) -> Column:
    """Common share of two term arrays, of the larger one; 0 where one is empty."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / most).otherwise(0.0)


def redacted(text: Column) -> Column:
    """E-mail addresses, links and telephone numbers replaced by marks."""
    out = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]")
    out = F.regexp_replace(out, r"(https?://|www\.)[^\s]+", "[URL]")
    return F.regexp_replace(out, r"\+?[0-9][0-9 ().-]{8,}[0-9]", "[PHONE]")


def age_days(now: Column, then: Column) -> Column:
    """Whole days passed, never below 0: the floor of the time between, not a difference of dates."""
    return F.greatest(F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / F.lit(86400e6)), F.lit(0)).cast("long")


def source_name(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")


def quality_state(text: Column) -> Column:
    """FULL, PARTIAL or NEEDS_ENRICHMENT by words and by signs of sections."""
    n = word_count(text)
    strong = F.lower(text).rlike("(responsibilities|requirements|qualifications)")
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "NEEDS_ENRICHMENT").when((n >= 80) & (strong | (n >= 200)), "FULL").when(n >= 20, "PARTIAL").otherwise("NEEDS_ENRICHMENT")
