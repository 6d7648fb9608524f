"""Hash keys and normal forms of stored values, dates of messages, lists kept as JSON."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Abbreviations in titles, legal forms of companies, words for remote work and for one country.
TITLE_WORDS = ((r"\bsr\.?\b", "senior"), (r"\bjr\.?\b", "junior"), (r"\bbi\b", "business intelligence"), (r"\beng\b", "engineer"))
LEGAL_FORMS = ("co", "company", "corp", "corporation", "inc", "incorporated", "llc", "ltd")
REMOTE, COUNTRY = r"\b(remote|remote only|work from home)\b", r"\b(united states|usa|u s|us|america|remote us|us remote)\b"
MATCHES, MOST_MATCHES = ("excellent", "strong", "partial", "gap"), 10


@F.pandas_udf(T.StringType())
def _folded(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else x.casefold())


@F.pandas_udf(T.StringType())
def _plain(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).casefold())


def _beyond_ascii(text: Column, by) -> Column:
    """Small letters; only texts with other letters than ASCII ones go through Python."""
    other = text.rlike(r"[^\x00-\x7F]")
    return F.when(other, by(F.when(other, text))).otherwise(F.lower(text))


def for_hash(text: Column) -> Column:
    """Null as empty, small letters as in case-insensitive comparison, white space as one space."""
    return F.trim(F.regexp_replace(_beyond_ascii(F.coalesce(text, F.lit("")), _folded), r"(?U)\s+", " "))


def hashed(*parts: Column) -> Column:
    """SHA-256 of normalised parts with bars between; null counts as empty, so that parts keep their places."""
    return F.sha2(F.concat_ws("|", *map(for_hash, parts)), 256)


def record_key(source: Column, message_id: Column, url: Column) -> Column:
    return hashed(source, message_id, url)


def job_fingerprint(title: Column, company: Column, location: Column) -> Column:
    return hashed(title, company, location)


def email_key(source: Column, message_id: Column, folder: Column, sender: Column, subject: Column, date: Column) -> Column:
    """By the message's own id, else by what is known of it."""
    return F.when(F.coalesce(message_id, F.lit("")) != "", hashed(source, message_id)).otherwise(hashed(source, folder, sender, subject, date))


def loose_text(text: Column) -> Column:
    """Compatibility forms taken apart, & as and, small letters and digits, everything else one space."""
    out = F.replace(_beyond_ascii(F.coalesce(text, F.lit("")), _plain), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def description_hash(text: Column) -> Column:
    """SHA-256 of the loose text, '' for an empty one."""
    loose = loose_text(text)
    return F.when(loose == "", "").otherwise(F.sha2(loose, 256))


def company_name(name: Column) -> Column:
    return F.array_join(F.filter(F.split(loose_text(name), " "), lambda w: ~w.isin(*LEGAL_FORMS)), " ")


def candidate_fingerprint(title: Column, company: Column, location: Column) -> Column:
    """What likely duplicates have in common: title, company and place, each in a normal form. Never an identity."""
    title = loose_text(title)
    for pattern, word in TITLE_WORDS:
        title = F.regexp_replace(title, pattern, word)
    place = loose_text(location)
    far, here = place.rlike(REMOTE), place.rlike(COUNTRY)
    other = F.regexp_replace(F.regexp_replace(place, r"\bunited states\b", "us"), r"\busa\b", "us")
    place = F.when(far & here, "remote-us").when(far, "remote").otherwise(other)
    return F.concat_ws("|", F.trim(F.regexp_replace(title, " +", " ")), company_name(company), place)


def message_time(text: Column) -> Column:
    """The time that a mail header or an ISO form names, in UTC; null where it is neither. Without a zone it is UTC."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s*[A-Za-z]{3},\s*", ""), r"\s*\([^)]*\)\s*$", ""))
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?i)\s(?:GMT|UTC|UT|Z)$", " +0000"), r"\s+", " ")
    shapes = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm")
    header = F.coalesce(*(F.try_to_timestamp(bare, F.lit(shape)) for shape in shapes))
    iso = F.trim(text)
    iso = F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?$"), iso)
    return F.coalesce(header, iso.try_cast("timestamp"))


def string_list(text: Column) -> Column:
    """The strings of a list kept as JSON; an empty list for null, other JSON and broken text."""
    return F.coalesce(F.from_json(F.when(F.json_array_length(text).isNotNull(), text), "array<string>"), F.array().cast("array<string>"))


def requirement_matches(text: Column) -> Column:
    """The first ten entries of a list kept as JSON that have a requirement, a background and a known grade."""
    kind = "array<struct<job_requirement:string,candidate_background:string,match:string>>"
    rows = F.coalesce(F.from_json(F.when(F.json_array_length(text).isNotNull(), text), kind), F.array().cast(kind))
    tidy = F.transform(rows, lambda r: F.struct(*(F.trim(F.coalesce(r[c], F.lit(""))).alias(c) for c in ("job_requirement", "candidate_background")), F.lower(F.trim(F.coalesce(r["match"], F.lit("")))).alias("match")))
    return F.slice(F.filter(tidy, lambda r: (r["job_requirement"] != "") & (r["candidate_background"] != "") & r["match"].isin(*MATCHES)), 1, MOST_MATCHES)


def city(location: Column) -> Column:
    place = F.trim(F.coalesce(location, F.lit("")))
    return F.when(place == "", "Unknown").when(F.lower(place) == "remote", "Remote").otherwise(F.trim(F.split_part(place, F.lit(","), F.lit(1))))


def description_state(enrichment_status: Column, words: Column, full: Column) -> Column:
    """FULL_JD, PARTIAL_JD, NEEDS_ENRICHMENT or, where a resolved page was turned down, ENRICHMENT_REJECTED."""
    n = F.coalesce(words, F.lit(0))
    return F.when(F.coalesce(enrichment_status, F.lit("")) == "resolution_rejected", "ENRICHMENT_REJECTED").when((n >= 80) & F.coalesce(full, F.lit(False)), "FULL_JD").when(n > 0, "PARTIAL_JD").otherwise("NEEDS_ENRICHMENT")
