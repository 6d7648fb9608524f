"""Posting identity and canonical forms of addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import source_name

#: Query parameters that only track. Fixed values.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "refid", "src", "source", "trk", "trackingid", "campaign", "medium")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def in_domain(url: Column, domain: str) -> Column:
    """Whether a url's host is a domain or lies below it."""
    return (host(url) == domain) | host(url).endswith("." + domain)


def canonical(url: Column) -> Column:
    """Small scheme and host without www, no fragment, no closing slash, no tracking parameters, the others sorted."""
    url = F.coalesce(F.trim(url), F.lit(""))
    bare = F.regexp_replace(url, "#.*$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+", "/"), "/$", "")
    query = F.regexp_extract(bare, "\\?(.*)$", 1)
    name = lambda p: F.lower(F.split_part(p, F.lit("="), F.lit(1)))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~name(p).startswith("utm_") & ~name(p).isin(*TRACKING)))
    base = F.concat(F.lit("https://"), F.regexp_replace(host(url), "^www\\.", ""), path)
    return F.when(host(url) == "", url).when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)


def model_key(source: Column, source_job_id: Column, url: Column, record: Column) -> Column:
    """The identity of the staging model: a cascade of the first identifier there is.

    Of the redirect patterns only /ls/click takes effect, as in the model; the application's own
    identity (`application_key`) is another function and neither stands for the other.
    """
    name, link = source_name(source), F.coalesce(url, F.lit(""))
    found = lambda pattern, group: F.nullif(F.regexp_extract(link, pattern, group), F.lit(""))
    linkedin, greenhouse = found("/jobs/view/([0-9]+)", 1), found("[?&]gh_jid=([^&]+)", 1)
    query = found("[?&](jobId|job_id|jid|postingId|requisitionId)=([^&]+)", 2)
    return (
        F.when(F.nullif(source_job_id, F.lit("")).isNotNull(), F.concat(name, F.lit("|"), F.lower(F.trim(source_job_id))))
        .when(linkedin.isNotNull(), F.concat(name, F.lit("|linkedin:"), linkedin))
        .when(greenhouse.isNotNull(), F.concat(name, F.lit("|gh_jid:"), greenhouse))
        .when(query.isNotNull(), F.concat(name, F.lit("|job_id:"), query))
        .when(F.lower(link).contains("/ls/click"), F.concat(name, F.lit("|record:"), record))
        .when(link != "", F.concat(name, F.lit("|"), F.lower(F.trim(url))))
        .otherwise(F.concat(name, F.lit("|record:"), record))
    )


def application_key(source: Column, source_job_id: Column, url: Column, record: Column) -> Column:
    """The identity that the application joins on: punctuation of ids evened out, then platform ids, then the canonical address."""
    name = F.trim(source_name(source))
    own = F.trim(F.regexp_replace(F.lower(F.coalesce(source_job_id, F.lit(""))), "[^a-z0-9]+", " "))
    link = F.coalesce(url, F.lit(""))
    platform = F.coalesce(
        F.nullif(F.concat(F.lit("linkedin:"), F.regexp_extract(link, "linkedin\\.[a-z.]+/.*?/?jobs/view/(?:[^/?#]*-)?([0-9]+)", 1)), F.lit("linkedin:")),
        F.nullif(F.concat(F.lit("greenhouse:"), F.regexp_extract(link, "[?&]gh_jid=([0-9]+)", 1)), F.lit("greenhouse:")),
        F.nullif(F.concat(F.lit("greenhouse:"), F.regexp_extract(link, "greenhouse\\.io/[^?#]*/jobs/([0-9]+)", 1)), F.lit("greenhouse:")),
        F.nullif(F.concat(F.lit("lever:"), F.regexp_extract(link, "lever\\.co/[^/?#]+/([0-9a-f-]{36})", 1)), F.lit("lever:")),
    )
    return F.when(own != "", F.concat(name, F.lit("|"), own)).when(platform.isNotNull(), platform).when(host(link) != "", F.concat(name, F.lit("|"), canonical(link))).otherwise(F.concat(name, F.lit("|record:"), record))
