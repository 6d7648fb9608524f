"""Addresses of postings: canonical forms, redirects, platform ids, identities and verified keys.

An address is taken apart once for each question: the parts, and what is used of them more than once, are bound
to a lambda's variable, since the optimizer would repeat the work wherever a field of a struct column is used. A
pattern only runs where the character that it needs occurs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import loose

# Parameters, hosts and paths that results must follow.
TRACKING = ("ao", "campaign", "cb", "clickid", "cs", "fbclid", "gclid", "guid", "igshid", "imp_id", "mc_cid", "mc_eid", "mkt_tok", "ref", "ref_src", "referrer", "s", "src", "t", "tr", "uid", "uido", "utm_campaign", "utm_content", "utm_id", "utm_medium", "utm_source", "utm_term", "vt")
DESTINATIONS = ("dest", "destination", "href", "link", "redirect", "redirect_uri", "redirect_url", "target", "u", "url")
REDIRECT_HOSTS = ("sendgrid.net", "sg3email.lensa.com")
REDIRECT_PATHS = ("/ls/click", "/click", "/redirect")
JOB_IDS = ("gh_jid", "jid", "job_id", "jobid", "postingid", "requisitionid")
VERIFIED_JOB_IDS = (*JOB_IDS, "reqid")
OFFICIAL_HOSTS = ("ashbyhq.com", "greenhouse.io", "icims.com", "lever.co", "myworkdayjobs.com", "smartrecruiters.com", "workdayjobs.com")
THIRD_PARTIES = ("bebee.com", "glassdoor.com", "jobleads.com", "joblookup.com", "jobright.ai", "lensa.com", "builtin.com", "builtinsf.com")
BUILT_IN = ("builtin.com", "builtinsf.com")
GENERIC_PATHS = ("", "/", "/career", "/careers", "/careers/jobs", "/job", "/jobs", "/openings")
TRUSTED_SOURCES = ("official_found_verified", "direct_ats_source", "source_redirect_verified", "embedded_official_destination", "accepted_direct_candidate", "explicit_requisition_id", "verified_reuse")
UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
_SHAPE = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _where_has(text: Column, mark: str, value: Column, other: Column | None = None) -> Column:
    return F.when(text.contains(mark), value).otherwise(F.lit("") if other is None else other)


def _trimmed(url: Column) -> Column:
    return F.trim(F.coalesce(url, F.lit("")))


def _place(url: Column) -> Column:
    """Host and port of a trimmed address, without user."""
    return let(_where_has(url, "//", F.regexp_extract(url, _SHAPE, 2)), lambda p: _where_has(p, "@", F.regexp_replace(p, "^.*@", ""), p))


def _host(place: Column) -> Column:
    return F.lower(_where_has(place, ":", F.regexp_replace(place, r":\d*$", ""), place))


def host_of(url: Column) -> Column:
    """The host of an address, small, without user and port."""
    return let(let(_trimmed(url), _place), _host)


def taken_apart(url: Column) -> Column:
    """A struct of scheme, host (small, without user and port), port, path and pairs (name and value of each
    parameter, decoded, in order). Null counts as the empty address."""

    def parts(url: Column, place: Column) -> Column:
        part = lambda k: F.regexp_extract(url, _SHAPE, k)
        pairs = F.transform(
            F.filter(F.split(_where_has(url, "?", part(4)), "&"), lambda p: p != ""),
            lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("name"), _decoded(F.when(p.contains("="), F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise(F.lit(""))).alias("value")),
        )
        port = _where_has(place, ":", F.regexp_extract(place, r":(\d+)$", 1))
        return F.struct(_where_has(url, ":", F.lower(part(1))).alias("scheme"), _host(place).alias("host"), port.alias("port"), part(3).alias("path"), pairs.alias("pairs"))

    return let(_trimmed(url), lambda text: let(_place(text), lambda place: parts(text, place)))


def host_in(host: Column, domains: tuple[str, ...]) -> Column:
    """Whether a host is one of some domains or lies below one."""
    return reduce(lambda a, b: a | b, ((host == d) | host.endswith(f".{d}") for d in domains))


def _canonical(u: Column) -> Column:
    """The address of a struct without tracking parameters and fragment: parameters sorted, slashes single, none at the end."""
    single = _where_has(u["path"], "//", F.regexp_replace(u["path"], "/+", "/"), u["path"])
    path = F.when(u["path"] == "", "/").otherwise(let(single, lambda p: F.when(p == "/", p).otherwise(F.regexp_replace(p, "/+$", ""))))
    kept = F.filter(u["pairs"], lambda p: ~F.lower(p["name"]).isin(*TRACKING) & ~F.lower(p["name"]).startswith("utm_"))
    ordered = F.array_sort(F.transform(kept, lambda p: F.struct(F.lower(p["name"]).alias("a"), p["value"].alias("b"), p["name"].alias("c"))))
    code = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    query = F.array_join(F.transform(ordered, lambda p: F.concat(code(p["c"]), F.lit("="), code(p["b"]))), "&")
    base = F.concat(F.when(u["scheme"] == "", "https").otherwise(u["scheme"]), F.lit("://"), u["host"], F.when(u["port"] != "", F.concat(F.lit(":"), u["port"])).otherwise(""), path)
    bare = F.size(u["pairs"]) == 0
    return F.when(bare & (u["host"] == "") & (u["path"] == ""), "").when(bare, base).otherwise(let(query, lambda q: F.when(q != "", F.concat(base, F.lit("?"), q)).otherwise(base)))


def _is_redirect(u: Column) -> Column:
    """Whether an address only leads to another one, by its host, its path or a parameter that names the other."""
    path = F.lower(u["path"])
    by_host = reduce(lambda a, b: a | b, (u["host"].endswith(h) for h in REDIRECT_HOSTS))
    by_path = reduce(lambda a, b: a | b, (path.contains(p) for p in REDIRECT_PATHS))
    return by_host | by_path | F.exists(u["pairs"], lambda p: F.lower(p["name"]).isin(*DESTINATIONS))


def _carried(u: Column) -> Column:
    """The address that a parameter carries, first one whose name says so; null without any."""
    def decoded(value: Column) -> Column:
        return F.trim(_decoded(_decoded(_decoded(F.trim(value)))))

    values = F.transform(u["pairs"], lambda p: F.struct(F.lower(p["name"]).isin(*DESTINATIONS).alias("named"), decoded(p["value"]).alias("value")))
    links = F.filter(values, lambda v: v["value"].startswith("http://") | v["value"].startswith("https://"))
    return let(links, lambda found: F.coalesce(F.get(F.filter(found, lambda v: v["named"]), F.lit(0))["value"], F.get(found, F.lit(0))["value"]))


def canonical(url: Column) -> Column:
    """An address without tracking parameters and fragment."""
    return let(taken_apart(url), _canonical)


def is_redirect(url: Column) -> Column:
    """Whether an address only leads to another one."""
    return let(taken_apart(url), _is_redirect)


def is_specific(url: Column) -> Column:
    """Whether an address names a single posting."""
    return _read(url, lambda text, u, given, specific: specific)


def _read(url: Column, body: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """body of an address's canonical form, its parts, its parameter that holds an id, and whether it is specific."""
    inner = lambda text, u, given: let(_is_specific(u, given), lambda specific: body(text, u, given, specific))
    return let(canonical(url), lambda text: let(taken_apart(text), lambda u: let(_parameter(u, VERIFIED_JOB_IDS), lambda given: inner(text, u, given))))


def platform_id(url: Column) -> Column:
    """The platform's own id of a posting with a canonical address; null without one."""
    return let(taken_apart(url), lambda u: _platform_id(u, url))


def with_destination(df: DataFrame, url: str, name: str, depth: int = 3) -> DataFrame:
    """df with the innermost address that an address carries in its parameters, at most depth steps down; '' without any."""
    steps = [f"_{name}_{k}" for k in range(depth)]
    last = url
    for step in steps:
        df = df.withColumn(step, F.when(F.col(last).isNotNull(), let(taken_apart(F.col(last)), _carried)))
        last = step
    return df.withColumn(name, F.coalesce(*reversed(steps), F.lit(""))).drop(*steps)


def _parameter(u: Column, names: tuple[str, ...]) -> Column:
    """Name (as in names) and value of the first of some parameters that has a value; of repeated ones the last counts."""
    known = F.array(*map(F.lit, names))
    ranked = F.transform(u["pairs"], lambda p, k: F.struct(F.array_position(known, F.lower(p["name"])).alias("rank"), (-k).alias("place"), F.lower(p["name"]).alias("name"), p["value"].alias("value")))
    return F.array_min(F.filter(ranked, lambda p: (p["rank"] > 0) & (p["value"] != "")))


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, f"(?i){pattern}", 1), F.lit(""))


def _platform_id(u: Column, url: Column) -> Column:
    """The platform's own id of a posting, by a parameter or the form of its address; null without one."""
    given = _parameter(u, JOB_IDS)
    return F.coalesce(
        F.concat(u["host"], F.lit(":"), given["name"], F.lit(":"), given["value"]),
        F.concat(F.lit("linkedin:"), _found(url, "/jobs/view/([0-9]+)")),
        F.when(u["host"].contains("greenhouse.io"), F.concat(F.lit("greenhouse:"), _found(url, "/jobs/([0-9]+)"))),
        F.when(u["host"].contains("lever.co"), F.concat(F.lit("lever:"), _found(url, "/([^/?#]+)$"))),
        F.when(u["host"].contains("ashbyhq.com"), F.concat(F.lit("ashby:"), _found(url, "/job/([^/?#]+)"))),
    )


def with_identity(df: DataFrame, source: str = "source", job_id: str = "source_job_id", url: str = "apply_url", record: str = "record_key", name: str = "posting") -> DataFrame:
    """df with a struct of identity, confidence, identity_type, resolved_url and is_redirect: what a posting is
    known by across runs. The source's own id comes first, then a platform's id, then the address; a redirect
    that carries no address is known by its record alone."""
    c = {k: f"_{name}_{k}" for k in ("own", "read", "inner", "dest", "url", "platform")}
    own, from_, read = F.col(c["own"]), loose(F.col(source)), lambda part: F.col(f"{c['read']}.{part}")
    # An address is read where the posting has no id of its own, as nothing else needs it.
    parts = let(taken_apart(F.col(url)), lambda u: F.struct(_carried(u).alias("to"), _is_redirect(u).alias("redirects"), _canonical(u).alias("plain")))
    df = df.withColumn(c["own"], loose(F.col(job_id))).withColumn(c["read"], F.when(own == "", parts))
    df = with_destination(df, f"{c['read']}.to", c["inner"], 2)
    df = df.withColumn(c["dest"], F.when(F.col(c["inner"]) != "", F.col(c["inner"])).otherwise(F.coalesce(read("to"), F.lit(""))))
    df = df.withColumn(c["url"], F.when(F.col(c["dest"]) != "", canonical(F.col(c["dest"]))).otherwise(read("plain")))
    df = df.withColumn(c["platform"], F.when(F.col(c["url"]) != "", platform_id(F.col(c["url"]))))
    redirects = read("redirects")
    known = lambda x: F.concat(from_, F.lit("|"), x)
    by_record = known(F.concat(F.lit("record:"), F.coalesce(F.col(record).cast("string"), F.lit(""))))

    def made(identity: Column, confidence: Column, kind: Column, resolved: Column, leads: Column) -> Column:
        return F.struct(identity.alias("identity"), confidence.alias("confidence"), kind.alias("identity_type"), resolved.alias("resolved_url"), leads.alias("is_redirect"))

    lit, link = F.lit, F.col(c["url"])
    out = (
        F.when(own != "", made(known(own), lit("high"), lit("source_job_id"), lit(""), lit(False)))
        .when(redirects & (F.col(c["dest"]) == ""), made(by_record, lit("low"), lit("record_key"), lit(""), lit(True)))
        .when(F.col(c["platform"]).isNotNull(), made(known(F.col(c["platform"])), lit("high"), lit("platform_job_id"), link, redirects))
        .when(link != "", made(known(link), F.when(redirects, "high").otherwise("medium"), F.when(redirects, "resolved_url").otherwise("direct_url"), link, redirects))
        .otherwise(made(by_record, lit("low"), lit("record_key"), lit(""), redirects))
    )
    return df.withColumn(name, out).drop(*c.values())


def _is_specific(u: Column, given: Column) -> Column:
    """Whether a canonical address names a single posting; given is its parameter that holds an id, if any."""
    host, path = u["host"], u["path"]
    says = lambda pattern: path.rlike(pattern)

    def judged(parts: Column) -> Column:
        last = F.element_at(F.concat(F.array(F.lit("")), parts), -1)
        return (
            F.when(host.contains("greenhouse.io"), says("/jobs/[0-9]+(?:/|$)"))
            .when(host.contains("lever.co"), F.size(parts) >= 2)
            .when(host_in(host, ("ashbyhq.com",)), says("/(?:job|jobs)/[^/]+(?:/|$)") | says(f"(?i)^/[^/]+/{UUID}/?$"))
            .when(host.contains("smartrecruiters.com"), F.size(parts) >= 2)
            .when(host.contains("icims.com"), says("/jobs/[0-9]+(?:/|$)"))
            .when(host.contains("workday"), says("/(?:job|jobs)/[^/]+/[^/]+(?:/|$)"))
            .when((F.size(parts) < 2) | F.regexp_replace(F.lower(path), "/+$", "").isin(*GENERIC_PATHS), False)
            .otherwise(let(last, lambda x: x.rlike("[0-9]") | x.rlike("(?i)\\b(req|job|jr|id)[-_]?[0-9a-z]+")))
        )

    return F.when(given.isNotNull(), True).otherwise(let(F.filter(F.split(path, "/"), lambda p: p != ""), judged))


def is_third_party(url: Column) -> Column:
    return let(host_of(url), lambda host: host_in(host, THIRD_PARTIES))


def can_be_trusted(key: Column) -> Column:
    """Whether a verified key says something: not empty, and not the address of a third party."""
    key = F.coalesce(key, F.lit(""))
    return (key != "") & ~(key.startswith("official-url:") & is_third_party(F.substring(key, F.lit(len("official-url:") + 1), F.length(key))))


def verified_key(url: Column) -> Column:
    """The key that an official address gives, '' where it gives none or belongs to a third party."""
    return _read(url, _verified_key)


def key_and_specific(url: Column) -> Column:
    """A struct of key (as verified_key has it) and specific (as is_specific has it): the address is read once."""
    return _read(url, lambda text, u, given, specific: F.struct(_verified_key(text, u, given, specific).alias("key"), specific.alias("specific")))


def _verified_key(text: Column, u: Column, given: Column, specific: Column) -> Column:
    host = u["host"]
    key = lambda kind, value: F.concat(F.lit(f"{kind}:"), value)
    own = F.coalesce(
        F.when(host.contains("greenhouse.io"), key("greenhouse", F.coalesce(_parameter(u, ("gh_jid",))["value"], _found(text, "/jobs/([0-9]+)")))),
        F.when(host.contains("lever.co") & specific, key("lever", _found(text, "/([^/?#]+)$"))),
        F.when(host_in(host, ("ashbyhq.com",)), key("ashby", F.coalesce(_found(text, "/(?:job|jobs)/([^/?#]+)$"), F.lower(_found(u["path"], f"^/[^/]+/({UUID})/?$"))))),
        F.when(host.contains("smartrecruiters.com") & specific, key("smartrecruiters", _found(text, "/(?:[^/?#]+/)?([^/?#]+)$"))),
        F.when(host.contains("icims.com"), key("icims", _found(text, "/jobs/([0-9]+)"))),
        F.when(host.contains("workday"), key("workday", F.coalesce(given["value"], _found(text, "/(?:job|jobs)/[^/?#]*/([^/?#]+)")))),
        F.concat(host, F.lit(":"), given["name"], F.lit(":"), given["value"]),
        F.when(specific, key("official-url", text)),
        F.lit(""),
    )
    return F.when(host_in(host, THIRD_PARTIES) | (text == ""), "").otherwise(own)


def is_official(url: Column) -> Column:
    """Whether an address lies at a platform whose keys count."""
    return let(host_of(url), lambda host: ~host_in(host, THIRD_PARTIES) & reduce(lambda a, b: a | b, (host.contains(h) for h in OFFICIAL_HOSTS)))


def is_built_in(url: Column) -> Column:
    return let(host_of(url), lambda host: host_in(host, BUILT_IN))


def is_trusted(key: Column, source: Column, trust: Column, url: Column) -> Column:
    """Whether a stored key counts: not blank, marked as trusted, from a source that can vouch for it, and
    neither the key nor its address is a third party's."""
    small = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return (F.trim(F.coalesce(key, F.lit(""))) != "") & (small(trust) == "trusted") & small(source).isin(*TRUSTED_SOURCES) & can_be_trusted(key) & ~is_third_party(url)
