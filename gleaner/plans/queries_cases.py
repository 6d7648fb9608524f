"""Row functions on made-up values with a number from the driver's tables, against results derived by hand.

A case is an input and an expected result, both with {k} for the key of a part. Every part meets every
case, so a query runs its function over many rows; its SQL only fills in the expected results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.catalog import ORACLE_SQL, QUERIES
from gleaner.functions import addresses, keys, requirements, scoring, text, titles
from gleaner.functions.similar import likeness
from gleaner.plans import evidence, postings
from gleaner.sources.tables import dealt, table


def cases(name: str, rows: list[tuple], run: Callable[[DataFrame], DataFrame]) -> None:
    """Registers a query: run adds `result`, a string, to rows with the columns k, a, b, c, ... of the inputs."""
    width = len(rows[0]) - 1
    columns = [chr(97 + j) for j in range(width)]

    def query(spark, d):
        made = F.array(*(F.struct(F.lit(n).alias("case_no"), *(F.lit(v).cast("string").alias(c) for c, v in zip(columns, row))) for n, row in enumerate(rows)))
        parts = dealt(table(spark, d, "part").select(F.col("p_partkey").alias("k"))).select("k", F.explode(made).alias("x")).select("k", "x.*")
        filled = parts.select("k", "case_no", *(F.replace(F.col(c), F.lit("{k}"), F.col("k").cast("string")).alias(c) for c in columns))
        return run(filled).select("k", "case_no", F.col("result").cast("string").alias("result"))

    quoted = lambda v: "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
    values = ", ".join(f"({n}, {quoted(row[-1])})" for n, row in enumerate(rows))
    query.__name__, query.__doc__ = name, f"{len(rows)} cases of {name}."
    QUERIES[name] = query
    ORACLE_SQL[name] = f"SELECT p_partkey AS k, case_no, CAST(replace(expected, '{{k}}', CAST(p_partkey AS VARCHAR)) AS VARCHAR) AS result FROM part, (VALUES {values}) AS v(case_no, expected)"


def column(make) -> Callable[[DataFrame], DataFrame]:
    """A run that only needs columns."""
    return lambda df: df.withColumn("result", make(*(F.col(c) for c in df.columns[2:])))


def joined(*parts) -> Column:
    return F.concat_ws(" # ", *(F.coalesce(F.lit(p) if isinstance(p, str) else p.cast("string"), F.lit("-")) for p in parts))


_G = "https://boards.greenhouse.io/acme/jobs/{k}"
cases(
    "posting_identity",
    [
        ("LinkedIn", "J-{k}", "https://x.com/1", "linkedin|j {k} # high # source_job_id #  # false"),
        ("linkedin", None, "https://www.linkedin.com/jobs/view/{k}/?trk=a&refId=b", "linkedin|linkedin:{k} # high # platform_job_id # https://www.linkedin.com/jobs/view/{k}?refId=b&trk=a # false"),
        ("lensa", " ", "https://u1.ct.sendgrid.net/ls/click?upn={k}", "lensa|record:{k} # low # record_key #  # true"),
        ("Zip-Recruiter", None, f"https://t.example.com/redirect?x=1&url={_G.replace(':', '%3A').replace('/', '%2F')}%3Futm_source%3Da", f"zip recruiter|greenhouse:{{k}} # high # platform_job_id # {_G} # true"),
        ("a", None, "https://t.example.com/go?url=https%253A%252F%252Fx.com%252Fgo%253Fu%253Dhttps%25253A%25252F%25252Fy.com%25252Fp{k}", "a|https://y.com/p{k} # high # resolved_url # https://y.com/p{k} # true"),
        ("a", None, "HTTPS://User@Acme.COM:8080//Careers//role-{k}/?utm_source=a&b=2&a=1&gclid=9#frag", "a|https://acme.com:8080/Careers/role-{k}?a=1&b=2 # medium # direct_url # https://acme.com:8080/Careers/role-{k}?a=1&b=2 # false"),
        ("a", None, "https://x.com/j?JobId={k}", "a|x.com:jobid:{k} # high # platform_job_id # https://x.com/j?JobId={k} # false"),
        ("a", None, "https://jobs.lever.co/acme/p{k}/", "a|lever:p{k} # high # platform_job_id # https://jobs.lever.co/acme/p{k} # false"),
        ("a", None, "https://jobs.ashbyhq.com/acme/job/q{k}", "a|ashby:q{k} # high # platform_job_id # https://jobs.ashbyhq.com/acme/job/q{k} # false"),
        ("a", None, None, "a|record:{k} # low # record_key #  # false"),
        (None, None, "", "|record:{k} # low # record_key #  # false"),
        ("a", None, "https://x.com/a?q=c%20d{k}&p=", "a|https://x.com/a?p=&q=c+d{k} # medium # direct_url # https://x.com/a?p=&q=c+d{k} # false"),
    ],
    lambda df: addresses.with_identity(df, "a", "b", "c", "k").withColumn("result", joined(*(F.col(f"posting.{x}") for x in ("identity", "confidence", "identity_type", "resolved_url", "is_redirect")))),
)

cases(
    "apply_url_identity",
    [("https://A.com/x/?utm_id=1&k={k}", "https://a.com/x?k={k}"), ("https://a.com", "https://a.com/"), ("https://a.com/?fbclid=1#x", "https://a.com/"), ("https://a.com/p?b=z{k}&B=1&a=%7E*", "https://a.com/p?a=~%2A&B=1&b=z{k}"), ("", ""), (None, "")],
    column(addresses.canonical),
)
cases(
    "redirect_urls",
    [("https://x.sendgrid.net/{k}", "true # "), ("https://a.com/click/{k}", "true # "), ("https://a.com/{k}?TARGET=b", "true # "), ("https://a.com/{k}?x=https%3A%2F%2Fb.com%2F{k}", "false # https://b.com/{k}"), ("https://a.com/x", "false # "), (None, "false # ")],
    lambda df: addresses.with_destination(df, "a", "to").withColumn("result", joined(addresses.is_redirect(F.col("a")), F.col("to"))),
)
cases(
    "verified_posting_keys",
    [
        (_G, "greenhouse:{k} # true # true # false # true"),
        (f"{_G}?gh_jid=7{{k}}", "greenhouse:7{k} # true # true # false # true"),
        ("https://jobs.lever.co/acme/{k}", "lever:{k} # true # true # false # true"),
        ("https://jobs.lever.co/{k}", " # false # false # false # true"),
        ("https://jobs.ashbyhq.com/a/0A0B0C0D-1111-2222-3333-444455556666", "ashby:0a0b0c0d-1111-2222-3333-444455556666 # true # true # false # true"),
        ("https://careers.smartrecruiters.com/Acme/{k}-x", "smartrecruiters:{k}-x # true # true # false # true"),
        ("https://acme.icims.com/jobs/{k}/login", "icims:{k} # true # true # false # true"),
        ("https://acme.wd1.myworkdayjobs.com/en/job/Rome/R-{k}", "workday:R-{k} # true # true # false # true"),
        ("https://acme.com/careers/data-engineer-{k}?utm_source=a", "official-url:https://acme.com/careers/data-engineer-{k} # true # true # false # false"),
        ("https://acme.com/careers", " # false # false # false # false"),
        ("https://acme.com/x?reqId={k}", "acme.com:reqid:{k} # true # true # false # false"),
        ("https://www.lensa.com/job/{k}", " # false # false # true # false"),
        (None, " # false # false # false # false"),
    ],
    lambda df: df.withColumn("of", addresses.key_and_specific(F.col("a"))).withColumn("third", addresses.is_third_party(F.col("a"))).withColumn("result", joined(F.col("of.key"), F.col("of.specific") & ~F.col("third"), addresses.can_be_trusted(F.col("of.key")), F.col("third"), addresses.is_official(F.col("a")))),
)
cases(
    "trusted_keys",
    [
        ("greenhouse:{k}", "direct_ats_source", "Trusted", _G, "true"),
        ("greenhouse:{k}", "search", "trusted", _G, "false"),
        ("greenhouse:{k}", "verified_reuse", "untrusted", _G, "false"),
        (" ", "verified_reuse", "trusted", _G, "false"),
        ("official-url:https://jobs.lensa.com/{k}", "verified_reuse", "trusted", None, "false"),
        ("official-url:https://notlensa.com/{k}", "verified_reuse", "trusted", None, "true"),
        ("lever:{k}", "verified_reuse", "trusted", "https://builtin.com/{k}", "false"),
        (None, None, None, None, "false"),
    ],
    column(lambda a, b, c, d: addresses.is_trusted(a, b, c, d)),
)
cases(
    "verified_scopes",
    [("workday:{k}", "https://a.wd1.myworkdayjobs.com/x", "workday:{k}|tenant:a.wd1.myworkdayjobs.com"), ("workday:{k}", "https://evil.com", None), ("workday:{k}", None, None), (" lever:{k}", None, "lever:{k}"), ("", "https://a.com", None)],
    column(postings.verified_scope),
)
cases(
    "normal_titles",
    [("Sr. Data Engineer (Remote, US)", "senior data engineer"), ("BI Developer", "business intelligence developer"), ("Data & Analytics - Lead", "data and analytics lead"), ("Jr. Cook – usa", "junior cook"), ("!!", "!!"), (None, ""), ("Data/ML Engineer II: hybrid", "data ml engineer ii")],
    column(titles.normal),
)
cases(
    "classified_titles",
    [
        ("Sr. Data Engineer", "STRONG_MATCH # 95 # Data Engineer is a primary target job family # data engineer"),
        ("[Apply now", "FILTERED_OUT # 0 # title is malformed link text # malformed link text"),
        ("!!", "FILTERED_OUT # 0 # title is malformed punctuation # malformed punctuation"),
        ("", "POSSIBLE_MATCH # 50 # title is missing or blank # -"),
        ("Data Business Analyst", "POSSIBLE_MATCH # 65 # Data business analysis may be relevant # data business analyst"),
        ("Business Analyst", "FILTERED_OUT # 30 # primary job family is Business Analysis # business analyst"),
        ("Junior Data Engineer", "FILTERED_OUT # 10 # title indicates a junior or early-career role # junior"),
        ("Data & Analytics Manager", "FILTERED_OUT # 20 # title is a management role rather than a hands-on IC role # manager"),
        ("Cook {k}", "POSSIBLE_MATCH # 50 # title did not match a configured target or exclusion family # -"),
        ("Data Platform Engineer", "POSSIBLE_MATCH # 72 # Data platform role may be relevant after description review # data platform"),
        ("Looker Developer", "STRONG_MATCH # 88 # Looker role is a primary target job family # looker"),
    ],
    lambda df: df.withColumn("n", titles.normal(F.col("a"))).withColumn("c", titles.classified(F.col("a"), F.col("n"))).withColumn("result", joined(F.col("c.category"), F.col("c.score"), F.col("c.reason"), F.col("c.matched_pattern"))),
)
cases(
    "excluded_titles",
    [("Scrum Master {k}", "true # primary job family is Scrum Master"), ("Data Engineer {k}", "false # -"), ("Cook", "false # -"), (None, "false # -")],
    lambda df: df.withColumn("n", titles.normal(F.col("a"))).withColumn("c", titles.classified(F.col("a"), F.col("n"))).withColumn("result", joined(F.col("c.category") == "FILTERED_OUT", F.when(F.col("c.category") == "FILTERED_OUT", F.col("c.reason")))),
)
cases("occupations", [("senior data engineer", "data_engineer"), ("bi developer", "business_intelligence_developer"), ("dba", "database_administrator"), ("cook {k}", None)], column(titles.occupation))
cases("seniority_levels", [("Sr Staff Engineer", "senior_staff"), ("Principal Cook", "principal"), ("Lead {k}", "lead"), ("Engineer III", "senior"), ("Engineer I", "entry"), ("Cook", "unknown"), (None, "unknown")], column(evidence.seniority))
cases("company_names", [("ACME, Inc.", "acme"), ("Müller & Söhne Co", "mu ller and so hne"), ("Company {k} LLC", "{k}"), (None, "")], column(keys.company_name))
cases("loose_texts", [("Ｆull—width & ﬁne {k}", "full width and fine {k}"), ("Straße", "strasse"), ("A  b\tC", "a b c"), (None, "")], column(keys.loose_text))
cases(
    "candidate_fingerprints",
    [("Sr. BI Eng", "Acme Inc", "Remote - United States", "senior business intelligence engineer|acme|remote-us"), ("Cook {k}", "The Co", "Remote", "cook {k}|the|remote"), ("A & B", None, "Austin, United States", "a and b||austin us"), (None, None, None, "||")],
    column(keys.candidate_fingerprint),
)
cases(
    "message_times",
    [
        ("Mon, 1 Jan 2024 08:30:00 -0500", "2024-01-01 13:30:00"), ("1 Feb 2024 00:00:00 GMT", "2024-02-01 00:00:00"), ("Tue, 02 Jan 2024 10:00:00 +0000 (UTC)", "2024-01-02 10:00:00"),
        ("2024-03-04T05:06:07Z", "2024-03-04 05:06:07"), ("2024-03-04 05:06:07+02:00", "2024-03-04 03:06:07"), ("2024-03-04", "2024-03-04 00:00:00"), ("soon {k}", None), (None, None),
    ],
    column(lambda a: F.date_format(keys.message_time(a), "yyyy-MM-dd HH:mm:ss")),
)
cases(
    "json_lists",
    [('["a{k}", "b"]', "a{k};b # 2"), ("[]", " # 0"), ('{"a": 1}', " # 0"), ("[broken", " # 0"), (None, " # 0"), ("[1, true]", "1;true # 2")],
    column(lambda a: joined(F.array_join(keys.string_list(a), ";"), F.size(keys.string_list(a)))),
)
cases(
    "requirement_matches",
    [
        ('[{"job_requirement": " SQL {k} ", "candidate_background": "yes", "match": "Strong"}, {"job_requirement": "x", "candidate_background": "", "match": "gap"}, {"job_requirement": "x", "candidate_background": "y", "match": "odd"}]', "SQL {k}:yes:strong"),
        ("[" + ", ".join('{"job_requirement": "r", "candidate_background": "b", "match": "gap"}' for _ in range(12)) + "]", ";".join(["r:b:gap"] * 10)),
        ("{}", ""), ("nope", ""), (None, ""),
    ],
    column(lambda a: F.array_join(F.transform(keys.requirement_matches(a), lambda r: F.concat_ws(":", r["job_requirement"], r["candidate_background"], r["match"])), ";")),
)
cases("cities", [("San Diego, CA", "San Diego"), (" REMOTE ", "Remote"), ("", "Unknown"), (None, "Unknown"), ("Town {k}", "Town {k}")], column(keys.city))
cases(
    "description_states",
    [("resolution_rejected", "500", "true", "ENRICHMENT_REJECTED"), (None, "80", "true", "FULL_JD"), ("enriched", "79", "true", "PARTIAL_JD"), ("enriched", "200", "false", "PARTIAL_JD"), (None, None, None, "NEEDS_ENRICHMENT")],
    column(lambda a, b, c: keys.description_state(a, b.cast("int"), c.cast("boolean"))),
)
_W = "word " * 90
cases(
    "description_quality",
    [
        ("requirements {k}", "false # 2 # below minimum description length"),
        (_W, "false # 90 # insufficient JD structure/content evidence"),
        (f"{_W}\nRequirements", "true # 91 # explicit JD section evidence"),
        (f"{'w ' * 210}\nAbout you\n you will build and design", "true # 217 # multiple independent JD content signals"),
        (f"{_W} Search results. Browse jobs. requirements", "false # 95 # search/listing or navigation-dominated content"),
        (None, "false # 0 # below minimum description length"),
    ],
    column(lambda a: joined(postings.description_quality(a)["full_jd"], postings.description_quality(a)["word_count"], postings.description_quality(a)["reason"])),
)
cases(
    "platform_tenure",
    [
        ("3+ years of experience with Snowflake", "Snowflake # 3"), ("Snowflake experience of 4 years", "Snowflake # 4"), ("5 years data engineering, including dbt", "- # -"), ("3 years with Snowflake or similar", "- # -"),
        ("3 years data engineering or analytics engineering, including 2 years building production dbt projects", "dbt # 2"), ("3 years with Snowflake and Databricks", "- # -"), (None, "- # -"),
    ],
    lambda df: requirements.platform_years(df, "a").withColumn("result", joined(F.col("platform"), F.col("years"))),
)
cases(
    "name_likeness",
    [("data engineer", "data engineer", "1.0"), ("data engineer ii", "data engineer", "0.896552"), ("engineer data", "data engineer", "1.0"), ("", "x", None), ("abcd", "bcde", "0.75"), ("cook {k}", "{k} cook", "1.0")],
    column(lambda a, b: F.round(likeness(a, b), 6)),
)
cases("states_in_places", [("Austin, TX", "Austin, TX", "20"), ("Dallas, TX", "Austin, TX", "10"), ("Rome", "Austin, TX", "0"), ("anywhere {k}", "", "10"), ("Reno, United States", "Austin, TX", "5")], column(lambda a, b: scoring.location_score(a, b, F.lit(False))))
cases("remote_places", [("Remote, US", "20"), ("United States {k}", "15"), ("Rome", "0"), (None, "0")], column(lambda a: scoring.location_score(a, F.lit(""), F.lit(True))))
cases("terms_in_texts", [("Senior C++ and SQL, {k}", "sql", "true"), ("mysql", "sql", "false"), ("a b c", "b  C", "true"), ("a", "", "false"), (None, "a", "false")], column(text.has_term))


def _hash_query(name: str, sql: str):
    def add(f):
        f.__name__ = name
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


_H = "lower(trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g')))"
_KEYS_SQL = f"""SELECT o_orderkey, sha256('mail|' || {_H.format("o_orderstatus || '  X'")} || '|' || {_H.format("o_orderpriority")}) AS record_key,
sha256({_H.format("o_orderpriority")} || '|company ' || o_custkey || '|') AS fingerprint,
CASE WHEN o_orderkey % 2 = 0 THEN sha256('mail|' || o_orderkey) ELSE sha256('mail|inbox|a@b|' || {_H.format("o_orderpriority")} || '|') END AS email_key,
CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE sha256(trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', ' ', 'g'))) END AS description_hash FROM orders"""


@_hash_query("hash_keys", _KEYS_SQL)
def hash_keys(spark, d):
    c, lit, none = F.col, F.lit, F.lit(None).cast("string")
    orders = table(spark, d, "orders").withColumn("id", F.when(c("o_orderkey") % 2 == 0, c("o_orderkey").cast("string")))
    return orders.select(
        "o_orderkey",
        keys.record_key(lit(" MAIL"), F.concat("o_orderstatus", lit("  X")), c("o_orderpriority")).alias("record_key"),
        keys.job_fingerprint(c("o_orderpriority"), F.concat(lit("Company "), c("o_custkey").cast("string")), none).alias("fingerprint"),
        keys.email_key(lit("Mail"), c("id"), lit("Inbox"), lit("a@B"), c("o_orderpriority"), none).alias("email_key"),
        keys.description_hash(F.when(c("o_orderkey") % 3 == 0, " -- ").otherwise(c("o_orderpriority"))).alias("description_hash"),
    )
