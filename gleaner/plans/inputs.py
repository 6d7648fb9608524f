"""Operational tables of the posting engine made of the driver's tables.

Each table is one SELECT in words that Spark and other engines share, so that a query and its SQL start
from the same rows. Orders are postings, lines are their rule matches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from gleaner.sources.tables import dealt, table

_K = "CAST(o_orderkey AS STRING)"
_C = "CAST(o_custkey AS STRING)"


def _pick(number: str, *values: str | None) -> str:
    """One of some SQL values, by a number modulo their count."""
    return f"CASE {number} % {len(values)} " + " ".join(f"WHEN {k} THEN {v or 'NULL'}" for k, v in enumerate(values)) + " END"


SOURCES = ("linkedin", "indeed", "ziprecruiter", "remote hunter", "glassdoor", "builtin", "greenhouse", "lever")
TITLES = ("Senior Data Engineer", "BI Developer", "Data Analyst", "Analytics Engineer", "Marketing Manager", "Cook", "Data Business Analyst", "Junior Data Engineer", "Staff Data Engineer", "Power BI Developer", "Software Engineer", "Sr. Analytics Engineer", "Data Platform Engineer")
#: Shapes of addresses, and what a posting without an id of its own is known by, from the same numbers.
_SHAPES = (
    (f"'https://www.linkedin.com/jobs/view/' || {_C}", f"'linkedin:' || {_C}"),
    (f"'https://boards.greenhouse.io/acme/jobs/' || {_C} || '?utm_source=m'", f"'greenhouse:' || {_C}"),
    (f"'https://jobs.lever.co/acme/p' || {_C}", f"'lever:p' || {_C}"),
    (f"'https://x.example.com/careers/role?jobId=' || {_C}", f"'x.example.com:jobid:' || {_C}"),
    (f"'https://u.sendgrid.net/ls/click?id=' || {_K}", f"'record:r' || {_K}"),
    (f"'https://t.example.com/redirect?url=https%3A%2F%2Fboards.greenhouse.io%2Facme%2Fjobs%2F' || {_C}", f"'greenhouse:' || {_C}"),
    (f"'https://Acme.com//Careers/role-' || {_C} || '/?utm_source=a&b=2&a=1#frag'", f"'https://acme.com/Careers/role-' || {_C} || '?a=1&b=2'"),
    ("''", f"'record:r' || {_K}"),
    (None, f"'record:r' || {_K}"),
)
_SOURCE = _pick("o_orderkey", *(f"'{s}'" for s in ("linkedin", "Indeed", "ziprecruiter", "Remote-Hunter", "glassdoor", "builtin", "greenhouse", "lever")))
_OWN = f"CASE WHEN o_orderkey % 3 = 0 THEN 'J-' || CAST(o_custkey % 300 AS STRING) WHEN o_orderkey % 3 = 1 THEN ' ' END"
_FULL = "o_orderkey % 5 IN (2, 4)"
_DESCRIPTION = _pick("o_orderkey", None, "'short text'", "repeat('word ', 90) || 'Requirements: SQL'", "repeat('word ', 90)", "repeat('you will build and design data ', 40) || 'About you'")

#: Expected identity and state of a description, by construction.
IDENTITY = f"CASE WHEN o_orderkey % 3 = 0 THEN {_pick('o_orderkey', *(f"'{s}'" for s in SOURCES))} || '|j ' || CAST(o_custkey % 300 AS STRING) ELSE {_pick('o_orderkey', *(f"'{s}'" for s in SOURCES))} || '|' || {_pick('o_orderkey', *(i for _, i in _SHAPES))} END"
WORDS = _pick("o_orderkey", "0", "2", "92", "90", "242")

RAW_JOBS = f"""SELECT 'r' || {_K} AS record_key, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'f' || CAST(o_custkey % 50 AS STRING) END AS job_fingerprint,
{_SOURCE} AS source, {_OWN} AS source_job_id, {_pick("o_orderkey", *(f"'{t}'" for t in TITLES))} AS title, 'Company ' || CAST(o_custkey % 40 AS STRING) AS company_name,
{_pick("o_orderkey", "'Remote, US'", "'Austin, TX'", "'Rome'", None)} AS location, {_DESCRIPTION} AS description, {_pick("o_orderkey", *(u for u, _ in _SHAPES))} AS apply_url,
o_orderdate AS discovered_at, CASE WHEN o_orderkey % 4 = 1 THEN o_orderdate + INTERVAL '3' DAY END AS description_updated_at FROM orders"""

JOB_MATCHES = """SELECT 'r' || CAST(l_orderkey AS STRING) AS record_key, 's' || CAST(l_linenumber AS STRING) AS search_id, 'Search ' || CAST(l_linenumber AS STRING) AS search_title,
CAST(l_quantity * 2 AS INT) AS match_score, CAST(l_linenumber * 5 AS INT) AS title_score, l_returnflag = 'R' AS is_recommended,
CASE WHEN l_linestatus = 'O' THEN true WHEN l_returnflag = 'A' THEN false END AS needs_review, l_shipdate AS scored_at FROM lineitem WHERE l_orderkey % 6 <> 5"""

SCORES = f"""SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'h2' ELSE 'h1' END AS resume_hash, 'r' || {_K} AS record_key, CAST(floor(o_totalprice) AS BIGINT) % 101 AS overall_score,
CASE WHEN CAST(floor(o_totalprice) AS BIGINT) % 101 >= 75 THEN 'apply' WHEN CAST(floor(o_totalprice) AS BIGINT) % 101 >= 50 THEN 'review' ELSE 'skip' END AS recommendation,
{_pick("o_orderkey", "'high'", "'medium'", "'low'")} AS confidence, 70 + o_orderkey % 30 AS description_word_count, o_orderkey % 10 <> 4 AS description_complete,
'm' || CAST(o_orderkey % 2 AS STRING) AS model_name, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN 'v1' ELSE 'v9' END AS prompt_version,
o_orderdate + INTERVAL '5' DAY AS scored_at FROM orders WHERE o_orderkey % 5 <> 1"""

STATUSES = f"""SELECT 'r' || {_K} AS record_key, {_pick("o_orderkey", "'applied'", "'removed'", "'new'")} AS status, CASE WHEN o_orderkey % 20 <> 0 THEN o_orderdate + INTERVAL '2' DAY END AS updated_at FROM orders WHERE o_orderkey % 5 = 0"""

ATTEMPTS = f"""SELECT 'r' || {_K} AS record_key, {_pick("o_orderkey", "'enriched'", "'blocked'", "'failed'", "'enriched'", "'resolution_rejected'", "'blocked'", "'enriched'", "'failed'", "'enriched'", "'enriched'", "'enriched'")} AS status,
CAST(o_orderkey % 4 AS INT) AS attempt_count, o_orderdate + INTERVAL '1' DAY AS last_attempted_at,
{_pick("o_orderkey", f"'greenhouse:' || CAST(o_custkey % 90 AS STRING)", "'workday:' || CAST(o_custkey % 20 AS STRING)", "'official-url:https://jobs.lensa.com/' || CAST(o_custkey AS STRING)", "' '", None, "'lever:' || CAST(o_custkey % 60 AS STRING)")} AS verified_posting_key,
{_pick("o_orderkey", "'direct_ats_source'", "'Verified_Reuse'", "'official_found_verified'", "'search'", None, "'official_found_verified'")} AS verified_posting_key_source,
CASE WHEN o_orderkey % 11 = 3 THEN 'untrusted' WHEN o_orderkey % 11 = 5 THEN NULL ELSE 'Trusted' END AS verified_posting_key_trust,
{_pick("o_orderkey", f"'https://boards.greenhouse.io/acme/jobs/' || CAST(o_custkey % 90 AS STRING)", "'https://t' || CAST(o_custkey % 3 AS STRING) || CASE WHEN o_custkey % 7 = 0 THEN '.example.com/job/a/1' ELSE '.wd1.myworkdayjobs.com/en/job/a/' || CAST(o_custkey % 20 AS STRING) END", "'https://jobs.lensa.com/' || CAST(o_custkey AS STRING)", "''", None, "CASE WHEN o_custkey % 9 = 0 THEN 'https://builtin.com/job/' ELSE 'https://jobs.lever.co/acme/' END || CAST(o_custkey % 60 AS STRING)")} AS official_job_url,
{_pick("o_orderkey", "'FOUND_VERIFIED'", "'FOUND_VERIFIED'", "'FOUND_VERIFIED'", "'SEARCH_DEFERRED'", None, "'FOUND_VERIFIED'", "'AMBIGUOUS'", "'BLOCKED'")} AS official_url_status,
CASE WHEN o_orderkey % 8 = 7 THEN 'search' END AS official_url_source, o_orderdate + INTERVAL '4' DAY AS official_url_resolved_at,
CASE WHEN o_orderkey % 9 <> 0 THEN 'd' || CAST(o_custkey % 3 AS STRING) END AS description_hash, {_pick("o_orderkey", "'greenhouse'", "'source_verified'", "'verified_reuse'", None)} AS description_source FROM orders WHERE o_orderkey % 4 <> 3"""

ELIGIBILITY = f"""SELECT 'h1' AS resume_hash, {IDENTITY} AS canonical_job_key, CASE WHEN o_orderkey % 14 = 0 THEN 'v1' ELSE 'e3' END AS prompt_version,
{_pick("o_orderkey", "'eligible'", "'exclude'", "'needs_description'")} AS decision, o_orderdate + INTERVAL '6' DAY AS screened_at, 'r' || {_K} AS record_key FROM orders WHERE o_orderkey % 7 = 0"""

TABLES = {"raw_jobs": (RAW_JOBS, "orders"), "job_matches": (JOB_MATCHES, "lineitem"), "resume_job_scores": (SCORES, "orders"), "application_status": (STATUSES, "orders"), "job_enrichment_attempts": (ATTEMPTS, "orders"), "resume_job_eligibility": (ELIGIBILITY, "orders")}


#: Those whose rows take long, as their addresses and descriptions are read.
LONG = ("raw_jobs", "job_enrichment_attempts")


def operational(spark: SparkSession, folder: str, name: str) -> DataFrame:
    sql, base = TABLES[name]
    rows = table(spark, folder, base)
    return spark.sql(sql.replace(f"FROM {base}", "FROM {base}"), base=dealt(rows) if name in LONG else rows)


def with_sql(*names: str) -> str:
    """The tables as a list for WITH, raw_jobs with its identity (exact_key), word count (words) and full."""
    made = {n: sql for n, (sql, _) in TABLES.items()}
    made["raw_jobs"] = RAW_JOBS.replace("SELECT ", f"SELECT {IDENTITY} AS exact_key, {WORDS} AS words, {_FULL} AS is_full, ", 1)
    return reduce(lambda a, b: f"{a}, {b}", (f"{n} AS ({made[n]})" for n in names))
