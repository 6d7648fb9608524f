"""Scores, choices, states, writes and counts of the posting engine on tables made of the driver's."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.catalog import query
from gleaner.functions import requirements
from gleaner.operators.keyed import counted_upsert, guarded_update
from gleaner.plans import board, evidence, inputs, postings
from gleaner.plans.inputs import with_sql
from gleaner.plans.queries_board import _QUEUE, BOARD, _scoring, _tables
from gleaner.plans.queries_cases import cases, joined
from gleaner.plans.queries_marts import _POINTS, _PRIORITY, _prioritised
from gleaner.sources.tables import staged, table

_PARTS = {"title_fit": "l_quantity * 2", "skills_fit": "l_discount * 1000", "experience_fit": "l_linenumber * 10", "seniority_fit": "l_tax * 1000", "industry_fit": "100 - l_quantity", "location_fit": "l_suppkey % 101"}


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, CAST(round_even({' + '.join(f'({e}) * {w}' for (_, e), w in zip(_PARTS.items(), postings.WEIGHTS.values()))}, 0) AS INTEGER) AS score FROM lineitem")
def overall_scores(spark, d):
    rows = table(spark, d, "lineitem").withColumns({n: F.expr(e) for n, e in _PARTS.items()})
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", postings.overall_score().alias("score"))


_SCORED = "SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 100 ELSE CAST(o_orderkey * 13 % 101 AS INT) END AS title_score, CASE WHEN o_orderkey % 6 = 0 THEN 100 ELSE CAST(o_orderkey * 7 % 101 AS INT) END AS company_score FROM orders"
_CANDIDATE = "CASE WHEN company_score < 70 THEN least(title_score, 45) ELSE CAST(round_even(title_score * 0.55 + company_score * 0.45, 0) AS INT) END"


def _candidates(spark, d):
    return spark.sql(_SCORED.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders"))


@query(f"""SELECT o_orderkey, {_CANDIDATE} AS score, CASE WHEN company_score < 70 THEN 'company mismatch' WHEN title_score = 100 AND company_score = 100 THEN 'exact normalized title/company match' WHEN title_score >= 90 AND company_score = 100 THEN 'very strong title match and exact company'
WHEN title_score >= 80 AND company_score >= 80 THEN 'strong title/company match' ELSE 'weak match' END AS reason FROM ({_SCORED})""")
def candidate_scores(spark, d):
    rows = _candidates(spark, d).withColumn("c", postings.candidate_score(F.col("title_score"), F.col("company_score")))
    return rows.select("o_orderkey", "c.score", "c.reason")


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, company_score DESC, title_score DESC, o_orderkey) AS k FROM (SELECT *, {_CANDIDATE} AS score FROM ({_SCORED})))
SELECT a.o_custkey, a.o_orderkey, a.score FROM r a LEFT JOIN r b ON b.o_custkey = a.o_custkey AND b.k = 2 AND b.score >= 75 WHERE a.k = 1 AND a.score >= 75 AND ((a.title_score = 100 AND a.company_score = 100) OR b.score IS NULL OR a.score - b.score >= 8)""")
def candidate_selection(spark, d):
    return postings.selected(_candidates(spark, d), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "score")


@query("""WITH r AS (SELECT o_custkey, 'u' || CAST(o_orderkey AS VARCHAR) AS url, (o_orderkey * 37 % 1000) / 1000.0 AS confidence, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey * 37 % 1000 DESC, o_orderkey % 50 DESC, 'u' || CAST(o_orderkey AS VARCHAR) DESC) AS k FROM orders)
SELECT a.o_custkey, CASE WHEN a.confidence - b.confidence < 0.05 - 1e-12 THEN 'AMBIGUOUS' ELSE 'VERIFIED' END AS outcome, CASE WHEN a.confidence - b.confidence < 0.05 - 1e-12 THEN NULL ELSE a.url END AS url FROM r a LEFT JOIN r b ON b.o_custkey = a.o_custkey AND b.k = 2 WHERE a.k = 1""")
def verified_choice(spark, d):
    c = F.col
    rows = table(spark, d, "orders").select("o_custkey", F.concat(F.lit("u"), c("o_orderkey").cast("string")).alias("url"), ((c("o_orderkey") * 37 % 1000) / F.lit(1000.0)).alias("confidence"), (c("o_orderkey") % 50).alias("words"))
    return postings.chosen(rows, "o_custkey", 0.05 - 1e-12)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 60 <= 48 THEN 'ACTIVE' ELSE 'UNKNOWN' END AS status FROM orders""")
def actionability_status(spark, d):
    """A cached state counts for two days, for the same key, address and context."""
    k = F.col("o_orderkey")
    now = F.lit("1998-12-01 00:00:00").cast("timestamp_ntz")
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.lit("ACTIVE").alias("cached_status"), F.lit("key").alias("trusted_key"), F.when(k % 4 == 3, "other").otherwise("key").alias("checked_key"),
        F.lit("u").alias("official_url"), F.when(k % 5 == 0, None).otherwise("u").alias("checked_url"), F.when(k % 7 == 0, "old").otherwise("now").alias("checked_context"),
        F.timestamp_micros((F.unix_micros(now.cast("timestamp")) - (k % 60) * 3_600_000_000).cast("long")).alias("checked_at"),
    )
    return rows.select("o_orderkey", evidence.effective_status(now, 48, "now").alias("status"))


@query("""WITH c AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 101 AS score, o_orderkey % 3 AS a, o_orderkey % 4 AS b FROM orders), m AS (SELECT o_orderkey, score, CAST((a = 1) AS INT) + CAST((b = 2) AS INT) AS lacking, CAST((a = 2) AS INT) + CAST((b = 3) AS INT) AS uncertain FROM c)
SELECT 'c' || CAST(o_orderkey AS VARCHAR) AS case_id, CAST(2 AS BIGINT) AS mandatory_total, CAST(2 - lacking - uncertain AS BIGINT) AS mandatory_met, CAST(lacking AS BIGINT) AS mandatory_not_demonstrated, CAST(uncertain AS BIGINT) AS mandatory_uncertain, lacking + uncertain > 0 AS flagged,
CAST(lacking + uncertain + CASE WHEN score >= 95 AND lacking > 0 THEN 1 ELSE 0 END + CASE WHEN score >= 95 AND uncertain > 0 THEN 1 ELSE 0 END AS INT) AS flags FROM m""")
def evidence_flags(spark, d):
    k, c = F.col("o_orderkey"), F.col
    state = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int"))
    item = lambda name, must, status: F.struct(F.lit(name).alias("requirement"), F.lit(must).alias("mandatory"), status.alias("status"), F.lit("seen").alias("resume_evidence"))
    rows = F.array(item("one", True, state(3, "met", "not_demonstrated", "partial")), item("two", True, state(4, "met", "met", "not_demonstrated", "unclear")), item("three", False, state(2, "partial", "not_demonstrated")))
    made = table(spark, d, "orders").select(F.concat(F.lit("c"), k.cast("string")).alias("case_id"), (F.floor("o_totalprice").cast("long") % 101).cast("double").alias("stored_score"), F.lit("inflated").alias("review_label"), rows.alias("requirements"))
    return evidence.assessed(made).select("case_id", "mandatory_total", "mandatory_met", "mandatory_not_demonstrated", "mandatory_uncertain", "flagged", F.size("flags").alias("flags"))


cases(
    "identity_validation",
    [
        ("Data Engineer", "Acme Inc", "Data Engineer", "ACME", None, None, "true # 1.0 # identity accepted"),
        ("Data Engineer", "Acme", "Data Analyst", "Acme", None, None, "false # 0.675 # title mismatch; primary occupation mismatch"),
        ("Data Engineer", None, "Data Engineer", "Acme", "k{k}", "k{k}", "true # 0.85 # identity accepted with trusted exact posting proof; company unavailable"),
        ("Data Engineer", "", "Data Engineer", "", None, None, "false # 0.55 # company unavailable; independent same-posting proof unavailable"),
        ("Data Engineer", "Acme", None, "Acme", None, None, "false # 0.55 # resolved title missing"),
        ("Cook {k}", "Diner", "Cook {k}", "Other Place", None, None, "false # - # company mismatch"),
    ],
    lambda df: postings.validated(df.withColumnsRenamed({"a": "title", "b": "company", "c": "resolved_title", "d": "resolved_company", "e": "trusted_key", "f": "resolved_key"})).withColumn(
        "result", joined(F.col("accepted"), F.when(F.col("company").isNull() | (F.col("company") != "Diner"), F.col("confidence")), F.col("reason"))
    ),
)
cases(
    "requirement_clauses",
    [
        ("<p>We build. Our mission is essential</p><h3>Requirements:</h3><ul><li>SQL {k}; Python (on AWS preferred)</li><li>Helpful: Go</li></ul>", "We build.:unknown:false:false;Our mission is essential:unknown:false:false;SQL {k}:required:true:false;Python (on AWS preferred):required:true:false;Helpful: Go:required:false:true"),
        ("SQL fluency is essential. Must know {k}", "SQL fluency is essential.:unknown:true:false;Must know {k}:unknown:true:false"),
        ("Nice to have\nRust required", "Rust required:optional:false:true"),
    ],
    lambda df: df.join(
        requirements.clauses(df.select(F.concat_ws("-", "k", "case_no").alias("key"), F.col("a").alias("description")), "key")
        .withColumn("one", F.concat_ws(":", "clause", "section", F.col("mandatory").cast("string"), F.col("optional").cast("string")))
        .groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "one"))), lambda x: x["one"]), ";").alias("result")),
        F.concat_ws("-", "k", "case_no") == F.col("key"), "left",
    ),
)


@query(f"WITH {with_sql('raw_jobs')} SELECT record_key, discovered_at, title FROM raw_jobs WHERE source LIKE '%in%' AND title NOT LIKE 'Sr%' AND apply_url LIKE 'https://%' ORDER BY discovered_at DESC, record_key LIMIT 200")
def newest_raw_jobs(spark, d):
    raw = inputs.operational(spark, d, "raw_jobs")
    kept = raw.where(F.col("source").like("%in%") & ~F.col("title").like("Sr%") & F.col("apply_url").startswith("https://"))
    return kept.select("record_key", "discovered_at", "title").orderBy(F.desc_nulls_last("discovered_at"), "record_key").limit(200)


@query("""WITH a AS (SELECT user_id, count(*) AS n, max(event_id) AS last_event FROM events WHERE event_type = 'error' GROUP BY 1), b AS (SELECT user_id, min(event_id) AS last_event, CAST(3 AS BIGINT) AS attempt_count FROM events GROUP BY 1)
SELECT b.user_id, greatest(b.last_event, coalesce(a.last_event, 0)) AS last_event, attempt_count + coalesce(n, 0) AS attempt_count FROM b LEFT JOIN a USING (user_id)""")
def attempt_upsert(spark, d):
    events = table(spark, d, "events")
    before = events.groupBy("user_id").agg(F.min("event_id").alias("last_event"), F.lit(3).cast("long").alias("attempt_count"))
    return counted_upsert(before, events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("last_event")), "user_id", "attempt_count", [F.desc("last_event")])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 AND o_orderstatus = 'O' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderkey % 5 = 0 AND o_orderstatus = 'O' AS changed FROM orders")
def compare_and_update(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    changes = orders.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("O").alias("expected"), F.lit("X").alias("value"))
    return guarded_update(orders, changes, "o_orderkey", "o_orderstatus")


@query(f"WITH {with_sql('raw_jobs')} SELECT record_key, 'removed' AS status FROM raw_jobs WHERE exact_key = (SELECT exact_key FROM raw_jobs WHERE record_key = 'r3')")
def status_change(spark, d):
    jobs = staged(board.identified(inputs.operational(spark, d, "raw_jobs")).select("record_key", "exact_posting_key"))
    return board.status_changes(jobs, "r3", "removed", F.lit("1998-12-01").cast("timestamp_ntz")).drop("updated_at")


@query(f"""WITH {_QUEUE} SELECT 'raw_jobs' AS name, count(*) AS n FROM jobs UNION ALL SELECT 'exact_postings', count(DISTINCT exact_key) FROM jobs UNION ALL SELECT 'attempts_' || status, count(*) FROM attempts GROUP BY status UNION ALL SELECT 'ai_score_eligible', count(*) FROM queue""")
def operation_metrics(spark, d):
    t = _tables(spark, d)
    return board.operation_metrics(t["jobs"], t["attempts"], _scoring(t))


@query(f"""WITH {_PRIORITY}, r AS (SELECT CASE WHEN application_status = 'new' AND kind = 'STRONG_MATCH' THEN CASE WHEN age <= 7 THEN 'Tier 1' ELSE 'Tier 3' END WHEN application_status = 'new' AND kind = 'POSSIBLE_MATCH' THEN CASE WHEN age <= 7 THEN 'Tier 2' ELSE 'Tier 4' END ELSE 'Lowest priority' END AS tier, CAST({_POINTS} AS INT) AS score FROM labelled)
SELECT tier, count(*) AS n, max(score) AS best, min(score) AS worst FROM r GROUP BY 1""")
def enrichment_tiers(spark, d):
    return _prioritised(spark, d).groupBy(F.col("priority.tier").alias("tier")).agg(F.count("*").alias("n"), F.max("priority.score").alias("best"), F.min("priority.score").alias("worst"))


@query(f"WITH {BOARD} SELECT source, count(*) AS n, count(DISTINCT exact_key) AS postings FROM jobs GROUP BY 1")
def postings_by_source(spark, d):
    jobs = board.identified(inputs.operational(spark, d, "raw_jobs"))
    return jobs.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("exact_posting_key").alias("postings"))


_DOC_WORDS = "len(list_filter(regexp_split_to_array(translate(coalesce(text, ''), '’‘', ''''''), '\\s+'), lambda w: w <> ''))"
_KINDS = lambda p: f"len(list_distinct(list_transform(regexp_extract_all(t, '{p}'), lambda x: lower(x))))"
_SQL = lambda p: p.replace("'", "''")


@query(f"""WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '’‘', '''''') AS t, {_DOC_WORDS} AS n FROM documents),
q AS (SELECT doc_id, n, CASE WHEN n < 80 THEN 'below minimum description length' WHEN {_KINDS(postings.SEARCH_PAGE)} >= 2 OR (len(regexp_extract_all(t, '{postings.CHROME}')) >= 4 AND list_sum(list_transform(regexp_extract_all(t, '{postings.CHROME}'), lambda x: len(regexp_split_to_array(x, '\\s+')))) >= n * 0.25) THEN 'search/listing or navigation-dominated content'
WHEN regexp_matches(t, '{_SQL(postings.STRONG_SECTION)}') THEN 'explicit JD section evidence' WHEN n >= 200 AND CAST(regexp_matches(t, '{postings.ROLE_SECTION}') AS INT) + CAST(regexp_matches(t, '{postings.QUALIFICATION_SECTION}') AS INT) + CAST(regexp_matches(t, '{_SQL(postings.APPLICANT)}') AS INT) + CAST({_KINDS(postings.WORK)} >= 2 AS INT) >= 2 THEN 'multiple independent JD content signals' ELSE 'insufficient JD structure/content evidence' END AS reason FROM d)
SELECT doc_id, n AS word_count, reason FROM q""")
def full_text_quality(spark, d):
    docs = table(spark, d, "documents").withColumn("q", postings.description_quality(F.col("text")))
    return docs.select("doc_id", F.col("q.word_count").cast("long").alias("word_count"), "q.reason")
