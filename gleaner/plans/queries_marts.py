"""The model graph and priorities over tables made of the driver's."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.catalog import query
from gleaner.functions import text
from gleaner.plans import board, checks, inputs, marts, postings
from gleaner.plans.inputs import with_sql
from gleaner.plans.queries_board import _DONE, _MODEL_KEY, _ORDER, BOARD, NOW, _board, _complete
from gleaner.sources.tables import table

_STAGED = f"""{with_sql("raw_jobs", "job_matches", "resume_job_scores")},
staged AS (SELECT *, {_MODEL_KEY} AS model_key FROM (SELECT *, coalesce(trim(description), '') <> '' AS is_described, CASE lower(source) WHEN 'remote-hunter' THEN 'remote hunter' ELSE lower(source) END AS src FROM raw_jobs)),
dedup AS (SELECT * FROM staged QUALIFY row_number() OVER (PARTITION BY model_key ORDER BY {_ORDER}) = 1),
best AS (SELECT model_key, m.* FROM (SELECT * REPLACE (coalesce(needs_review, false) AS needs_review) FROM job_matches) m JOIN staged USING (record_key) QUALIFY row_number() OVER (PARTITION BY model_key ORDER BY is_recommended DESC, needs_review DESC, match_score DESC, title_score DESC, search_id, record_key) = 1),
latest AS (SELECT model_key, s.* FROM (SELECT * REPLACE (coalesce(prompt_version, 'v1') AS prompt_version) FROM resume_job_scores) s JOIN staged USING (record_key) QUALIFY row_number() OVER (PARTITION BY resume_hash, model_key ORDER BY scored_at DESC NULLS LAST, overall_score DESC, record_key, model_name, prompt_version) = 1),
mart AS (SELECT resume_hash, l.model_key, d.record_key AS canonical_record_key, l.record_key AS scored_record_key, b.record_key AS rule_record_key, b.match_score AS rule_score, overall_score AS ai_score,
  CASE WHEN recommendation = 'apply' AND NOT description_complete THEN 'review' ELSE recommendation END AS recommendation, NOT description_complete AS has_incomplete_description,
  row_number() OVER (PARTITION BY resume_hash ORDER BY overall_score DESC, CASE WHEN recommendation = 'apply' AND description_complete THEN 3 WHEN recommendation = 'review' OR recommendation = 'apply' THEN 2 WHEN recommendation = 'skip' THEN 1 ELSE 0 END DESC, b.match_score DESC NULLS LAST, title, company_name, l.model_key) AS ai_score_rank
  FROM latest l JOIN dedup d USING (model_key) LEFT JOIN best b USING (model_key))"""


def _models(spark, d):
    t = {name: inputs.operational(spark, d, name) for name in ("raw_jobs", "job_matches", "resume_job_scores")}
    staged = marts.staged_jobs(t["raw_jobs"])
    return t, staged, marts.deduplicated_jobs(staged), marts.best_rule_matches(t["job_matches"], staged), marts.latest_scores(t["resume_job_scores"], staged)


@query(f"WITH {_STAGED} SELECT record_key, model_key AS exact_posting_key, model_key AS canonical_job_key, job_fingerprint AS duplicate_fingerprint, title, location FROM staged")
def stg_jobs(spark, d):
    return _models(spark, d)[1].select("record_key", "exact_posting_key", "canonical_job_key", "duplicate_fingerprint", "title", "location")


@query(f"WITH {_STAGED} SELECT model_key AS exact_posting_key, record_key AS canonical_record_key, discovered_at FROM dedup")
def int_jobs_deduplicated(spark, d):
    return _models(spark, d)[2].select("exact_posting_key", "canonical_record_key", "discovered_at")


@query(f"WITH {_STAGED} SELECT model_key AS exact_posting_key, record_key AS rule_record_key, match_score AS rule_score, search_id AS best_search_id, needs_review FROM best")
def int_best_rule_match(spark, d):
    return _models(spark, d)[3].select("exact_posting_key", "rule_record_key", "rule_score", "best_search_id", "needs_review")


@query(f"WITH {_STAGED} SELECT resume_hash, model_key AS exact_posting_key, record_key AS scored_record_key, overall_score AS ai_score, prompt_version, scored_at FROM latest")
def int_latest_resume_score(spark, d):
    return _models(spark, d)[4].select("resume_hash", "exact_posting_key", "scored_record_key", "ai_score", "prompt_version", "scored_at")


_MART = "resume_hash, exact_posting_key, canonical_record_key, scored_record_key, rule_record_key, rule_score, ai_score, recommendation, has_incomplete_description, ai_score_rank"


@query(f"WITH {_STAGED} SELECT {_MART.replace('exact_posting_key', 'model_key AS exact_posting_key')} FROM mart")
def mart_job_recommendations(spark, d):
    _, _, jobs, rules, scores = _models(spark, d)
    return marts.recommendations(scores, jobs, rules).select(*_MART.split(", "))


@query(f"""WITH {_STAGED} SELECT (SELECT count(*) FROM raw_jobs) AS raw_jobs, (SELECT max(discovered_at) FROM raw_jobs) AS latest_discovered, (SELECT count(*) FROM dedup) AS deduplicated_jobs, (SELECT count(DISTINCT record_key) FROM job_matches) AS rule_matched_jobs,
count(DISTINCT resume_hash) AS resumes, count(*) FILTER (recommendation = 'apply') AS apply_jobs, count(*) FILTER (recommendation = 'review') AS review_jobs, count(*) FILTER (recommendation = 'skip') AS skip_jobs, count(*) FILTER (NOT description_complete) AS incomplete_jobs,
max(scored_at) AS latest_scored, (SELECT count(*) FROM mart) AS recommendation_rows FROM latest""")
def mart_pipeline_summary(spark, d):
    t, _, jobs, rules, scores = _models(spark, d)
    return marts.pipeline_summary(t["raw_jobs"], jobs, t["job_matches"], scores, marts.recommendations(scores, jobs, rules))


@query("""SELECT 'a' || CAST(o_orderkey AS VARCHAR) AS assessment_id, 'c' || CAST(o_custkey AS VARCHAR) AS candidate_id, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 101 AS INTEGER) END AS overall_score, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS recommendation, CAST(NULL AS VARCHAR) AS summary
FROM orders JOIN customer ON o_custkey = c_custkey AND o_orderkey % 3 = c_custkey % 3""")
def mart_candidate_assessments(spark, d):
    c = F.col
    orders = table(spark, d, "orders")
    score = F.when(c("o_orderkey") % 5 == 0, F.lit('"none"')).otherwise((c("o_orderkey") % 101).cast("string"))
    payload = F.concat(F.lit('{"overall_score": '), score, F.when(c("o_orderkey") % 7 == 0, "").otherwise(F.concat(F.lit(', "recommendation": "'), c("o_orderstatus"), F.lit('"'))), F.lit("}"))
    assessments = orders.select(F.concat(F.lit("a"), c("o_orderkey").cast("string")).alias("assessment_id"), F.concat(F.lit("c"), c("o_custkey").cast("string")).alias("candidate_id"), payload.alias("payload"))
    people = table(spark, d, "customer").select(c("c_custkey"))
    active = orders.join(people, (c("o_custkey") == c("c_custkey")) & (c("o_orderkey") % 3 == c("c_custkey") % 3)).select(F.concat(F.lit("a"), c("o_orderkey").cast("string")).alias("assessment_id"), F.concat(F.lit("c"), c("o_custkey").cast("string")).alias("candidate_id"))
    return marts.candidate_assessments(assessments, active).select("assessment_id", "candidate_id", "overall_score", "recommendation", "summary")


@query(f"""WITH {_STAGED} SELECT 'incomplete_apply' AS check_name, count(*) FILTER (has_incomplete_description AND recommendation = 'apply') AS violations FROM mart UNION ALL SELECT 'no_address', count(*) FILTER (coalesce(trim(apply_url), '') = '') FROM staged
UNION ALL SELECT 'apply_below_75', count(*) FILTER (recommendation = 'apply' AND ai_score < 75) FROM mart UNION ALL SELECT 'scores_without_job', 0 UNION ALL SELECT 'repeated_match', count(*) FROM (SELECT record_key, search_id FROM job_matches GROUP BY ALL HAVING count(*) > 1)""")
def mart_checks(spark, d):
    t, staged, jobs, rules, scores = _models(spark, d)
    mart = marts.recommendations(scores, jobs, rules)
    found = {
        "incomplete_apply": checks.broken(mart, ~(F.col("has_incomplete_description") & (F.col("recommendation") == "apply"))),
        "no_address": checks.broken(staged, F.trim(F.coalesce("apply_url", F.lit(""))) != ""),
        "apply_below_75": checks.broken(mart, ~((F.col("recommendation") == "apply") & (F.col("ai_score") < 75))),
        "scores_without_job": checks.orphans(t["resume_job_scores"], t["raw_jobs"].withColumnRenamed("record_key", "job"), "record_key", "job"),
        "repeated_match": checks.repeated(t["job_matches"], ["record_key", "search_id"]),
    }
    out = None
    for name, rows in found.items():
        one = rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


_CLASS = """CASE WHEN title IN ('Junior Data Engineer', 'Software Engineer') THEN 'FILTERED_OUT' WHEN title IN ('Senior Data Engineer', 'BI Developer', 'Analytics Engineer', 'Staff Data Engineer', 'Power BI Developer', 'Sr. Analytics Engineer') THEN 'STRONG_MATCH' ELSE 'POSSIBLE_MATCH' END"""
_AGE = f"greatest(0, CAST(floor(epoch(TIMESTAMP '{NOW}' - discovered_at) / 86400) AS BIGINT))"
_PRIORITY = f"""{BOARD}, p AS (SELECT *, {_DONE} AS done, {_CLASS} AS kind, {_AGE} AS age, title IN ('Marketing Manager', 'Cook') AS unmatched, description_state IN ('NEEDS_ENRICHMENT', 'PARTIAL_JD', 'ENRICHMENT_REJECTED') AS thin, coalesce(enrichment_attempt_count, 0) AS tries FROM board),
labelled AS (SELECT *, CASE WHEN done THEN CASE recommendation WHEN 'apply' THEN 'High' WHEN 'review' THEN 'Medium' ELSE 'Low' END WHEN thin AND kind = 'STRONG_MATCH' THEN 'Medium' WHEN thin AND kind = 'POSSIBLE_MATCH' THEN 'Low' ELSE 'Mismatch' END AS label, CASE WHEN done THEN 'AI assessment' WHEN thin AND kind <> 'FILTERED_OUT' THEN 'Needs enrichment' ELSE 'Pre-screening' END AS origin FROM p)"""


def _prioritised(spark, d):
    c, none = F.col, F.lit(None).cast("string")
    complete, rows = _complete(board.fitting_class(_board(spark, d)))
    rows = rows.withColumns({
        "has_current_complete_ai_assessment": F.coalesce(complete, F.lit(False)), "age_days": text.age_days(F.lit(NOW).cast("timestamp_ntz"), c("discovered_at")).cast("int"),
        "attempt_count": c("enrichment_attempt_count"), "waiting_days": F.lit(None).cast("int"), "admission_decision": none, "critical_skill_gaps": F.array().cast("array<string>"), "role_family_match": none,
    })
    rows = rows.withColumn("fit", postings.fit_priority(c("has_current_complete_ai_assessment"))).withColumn("priority", postings.enrichment_priority())
    return rows.withColumns({"fit_priority_label": c("fit.label"), "fit_priority_source": c("fit.source")})


@query(f"WITH {_PRIORITY} SELECT record_key, label AS fit_priority_label, origin AS fit_priority_source FROM labelled")
def fit_priorities(spark, d):
    return _prioritised(spark, d).select("record_key", "fit_priority_label", "fit_priority_source")


_POINTS = """CASE application_status WHEN 'new' THEN 40 WHEN 'applied' THEN -35 ELSE -100 END + CASE kind WHEN 'STRONG_MATCH' THEN 30 WHEN 'POSSIBLE_MATCH' THEN 15 ELSE -100 END + CASE WHEN age <= 7 THEN 20 WHEN age <= 30 THEN 10 ELSE 0 END + CASE WHEN ai_score IS NULL THEN 10 ELSE -20 END
+ CASE description_state WHEN 'NEEDS_ENRICHMENT' THEN 15 WHEN 'PARTIAL_JD' THEN 8 WHEN 'FULL_JD' THEN -20 ELSE -40 END + CASE WHEN application_status = 'new' AND kind <> 'FILTERED_OUT' AND thin THEN CASE WHEN tries = 0 THEN 20 ELSE -least(20, tries * 4) END ELSE 0 END + CAST(least(10, greatest(0, floor(coalesce(rule_score, 0) / 10))) AS INT)"""


@query(f"""WITH {_PRIORITY} SELECT record_key, CAST({_POINTS} AS INT) AS score, CASE WHEN application_status = 'new' AND kind = 'STRONG_MATCH' THEN CASE WHEN age <= 7 THEN 'Tier 1' ELSE 'Tier 3' END WHEN application_status = 'new' AND kind = 'POSSIBLE_MATCH' THEN CASE WHEN age <= 7 THEN 'Tier 2' ELSE 'Tier 4' END ELSE 'Lowest priority' END AS tier FROM labelled""")
def enrichment_priorities(spark, d):
    return _prioritised(spark, d).select("record_key", "priority.score", "priority.tier")


_FIT = "CASE WHEN application_status IN ('applied', 'removed') AND done THEN 'recommended' WHEN NOT done AND (kind = 'FILTERED_OUT' OR unmatched) THEN 'low_fit' WHEN NOT done THEN 'needs_review' WHEN recommendation = 'apply' OR (recommendation = 'review' AND ai_score >= 50) OR ai_score >= 60 THEN 'recommended' WHEN (recommendation = 'skip' AND confidence = 'high') OR ai_score < 50 THEN 'low_fit' ELSE 'recommended' END"
_BUCKET = f"CASE WHEN {_FIT} = 'recommended' AND application_status = 'new' AND NOT coalesce(official_url_status = 'FOUND_VERIFIED', false) THEN 'needs_review' ELSE {_FIT} END"


def _bucketed(spark, d):
    active = F.coalesce(F.col("official_url_status") == board.FOUND, F.lit(False))
    return _prioritised(spark, d).withColumn("bucket", postings.review_bucket(active))


@query(f"WITH {_PRIORITY} SELECT record_key, {_BUCKET} AS bucket FROM labelled")
def review_buckets(spark, d):
    return _bucketed(spark, d).select("record_key", "bucket")


@query(f"WITH {_PRIORITY}, b AS (SELECT {_BUCKET} AS bucket FROM labelled) SELECT bucket, count(*) AS n FROM b WHERE bucket = 'recommended' GROUP BY 1 UNION ALL SELECT 'needs_review', count(*) FROM b WHERE bucket = 'needs_review' UNION ALL SELECT 'low_fit', count(*) FROM b WHERE bucket = 'low_fit'")
def review_bucket_views(spark, d):
    """How many postings each view of the board shows."""
    rows = _bucketed(spark, d).select("bucket")
    return rows.where(board.visible(F.col("bucket"), "Recommended") | board.visible(F.col("bucket"), "Needs review") | board.visible(F.col("bucket"), "Low fit")).groupBy("bucket").agg(F.count("*").alias("n"))


@query(f"""WITH {_PRIORITY}, waiting AS (SELECT *, {_POINTS} AS points FROM labelled WHERE application_status = 'new' AND thin AND kind <> 'FILTERED_OUT'),
ordered AS (SELECT record_key, row_number() OVER (ORDER BY points DESC, discovered_at DESC, record_key) AS queue_rank FROM waiting) SELECT * FROM ordered WHERE queue_rank <= 100""")
def enrichment_queue_rank(spark, d):
    """The first hundred of the queue that waits for descriptions."""
    waiting = _prioritised(spark, d).where((F.col("application_status") == "new") & F.col("description_state").isin(*board.INCOMPLETE) & (F.col("title_classification") != "FILTERED_OUT"))
    return board.queue_ranks(waiting, [F.desc("priority.score"), F.desc("discovered_at"), F.col("record_key")], 100).select("record_key", "queue_rank")
