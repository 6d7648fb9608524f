"""The board of postings and its queues over tables made of the driver's; SQL starts from the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.catalog import query
from gleaner.plans import board, inputs, marts, postings
from gleaner.plans.inputs import with_sql

RESUME, PROMPT, SCREEN, NOW = "h1", "v9", "e3", "1998-12-01 00:00:00"


def _tables(spark, d) -> board.Tables:
    return board.prepared({name: inputs.operational(spark, d, name) for name in inputs.TABLES})


def _mart(t: board.Tables):
    """The mart's whole scores of the resume and the prompt, as the board takes them."""
    staged = marts.staged_jobs(t["raw_jobs"])
    rows = marts.recommendations(marts.latest_scores(t["resume_job_scores"], staged), marts.deduplicated_jobs(staged), marts.best_rule_matches(t["job_matches"], staged))
    rows = rows.where((F.col("resume_hash") == RESUME) & (F.col("prompt_version") == PROMPT) & (F.col("description_word_count") >= 80) & ~F.col("has_incomplete_description"))
    return rows.select("exact_posting_key", F.col("ai_score").alias("overall_score"), *board.SCORE_COLUMNS)


def _board(spark, d):
    t = _tables(spark, d)
    return board.all_jobs(t, RESUME, PROMPT, SCREEN, _mart(t))


_ORDER = "is_described DESC, description_updated_at DESC NULLS LAST, discovered_at DESC NULLS LAST, record_key"
_MODEL_KEY = "CASE WHEN source_job_id <> '' THEN src || '|' || lower(trim(source_job_id)) WHEN contains(apply_url, '/ls/click') OR coalesce(apply_url, '') = '' THEN src || '|record:' || record_key ELSE src || '|' || lower(apply_url) END"
_FILTERED = "title IN ('Junior Data Engineer', 'Software Engineer')"
BOARD = f"""{with_sql("raw_jobs", "job_matches", "resume_job_scores", "application_status", "resume_job_eligibility")},
attempts AS (SELECT *, CASE WHEN lower(coalesce(verified_posting_key_trust, '')) <> 'trusted' THEN NULL
  WHEN starts_with(verified_posting_key, 'greenhouse:') OR (starts_with(verified_posting_key, 'lever:') AND NOT contains(official_job_url, 'builtin.com')) THEN verified_posting_key
  WHEN starts_with(verified_posting_key, 'workday:') AND contains(official_job_url, '.myworkdayjobs.com/') THEN verified_posting_key || '|tenant:' || split_part(official_job_url, '/', 3) END AS scope FROM ({inputs.ATTEMPTS})),
jobs AS (SELECT *, coalesce(nullif(job_fingerprint, ''), record_key) AS duplicate_fingerprint, coalesce(trim(description), '') <> '' AS is_described, CASE lower(source) WHEN 'remote-hunter' THEN 'remote hunter' ELSE lower(source) END AS src FROM raw_jobs),
canon AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY exact_key ORDER BY {_ORDER}) = 1),
matched AS (SELECT exact_key, search_title, match_score FROM job_matches JOIN jobs USING (record_key) QUALIFY row_number() OVER (PARTITION BY exact_key ORDER BY is_recommended DESC NULLS LAST, needs_review DESC NULLS LAST, match_score DESC, title_score DESC, search_id, record_key) = 1),
statused AS (SELECT exact_key, scope, s.status, s.record_key, updated_at FROM application_status s JOIN jobs USING (record_key) LEFT JOIN attempts a ON a.record_key = s.record_key),
own_status AS (SELECT * FROM statused QUALIFY row_number() OVER (PARTITION BY exact_key ORDER BY updated_at DESC NULLS LAST, record_key) = 1),
scope_status AS (SELECT * FROM statused WHERE scope IS NOT NULL QUALIFY row_number() OVER (PARTITION BY scope ORDER BY updated_at DESC NULLS LAST, record_key) = 1),
tried AS (SELECT exact_key, a.* FROM attempts a JOIN jobs USING (record_key) QUALIFY row_number() OVER (PARTITION BY exact_key ORDER BY status = 'enriched' DESC, last_attempted_at DESC NULLS LAST, a.record_key) = 1),
screened AS (SELECT canonical_job_key AS exact_key, decision FROM resume_job_eligibility WHERE prompt_version = '{SCREEN}' QUALIFY row_number() OVER (PARTITION BY canonical_job_key ORDER BY screened_at DESC NULLS LAST, record_key) = 1),
own_scores AS (SELECT * FROM resume_job_scores WHERE resume_hash = '{RESUME}' AND coalesce(prompt_version, 'v1') = '{PROMPT}' AND description_complete),
exact_scores AS (SELECT c.exact_key, s.* FROM own_scores s JOIN jobs j ON s.record_key = j.record_key JOIN canon c ON c.exact_key = j.exact_key WHERE s.description_word_count >= 80 AND j.is_full AND c.is_full
  AND s.scored_at >= coalesce(c.description_updated_at, TIMESTAMP '1970-01-01') QUALIFY row_number() OVER (PARTITION BY c.exact_key ORDER BY s.scored_at DESC NULLS LAST, s.record_key, model_name) = 1),
scope_scores AS (SELECT a.scope, a.description_hash, s.* FROM own_scores s JOIN attempts a ON s.record_key = a.record_key WHERE a.scope IS NOT NULL AND a.description_hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY a.scope, a.description_hash ORDER BY s.scored_at DESC NULLS LAST, s.record_key) = 1),
mart AS (SELECT * FROM (SELECT lower({_MODEL_KEY}) AS model_key, s.* FROM resume_job_scores s JOIN jobs j USING (record_key) QUALIFY row_number() OVER (PARTITION BY s.resume_hash, {_MODEL_KEY} ORDER BY s.scored_at DESC NULLS LAST, overall_score DESC, s.record_key, model_name, coalesce(prompt_version, 'v1')) = 1)
  WHERE resume_hash = '{RESUME}' AND prompt_version = '{PROMPT}' AND description_word_count >= 80 AND description_complete),
board AS (SELECT c.record_key, c.exact_key AS exact_posting_key, c.duplicate_fingerprint, c.title, c.source, c.location, c.apply_url, c.words, c.is_full, c.discovered_at, c.description_updated_at, search_title AS best_search_title, match_score AS rule_score,
  coalesce(o.status, v.status, 'new') AS application_status, CASE WHEN o.status IS NOT NULL THEN 'exact' WHEN v.status IS NOT NULL THEN 'verified_posting' ELSE 'default' END AS application_status_scope,
  coalesce(o.record_key, v.record_key) AS application_status_record_key, CASE WHEN o.status IS NOT NULL THEN o.updated_at ELSE v.updated_at END AS application_status_updated_at,
  t.status AS enrichment_status, t.attempt_count AS enrichment_attempt_count, t.last_attempted_at AS enrichment_attempted_at, t.official_url_status, t.official_job_url, t.official_url_resolved_at, t.official_url_source, t.description_source, t.scope, t.description_hash,
  CASE WHEN e.overall_score IS NOT NULL THEN e.overall_score WHEN m.overall_score IS NOT NULL THEN m.overall_score ELSE w.overall_score END AS ai_score,
  CASE WHEN e.overall_score IS NOT NULL OR m.overall_score IS NOT NULL THEN 'exact' WHEN w.overall_score IS NOT NULL THEN 'verified_posting' END AS ai_score_scope,
  CASE WHEN e.overall_score IS NOT NULL THEN e.recommendation WHEN m.overall_score IS NOT NULL THEN m.recommendation ELSE w.recommendation END AS recommendation,
  CASE WHEN e.overall_score IS NOT NULL THEN e.confidence WHEN m.overall_score IS NOT NULL THEN m.confidence ELSE w.confidence END AS confidence,
  CASE WHEN e.overall_score IS NOT NULL THEN e.scored_at WHEN m.overall_score IS NOT NULL THEN m.scored_at ELSE w.scored_at END AS ai_scored_at, decision AS eligibility_decision,
  CASE WHEN coalesce(t.status, '') = 'resolution_rejected' THEN 'ENRICHMENT_REJECTED' WHEN c.words >= 80 AND c.is_full THEN 'FULL_JD' WHEN c.words > 0 THEN 'PARTIAL_JD' ELSE 'NEEDS_ENRICHMENT' END AS description_state
  FROM canon c LEFT JOIN matched b ON b.exact_key = c.exact_key LEFT JOIN own_status o ON o.exact_key = c.exact_key LEFT JOIN tried t ON t.exact_key = c.exact_key LEFT JOIN scope_status v ON v.scope = t.scope
  LEFT JOIN exact_scores e ON e.exact_key = c.exact_key LEFT JOIN mart m ON m.model_key = lower(c.exact_key) AND m.scored_at >= coalesce(c.description_updated_at, TIMESTAMP '1970-01-01')
  LEFT JOIN scope_scores w ON w.scope = t.scope AND w.description_hash = t.description_hash LEFT JOIN screened x ON x.exact_key = c.exact_key)"""
_COLUMNS = "record_key, exact_posting_key, duplicate_fingerprint, title, best_search_title, rule_score, application_status, application_status_scope, application_status_record_key, application_status_updated_at, enrichment_status, official_url_status, scope, ai_score, ai_score_scope, recommendation, ai_scored_at, eligibility_decision, description_state"


@query(f"WITH {BOARD} SELECT {_COLUMNS} FROM board")
def all_jobs(spark, d):
    return _board(spark, d).select(*_COLUMNS.split(", "))


@query(f"WITH {BOARD} SELECT j.record_key, coalesce(o.status, v.status, 'new') AS status FROM jobs j LEFT JOIN own_status o ON o.exact_key = j.exact_key LEFT JOIN tried t ON t.exact_key = j.exact_key LEFT JOIN scope_status v ON v.scope = t.scope")
def automatic_statuses(spark, d):
    return board.automatic_statuses(_tables(spark, d))


_AUTOMATIC = "(SELECT j.record_key FROM jobs j LEFT JOIN own_status o ON o.exact_key = j.exact_key LEFT JOIN tried t ON t.exact_key = j.exact_key LEFT JOIN scope_status v ON v.scope = t.scope WHERE coalesce(o.status, v.status, 'new') = 'new')"
_SHOWN = "source NOT IN ('glassdoor', 'builtin') OR (official_url_status = 'FOUND_VERIFIED' AND official_job_url <> '' AND NOT contains(official_job_url, 'lensa.com'))"
_QUEUE = f"""{BOARD}, model_scores AS (SELECT * FROM own_scores WHERE model_name = 'm1'),
done AS (SELECT c.exact_key FROM model_scores s JOIN jobs j ON j.record_key = s.record_key JOIN jobs c ON c.exact_key = j.exact_key WHERE s.scored_at >= coalesce(c.description_updated_at, TIMESTAMP '1970-01-01')
  UNION SELECT c.exact_key FROM model_scores s JOIN attempts a ON a.record_key = s.record_key JOIN attempts b ON a.scope = b.scope AND a.description_hash = b.description_hash JOIN jobs c ON c.record_key = b.record_key WHERE s.scored_at >= coalesce(c.description_updated_at, TIMESTAMP '1970-01-01')),
queue AS (SELECT * FROM (SELECT j.record_key, j.exact_key AS exact_posting_key, j.title, j.source, j.words, m.match_score AS rule_score, m.search_id, a.official_url_status, a.official_job_url,
  row_number() OVER (PARTITION BY j.exact_key ORDER BY is_recommended DESC NULLS LAST, needs_review DESC NULLS LAST, match_score DESC, title_score DESC, is_described DESC, description_updated_at DESC NULLS LAST, discovered_at DESC NULLS LAST, j.record_key, m.search_id) AS k
  FROM jobs j JOIN job_matches m ON m.record_key = j.record_key LEFT JOIN attempts a ON a.record_key = j.record_key
  LEFT JOIN (SELECT DISTINCT canonical_job_key, decision FROM resume_job_eligibility WHERE prompt_version = '{SCREEN}') e ON e.canonical_job_key = j.exact_key
  WHERE m.match_score >= 20 AND j.is_full AND NOT ({_FILTERED}) AND coalesce(a.status, '') <> 'resolution_rejected' AND j.exact_key NOT IN (SELECT exact_key FROM done)
  AND j.record_key IN {_AUTOMATIC} AND j.exact_key NOT IN (SELECT exact_key FROM own_status WHERE status <> 'new') AND coalesce(e.decision, 'needs_description') IN ('eligible', 'needs_description')
  AND (e.decision IS NOT NULL OR j.exact_key NOT IN (SELECT canonical_job_key FROM resume_job_eligibility WHERE prompt_version = 'v1' AND decision = 'exclude'))) WHERE k = 1 AND ({_SHOWN}))"""


def _scoring(t: board.Tables):
    return board.scoring_queue(t, RESUME, "m1", PROMPT, SCREEN, 20)


@query(f"WITH {_QUEUE} SELECT record_key, exact_posting_key, title, words, rule_score, search_id FROM queue")
def scoring_queue(spark, d):
    return _scoring(_tables(spark, d)).select("record_key", "exact_posting_key", "title", "words", "rule_score", "search_id")


@query(f"WITH {_QUEUE} SELECT count(*) AS unscored FROM queue")
def scoring_queue_size(spark, d):
    return _scoring(_tables(spark, d)).agg(F.count("*").alias("unscored"))


@query(f"WITH {_QUEUE} SELECT record_key, rule_score, title FROM queue ORDER BY rule_score DESC, title, record_key LIMIT 25")
def scoring_batch(spark, d):
    """The first postings of the queue: the limit comes after all gates."""
    return _scoring(_tables(spark, d)).select("record_key", "rule_score", "title").orderBy(F.desc("rule_score"), "title", "record_key").limit(25)


@query(f"""WITH {BOARD} SELECT record_key, exact_posting_key, title FROM (SELECT j.record_key, j.exact_key AS exact_posting_key, j.title, j.source, a.official_url_status, a.official_job_url, row_number() OVER (PARTITION BY j.exact_key ORDER BY coalesce(a.status, '') <> 'resolution_rejected' AND is_described DESC,
  description_updated_at DESC NULLS LAST, discovered_at DESC NULLS LAST, j.record_key) AS k FROM jobs j LEFT JOIN attempts a ON a.record_key = j.record_key
  WHERE NOT ({_FILTERED}) AND j.exact_key NOT IN (SELECT canonical_job_key FROM resume_job_eligibility WHERE prompt_version = '{SCREEN}') AND j.exact_key NOT IN (SELECT exact_key FROM own_status WHERE status <> 'new') AND j.record_key IN {_AUTOMATIC}) WHERE k = 1 AND ({_SHOWN})""")
def screening_queue(spark, d):
    return board.screening_queue(_tables(spark, d), RESUME, SCREEN).select("record_key", "exact_posting_key", "title")


_WAITS = f"CAST(coalesce(official_url_resolved_at, enrichment_attempted_at) > TIMESTAMP '{NOW}' - INTERVAL 7 DAY AS BOOLEAN)"
_RETRY = "('AMBIGUOUS', 'BLOCKED', 'ERROR', 'OFFICIAL_NOT_FOUND', 'SEARCH_DEFERRED')"


@query(f"""WITH {BOARD} SELECT record_key, CASE WHEN ai_score IS NOT NULL THEN 'AI_SCORED' WHEN description_state = 'FULL_JD' AND record_key IN (SELECT record_key FROM board WHERE application_status = 'new' AND rule_score >= 60) THEN 'SCORING_PENDING' WHEN description_state = 'FULL_JD' THEN 'SCORING_EXCLUDED'
WHEN official_url_status IN {_RETRY} AND coalesce({_WAITS}, false) THEN 'ENRICHMENT_COOLDOWN' WHEN enrichment_status = 'blocked' AND coalesce(official_url_status, '') <> 'FOUND_VERIFIED' THEN 'ENRICHMENT_PENDING' WHEN official_url_status IN {_RETRY} THEN 'ENRICHMENT_PENDING'
WHEN coalesce(enrichment_attempt_count, 0) = 0 THEN 'NEEDS_ENRICHMENT' ELSE 'UNRESOLVED_DESCRIPTION' END AS code FROM board""")
def job_pipeline_states(spark, d):
    eligible = (F.col("application_status") == "new") & F.coalesce(F.col("rule_score") >= 60, F.lit(False))
    return _board(spark, d).select("record_key", board.pipeline_state(F.lit(NOW).cast("timestamp_ntz"), eligible)["code"].alias("code"))


_AGGREGATOR = "source IN ('glassdoor', 'builtin')"


@query(f"""WITH {BOARD} SELECT record_key, official_url_status IS DISTINCT FROM 'FOUND_VERIFIED' AND NOT (description_state = 'FULL_JD' AND NOT {_AGGREGATOR}) AND NOT (coalesce(official_url_status, '') IN {_RETRY} AND coalesce({_WAITS}, false)) AS official,
NOT (words >= 80 AND description_state = 'FULL_JD') AND ((coalesce(official_url_status, '') = 'FOUND_VERIFIED' AND scope IS NOT NULL AND coalesce(enrichment_status, '') NOT IN ('failed', 'blocked')) OR enrichment_status IS NULL OR enrichment_status IN ('failed', 'blocked')) AS description FROM board""")
def enrichment_needs(spark, d):
    return _board(spark, d).select("record_key", board.needs_official(F.lit(NOW).cast("timestamp_ntz")).alias("official"), board.needs_description(True).alias("description"))


def _complete(df):
    """Whether a row's score is current and for a full description."""
    return postings.complete_score(PROMPT), df.withColumns({"description_words": F.col("words"), "description_complete": F.lit(True), "candidate_assessment_id": F.lit(None).cast("string")})


_DONE = "(ai_score IS NOT NULL AND words >= 80 AND description_state = 'FULL_JD' AND coalesce(ai_scored_at >= description_updated_at, true))"
_TRUSTED = """CASE WHEN scope IS NULL THEN NULL WHEN starts_with(scope, 'greenhouse:') AND official_job_url = 'https://boards.greenhouse.io/acme/jobs/' || substr(scope, 12) THEN scope WHEN starts_with(scope, 'lever:') AND official_job_url = 'https://jobs.lever.co/acme/' || substr(scope, 7) THEN scope
WHEN starts_with(scope, 'workday:') AND split_part(official_job_url, '/', 7) = substr(split_part(scope, '|', 1), 9) THEN scope END"""
_ORIGIN = "CASE WHEN description_source = 'greenhouse' THEN 3 WHEN description_source = 'source_verified' THEN 2 WHEN description_source = 'verified_reuse' THEN 1 ELSE 0 END"
_SEEN = f"(application_status IN ('applied', 'removed') OR (official_url_status = 'FOUND_VERIFIED' AND contains(official_job_url, 'builtin.com')) OR (source = 'builtin' AND {_DONE}) OR {_SHOWN})"


def _shown(spark, d):
    complete, rows = _complete(_board(spark, d))
    return complete, board.display_scope(rows.where(board.is_reviewable(F.coalesce(complete, F.lit(False)))))


@query(f"""WITH {BOARD}, seen AS (SELECT *, {_DONE} AS done, {_TRUSTED} AS trusted_key FROM board WHERE {_SEEN})
SELECT record_key, trusted_key, ai_score FROM (SELECT *, row_number() OVER (PARTITION BY trusted_key ORDER BY application_status_updated_at DESC NULLS LAST, CASE application_status WHEN 'removed' THEN 2 WHEN 'applied' THEN 1 ELSE 0 END DESC, description_state = 'FULL_JD' DESC, {_ORIGIN} DESC, done DESC,
CASE WHEN description_state = 'FULL_JD' THEN description_updated_at END DESC NULLS LAST, CASE WHEN done THEN ai_scored_at END DESC NULLS LAST, record_key) AS k FROM seen WHERE trusted_key IS NOT NULL) WHERE k = 1
UNION ALL SELECT record_key, trusted_key, ai_score FROM seen WHERE trusted_key IS NULL""")
def board_display(spark, d):
    complete, rows = _shown(spark, d)
    return board.displayed(rows, complete).select("record_key", "trusted_key", "ai_score")


@query(f"""WITH {BOARD}, seen AS (SELECT *, {_DONE} AS done, {_TRUSTED} AS trusted_key, CASE lower(source) WHEN 'remote-hunter' THEN 'remote hunter' ELSE lower(source) END AS src FROM board WHERE {_SEEN})
SELECT a.record_key, a.application_status = 'new' AND a.trusted_key IS NULL AND EXISTS (SELECT 1 FROM seen b WHERE b.application_status = 'removed' AND b.trusted_key IS NULL AND b.src = a.src AND b.duplicate_fingerprint = a.duplicate_fingerprint AND b.exact_posting_key <> a.exact_posting_key AND b.application_status_updated_at <= a.discovered_at) AS similar_removed FROM seen a""")
def similar_previously_removed(spark, d):
    return board.previously_removed(_shown(spark, d)[1]).select("record_key", "similar_removed")


@query(f"""WITH {BOARD}, seen AS (SELECT * FROM board WHERE {_SEEN}) SELECT count(*) AS reviewable_jobs, count(*) FILTER (application_status = 'new') AS new_jobs, count(*) FILTER (application_status = 'applied') AS applied_jobs, count(*) FILTER (application_status = 'removed') AS removed_jobs,
count(*) FILTER (description_state = 'NEEDS_ENRICHMENT') AS needs_enrichment, count(*) FILTER (description_state = 'FULL_JD') AS full_jd, count(*) FILTER (description_state = 'PARTIAL_JD') AS partial_jd, count(*) FILTER (description_state = 'ENRICHMENT_REJECTED') AS rejected_enrichment, count(ai_score) AS ai_scored FROM seen""")
def board_metrics(spark, d):
    return board.metrics(_shown(spark, d)[1])


@query(f"""WITH {BOARD} SELECT record_key FROM board WHERE {_SEEN} AND application_status = 'new' AND trim(split_part(location, ',', 1)) = 'Austin' AND CAST(discovered_at AS DATE) BETWEEN DATE '1994-01-01' AND DATE '1999-06-30' AND ai_score IS NULL AND title IN ('BI Developer', 'Data Analyst')""")
def board_filters(spark, d):
    picked = {"status": "new", "source": None, "city": "Austin", "since": "1994-01-01", "until": "1999-06-30", "scored": False, "titles": ["business intelligence developer", "data analyst"], "recommendation": ""}
    return _shown(spark, d)[1].where(board.chosen_by(picked)).select("record_key")


@query(f"""WITH {with_sql("job_matches")} SELECT record_key, search_id, match_score FROM job_matches QUALIFY row_number() OVER (PARTITION BY record_key ORDER BY is_recommended DESC NULLS LAST, needs_review DESC NULLS LAST, match_score DESC, search_id) = 1""")
def best_match_of_record(spark, d):
    return board.best_match_of_record(inputs.operational(spark, d, "job_matches")).select("record_key", "search_id", "match_score")
