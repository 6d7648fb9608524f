"""The board of postings: one row for each posting with its match, status, score, eligibility and page, the
queues that feed on it, and what is shown.

Tables come as a dict of DataFrames by name, through prepared. Every lookup is one row for each key, found by a window, and
joins by equality; a null key meets nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import addresses, keys, titles
from gleaner.functions.text import loose, word_count
from gleaner.operators.keyed import first_per_key, newest
from gleaner.plans import postings
from gleaner.sources.tables import staged

# Sources that only pass postings on, states of official lookups, and where descriptions come from.
AGGREGATORS = ("bebee", "builtin", "glassdoor", "jobleads", "joblookup", "jobright", "lensa")
FOUND = "FOUND_VERIFIED"
RETRY_STATES, COOLDOWN_DAYS = ("AMBIGUOUS", "BLOCKED", "ERROR", "OFFICIAL_NOT_FOUND", "SEARCH_DEFERRED"), 7
FAILED = ("failed", "blocked")
DIRECT, FROM_SOURCE, REUSED = ("verified_official_direct", "greenhouse", "lever", "ashby", "workday", "icims", "smartrecruiters"), ("source_verified", "source_verified_known_candidate"), "verified_reuse"
INCOMPLETE = ("NEEDS_ENRICHMENT", "PARTIAL_JD", "ENRICHMENT_REJECTED")
LEAST_WORDS = 80
EPOCH = "1970-01-01"

Tables = dict[str, DataFrame]


def prepared(t: Tables) -> Tables:
    """t with jobs (raw_jobs with their identity) and attempts (with their trusted scope), which every lookup
    reads: written once, as identities take long."""
    return t | {"jobs": staged(identified(t["raw_jobs"])), "attempts": staged(with_scope(t["job_enrichment_attempts"]))}


def identified(raw: DataFrame) -> DataFrame:
    """raw_jobs with exact_posting_key, duplicate_fingerprint, words, full_jd and is_described."""
    out = addresses.with_identity(raw).withColumn("exact_posting_key", F.col("posting.identity")).drop("posting")
    said = F.trim(F.coalesce("description", F.lit(""))) != ""
    out = out.withColumn("duplicate_fingerprint", F.coalesce(F.nullif("job_fingerprint", F.lit("")), "record_key")).withColumn("is_described", said)
    return out.withColumn("words", F.when(said, word_count(F.col("description"))).otherwise(0)).withColumn("full_jd", postings.description_quality(F.col("description"))["full_jd"])


def with_scope(attempts: DataFrame) -> DataFrame:
    """Attempts with scope: what a trusted verified key identifies, null where it is not to be trusted."""
    c = F.col
    trusted = addresses.is_trusted(c("verified_posting_key"), c("verified_posting_key_source"), c("verified_posting_key_trust"), c("official_job_url"))
    return attempts.withColumn("scope", F.when(trusted, postings.verified_scope(c("verified_posting_key"), c("official_job_url"))))


def canonical(jobs: DataFrame) -> DataFrame:
    """The posting's own row: one with a description, the newest one."""
    return first_per_key(jobs, ["exact_posting_key"], [F.col("is_described").desc(), newest("description_updated_at"), newest("discovered_at"), F.col("record_key")])


def best_matches(matches: DataFrame, jobs: DataFrame) -> DataFrame:
    joined = matches.join(jobs.select("record_key", "exact_posting_key"), "record_key")
    order = [F.col("is_recommended").desc_nulls_last(), F.col("needs_review").desc_nulls_last(), newest("match_score"), newest("title_score"), F.col("search_id"), F.col("record_key")]
    return first_per_key(joined, ["exact_posting_key"], order)


def best_match_of_record(matches: DataFrame) -> DataFrame:
    """The best match of each record; of equal ones the first search."""
    return first_per_key(matches, ["record_key"], [F.col("is_recommended").desc_nulls_last(), F.col("needs_review").desc_nulls_last(), newest("match_score"), F.col("search_id")])


def latest_statuses(statuses: DataFrame, jobs: DataFrame, attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The latest status of each posting, and of each trusted scope."""
    known = statuses.join(jobs.select("record_key", "exact_posting_key", F.col("source").alias("status_source")), "record_key")
    order = [newest("updated_at"), F.col("record_key")]
    scoped = known.join(attempts.where("scope is not null").select("record_key", "scope"), "record_key")
    return first_per_key(known, ["exact_posting_key"], order), first_per_key(scoped, ["scope"], order)


def best_attempts(attempts: DataFrame, jobs: DataFrame) -> DataFrame:
    """The attempt that stands for a posting: one that succeeded, the last one."""
    joined = attempts.join(jobs.select("record_key", "exact_posting_key"), "record_key")
    return first_per_key(joined, ["exact_posting_key"], [(F.col("status") == "enriched").desc(), newest("last_attempted_at"), F.col("record_key")])


def latest_eligibility(eligibility: DataFrame, resume: str, prompt: str) -> DataFrame:
    own = eligibility.where((F.col("resume_hash") == resume) & (F.col("prompt_version") == prompt))
    return first_per_key(own, ["canonical_job_key"], [newest("screened_at"), F.col("record_key")]).withColumnRenamed("canonical_job_key", "exact_posting_key")


def _own_scores(scores: DataFrame, resume: str, prompt: str) -> DataFrame:
    return scores.where((F.col("resume_hash") == resume) & (F.coalesce("prompt_version", F.lit("v1")) == prompt) & F.col("description_complete"))


def _epoch(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(EPOCH).cast("timestamp_ntz"))


def exact_scores(scores: DataFrame, jobs: DataFrame, current: DataFrame, resume: str, prompt: str) -> DataFrame:
    """The latest score of each posting that still holds: whole and full descriptions then and now, none newer."""
    own = _own_scores(scores, resume, prompt).where(F.col("description_word_count") >= LEAST_WORDS)
    own = own.join(jobs.where("full_jd").select("record_key", "exact_posting_key"), "record_key")
    own = own.join(current.where("full_jd").select("exact_posting_key", F.col("description_updated_at").alias("_changed")), "exact_posting_key")
    return first_per_key(own.where(F.col("scored_at") >= _epoch("_changed")), ["exact_posting_key"], [newest("scored_at"), F.col("record_key"), F.col("model_name")])


def verified_scores(scores: DataFrame, attempts: DataFrame, resume: str, prompt: str) -> DataFrame:
    """The latest score of each trusted scope and description."""
    known = attempts.where("scope is not null and trim(coalesce(description_hash, '')) <> ''").select("record_key", "scope", "description_hash")
    return first_per_key(_own_scores(scores, resume, prompt).join(known, "record_key"), ["scope", "description_hash"], [newest("scored_at"), F.col("record_key")])


SCORE_COLUMNS = ("recommendation", "confidence", "description_word_count", "prompt_version", "scored_at")


def all_jobs(t: Tables, resume: str, prompt: str, screen: str, mart: DataFrame | None = None) -> DataFrame:
    """One row for each posting.

    The status is the posting's own, else that of its trusted scope, else new. The score is taken whole from
    the first of: the posting's own score, the mart's row (exact_posting_key, overall_score and the columns
    of SCORE_COLUMNS), the score of its trusted scope and description."""
    jobs, attempts = t["jobs"], t["attempts"]
    current = canonical(jobs)
    own, scoped = latest_statuses(t["application_status"], jobs, attempts)
    out = current.join(best_matches(t["job_matches"], jobs).select("exact_posting_key", F.col("search_title").alias("best_search_title"), F.col("match_score").alias("rule_score")), "exact_posting_key", "left")
    tried = best_attempts(attempts, jobs).withColumnsRenamed({"status": "enrichment_status", "attempt_count": "enrichment_attempt_count", "last_attempted_at": "enrichment_attempted_at"}).drop("record_key")
    out = out.join(tried, "exact_posting_key", "left")
    status = lambda df, key, as_: df.select(key, *(F.col(c).alias(f"_{as_}_{c}") for c in ("status", "status_source", "record_key", "updated_at")))
    out = out.join(status(own, "exact_posting_key", "own"), "exact_posting_key", "left").join(status(scoped, "scope", "scoped"), "scope", "left")
    of = lambda c: F.coalesce(f"_own_{c}", f"_scoped_{c}")
    exact_there = F.col("_own_status").isNotNull()
    out = out.withColumns({
        "application_status": F.coalesce(of("status"), F.lit("new")),
        "application_status_scope": F.when(exact_there, "exact").when(F.col("_scoped_status").isNotNull(), "verified_posting").otherwise("default"),
        "application_status_record_key": of("record_key"),
        "application_status_source": of("status_source"),
        "application_status_updated_at": F.when(exact_there, F.col("_own_updated_at")).otherwise(F.col("_scoped_updated_at")),
    })
    layers = [("exact", exact_scores(t["resume_job_scores"], jobs, current, resume, prompt), ["exact_posting_key"])]
    if mart is not None:
        out = out.withColumn("_lower", F.lower("exact_posting_key"))
        layers.append(("mart", mart.withColumn("_lower", F.lower("exact_posting_key")), ["_lower"]))
    layers.append(("verified", verified_scores(t["resume_job_scores"], attempts, resume, prompt), ["scope", "description_hash"]))
    for name, layer, on in layers:
        out = out.join(layer.select(*on, *(F.col(c).alias(f"_{name}_{c}") for c in ("overall_score", *SCORE_COLUMNS))), on, "left")
        if name == "mart":  # a row of the mart counts while no newer description came
            fresh = F.col("_mart_scored_at") >= _epoch("description_updated_at")
            out = out.withColumn("_mart_overall_score", F.when(fresh, F.col("_mart_overall_score")))
    first = lambda c: reduce(lambda rest, x: F.when(F.col(f"_{x[0]}_overall_score").isNotNull(), F.col(f"_{x[0]}_{c}")).otherwise(rest), reversed(layers), F.lit(None))
    scope = reduce(lambda rest, x: F.when(F.col(f"_{x[0]}_overall_score").isNotNull(), "verified_posting" if x[0] == "verified" else "exact").otherwise(rest), reversed(layers), F.lit(None).cast("string"))
    out = out.withColumns({"ai_score": first("overall_score"), "ai_score_scope": scope, "ai_prompt_version": first("prompt_version"), "ai_scored_at": first("scored_at"), **{c: first(c) for c in SCORE_COLUMNS[:3]}})
    out = out.join(latest_eligibility(t["resume_job_eligibility"], resume, screen).select("exact_posting_key", F.col("decision").alias("eligibility_decision")), "exact_posting_key", "left")
    out = out.withColumn("description_state", keys.description_state(F.col("enrichment_status"), F.col("words"), F.col("full_jd")))
    return out.drop(*(c for c in out.columns if c.startswith("_")))


def automatic_statuses(t: Tables) -> DataFrame:
    """record_key and status: the posting's own latest, else that of the trusted scope of its best attempt, else new."""
    jobs, attempts = t["jobs"], t["attempts"]
    own, scoped = latest_statuses(t["application_status"], jobs, attempts)
    out = jobs.select("record_key", "exact_posting_key").join(best_attempts(attempts, jobs).select("exact_posting_key", "scope"), "exact_posting_key", "left")
    out = out.join(own.select("exact_posting_key", F.col("status").alias("_own")), "exact_posting_key", "left").join(scoped.select("scope", F.col("status").alias("_scoped")), "scope", "left")
    return out.select("record_key", F.coalesce("_own", "_scoped", F.lit("new")).alias("status"))


def is_aggregator(source: Column, url: Column) -> Column:
    return loose(source).isin(*AGGREGATORS) | addresses.is_third_party(url)


def is_reviewable(scored: Column) -> Column:
    """Whether a posting is shown at all: decided ones, those of employers and platforms, and passed-on ones whose official address is known."""
    c = F.col
    status, official = F.lower(F.coalesce("application_status", F.lit("new"))), F.trim(F.coalesce("official_job_url", F.lit("")))
    found = F.coalesce(c("official_url_status") == FOUND, F.lit(False)) & (official != "")
    legacy = found & addresses.is_built_in(official)
    built_in = (F.lower(F.coalesce("source", F.lit(""))) == "builtin") & scored
    return status.isin("applied", "removed") | legacy | built_in | ~is_aggregator(c("source"), c("apply_url")) | (found & ~addresses.is_third_party(official))


def visible(bucket: Column, choice: str) -> Column:
    """Whether a posting's review bucket belongs to a view: All, Low fit, Needs review or, for anything else, Recommended."""
    return {"All": F.lit(True), "Low fit": bucket == "low_fit", "Needs review": bucket == "needs_review"}.get(choice, bucket == "recommended")


def chosen_by(filters: dict[str, object]) -> Column:
    """The conjunction of what a user picked; a filter that is None or empty picks all.

    Keys: status, source, city, recommendation, fit_priority_label, description_state, review_bucket (a value
    each), since and until (dates of discovered_at, both included), scored (true or false), titles (a list of
    normal titles)."""
    c = F.col
    plain = {"status": "application_status", "source": "source", "recommendation": "recommendation", "fit_priority_label": "fit_priority_label", "description_state": "description_state", "review_bucket": "review_bucket"}
    tests = {k: (lambda v, col=col: c(col) == v) for k, col in plain.items()} | {
        "city": lambda v: keys.city(c("location")) == v,
        "since": lambda v: F.to_date("discovered_at") >= F.lit(v).cast("date"),
        "until": lambda v: F.to_date("discovered_at") <= F.lit(v).cast("date"),
        "scored": lambda v: c("ai_score").isNotNull() if v else c("ai_score").isNull(),
        "titles": lambda v: titles.normal(c("title")).isin(*v),
    }
    picked = [F.coalesce(tests[k](v), F.lit(False)) for k, v in filters.items() if v is not None and v != "" and v != []]
    return reduce(lambda a, b: a & b, picked, F.lit(True))


def pipeline_state(now: Column, eligible: Column) -> Column:
    """A struct of code and label: where a posting stands between its page and its score."""
    c = F.col
    official, tried = F.trim(F.coalesce("official_url_status", F.lit(""))), F.trim(F.coalesce("enrichment_status", F.lit("")))
    last = F.coalesce("official_url_resolved_at", "enrichment_attempted_at")
    cooling = official.isin(*RETRY_STATES) & F.coalesce(last > now - F.expr(f"INTERVAL {COOLDOWN_DAYS} DAYS"), F.lit(False))
    made = lambda code, label: F.struct(F.lit(code).alias("code"), F.lit(label).alias("label"))
    full = F.coalesce("description_state", F.lit("NEEDS_ENRICHMENT")) == "FULL_JD"
    return (
        F.when(c("ai_score").isNotNull(), made("AI_SCORED", "AI-scored"))
        .when(full & eligible, made("SCORING_PENDING", "Awaiting AI scoring"))
        .when(full, made("SCORING_EXCLUDED", "Not eligible for AI scoring"))
        .when(cooling, made("ENRICHMENT_COOLDOWN", "Official lookup retry after cooldown"))
        .when((tried == "blocked") & (official != FOUND), made("ENRICHMENT_PENDING", "Source fetch blocked - official lookup pending"))
        .when(official.isin(*RETRY_STATES), made("ENRICHMENT_PENDING", "Official job lookup pending"))
        .when(F.coalesce("enrichment_attempt_count", F.lit(0)) == 0, made("NEEDS_ENRICHMENT", "Awaiting enrichment"))
        .otherwise(made("UNRESOLVED_DESCRIPTION", "No verified full job description found"))
    )


def needs_official(now: Column) -> Column:
    """Whether the official address is still to be looked up."""
    status = F.trim(F.coalesce("official_url_status", F.lit("")))
    last = F.coalesce("official_url_resolved_at", "enrichment_attempted_at")
    settled = (F.col("description_state") == "FULL_JD") & ~is_aggregator(F.col("source"), F.col("apply_url"))
    waits = status.isin(*RETRY_STATES) & F.coalesce(last > now - F.expr(f"INTERVAL {COOLDOWN_DAYS} DAYS"), F.lit(False))
    return ~(status == FOUND) & ~settled & ~waits


def needs_description(retry_failed: bool) -> Column:
    """Whether a description is still to be fetched."""
    c = F.col
    full = (c("words") >= LEAST_WORDS) & (c("description_state") == "FULL_JD")
    failed = F.coalesce(c("enrichment_status").isin(*FAILED), F.lit(False))
    known = F.coalesce(c("official_url_status") == FOUND, F.lit(False)) & c("scope").isNotNull() & ~failed
    return ~full & (known | c("enrichment_status").isNull() | (failed if retry_failed else F.lit(False)))


def scoring_queue(t: Tables, resume: str, model: str | None, prompt: str, screen: str, least_rule_score: int, reuse_any_model: bool = False) -> DataFrame:
    """Postings to be scored, one row each, the best rule match first: full descriptions of fitting titles that
    are new, not ruled out by a screening and not scored yet, exactly or under their trusted scope."""
    c = F.col
    jobs, attempts = t["jobs"], t["attempts"]
    scores = t["resume_job_scores"].where((c("resume_hash") == resume) & (F.coalesce("prompt_version", F.lit("v1")) == prompt) & c("description_complete"))
    if not reuse_any_model:
        scores = scores.where(c("model_name") == model)
    changed = jobs.select("exact_posting_key", "record_key", _epoch("description_updated_at").alias("_changed"))
    latest = scores.join(jobs.select("record_key", "exact_posting_key"), "record_key").groupBy("exact_posting_key").agg(F.max("scored_at").alias("_scored"))
    exact = changed.join(latest, "exact_posting_key").where("_scored >= _changed").select("exact_posting_key")
    scoped = attempts.where("scope is not null and trim(coalesce(description_hash, '')) <> ''").select("record_key", "scope", "description_hash")
    by_scope = scores.join(scoped, "record_key").groupBy("scope", "description_hash").agg(F.max("scored_at").alias("_scored"))
    verified = changed.join(scoped, "record_key").join(by_scope, ["scope", "description_hash"]).where("_scored >= _changed").select("exact_posting_key")
    done = exact.union(verified).distinct()
    own, _ = latest_statuses(t["application_status"], jobs, attempts)
    excluded = t["resume_job_eligibility"].where(c("resume_hash") == resume)
    now = excluded.where(c("prompt_version") == screen).select(c("canonical_job_key").alias("exact_posting_key"), "decision").distinct()
    old = excluded.where((c("prompt_version") == "v1") & (c("decision") == "exclude")).select(c("canonical_job_key").alias("exact_posting_key"), F.lit(True).alias("_old")).distinct()
    rows = fitting(jobs).where("is_described and words >= 80 and full_jd").join(done, "exact_posting_key", "left_anti")
    rows = rows.join(t["job_matches"].where(c("match_score") >= least_rule_score).drop("scored_at"), "record_key")
    rows = rows.join(attempts.select("record_key", c("status").alias("enrichment_status"), "official_job_url", "official_url_status"), "record_key", "left").where("coalesce(enrichment_status, '') <> 'resolution_rejected'")
    rows = rows.join(automatic_statuses(t).where("status = 'new'").select("record_key"), "record_key", "left_semi")
    rows = rows.join(own.where("status <> 'new'").select("exact_posting_key"), "exact_posting_key", "left_anti")
    rows = rows.join(now, "exact_posting_key", "left").join(old, "exact_posting_key", "left")
    rows = rows.where("coalesce(decision, 'needs_description') in ('eligible', 'needs_description') and (decision is not null or _old is null)")
    order = [c("is_recommended").desc_nulls_last(), c("needs_review").desc_nulls_last(), newest("match_score"), newest("title_score"), c("is_described").desc(), newest("description_updated_at"), newest("discovered_at"), c("record_key"), c("search_id")]
    out = first_per_key(rows, ["exact_posting_key"], order).withColumn("application_status", F.lit("new"))
    return out.where(is_reviewable(F.lit(False))).withColumnRenamed("match_score", "rule_score")


def fitting_class(jobs: DataFrame) -> DataFrame:
    """jobs with title_classification and matched_pattern. Different titles are few: each is classified once."""
    made = addresses.let(titles.normal(F.col("title")), lambda normal: titles.classified(F.col("title"), normal))
    # The count is always positive; without it a filter on the class would be pushed below the grouping, to every row.
    known = jobs.groupBy("title").agg(F.count("*").alias("_n")).withColumn("_class", F.when(F.col("_n") > 0, made))
    known = known.select(F.col("title").alias("_title"), F.col("_class.category").alias("title_classification"), F.col("_class.matched_pattern").alias("matched_pattern"))
    return jobs.join(known, F.col("title").eqNullSafe(F.col("_title")), "left").drop("_title")


def fitting(jobs: DataFrame) -> DataFrame:
    """jobs but for titles outside the lane."""
    return fitting_class(jobs).where("title_classification <> 'FILTERED_OUT'")


def queue_ranks(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows in an order with their queue_rank, from 1. Tasks hand on only so many rows each."""
    return rows.orderBy(*order).limit(most).withColumn("queue_rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def screening_queue(t: Tables, resume: str, screen: str) -> DataFrame:
    """Postings to be screened, one row each: fitting titles that are new and have no decision of this screening."""
    c = F.col
    jobs, attempts = t["jobs"], t["attempts"]
    decided = t["resume_job_eligibility"].where((c("resume_hash") == resume) & (c("prompt_version") == screen)).select(c("canonical_job_key").alias("exact_posting_key")).distinct()
    own, _ = latest_statuses(t["application_status"], jobs, attempts)
    rows = fitting(jobs).join(decided, "exact_posting_key", "left_anti").join(own.where("status <> 'new'").select("exact_posting_key"), "exact_posting_key", "left_anti")
    rows = rows.join(automatic_statuses(t).where("status = 'new'").select("record_key"), "record_key", "left_semi")
    rows = rows.join(attempts.select("record_key", c("status").alias("enrichment_status"), "official_job_url", "official_url_status"), "record_key", "left")
    usable = (F.coalesce("enrichment_status", F.lit("")) != "resolution_rejected") & c("is_described")
    out = first_per_key(rows, ["exact_posting_key"], [usable.desc(), newest("description_updated_at"), newest("discovered_at"), c("record_key")])
    return out.withColumn("application_status", F.lit("new")).where(is_reviewable(F.lit(False)))


def display_scope(t: DataFrame) -> DataFrame:
    """Rows with trusted_key: the scope of a trusted key whose official address gives that key and names one posting."""
    given = postings.verified_scope(F.col("_given"), F.col("official_job_url"))
    out = t.withColumn("_given", addresses.verified_key(F.col("official_job_url")))
    return out.withColumn("trusted_key", F.when((F.col("scope") == given) & addresses.is_specific(F.col("official_job_url")), F.col("scope"))).drop("_given")


def representative_order(complete: Column) -> list[Column]:
    """Which row stands for a trusted opening: the last decision, decided before new, a full description from the
    best origin, a complete score, the newest description and score. Never the score itself."""
    c = F.col
    status, origin = F.lower(F.coalesce("application_status", F.lit("new"))), F.lower(F.trim(F.coalesce("description_source", F.lit(""))))
    full = F.coalesce(c("description_state") == "FULL_JD", F.lit(False))
    return [
        newest("application_status_updated_at"),
        F.when(status == "removed", 2).when(status == "applied", 1).otherwise(0).desc(),
        full.desc(),
        F.when(origin.isin(*DIRECT), 3).when(origin.isin(*FROM_SOURCE), 2).when(origin == REUSED, 1).otherwise(0).desc(),
        complete.desc(),
        F.when(full, c("description_updated_at")).desc_nulls_last(),
        F.when(complete, c("ai_scored_at")).desc_nulls_last(),
        c("record_key"),
    ]


def display_order() -> list[Column]:
    """Scored before unscored, high scores, then new arrivals."""
    return [newest("ai_score"), newest("discovered_at"), F.coalesce("trusted_key", "exact_posting_key", "record_key"), F.col("record_key")]


def displayed(board: DataFrame, complete: Column) -> DataFrame:
    """The rows of a board (display_scope applied) that are shown: of a trusted opening its representative, of a
    posting the first in display order."""
    complete = F.coalesce(complete, F.lit(False))
    of_opening = first_per_key(board.where("trusted_key is not null"), ["trusted_key"], representative_order(complete))
    rest = first_per_key(board.where("trusted_key is null"), ["exact_posting_key"], display_order())
    return of_opening.unionByName(rest)


def previously_removed(board: DataFrame) -> DataFrame:
    """board with similar_removed: a new posting without a trusted key came after another one of its source and
    fingerprint was removed."""
    source = loose(F.col("source"))
    out = board.withColumn("_source", source).withColumn("_print", F.nullif(F.trim("duplicate_fingerprint"), F.lit("")))
    gone = out.where("application_status = 'removed' and trusted_key is null and application_status_updated_at is not null and _print is not null and _source <> ''")
    # Of other identities only the first two removals matter: one of them is not the posting itself.
    first = gone.groupBy("_source", "_print", "exact_posting_key").agg(F.min("application_status_updated_at").alias("at"))
    place = F.row_number().over(Window.partitionBy("_source", "_print").orderBy("at", "exact_posting_key"))
    two = first.withColumn("_place", place).where("_place <= 2").groupBy("_source", "_print")
    of = lambda k, c: F.max(F.when(F.col("_place") == k, F.col(c)))
    two = two.agg(of(1, "at").alias("_at1"), of(1, "exact_posting_key").alias("_key1"), of(2, "at").alias("_at2"))
    out = out.join(two, ["_source", "_print"], "left")
    other = F.when(F.col("_key1") == F.col("exact_posting_key"), F.col("_at2")).otherwise(F.col("_at1"))
    flag = (F.col("application_status") == "new") & F.col("trusted_key").isNull() & (other <= F.col("discovered_at"))
    return out.withColumn("similar_removed", F.coalesce(flag, F.lit(False))).drop("_source", "_print", "_at1", "_key1", "_at2")


def metrics(board: DataFrame) -> DataFrame:
    """One row of counts of a board."""
    c = F.col
    n = lambda test, name: F.count_if(F.coalesce(test, F.lit(False))).cast("long").alias(name)
    state = lambda s: c("description_state") == s
    return board.agg(
        F.count("*").alias("reviewable_jobs"), *(n(c("application_status") == s, f"{s}_jobs") for s in ("new", "applied", "removed")),
        n(state("NEEDS_ENRICHMENT"), "needs_enrichment"), n(state("FULL_JD"), "full_jd"), n(state("PARTIAL_JD"), "partial_jd"), n(state("ENRICHMENT_REJECTED"), "rejected_enrichment"), n(c("ai_score").isNotNull(), "ai_scored"),
    )


def status_changes(jobs: DataFrame, record: str, status: str, at: Column) -> DataFrame:
    """The status rows that a decision on one record writes: one for every record of the same posting."""
    if status not in ("new", "applied", "removed"):
        raise ValueError("a status is new, applied or removed")
    target = jobs.where(F.col("record_key") == record).select("exact_posting_key").distinct()
    return jobs.join(F.broadcast(target), "exact_posting_key", "left_semi").select("record_key", F.lit(status).alias("status"), at.alias("updated_at"))


def operation_metrics(raw: DataFrame, attempts: DataFrame, queue: DataFrame) -> DataFrame:
    """name and n: raw and different postings, postings to be scored, attempts by status."""
    jobs = raw.agg(F.count("*").alias("a"), F.count_distinct("exact_posting_key").alias("b"))
    rows = jobs.select(F.inline(F.array(F.struct(F.lit("raw_jobs").alias("name"), F.col("a").alias("n")), F.struct(F.lit("exact_postings").alias("name"), F.col("b").alias("n")))))
    tried = attempts.groupBy(F.concat(F.lit("attempts_"), F.col("status")).alias("name")).agg(F.count("*").alias("n"))
    return rows.unionByName(tried).unionByName(queue.agg(F.count("*").alias("n")).select(F.lit("ai_score_eligible").alias("name"), "n"))
