"""The model graph of the posting engine: staging, intermediate and mart tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.urls import model_key
from gleaner.operators.keyed import first_per_key, newest, ranked


def staged_jobs(raw: DataFrame) -> DataFrame:
    """Raw postings with their key; duplicate_fingerprint is the raw fingerprint, as in the model."""
    k = model_key(F.col("source"), F.col("source_job_id"), F.col("apply_url"), F.col("record_key"))
    return raw.withColumn("exact_posting_key", k).withColumn("canonical_job_key", F.col("exact_posting_key")).withColumnRenamed("job_fingerprint", "duplicate_fingerprint")


def deduplicated_jobs(staged: DataFrame) -> DataFrame:
    described = F.when(F.trim(F.coalesce("description", F.lit(""))) != "", 1).otherwise(0)
    return first_per_key(staged, ["exact_posting_key"], [described.desc(), newest("description_updated_at"), newest("discovered_at"), F.col("record_key")]).withColumnRenamed("record_key", "canonical_record_key")


def best_rule_matches(matches: DataFrame, staged: DataFrame) -> DataFrame:
    matches = matches.withColumn("needs_review", F.coalesce("needs_review", F.lit(False)))
    joined = matches.join(staged.select("record_key", "exact_posting_key"), "record_key")
    order = [F.col("is_recommended").desc(), F.col("needs_review").desc(), F.col("match_score").desc(), F.col("title_score").desc(), F.col("search_id"), F.col("record_key")]
    return first_per_key(joined, ["exact_posting_key"], order).withColumnsRenamed({"record_key": "rule_record_key", "match_score": "rule_score", "search_id": "best_search_id"})


def latest_scores(scores: DataFrame, staged: DataFrame) -> DataFrame:
    scores = scores.withColumn("prompt_version", F.coalesce("prompt_version", F.lit("v1")))
    joined = scores.join(staged.select("record_key", "exact_posting_key"), "record_key")
    order = [newest("scored_at"), F.col("overall_score").desc(), F.col("record_key"), F.col("model_name"), F.col("prompt_version")]
    return first_per_key(joined, ["resume_hash", "exact_posting_key"], order).withColumnsRenamed({"record_key": "scored_record_key", "overall_score": "ai_score"})


def recommendations(scores: DataFrame, jobs: DataFrame, rules: DataFrame) -> DataFrame:
    """The recommendation mart. The rank goes by the raw recommendation, the column shows the adjusted one."""
    rules = rules.select("exact_posting_key", "rule_record_key", "rule_score", "best_search_id")
    out = scores.drop("source").join(jobs, "exact_posting_key").join(rules, "exact_posting_key", "left")
    apply, whole = F.col("recommendation") == "apply", F.col("description_complete")
    priority = F.when(apply & whole, 3).when((F.col("recommendation") == "review") | (apply & ~whole), 2).when(F.col("recommendation") == "skip", 1).otherwise(0)
    out = ranked(out, ["resume_hash"], [F.col("ai_score").desc(), priority.desc(), newest("rule_score"), F.col("title"), F.col("company_name"), F.col("exact_posting_key")], "ai_score_rank")
    return out.withColumn("has_incomplete_description", ~whole).withColumn("recommendation", F.when(apply & ~whole, "review").otherwise(F.col("recommendation")))


def pipeline_summary(raw: DataFrame, jobs: DataFrame, rules: DataFrame, scores: DataFrame, mart: DataFrame) -> DataFrame:
    """One row of totals; recommendations are counted raw. Each input is read once."""
    said = lambda x: F.count_if(F.col("recommendation") == x)
    parts = [
        raw.agg(F.count("*").alias("raw_jobs"), F.max("discovered_at").alias("latest_discovered")),
        jobs.agg(F.count("*").alias("deduplicated_jobs")),
        rules.agg(F.count_distinct("record_key").alias("rule_matched_jobs")),
        scores.agg(F.count_distinct("resume_hash").alias("resumes"), said("apply").alias("apply_jobs"), said("review").alias("review_jobs"), said("skip").alias("skip_jobs"), F.count_if(~F.col("description_complete")).alias("incomplete_jobs"), F.max("scored_at").alias("latest_scored")),
        mart.agg(F.count("*").alias("recommendation_rows")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.crossJoin(more)  # one row by one row
    return out


def candidate_assessments(assessments: DataFrame, active: DataFrame) -> DataFrame:
    """Active assessments with chosen fields of their payload."""
    payload = lambda path: F.get_json_object("payload", path)
    return assessments.join(active, ["assessment_id", "candidate_id"]).select("assessment_id", "candidate_id", payload("$.overall_score").try_cast("int").alias("overall_score"), payload("$.recommendation").alias("recommendation"), payload("$.summary").alias("summary"))
