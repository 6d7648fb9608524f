"""Reviewed evidence: flags of cases whose mandatory requirements lack support, and how well flags detect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States of evidence, labels of reviewers, and the severity of a gap.
STATES = ("met", "partial", "unclear", "not_demonstrated")
SEVERITY = {"not_demonstrated": "high", "partial": "review", "unclear": "review"}
CASE = "case_id string, stored_score double, review_label string, requirements array<struct<requirement: string, mandatory: boolean, status: string, resume_evidence: string>>"


def invalid(cases: DataFrame) -> DataFrame:
    """case_id and problem of each malformed or repeated case; assess only when this is empty."""
    r = F.col("requirements")
    some = lambda test: F.coalesce(F.exists(r, test), F.lit(False))
    rules = [
        (F.trim(F.coalesce("case_id", F.lit(""))) == "", "case_id is missing"),
        (~F.coalesce(F.col("stored_score").between(0, 100), F.lit(False)), "stored_score is not from 0 to 100"),
        (F.trim(F.coalesce("review_label", F.lit(""))) == "", "review_label is missing"),
        (F.coalesce(F.size(r), F.lit(0)) < 1, "no requirement"),
        (some(lambda x: F.trim(F.coalesce(x["requirement"], F.lit(""))) == ""), "a requirement has no wording"),
        (some(lambda x: x["mandatory"].isNull()), "mandatory is missing"),
        (some(lambda x: ~F.coalesce(x["status"].isin(*STATES), F.lit(False))), "a status is unknown"),
        (some(lambda x: (x["status"] == "met") & (F.trim(F.coalesce(x["resume_evidence"], F.lit(""))) == "")), "a met requirement has no evidence"),
    ]
    problems = F.filter(F.array(*(F.when(c, F.lit(text)) for c, text in rules)), lambda p: p.isNotNull())
    repeated = cases.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1").select("case_id", F.lit("case_id is repeated").alias("problem"))
    return cases.select("case_id", F.explode(problems).alias("problem")).union(repeated)


def _mandatory(*states: str) -> Column:
    return F.size(F.filter("requirements", lambda x: x["mandatory"] & x["status"].isin(*states))).cast("long")


def assessed(cases: DataFrame, high: float = 95) -> DataFrame:
    """For each case its flags (code, index, severity) and counts of mandatory requirements. A flag asks for review; scores stay."""
    gap = F.transform(
        "requirements",
        lambda x, k: F.when(x["mandatory"] & (x["status"] != "met"), F.struct(F.lit("mandatory_evidence_gap").alias("code"), k.cast("int").alias("requirement_index"), F.when(x["status"] == "not_demonstrated", SEVERITY["not_demonstrated"]).otherwise(SEVERITY["partial"]).alias("severity"))),
    )
    whole = lambda code, severity, test: F.when((F.col("stored_score") >= high) & test, F.struct(F.lit(code).alias("code"), F.lit(None).cast("int").alias("requirement_index"), F.lit(severity).alias("severity")))
    last = F.array(whole("high_score_unsupported_mandatory", "high", F.col("mandatory_not_demonstrated") > 0), whole("high_score_uncertain_mandatory", "review", F.col("mandatory_uncertain") > 0))
    out = cases.withColumns({"mandatory_total": _mandatory(*STATES), "mandatory_met": _mandatory("met"), "mandatory_not_demonstrated": _mandatory("not_demonstrated"), "mandatory_uncertain": _mandatory("partial", "unclear")})
    out = out.withColumn("flags", F.filter(F.concat(gap, last), lambda f: f.isNotNull()))
    return out.withColumn("flagged", F.size("flags") > 0).drop("requirements")


def detection(results: DataFrame) -> DataFrame:
    """One row: how many inflated cases were flagged, and how many supported ones were by mistake."""
    of = lambda label: F.col("review_label") == label
    count = lambda c, name: F.count_if(c).cast("long").alias(name)
    flagged = F.col("flagged")
    return results.agg(
        F.count("*").alias("n"), count(of("inflated") & flagged, "known_inflated_detected"), count(of("inflated"), "known_inflated_total"),
        count(of("strongly_supported") & flagged, "supported_false_flags"), count(of("strongly_supported"), "supported_total"),
        count(of("questionable") & flagged, "questionable_flagged"), count(of("questionable"), "questionable_total"),
    )


def seniority(title: Column) -> Column:
    """The level that a title names, the highest first."""
    text = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9+#.]+", " ")
    levels = ((r"\b(senior|sr) staff\b", "senior_staff"), (r"\bprincipal\b", "principal"), (r"\bstaff\b", "staff"), (r"\blead\b", "lead"), (r"\b(senior|sr|iii|iv)\b", "senior"), (r"\b(junior|entry|i)\b", "entry"))
    return F.coalesce(*(F.when(text.rlike(p), F.lit(name)) for p, name in levels), F.lit("unknown"))


def effective_status(now: Column, ttl_hours: float, context: str) -> Column:
    """A cached state of a posting while it is fresh and was taken for the same key, address and context; else UNKNOWN."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("checked_at").cast("timestamp"))) / F.lit(3600e6)
    same = (F.col("trusted_key") != "") & (F.col("trusted_key") == F.col("checked_key")) & F.col("official_url").eqNullSafe(F.col("checked_url")) & (F.col("checked_context") == context)
    valid = F.coalesce(age.between(0, ttl_hours) & same, F.lit(False)) & F.coalesce(F.col("cached_status").isin("ACTIVE", "CLOSED", "INELIGIBLE", "UNKNOWN"), F.lit(False))
    return F.when(valid, F.col("cached_status")).otherwise("UNKNOWN")
