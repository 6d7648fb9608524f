"""Titles, descriptions, identity and priorities on cases whose results are known."""

from pyspark.sql import functions as F

from gleaner.functions import titles
from gleaner.plans import postings


def test_titles(spark):
    cases = {"Sr. Data Engineer (Remote, US)": ("senior data engineer", "STRONG_MATCH", 95), "BI Developer": ("business intelligence developer", "STRONG_MATCH", 90), "[Apply": ("apply", "FILTERED_OUT", 0), "!!": ("!!", "FILTERED_OUT", 0), "": ("", "POSSIBLE_MATCH", 50), "Data Business Analyst": ("data business analyst", "POSSIBLE_MATCH", 65), "Business Analyst": ("business analyst", "FILTERED_OUT", 30), "Junior Data Engineer": ("junior data engineer", "FILTERED_OUT", 10), "Data & Analytics Manager": ("data and analytics manager", "FILTERED_OUT", 20), "Cook": ("cook", "POSSIBLE_MATCH", 50), "Data Architect": ("data architect", "POSSIBLE_MATCH", 70)}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").withColumn("n", titles.normal(F.col("t")))
    got = {r.t: (r.n, r.c.category, r.c.score) for r in df.withColumn("c", titles.classified(F.col("t"), F.col("n"))).collect()}
    assert got == cases | {None: ("", "POSSIBLE_MATCH", 50)}


def test_descriptions(spark):
    words = "word " * 90
    cases = [("short requirements", False), (words, False), (words + "\nRequirements\n", True), ("w " * 210 + "\nAbout you\n you will build and design", True), (words + "Search results. Browse jobs. requirements", False), (None, False)]
    df = spark.createDataFrame(cases, "t string, full boolean").withColumn("q", postings.description_quality(F.col("t")))
    assert all(r.q.full_jd == r.full for r in df.collect())


def test_scope_and_identity(spark):
    df = spark.createDataFrame([("workday:1", "https://a.myworkdayjobs.com/x"), ("workday:1", "https://evil.com"), ("lever:2", None), (" ", None)], "k string, u string")
    assert [r.s for r in df.select(postings.verified_scope(F.col("k"), F.col("u")).alias("s")).collect()] == ["workday:1|tenant:a.myworkdayjobs.com", None, "lever:2", None]
    rows = [("Data Engineer", "Acme Inc", "Data Engineer", "ACME", None, None), ("Data Engineer", "Acme", "Data Analyst", "Acme", None, None), ("Data Engineer", None, "Data Engineer", "Acme", "k", "k"), ("Data Engineer", "", "Data Engineer", "", None, None), ("Data Engineer", "Acme", None, "Acme", None, None)]
    got = postings.validated(spark.createDataFrame(rows, "title string, company string, resolved_title string, resolved_company string, trusted_key string, resolved_key string")).collect()
    assert [(r.accepted, r.confidence) for r in got][:4] == [(True, 1.0), (False, 0.675), (True, 0.85), (False, 0.55)] and not got[4].accepted
    assert got[1].reason == "title mismatch; primary occupation mismatch" and got[4].reason == "resolved title missing"
    candidates = spark.createDataFrame([("a", 0.9, 10, "u1"), ("a", 0.86, 99, "u2"), ("b", 0.9, 10, "u3"), ("b", 0.8, 10, "u4"), ("c", 0.9, 1, "u5")], "k string, confidence double, words int, url string")
    assert {r.k: (r.outcome, r.url) for r in postings.chosen(candidates, "k").collect()} == {"a": ("AMBIGUOUS", None), "b": ("VERIFIED", "u3"), "c": ("VERIFIED", "u5")}


JOB = "application_status string, title_classification string, matched_pattern string, description_state string, age_days int, attempt_count int, waiting_days int, rule_score int, ai_score int, admission_decision string, critical_skill_gaps array<string>, role_family_match string, recommendation string, confidence string, fit_priority_label string, fit_priority_source string, has_current_complete_ai_assessment boolean"


def test_priorities(spark):
    rows = [
        ("new", "STRONG_MATCH", "data engineer", "NEEDS_ENRICHMENT", 3, 0, 7, 55, None, None, None, None, None, None, None, None, None),
        ("applied", "POSSIBLE_MATCH", None, "FULL_JD", 40, 2, None, 0, 70, "exclude", None, "possible", "apply", "high", None, None, True),
        (None, "FILTERED_OUT", "x", "PARTIAL_JD", None, 3, 40, None, None, None, ["gap"], None, "skip", None, None, None, False),
    ]
    df = spark.createDataFrame(rows, JOB).select("*", postings.enrichment_priority().alias("p"), postings.fit_priority(F.col("has_current_complete_ai_assessment")).alias("f"), postings.review_bucket(F.lit(True)).alias("b"))
    got = df.collect()
    assert [r.p.score for r in got] == [40 + 30 + 20 + 10 + 15 + 20 + 10 + 5, -35 + 15 + 0 - 20 - 20 - 25, 40 - 100 - 35 + 10 + 8]
    alone = spark.createDataFrame([rows[0][:6] + (None,) + rows[0][7:]], JOB).select(postings.enrichment_priority().alias("p")).head()  # who never waited gets no bonus for it
    assert alone.p.score == got[0].p.score - 10 and "waiting" not in alone.p.reason
    assert [r.p.tier for r in got] == ["Tier 1", "Lowest priority", "Lowest priority"]
    assert got[0].p.reason == "new, strong title, recent <= 7d, not AI scored, no JD, never attempted, waiting 7d +10, rule +5"
    assert [r.f.label for r in got] == ["Medium", "High", "Mismatch"] and [r.b for r in got] == ["needs_review", "recommended", "low_fit"]
