"""Evidence flags, seniority and cached states."""

import datetime as dt

from pyspark.sql import functions as F

from gleaner.plans import evidence


def test_cases(spark):
    need = lambda status, mandatory=True, proof="cv": ("sql", mandatory, status, proof)
    cases = spark.createDataFrame([("a", 97.0, "inflated", [need("met"), need("not_demonstrated")]), ("b", 96.0, "strongly_supported", [need("met"), need("unclear", False)]), ("c", 60.0, "questionable", [need("partial")])], evidence.CASE)
    assert evidence.invalid(cases).count() == 0
    out = evidence.assessed(cases)
    got = {r.case_id: (r.flagged, [f.code for f in r.flags], r.mandatory_total, r.mandatory_met) for r in out.collect()}
    assert got == {"a": (True, ["mandatory_evidence_gap", "high_score_unsupported_mandatory"], 2, 1), "b": (False, [], 1, 1), "c": (True, ["mandatory_evidence_gap"], 1, 0)}
    assert tuple(evidence.detection(out).head()) == (3, 1, 1, 0, 1, 1, 1)
    bad = spark.createDataFrame([("a", 101.0, "x", [need("met", True, "")]), ("a", 1.0, "x", []), (None, None, None, None)], evidence.CASE)
    problems = [r.problem for r in evidence.invalid(bad).collect()]
    assert "case_id is repeated" in problems and "a met requirement has no evidence" in problems and problems.count("no requirement") == 2


def test_seniority(spark):
    df = spark.createDataFrame([("Sr Staff Engineer",), ("Staff Engineer",), ("Senior Lead",), ("Engineer III",), ("Engineer I",), (None,)], "t string")
    assert [r.s for r in df.select(evidence.seniority(F.col("t")).alias("s")).collect()] == ["senior_staff", "staff", "lead", "senior", "entry", "unknown"]


def test_cached_states(spark):
    now, key = dt.datetime(2024, 1, 2), ("k", "k", "u", "u", "US")
    rows = [(now - dt.timedelta(hours=1), *key, "ACTIVE"), (now - dt.timedelta(hours=30), *key, "ACTIVE"), (now, "k", "x", "u", "u", "US", "ACTIVE"), (None, *key, "ACTIVE"), (now, "", "", "u", "u", "US", "ACTIVE"), (now, *key, "odd")]
    df = spark.createDataFrame(rows, "checked_at timestamp, trusted_key string, checked_key string, official_url string, checked_url string, checked_context string, cached_status string")
    assert [r.s for r in df.select(evidence.effective_status(F.lit(now), 24, "US").alias("s")).collect()] == ["ACTIVE", *["UNKNOWN"] * 5]
