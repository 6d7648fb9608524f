"""Operators on small cases whose results are known."""

import difflib
import datetime as dt

from pyspark.sql import functions as F

from gleaner.functions import scoring, text, urls
from gleaner.functions.similar import likeness
from gleaner.operators.keyed import first_of_two_keys, overlay, page
from gleaner.plans import evaluation, marts
from gleaner.plans.queries_flow import posting_in_json_ld
from gleaner.sources.tables import html_text, mail


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).head())


def test_mart_of_six_postings(spark):
    """The six-row fixture with the rows that were derived by hand."""
    base = dt.datetime(2024, 1, 1)
    spec = [("ci-apply-original", "101", 88, "apply", True, 88, True, False), ("ci-apply-duplicate", "101", 84, "apply", True, 84, True, False), ("ci-unscored", "102", None, None, True, 70, True, False), ("ci-incomplete", "103", 80, "apply", False, 80, False, True), ("ci-review", "104", 68, "review", True, 68, True, False), ("ci-skip", "105", 40, "skip", True, 40, True, False)]
    raw = spark.createDataFrame([(k, f"f{j}", "linkedin", j, k, "c", "d", "http://x", base + dt.timedelta(days=i), base + dt.timedelta(days=i)) for i, (k, j, *_) in enumerate(spec)], "record_key string, job_fingerprint string, source string, source_job_id string, title string, company_name string, description string, apply_url string, discovered_at timestamp, description_updated_at timestamp")
    matches = spark.createDataFrame([(s[0], "s", s[5], s[5], s[6], s[7]) for s in spec], "record_key string, search_id string, match_score int, title_score int, is_recommended boolean, needs_review boolean")
    scores = spark.createDataFrame([("ci-profile", s[0], s[2], s[3], s[4], base + dt.timedelta(days=i, hours=1), "m", None) for i, s in enumerate(spec) if s[2] is not None], "resume_hash string, record_key string, overall_score int, recommendation string, description_complete boolean, scored_at timestamp, model_name string, prompt_version string")
    staged = marts.staged_jobs(raw)
    jobs, rules, latest = marts.deduplicated_jobs(staged), marts.best_rule_matches(matches, staged), marts.latest_scores(scores, staged)
    mart = marts.recommendations(latest, jobs, rules)
    got = [tuple(r) for r in mart.orderBy("ai_score_rank").select("exact_posting_key", "canonical_record_key", "scored_record_key", "rule_record_key", "rule_score", "ai_score", "recommendation", "has_incomplete_description", "ai_score_rank").collect()]
    assert got == [
        ("linkedin|101", "ci-apply-duplicate", "ci-apply-duplicate", "ci-apply-original", 88, 84, "apply", False, 1),
        ("linkedin|103", "ci-incomplete", "ci-incomplete", "ci-incomplete", 80, 80, "review", True, 2),
        ("linkedin|104", "ci-review", "ci-review", "ci-review", 68, 68, "review", False, 3),
        ("linkedin|105", "ci-skip", "ci-skip", "ci-skip", 40, 40, "skip", False, 4),
    ]
    total = marts.pipeline_summary(raw, jobs, matches, latest, mart).head()
    assert (total.raw_jobs, total.deduplicated_jobs, total.rule_matched_jobs, total.resumes, total.apply_jobs, total.review_jobs, total.skip_jobs, total.incomplete_jobs, total.recommendation_rows) == (6, 5, 6, 1, 2, 1, 1, 1, 4)
    assert marts.recommendations(latest.limit(0), jobs, rules).count() == 0


def test_two_identities_differ(spark):
    key = lambda f, *v: one(spark, f(*map(F.lit, v)).alias("k"))[0]
    assert key(urls.model_key, "Linked-In", " A-1 ", "http://x", "r") == "linked in|a-1"
    assert key(urls.application_key, "Linked-In", " A-1 ", "http://x", "r") == "linked in|a 1"
    assert key(urls.model_key, "a", "", "https://u.sendgrid.net/x", "r") == "a|https://u.sendgrid.net/x"
    assert key(urls.model_key, "a", "", "https://u.net/ls/click?x", "r") == "a|record:r"
    assert key(urls.application_key, "a", "", "https://boards.greenhouse.io/acme/jobs/77?utm_source=x", "r") == "greenhouse:77"
    assert key(urls.canonical, "HTTP://WWW.A.com//b/?utm_x=1&z=2&a=1#f") == "https://a.com/b?a=1&z=2"


def test_precedence_takes_layers_whole(spark):
    base = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    a = spark.createDataFrame([(1, 10, None), (2, None, "x")], "k int, score int, note string")
    b = spark.createDataFrame([(1, 5, "b"), (2, 6, "b")], "k int, score int, note string")
    got = {r.k: (r.score, r.note, r.scope) for r in overlay(base, [("exact", a), ("verified", b)], "k", ["score", "note"], "score").collect()}
    assert got == {1: (10, None, "exact"), 2: (6, "b", "verified"), 3: (None, None, "default")}


def test_first_of_two_keys_is_the_greedy_order(spark):
    rows = [(1, "a", "x"), (2, "a", "y"), (3, "b", "y"), (4, "b", "z"), (5, None, "z"), (6, None, None), (7, "c", "z")]
    kept, seen = [], set()
    for k, a, b in rows:
        if (a and ("1", a) in seen) or (b and ("2", b) in seen):
            continue
        kept.append(k)
        seen |= {("1", a), ("2", b)}
    got = first_of_two_keys(spark.createDataFrame(rows, "k int, one string, two string"), "one", "two", ["k"])
    assert sorted(r.k for r in got.collect()) == kept


def test_scores(spark):
    s = lambda c: one(spark, c.alias("c"))[0]
    title = lambda a, b: s(scoring.title_score(F.lit(a), F.lit(b)))
    assert [title("Data Engineer", "data engineer"), title("Senior Data Engineer", "Data Engineer"), title("Engineer, Data", "Data Engineer"), title("Data Lead", "Data Engineer"), title("Cook", "Data Engineer"), title(None, "x")] == [45, 40, 32, 12, 0, 0]
    assert s(scoring.overall([F.lit(5), F.lit(0)], [0.5, 0.5])) == 2  # half to even
    assert s(text.age_days(F.lit("2024-01-02 00:10:00").cast("timestamp"), F.lit("2024-01-01 23:50:00").cast("timestamp"))) == 0
    assert s(text.word_count(F.lit("\n a  b "))) in (2, 3)
    assert s(scoring.location_score(F.lit("Austin, TX"), F.lit("Dallas, TX"), F.lit(False))) == 10


def test_evaluation(spark):
    low, high = evaluation.wilson(F.lit(20), F.lit(20))
    assert [round(x, 3) for x in one(spark, low.alias("a"), high.alias("b"))] == [0.839, 1.0]
    low, _ = evaluation.wilson(F.lit(5), F.lit(9))
    assert one(spark, low.alias("a"))[0] is None
    df = spark.createDataFrame([("a", 1, 2), ("a", 2, 2), ("a", 2, 5), ("b", 1, 1), ("b", 2, 1)], "g string, x int, y int")
    got = {r.g: r.spearman for r in evaluation.spearman(df, "x", "y", ["g"]).collect()}
    assert round(got["a"], 6) == 0.5 and got["b"] is None


def test_pages_are_clamped(spark):
    df = spark.range(60)
    assert [r.id for r in page(df, [F.col("id")], 9, 25, 60).collect()] == list(range(50, 60))
    assert page(df, [F.col("id")], 1, 7, 60).count() == 25


def test_text_sources(spark, tmp_path):
    assert html_text('<p>a <a href="http://x/1">b</a></p><script>no</script>c')[0] == "a b\nc"
    assert html_text('<a href="http://x/1">b</a><a href="http://x/1">c</a>')[1] == ["http://x/1"]
    assert posting_in_json_ld('<script type="application/ld+json">{"@graph":[{"@type":"JobPosting","title":"t","description":"<b>a</b> b"}]}</script>') == ("t", "a b")
    assert posting_in_json_ld("<script type='application/ld+json'>{bad</script>") == (None, None)
    (tmp_path / "m.eml").write_bytes(b"Message-ID: <1@x>\r\nSubject: Jobs\r\nFrom: a@b.c\r\nContent-Type: text/html\r\n\r\n<p>Hi</p><a href='http://j/1'>x</a>")
    row = mail(spark, str(tmp_path)).head()
    assert (row.message_id, row.subject, row.links) == ("<1@x>", "Jobs", ["http://j/1"]) and "Hi" in row.text


def test_likeness_against_difflib(spark):
    """Every pair of some names, compared with the definition."""
    names = ["data engineer", "data engineer ii", "engineer data", "date engineer", "cook", "", None, "a b c d", "a b", "  cook "]
    df = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string").withColumn("s", likeness(F.col("a"), F.col("b")))
    for r in df.collect():
        a, b = (r.a or "").strip(), (r.b or "").strip()
        if not a or not b:
            assert r.s is None
        else:
            x, y = set(a.split()), set(b.split())
            want = 1.0 if a == b else max(len(x & y) / max(len(x), len(y)), difflib.SequenceMatcher(None, a, b).ratio())
            assert abs(r.s - want) < 1e-12, (a, b)


def test_keys_that_are_null_or_hot(spark):
    rows = [(k, "hot" if k % 3 == 0 else None if k % 3 == 1 else f"x{k % 7}", None if k % 2 else f"y{k % 5}") for k in range(90)]
    df = spark.createDataFrame(rows, "k long, one string, two string")
    kept, ones, twos = [], set(), set()
    for k, one_, two in rows:
        if one_ not in ones and two not in twos:
            kept.append(k)
            ones |= {one_} - {None}
            twos |= {two} - {None}
    assert sorted(r.k for r in first_of_two_keys(df, "one", "two", ["k"]).collect()) == kept
