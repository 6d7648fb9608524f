"""Domain operators on the driver's tables: identity, text, scores, decisions, evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner.catalog import query
from gleaner.functions import scoring, text, urls
from gleaner.operators.keyed import first_of_two_keys, first_per_key
from gleaner.plans import evaluation
from gleaner.sources.tables import table

#: Searches as a configuration would give them: id, title, required words, other words, excluded words.
SEARCHES = (("s1", "PROMO STEEL", ["steel"], ["promo", "standard"], ["nickel"]), ("s2", "ECONOMY", ["economy"], ["brass", "copper"], []), ("s3", "STANDARD TIN", [], ["tin", "steel", "copper"], ["brass"]))
NOW = "1998-12-01 00:00:00"


@query("""SELECT page_id, CASE WHEN regexp_extract(url, '/jobs/view/([0-9]+)', 1) <> '' THEN 'page|linkedin:' || regexp_extract(url, '/jobs/view/([0-9]+)', 1)
WHEN regexp_extract(url, '[?&]gh_jid=([^&]+)', 1) <> '' THEN 'page|gh_jid:' || regexp_extract(url, '[?&]gh_jid=([^&]+)', 1)
WHEN regexp_extract(url, '[?&](jobId|job_id|jid|postingId|requisitionId)=([^&]+)', 2) <> '' THEN 'page|job_id:' || regexp_extract(url, '[?&](jobId|job_id|jid|postingId|requisitionId)=([^&]+)', 2)
WHEN contains(lower(coalesce(url, '')), '/ls/click') THEN 'page|record:' || page_id WHEN url <> '' THEN 'page|' || lower(trim(url)) ELSE 'page|record:' || page_id END AS exact_key FROM pages""")
def exact_key_cascade(spark, d):
    return table(spark, d, "pages").select("page_id", urls.model_key(F.lit("page"), F.lit(None).cast("string"), F.col("url"), F.col("page_id").cast("string")).alias("exact_key"))


@query("SELECT doc_id, len(regexp_split_to_array(trim(text), '\\s+')) AS n_words FROM documents WHERE len(regexp_split_to_array(trim(text), '\\s+')) >= 80")
def word_count_filter(spark, d):
    n = text.word_count(F.col("text"))
    return table(spark, d, "documents").where(n >= 80).select("doc_id", n.cast("long").alias("n_words"))


@query("""SELECT fingerprint, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, sha256(lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')))) AS fingerprint FROM documents) GROUP BY 1 HAVING count(*) > 1""")
def content_fingerprint_dups(spark, d):
    prints = table(spark, d, "documents").select("doc_id", text.fingerprint(F.col("text")).alias("fingerprint"))
    return prints.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("""WITH t AS (SELECT p_name, count(*) AS n, list_distinct(list_filter(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9+#.]+', ' ', 'g')), ' '), lambda x: x <> '')) AS w FROM part GROUP BY 1)
SELECT a.p_name AS one, b.p_name AS other, a.n * b.n AS pairs, len(list_intersect(a.w, b.w)) / CAST(greatest(len(a.w), len(b.w)) AS DOUBLE) AS overlap FROM t a JOIN t b ON a.p_name < b.p_name WHERE len(list_intersect(a.w, b.w)) / CAST(greatest(len(a.w), len(b.w)) AS DOUBLE) >= 0.5""")
def token_overlap(spark, d):
    """Different names meet through a word that they share; parts are counted, not paired."""
    rows = table(spark, d, "part").groupBy("p_name").agg(F.count("*").alias("n")).withColumn("w", text.terms(F.col("p_name")))
    words = rows.select("p_name", "n", F.size("w").alias("size"), F.explode("w").alias("word"))
    a, b = (words.select("word", F.col("p_name").alias(k), F.col("n").alias(f"n_{k}"), F.col("size").alias(f"s_{k}")) for k in ("one", "other"))
    met = a.join(b, "word").where("one < other").groupBy("one", "other").agg(F.count("*").alias("both"), F.max(F.col("n_one") * F.col("n_other")).alias("pairs"), F.max(F.greatest("s_one", "s_other")).alias("most"))
    return met.select("one", "other", "pairs", (F.col("both") / F.col("most")).alias("overlap")).where("overlap >= 0.5")


@query("""WITH q AS (SELECT page_id, url, regexp_replace(trim(url), '#.*$', '') AS bare FROM pages),
r AS (SELECT page_id, regexp_replace(lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') AS h, regexp_replace(regexp_replace(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+', '/', 'g'), '/$', '') AS p,
 list_sort(list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(lower(split_part(x, '=', 1)), 'utm_') AND lower(split_part(x, '=', 1)) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid', 'ref', 'refid', 'src', 'source', 'trk', 'trackingid', 'campaign', 'medium'))) AS k FROM q)
SELECT page_id, 'https://' || h || p || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END AS canonical, h = 'example.net' OR ends_with(h, '.example.net') AS in_net FROM r""")
def url_canonicalise(spark, d):
    return table(spark, d, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical"), urls.in_domain(F.col("url"), "example.net").alias("in_net"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '(https?://|www\\.)[^\\s]+', '[URL]', 'g'), '\\+?[0-9][0-9 ().-]{8,}[0-9]', '[PHONE]', 'g') AS redacted FROM documents""")
def redaction(spark, d):
    return table(spark, d, "documents").select("doc_id", text.redacted(F.col("text")).alias("redacted"))


@query(f"""SELECT o_orderkey, greatest(0, floor(epoch(TIMESTAMP '{NOW}' - o_orderdate) / 86400))::BIGINT AS age, CASE WHEN epoch(TIMESTAMP '{NOW}' - o_orderdate) <= 86400 THEN 5 WHEN epoch(TIMESTAMP '{NOW}' - o_orderdate) <= 3 * 86400 THEN 4 WHEN epoch(TIMESTAMP '{NOW}' - o_orderdate) <= 7 * 86400 THEN 2 ELSE 0 END AS freshness FROM orders""")
def date_age_buckets(spark, d):
    now = F.lit(NOW).cast("timestamp_ntz")
    return table(spark, d, "orders").select("o_orderkey", text.age_days(now, F.col("o_orderdate")).alias("age"), scoring.freshness_score(now, F.col("o_orderdate")).alias("freshness"))


_WORDS = lambda c: f"string_split(trim(regexp_replace(lower({c}), '[^a-z0-9+#.]+', ' ', 'g')), ' ')"
_HAS = lambda w: f"contains(' ' || lower(p_type) || ' ', ' ' || {w} || ' ')"


@query(f"""WITH s(search_id, target, musts, others, excluded) AS (VALUES {", ".join(f"('{a}', '{b}', {list(c)}::VARCHAR[], {list(e)}::VARCHAR[], {list(f)}::VARCHAR[])" for a, b, c, e, f in SEARCHES)}),
r AS (SELECT p_partkey, search_id, CASE WHEN lower(p_type) = lower(target) THEN 45 WHEN {_HAS("lower(target)")} THEN 40 WHEN len(list_filter({_WORDS("target")}, lambda w: NOT list_contains({_WORDS("p_type")}, w))) = 0 THEN 32
  WHEN len(list_intersect({_WORDS("target")}, {_WORDS("p_type")})) / CAST(len({_WORDS("target")}) AS DOUBLE) >= 0.5 THEN CAST(round_even(24 * len(list_intersect({_WORDS("target")}, {_WORDS("p_type")})) / CAST(len({_WORDS("target")}) AS DOUBLE), 0) AS INT) ELSE 0 END AS title_score,
  CAST(CASE WHEN len(musts) > 0 THEN round_even(10.0 * len(list_filter(musts, lambda w: {_HAS("w")})) / len(musts), 0) ELSE 0 END AS INT) + least(20, 5 * len(list_filter(others, lambda w: {_HAS("w")}))) AS keyword_score, len(list_filter(excluded, lambda w: {_HAS("w")})) AS barred FROM part, s)
SELECT *, CASE WHEN barred > 0 THEN 0 ELSE least(100, title_score + keyword_score) END AS match_score, barred = 0 AND title_score + keyword_score >= 40 AS is_recommended FROM r""")
def cross_scoring(spark, d):
    """Every part against every search. Different types are few, so these are scored, and parts look theirs up."""
    searches = spark.createDataFrame(list(SEARCHES), "search_id string, target string, every array<string>, some array<string>, excluded array<string>")
    parts = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("_type"))
    rows = parts.select(F.col("_type").alias("p_type")).distinct().crossJoin(F.broadcast(searches))
    t = F.col("p_type")
    barred = F.filter("excluded", lambda w: text.has_term(t, w))
    rows = rows.withColumn("title_score", scoring.title_score(t, F.col("target"))).withColumn("keyword_score", scoring.keyword_score(t, F.col("every"), F.col("some"))).withColumn("barred", F.size(barred))
    total = F.when(F.col("barred") > 0, 0).otherwise(F.least(F.lit(100), F.col("title_score") + F.col("keyword_score")))
    rows = rows.select("p_type", "search_id", "title_score", "keyword_score", "barred", total.alias("match_score"), ((total >= 40) & (F.col("barred") == 0)).alias("is_recommended"))
    return parts.join(rows, F.col("_type") == F.col("p_type")).drop("_type", "p_type")


@query()
def greedy_two_key_select(spark, d):
    rows = table(spark, d, "documents").select("doc_id", text.fingerprint(F.col("text")).alias("one"), F.concat("lang", F.lit("|"), text.word_count(F.col("text")).cast("string")).alias("two"))
    return first_of_two_keys(rows, "one", "two", ["doc_id"])


@query("""SELECT event_type, ts, event_id, user_id, queue_rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, ts DESC, event_id) AS queue_rank, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC, event_id) AS r FROM events) WHERE r = 1""")
def display_representative(spark, d):
    events = table(spark, d, "events")
    rows = events.withColumn("queue_rank", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), F.desc("ts"), "event_id")).cast("long"))
    return first_per_key(rows, ["user_id"], [F.desc("ts"), F.desc("value"), F.col("event_id")]).select("event_type", "ts", "event_id", "user_id", "queue_rank")


@query("""SELECT event_id, EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'error' AND b.event_id <> a.event_id AND b.ts <= a.ts) AS prior_removed FROM events a""")
def prior_removed_flag(spark, d):
    events = table(spark, d, "events")
    errors = events.where("event_type = 'error'").select(F.col("user_id").alias("u"), "ts", "event_id")
    two = errors.withColumn("k", F.row_number().over(Window.partitionBy("u").orderBy("ts", "event_id"))).where("k <= 2")
    of = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    removed = two.groupBy("u").agg(of(1, "ts").alias("t1"), of(1, "event_id").alias("e1"), of(2, "ts").alias("t2"))
    other = F.when(F.col("e1") == F.col("event_id"), F.col("t2")).otherwise(F.col("t1"))
    return events.join(removed, F.col("user_id") == F.col("u"), "left").select("event_id", F.coalesce(other <= F.col("ts"), F.lit(False)).alias("prior_removed"))


@query("""SELECT event_id, CAST(errors_in_50 AS BIGINT) AS errors_in_50, run >= 5 OR errors_in_50 >= 10 AS tripped FROM (SELECT *, sum(CASE WHEN e THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id) AS run FROM (SELECT event_id, user_id, ts, event_type = 'error' AS e, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS errors_in_50, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM events))""")
def rate_limit_guard(spark, d):
    bad = F.when(F.col("event_type") == "error", 1).otherwise(0)
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").withColumn("e", bad).withColumn("errors_in_50", F.sum("e").over(own.rowsBetween(-49, 0))).withColumn("grp", F.sum(1 - F.col("e")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.sum("e").over(Window.partitionBy("user_id", "grp").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("run", run).select("event_id", "errors_in_50", ((F.col("run") >= 5) | (F.col("errors_in_50") >= 10)).alias("tripped"))


@query("""SELECT doc_id, lang, source, pick FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5('7|' || doc_id), doc_id) AS pick FROM documents) ORDER BY pick, lang, source, md5('7|' || doc_id), doc_id LIMIT 50""")
def stratified_round_robin(spark, d):
    order = F.md5(F.concat(F.lit("7|"), F.col("doc_id").cast("string")).cast("binary"))
    return evaluation.round_robin(table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], [order, F.col("doc_id")], 50).select("doc_id", "lang", "source", F.col("pick").cast("long").alias("pick"))


_LABELLED = "SELECT d.doc_id, lang, quality, toxic, n_chars FROM documents d JOIN labels USING (doc_id)"


def _labelled(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")


@query(f"""SELECT lang, n, hits, CASE WHEN n >= 10 THEN round(greatest(0, (p + z2 / (2 * n) - h) / (1 + z2 / n)), 9) END AS low, CASE WHEN n >= 10 THEN round(least(1, (p + z2 / (2 * n) + h) / (1 + z2 / n)), 9) END AS high FROM (SELECT *, {evaluation.Z} * sqrt((p * (1 - p) + z2 / (4 * n)) / n) AS h FROM (SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS hits, count(*) FILTER (quality = 1) / CAST(count(*) AS DOUBLE) AS p, {evaluation.Z} * {evaluation.Z} AS z2 FROM ({_LABELLED}) GROUP BY 1))""")
def wilson(spark, d):
    rows = _labelled(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("hits"))
    low, high = evaluation.wilson(F.col("hits"), F.col("n"))
    return rows.select("lang", "n", "hits", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query(f"""SELECT count(*) AS n, round(avg(abs(quality * 100 - n_chars % 101)), 9) AS mae, round(count(*) FILTER (abs(quality * 100 - n_chars % 101) <= 10) / CAST(count(*) AS DOUBLE), 9) AS within_10 FROM ({_LABELLED})""")
def mae(spark, d):
    error = F.abs(F.col("quality") * 100 - F.col("n_chars") % 101)
    return _labelled(spark, d).agg(F.count("*").alias("n"), F.round(F.avg(error), 9).alias("mae"), F.round(F.count_if(error <= 10) / F.count("*"), 9).alias("within_10"))


@query(f"""WITH g AS (SELECT * FROM (VALUES ('0'), ('1'), ('other')) a(truth), (VALUES ('0'), ('1'), ('other')) b(said)) SELECT g.truth, g.said, count(x.doc_id) AS n FROM g LEFT JOIN ({_LABELLED}) x ON CAST(x.quality AS VARCHAR) = g.truth AND CAST(x.toxic AS VARCHAR) = g.said GROUP BY ALL""")
def confusion(spark, d):
    return evaluation.confusion(_labelled(spark, d), "quality", "toxic", ["0", "1"], ["0", "1"])


@query(f"""WITH r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS a, rank() OVER (PARTITION BY lang ORDER BY quality) + (count(*) OVER (PARTITION BY lang, quality) - 1) / 2.0 AS b FROM ({_LABELLED}))
SELECT lang, count(*) AS n, round(CASE WHEN min(a) < max(a) AND min(b) < max(b) THEN corr(a, b) END, 9) AS spearman FROM r GROUP BY 1""")
def spearman(spark, d):
    return evaluation.spearman(_labelled(spark, d), "n_chars", "quality", ["lang"]).withColumn("spearman", F.round("spearman", 9))


@query(f"""SELECT lang, count(*) AS n, count(*) FILTER ((quality = 1) = (toxic = 0)) AS agree FROM ({_LABELLED}) GROUP BY 1""")
def agreement(spark, d):
    return _labelled(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.count_if((F.col("quality") == 1) == (F.col("toxic") == 0)).alias("agree"))
