"""Contract queries of mixing, WARC derivatives, URL filters and fingerprints, with SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import merkle, mixing, url_filters, warc
from gleaner.llm.common import table


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = """
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS h
  FROM documents),
sources AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)),
filled AS (
  SELECT *, 2 * source_size / weight AS until FROM sources),
levels AS (
  SELECT u.until, (1.5 * (SELECT sum(source_size) FROM sources) - coalesce(sum(CASE WHEN f.until <= u.until THEN 2 * f.source_size END), 0))
    / nullif(sum(CASE WHEN f.until > u.until THEN f.weight ELSE 0 END), 0) AS level
  FROM (SELECT until FROM filled UNION SELECT -1) u CROSS JOIN filled f GROUP BY u.until),
chosen AS (
  SELECT min_by(level, until) AS level FROM levels l
  WHERE level IS NOT NULL AND level < (SELECT min(until) FROM filled f WHERE f.until > l.until)),
targets AS (
  SELECT source, source_size, CASE WHEN 2 * source_size <= level * weight THEN CAST(2 * source_size AS DOUBLE) ELSE level * weight END AS target FROM filled, chosen),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM targets),
goals AS (SELECT *, CAST(floor(target - passes * source_size) AS BIGINT) AS rest FROM plan),
hashed AS (
  SELECT source, h, sum(size) AS of, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) - sum(size) AS before FROM sized GROUP BY source, h)
SELECT s.doc_id, s.size, g.source_size, g.target,
  CAST(s.size * g.passes + CASE WHEN b.before + b.of <= g.rest THEN s.size WHEN b.before <= g.rest AND b.of > 0
    THEN CAST(g.rest - b.before AS HUGEINT) * s.size // CAST(b.of AS HUGEINT) ELSE 0 END AS BIGINT) AS taken
FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
JOIN hashed b ON s.source IS NOT DISTINCT FROM b.source AND s.h = b.h
"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.derive(warc.responses(table(spark, sf_dir, "pages")), "page_id")
    return found.withColumn("block", F.decode("block", "utf-8")).withColumn("n_chars", F.char_length("block").cast("long"))


#: Host, path and verdict of the contract's rules.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(str(r) for r in RULES) + " AS r(host, path, verdict)")
    return url_filters.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


OP7_SQL = """
WITH rules(rhost, rpath, rverdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
rest AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parsed AS (
  SELECT page_id, url, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
best AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parsed) p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path)
SELECT page_id, url, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
"""


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compared_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _short_sql(hashes: str, digits: int) -> str:
    return f"regexp_replace({hashes}, '([0-9a-f]{{{digits}}})[0-9a-f]{{{64 - digits}}}', '\\1', 'g')"


def _tree_sql(source: str, columns: str) -> str:
    inner, leaf = merkle.INNER, merkle.LEAF
    return f"""
  SELECT {columns}, sha256(sections) || ':' || {_short_sql("sections", inner)} || ':' || {_short_sql("paragraphs", inner)} || ':' || translate({_short_sql("leaves", leaf)}, chr(10), ';') AS tree
  FROM (SELECT {columns}, leaves, paragraphs, array_to_string(list_transform(list_filter(string_split(regexp_replace(paragraphs, '\\b([01][0-9a-f]+,)', '\\1;', 'g'), ';'), lambda s: s <> ''), lambda s: sha256(s) || ','), '') AS sections
  FROM (SELECT {columns}, leaves, array_to_string(list_transform(list_filter(string_split(replace(leaves, chr(10), chr(10) || ';'), ';'), lambda s: s <> ''), lambda s: sha256(s) || ','), '') AS paragraphs
  FROM (SELECT {columns}, array_to_string(list_transform(regexp_extract_all(body, '[^.!?|\\n]{{1,64}}[.!?|\\n]*|[.!?|\\n]+'), lambda p: sha256(p) || CASE WHEN ends_with(p, chr(10)) THEN chr(10) ELSE ',' END), '') AS leaves
  FROM {source})))"""


def _likeness_sql(a: str, b: str) -> str:
    x, y = (f"list_distinct(list_filter(string_split(translate(split_part({t}, ':', 4), ';', ','), ','), lambda h: h <> ''))" for t in (a, b))
    return f"CASE WHEN split_part({a}, ':', 1) = split_part({b}, ':', 1) THEN 1.0 WHEN len({x}) + len({y}) = 0 THEN 0.0 ELSE least(2.0 * len(list_intersect({x}, {y})) / CAST(len({x}) + len({y}) AS DOUBLE), 0.999999) END"


OP8_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
n AS (SELECT doc_id, body, coalesce(lead(body) OVER (ORDER BY doc_id), first_value(body) OVER (ORDER BY doc_id)) AS after FROM d),
e AS (SELECT doc_id, body AS own, substr(body, 1, length(body) - length(body) // 2) || substr(after, 1, length(body) // 2) AS body FROM n),
trees AS ({_tree_sql("d", "doc_id")}),
edited AS ({_tree_sql("e", "doc_id, own, body")}),
pairs AS (
  SELECT t.doc_id, CAST(length(own) AS BIGINT) AS n_chars, sha256(body) AS edited_sha256, t.tree AS fingerprint, e.tree AS edited_fingerprint,
    coalesce(lead(t.tree) OVER (ORDER BY t.doc_id), first_value(t.tree) OVER (ORDER BY t.doc_id)) AS next_tree
  FROM trees t JOIN edited e USING (doc_id))
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
  CAST({_likeness_sql("fingerprint", "edited_fingerprint")} AS DOUBLE) AS near_edited, CAST({_likeness_sql("fingerprint", "next_tree")} AS DOUBLE) AS near_next
FROM pairs
"""
