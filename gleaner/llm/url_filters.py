"""URL filters by hash prefixes, with DataFrame functions only.

Every URL is expanded into expressions, a suffix of its host before a prefix of its path, for all
numbers of labels and all path lengths that rules have. Expressions and rules meet on the first eight
digits of their SHA-256; the whole digest confirms, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import numbered_columns, place_of, places_of, stage

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A to Z small, between the first :// and the next /, ? or #, and the path from there to ? or #; both empty for null or without ://."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _CAPITALS, _SMALL), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """pages (url, ...) with host, path, rule and verdict; all rows, other columns unchanged.

    Columns of pages named host, path, rule or verdict are replaced; any other name may occur.
    rules has host, path and verdict (allow or block). A rule fits its host and all subdomains where the
    URL's path starts with the rule's path; of the fitting rules the longest wins, of equally long ones one
    that blocks, and of those the first by its text. Without one, rule is null and verdict is otherwise.
    Null urls and urls without :// have an empty host and path, which no rule with a host fits. Empty
    tables are fine on either side.
    """
    kept = places_of(pages, "host", "path", "rule", "verdict")
    url = place_of(pages, "url")
    host, path = host_and_path(F.col(url))
    rows = numbered_columns(pages, kept).withColumn("host", host).withColumn("path", path)
    written = F.concat("host", "path")
    rules = rules.where("host is not null and host <> '' and path is not null").select(
        written.alias("rule"), "verdict", F.sha2(F.concat_ws("\n", "host", "path"), 256).alias("digest"), F.size(F.split("host", "\\.")).alias("labels"), F.length("path").alias("length")
    )
    rules = stage(rules.groupBy("rule", "digest", "labels", "length").agg(F.min(F.struct((F.col("verdict") != "block").alias("b"), "verdict"))["verdict"].alias("verdict")), clear=False)
    shapes = rules.agg(F.collect_set("labels"), F.collect_set("length")).head()
    labels, lengths = (F.array(*map(F.lit, sorted(x))) if x else F.array().cast("array<int>") for x in shapes)
    parts = F.split("host", "\\.")
    hosts = F.transform(F.filter(labels, lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    paths = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    told = rows.select("host", "path").distinct().withColumn("h", F.explode(hosts)).withColumn("p", F.explode(paths))
    told = told.select("host", "path", F.sha2(F.concat_ws("\n", "h", "p"), 256).alias("digest")).withColumn("short", F.substring("digest", 1, 8))
    met = told.join(rules.withColumn("short", F.substring("digest", 1, 8)).withColumnRenamed("digest", "whole"), "short").where("digest = whole")
    rank = F.struct((-F.length("rule")).alias("n"), (F.col("verdict") != "block").alias("b"), "rule", "verdict")
    best = met.groupBy("host", "path").agg(F.min(rank).alias("best"))
    best = best.withColumnsRenamed({"host": "_host", "path": "_path"})
    out = rows.join(best, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
    out = out.select(*[f"_in{k}" for k in kept], "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
    return out.toDF(*[pages.columns[k] for k in kept], "host", "path", "rule", "verdict")
