"""Text extraction, similarity, writes and streams on the driver's tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from gleaner.catalog import query
from gleaner.functions import text
from gleaner.functions.similar import likeness
from gleaner.operators.keyed import insert_if_absent, replace_keys, upsert
from gleaner.sources.tables import html_text, table
from gleaner.streaming.ingest import replayed


@query()
def html_to_text(spark, d):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [html_text(h) for h in f["html"]]
            yield pd.DataFrame({"page_id": f["page_id"], "text": [t for t, _ in rows], "n_words": [len(t.split()) for t, _ in rows], "links": [links for _, links in rows]})

    return table(spark, d, "pages").select("page_id", "html").mapInPandas(run, "page_id long, text string, n_words long, links array<string>")


@query("""SELECT page_id, list_distinct(list_transform(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda x: x)) IS NOT NULL AS has_links, len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS n_links FROM pages WHERE html IS NOT NULL""")
def link_extraction(spark, d):
    found = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return table(spark, d, "pages").where("html is not null").select("page_id", found.isNotNull().alias("has_links"), F.size(found).cast("long").alias("n_links"))


_BLOCK = re.compile(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script>", re.S | re.I)


def posting_in_json_ld(page: str | None) -> tuple[str | None, str | None]:
    """Title and the longest description among the JobPosting objects of a page's JSON-LD."""
    best: tuple[str | None, str | None] = (None, None)
    for block in _BLOCK.findall(page or ""):
        try:
            todo = [json.loads(block)]
        except ValueError:
            continue
        while todo:
            x = todo.pop()
            if isinstance(x, list):
                todo += x
            elif isinstance(x, dict):
                kinds = x.get("@type")
                if "JobPosting" in (kinds if isinstance(kinds, list) else [kinds]):
                    text = html_text(str(x.get("description") or ""))[0]
                    if best[1] is None or len(text.split()) > len(best[1].split()):
                        best = x.get("title"), text
                todo += list(x.values())
    return best


@query()
def json_ld(spark, d):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [posting_in_json_ld(h) for h in f["html"]]
            yield pd.DataFrame({"page_id": f["page_id"], "title": [a for a, _ in rows], "description": [b for _, b in rows]})

    made = F.concat(F.lit('<script type="application/ld+json">{"@type": "JobPosting", "title": "t'), F.col("page_id").cast("string"), F.lit('", "description": "<p>a b</p>c"}</script>'))
    return table(spark, d, "pages").select("page_id", F.concat(made, F.coalesce("html", F.lit(""))).alias("html")).mapInPandas(run, "page_id long, title string, description string")


@query()
def similarity_validate(spark, d):
    """Each part against the part with the next key: the likeness of their names, accepted from 0.78."""
    p = table(spark, d, "part").select("p_partkey", text.loose(F.col("p_name")).alias("name"))
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("name").alias("resolved"))
    pairs = p.join(after, "p_partkey").withColumn("similarity", F.bround(F.coalesce(likeness(F.col("name"), F.col("resolved")), F.lit(0.0)), 4))
    return pairs.select("p_partkey", "similarity", (F.col("similarity") >= 0.78).alias("accepted"))


@query("SELECT event_id, user_id, value FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, user_id, value + 1 FROM events WHERE event_id % 3 = 0")
def insert_absent(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "value")
    old, new = events.where("event_id % 3 <> 0"), events.where("event_id % 2 = 0 or event_id % 3 = 0").withColumn("value", F.col("value") + 1)
    return insert_if_absent(old, new, "event_id", [F.col("value")])


@query("SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN value + 1 ELSE value END AS value, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS version FROM events")
def upsert_latest(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "value", F.lit(1).alias("version"))
    changes = events.where("event_id % 2 = 0").withColumn("value", F.col("value") + 1).withColumn("version", F.lit(2))
    return upsert(events, changes, ["event_id"], [F.desc("version")])


@query("SELECT event_id, user_id, CASE WHEN user_id % 5 = 0 THEN 0 ELSE value END AS value FROM events WHERE user_id % 5 <> 0 OR event_type = 'click'")
def replace_by_key(spark, d):
    events = table(spark, d, "events")
    changes = events.where("user_id % 5 = 0 and event_type = 'click'").select("event_id", "user_id", F.lit(0.0).alias("value"))
    gone = events.where("user_id % 5 = 0 and event_type <> 'click'").select("user_id")
    kept = events.join(gone.distinct(), "user_id", "left_anti").select("event_id", "user_id", "value")
    return replace_keys(kept, changes, ["event_id"])


@query("SELECT event_id, user_id, event_type, value FROM events WHERE props IS NOT NULL")
def stream_ingest_idempotent(spark, d):
    return replayed(spark, f"{d}/events.parquet", "event_id").select("event_id", "user_id", "event_type", "value")
