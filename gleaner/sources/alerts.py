"""Alert messages to posting rows, as expressions over the lines of links.

A message's links become rows, each with its address and visible lines. A link that names a posting is a
view of it; the view with most lines stands for the posting. What a line says is told by its own shape
(a noise phrase, pay, a company with a place after a dot), never by its number alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.keyed import first_per_key

POSTING = ("source", "source_job_id", "title", "company_name", "location", "salary_text", "description", "apply_url", "posted_age_text")
# The shape of a posting's address, of pay, and lines that say nothing about the posting.
POSTING_LINK = r"/jobs/view/(?:[^/?#\s]*-)?(\d+)"
PAY = r"\$\s?\d[\d,.]*\s?[kK]?(?:\s?[-–]\s?\$?\s?\d[\d,.]*\s?[kK]?)?(?:\s?/\s?(?:yr|year|hr|hour|mo|month))?"
NOISE = ("easy apply", "actively recruiting", "promoted", "be an early applicant", "view job", "apply with resume & profile")
DOT, LINES_BEFORE_LINK = " · ", 4


def visible_lines(markup: Column) -> Column:
    """The lines of some markup or text, white space evened out, blank ones left out."""
    text = F.regexp_replace(F.coalesce(markup, F.lit("")), r"(?i)<(?:br|/p|/div|/li|/tr|/td|/h\d|p|div|li|tr|td|h\d)\b[^>]*>", "\n")
    text = F.regexp_replace(text, "<[^>]*>", "")
    for entity, char in (("&nbsp;|&#160;", " "), ("&#39;|&apos;", "'"), ("&quot;", '"'), ("&middot;|&#183;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.regexp_replace(text, entity, char)
    return F.filter(F.transform(F.split(text, r"[\r\n]+"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def links(messages: DataFrame) -> DataFrame:
    """message_id, place, href and lines of every link of messages (message_id, html)."""
    anchor = r"(?is)<a\b[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a\s*>"
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit(anchor), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(anchor), F.lit(2)).alias("inside"))
    rows = messages.where("html is not null").select("message_id", F.posexplode(found).alias("place", "link"))
    return rows.select("message_id", "place", F.replace(F.col("link.href"), F.lit("&amp;"), F.lit("&")).alias("href"), visible_lines(F.col("link.inside")).alias("lines"))


def _mentions(messages: DataFrame) -> DataFrame:
    """message_id, place, href and lines of every text line with a posting's address: the lines stand before it."""
    every = visible_lines(F.replace(F.col("text"), F.lit("<"), F.lit(" ")))
    rows = messages.where("text is not null").withColumn("every", every).select("message_id", "every", F.posexplode("every").alias("place", "href")).where(F.col("href").rlike(POSTING_LINK))
    first = F.greatest(F.col("place") - LINES_BEFORE_LINK, F.lit(0))
    return rows.select("message_id", "place", "href", F.slice("every", first + 1, F.col("place") - first).alias("lines"))


def _views(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The view of each posting that comes first in an order, with its fields; views without title, company and place go."""
    job = F.regexp_extract("href", POSTING_LINK, 1)
    views = first_per_key(rows.withColumn("job", job).where("job <> '' and size(lines) >= 2"), ["message_id", "job"], order)
    views = views.withColumn("title", F.get("lines", F.lit(0))).withColumn("rest", F.filter(F.slice("lines", F.lit(2), F.size("lines")), lambda x: ~F.lower(x).isin(*NOISE)))
    dotted = F.filter("rest", lambda x: (F.trim(F.split_part(x, F.lit(DOT), F.lit(1))) != "") & (F.trim(F.substring_index(x, DOT, -1)) != "") & x.contains(DOT))
    views = views.withColumn("dotted", F.get(dotted, F.lit(0)))
    mark = F.instr("dotted", DOT)
    company = F.when(F.col("dotted").isNotNull(), F.trim(F.substring("dotted", F.lit(1), mark - 1))).otherwise(F.get("rest", F.lit(0)))
    place = F.when(F.col("dotted").isNotNull(), F.trim(F.substring("dotted", mark + len(DOT), F.char_length("dotted")))).otherwise(F.get("rest", F.lit(1)))
    later = F.when(F.col("dotted").isNotNull(), F.slice("rest", F.array_position("rest", F.col("dotted")).cast("int") + 1, F.size("rest"))).otherwise(F.slice("rest", F.lit(3), F.size("rest")))
    pay = F.get(F.filter(F.transform(later, lambda x: F.trim(F.regexp_extract(x, PAY, 0))), lambda x: x != ""), F.lit(0))
    none = F.lit(None).cast("string")
    values = (F.lit("linkedin"), F.col("job"), F.col("title"), company, place, pay, none, F.concat(F.lit("https://www.linkedin.com/jobs/view/"), F.col("job"), F.lit("/")), none)
    return views.select("message_id", "place", *(v.alias(n) for v, n in zip(values, POSTING))).where("company_name is not null and location is not null")


def postings(messages: DataFrame) -> DataFrame:
    """A row for each posting of messages (message_id, html, text), message_id unique: the fields of POSTING and
    its place in the message. The text of a message counts only where its HTML has no posting."""
    from_html = _views(links(messages), [F.size("lines").desc(), F.col("place")])
    rest = messages.join(from_html.select("message_id").distinct(), "message_id", "left_anti")
    return from_html.unionByName(_views(_mentions(rest), [F.col("place")]))
