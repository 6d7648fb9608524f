"""Tables, configuration, mail files and reports."""

from __future__ import annotations

import email
import email.policy
import re
import tempfile
import uuid
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


SHARES = 4  # tasks for each core


def dealt(df: DataFrame) -> DataFrame:
    """df with its rows dealt out evenly, for steps that take long with each row: a file is read by one task for
    each of its row groups at most, and small columns of many rows have few of these."""
    spark = df.sparkSession
    return df.repartition(max(SHARES * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset a temporary one serves a local master, as in tests;
    on a cluster, whose machines share no such folder, that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gleaner-")
    return base.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: what several steps use is worked out once, and a lost
    executor costs one step. The files lie below the folder for the application to clear."""
    path = f"{shared_folder(df.sparkSession)}/gleaner-{df.sparkSession.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_or_empty(spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
    """A catalog table, or no rows of its schema where it doesn't exist."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)


def with_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the columns of schema in their order and types; those that it lacks are null, others go."""
    from pyspark.sql import functions as F

    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def enabled(spark: SparkSession, entries: list[dict], schema: T.StructType) -> DataFrame:
    """Entries of a configuration that aren't switched off, as a table."""
    return spark.createDataFrame([tuple(e.get(f.name) for f in schema) for e in entries if e.get("enabled", True)], schema)


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []
        self.links: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript", "svg"):
            self.skip += 1
        elif tag == "a":
            self.links += [v for k, v in attrs if k == "href" and v and v.startswith("http")]
        elif tag in ("p", "div", "br", "li", "tr", "h1", "h2", "h3"):
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript", "svg"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("p", "div", "li", "tr", "h1", "h2", "h3"):
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def html_text(html: str | None) -> tuple[str, list[str]]:
    """Visible text, a line for each block, and links in order without repeats."""
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    lines = (re.sub(r"[ \t\r\f\v ]+", " ", line).strip() for line in "".join(parser.parts).split("\n"))
    return "\n".join(line for line in lines if line), list(dict.fromkeys(parser.links))


def _message(data: bytes) -> tuple:
    m = email.message_from_bytes(data, policy=email.policy.default)
    text, html = [], []
    for part in m.walk():
        if part.is_multipart() or part.get_content_disposition() == "attachment":
            continue
        kind = part.get_content_type()
        if kind in ("text/plain", "text/html"):
            (text if kind == "text/plain" else html).append(str(part.get_content()))
    body, page = "\n".join(text), "\n".join(html)
    seen, links = html_text(page)
    links += [u.rstrip(".,);]") for u in re.findall(r"https?://[^\s<>\"]+", body)]
    return str(m["message-id"] or ""), str(m["subject"] or ""), str(m["from"] or ""), str(m["date"] or ""), body or seen, page, list(dict.fromkeys(links))


MESSAGE = "message_id string, subject string, sender string, date string, text string, html string, links array<string>"


def mail(spark: SparkSession, path: str) -> DataFrame:
    """Messages of .eml files: headers, text (from the HTML where there is no plain part), HTML and links; attachments are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([_message(bytes(x)) for x in frame["content"]], columns=["message_id", "subject", "sender", "date", "text", "html", "links"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(path).select("content").mapInPandas(run, MESSAGE)
