"""Versions of tables, alert messages, streams."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.sources.alerts import postings
from gleaner.sources.snapshots import Snapshots
from gleaner.sources.tables import enabled, table_or_empty, with_columns
from gleaner.streaming.ingest import ingest

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])


def test_versions(spark, tmp_path):
    t, rows = Snapshots(spark, str(tmp_path / "t"), SCHEMA), lambda *r: spark.createDataFrame(list(r), SCHEMA)
    assert t.read().count() == 0
    t.insert(rows((1, "a"), (1, "b"), (2, "c")), "k", [F.col("v")])
    t.insert(rows((2, "x"), (3, "d")), "k", [F.col("v")])
    content = lambda v=None: sorted(tuple(r) for r in t.read(v).collect())
    assert content() == [(1, "a"), (2, "c"), (3, "d")]
    t.merge(rows((3, "e"), (4, "f")), ["k"])
    t.update(F.col("k") == 1, {"v": F.upper("v")})
    t.replace(rows((4, "g")), ["k"])
    assert content() == [(1, "A"), (2, "c"), (3, "e"), (4, "g")] and content(1) == [(1, "a"), (2, "c")]
    with pytest.raises(ValueError):
        t.commit(rows((9, "z")), [rows((1, "bad"))])
    assert [n for n, _ in t.versions()] == [1, 2, 3, 4, 5]


def test_alerts(spark):
    html = '<a href="https://www.linkedin.com/comm/jobs/view/data-engineer-42?x">Data Engineer<br>Acme · Austin, TX<p>Easy Apply</p>$100K - $120K/yr</a><a href="/jobs/view/42">View job</a><a href="/jobs/view/7">Only title</a><a href="/jobs/view/9">Cook<br>Promoted<br>Diner &amp; Co<br>Rome</a>'
    text = "Analyst\nBeta\nParis\nView: https://www.linkedin.com/jobs/view/8\n"
    messages = spark.createDataFrame([("m1", html, text), ("m2", None, text), ("m3", None, None), ("m4", "", "")], "message_id string, html string, text string")
    got = {(r.message_id, r.source_job_id): (r.title, r.company_name, r.location, r.salary_text, r.apply_url) for r in postings(messages).collect()}
    link = "https://www.linkedin.com/jobs/view/"
    assert got == {
        ("m1", "42"): ("Data Engineer", "Acme", "Austin, TX", "$100K - $120K/yr", f"{link}42/"),
        ("m1", "9"): ("Cook", "Diner & Co", "Rome", None, f"{link}9/"),
        ("m2", "8"): ("Analyst", "Beta", "Paris", None, f"{link}8/"),
    }


def test_two_writers(spark, tmp_path, monkeypatch):
    """The one that comes second between check and commit fails, and nothing of it is read."""
    one, other = (Snapshots(spark, str(tmp_path / "t"), SCHEMA) for _ in range(2))
    rows = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    checked = one.versions
    monkeypatch.setattr(one, "versions", lambda: checked() if other.versions() else (checked(), other.commit(rows((1, "other"))))[0])
    with pytest.raises(RuntimeError):
        one.commit(rows((1, "one")))
    assert [n for n, _ in other.versions()] == [1] and [tuple(r) for r in other.read().collect()] == [(1, "other")]


def test_stream_is_idempotent(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "table")
    rows = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    rows((1, "a"), (2, None)).write.parquet(str(source / "one"))
    run = lambda mark: ingest(spark, f"{source}/*", SCHEMA, "k", table, str(tmp_path / mark), "v is not null")
    run("c1")
    rows((1, "a"), (2, "b"), (2, "b"), (3, "c")).write.parquet(str(source / "two"))
    run("c1")
    run("c2")
    assert sorted(r.k for r in spark.read.parquet(table).collect()) == [1, 2, 3]


def test_small_sources(spark):
    assert table_or_empty(spark, "no_such_table", SCHEMA).count() == 0
    df = with_columns(spark.createDataFrame([(1, "x")], "k int, other string"), SCHEMA)
    assert df.schema == SCHEMA and df.head() == (1, None)
    assert [r.k for r in enabled(spark, [{"k": 1, "v": "a"}, {"k": 2, "v": "b", "enabled": False}], SCHEMA).collect()] == [1]
