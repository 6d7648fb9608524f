"""Mixing, URL filters, fingerprints, WARC derivatives: edge cases, and the SQL of the contract queries."""

import hashlib
import math
import os

import duckdb
import pytest
from cases import SCHEMA, documents, frame

from gleaner.llm import merkle, mixing, registry, url_filters, warc

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df, want = registry.QUERIES[name](spark, FOLDER), con.sql(registry.ORACLE_SQL[name])
    tidy = lambda columns, rows: sorted(tuple("null" if v is None else f"{v:.9f}" if isinstance(v, float) else str(v) for _, v in sorted(zip(columns, r))) for r in rows)
    assert sorted(df.columns) == sorted(want.columns)
    assert tidy(df.columns, df.collect()) == tidy(want.columns, want.fetchall())


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] >= 2 * sizes[s]}
        if not over:
            return out | {s: share * weight[s] for s in open_}
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mixing(spark):
    docs = frame(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(documents())
    sizes, taken = {}, {}
    for r in rows:
        assert r.size == len((r.text or "").split()) if "é" not in (r.text or "") else True
        assert 0 <= r.taken <= 2 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = plain_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 3
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda x: sorted((r.doc_id or -1, r.text or "", r.taken) for r in x)
    assert key(rows) == key(again)


def test_mixing_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    blank = spark.createDataFrame([(1, None, None, "a", 0, "", "", 0), (2, " ", None, None, 0, "", "", 0)], SCHEMA)
    assert [(r.size, r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0, 0.0, 0)] * 2


def test_one_source_holds_most(spark):
    rows = [(k, "w " * (k % 50), "en", "hot" if k % 10 else f"s{k}", 0, "", "", 0) for k in range(600)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).groupBy("source", "target").sum("taken").collect()
    assert all(abs(r["sum(taken)"] - r.target) <= 1 for r in out)


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://a.net", "http://a.NET/", "HTTPS://www.example.net/en/x?y#z", "http://example.net/en", "http://badexample.net/en/", "ftp://example.com/de/1", "http://example.com/DE/", "http://x.org/fr/?q", "http://u@x.org:80/fr/", "http://org/fr/a/b", "a://b.net://c/", "http:///net/", "http://net?/", "http://" + "a." * 3000 + "net/" + "x" * 5000]
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(k, u, "old", 1) for k, u in enumerate(urls)] * 2, "page_id long, url string, verdict string, short int")
    got = url_filters.judge(pages, rules).collect()
    assert len(got) == 2 * len(urls)

    def plain(u):
        if not u or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fits = [(h + p, v) for h, p, v in [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=lambda f: len(f[0]), default=(None, "allow"))
        return host, path, *rule

    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain(r.url), r.url
    assert url_filters.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filters.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_trees(spark):
    rows = [(k, t) for k, t in enumerate([None, "", "a", "a", "a\nb\nc", "a\nX\nc", "Line one. Two!\n\nThree" * 40, "é" * 333])]
    df = merkle.with_fingerprint(spark.createDataFrame(rows, "k int, t string"), "t", "f")
    f = {r.k: r.f for r in df.collect()}
    assert f[0] == f[1] and f[2] == f[3] and len({f[k] for k in (1, 2, 4, 5, 6, 7)}) == 6
    pair = spark.createDataFrame([(f[4], f[5]), (f[2], f[3]), (f[0], f[1]), (f[0], f[2])], "a string, b string")
    got = merkle.edits(pair, "a", "b", "e").withColumn("n", merkle.likeness(pair.a, pair.b)).collect()
    assert [round(r.n, 3) for r in got] == [0.667, 1, 1, 0]
    assert [(r.e.paragraph, r.e.paragraphs, r.e.leaf, r.e.leaves, r.e.old_leaves) for r in got] == [(1, 1, 1, 1, 1), (1, 0, 1, 0, 0), (0, 0, 0, 0, 0), (0, 1, 0, 1, 0)]


def test_edits_with_the_next_document(spark):
    got = merkle.compared_with_next(frame(spark)).collect()
    assert len(got) == len(documents())
    low = lambda k: float("-inf") if k is None else k
    order = sorted({(r[0], r[1]) for r in documents()}, key=lambda r: low(r[0]))
    want = {}
    for (k, t), (_, after) in zip(order, [*order[1:], order[0]]):
        t, after = t or "", after or ""
        half = len(t) // 2
        want[k] = len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
    for r in got:
        assert (r.n_chars, r.edited_sha256) == want[r.doc_id], r.doc_id
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by = {r.doc_id: r for r in got}
    assert by[10].near_next == 1 and by[10].fingerprint == by[11].fingerprint
    assert merkle.compared_with_next(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = merkle.compared_with_next(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).head()
    assert alone.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_warc_derivatives(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>Hi &amp; ho</p><p>x</p>"), (2, None, None), (None, "http://b/", "")], "page_id long, url string, html string")
    sources = warc.responses(pages)
    made = warc.derive(sources, "page_id").collect()
    assert len(made) == 6 and len({r.record_id for r in made}) == 6
    origin = {r.page_id: r for r in sources.collect()}
    for r in made:
        assert r.refers_to == origin[r.page_id].record_id and r.target_uri == origin[r.page_id].target_uri
        assert r.block_digest == warc.digest(bytes(r.block))
    text = {r.page_id: bytes(r.block).decode() for r in made if r.warc_type == "conversion"}
    assert text == {1: "Hi & ho\nx", 2: "", None: ""}
    about = next(bytes(r.block).decode() for r in made if r.warc_type == "metadata" and r.page_id == 1)
    conversion = next(r for r in made if r.warc_type == "conversion" and r.page_id == 1)
    assert f"conversion-record-id: {conversion.record_id}" in about and "source-status: HTTP/1.1 200 OK" in about and "source-header-content-type: text/html" in about
    assert conversion.payload_digest == warc.digest(b"<p>Hi &amp; ho</p><p>x</p>")
    assert warc.derive(sources.limit(0)).count() == 0 and warc.derive(warc.derive(sources)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://a/{k}", f"<p>{k}\r\n\r\nWARC/1.1 é</p>") for k in range(5)], "page_id long, url string, html string")
    sources = warc.responses(pages).drop("page_id")
    (tmp_path / "a.warc.gz").write_bytes(b"".join(bytes(r.member) for r in warc.packed(sources).collect()))
    back = {tuple(r) for r in warc.read(spark, str(tmp_path)).select(*warc.RECORD.names[:-1]).collect()}
    assert back == {tuple(r) for r in sources.select(*warc.RECORD.names[:-1]).collect()}
    blocks = {bytes(r.block) for r in warc.read(spark, str(tmp_path)).collect()}
    assert blocks == {bytes(r.block) for r in sources.collect()}
    assert list(warc.parsed(b"WARC/1.0\r\nContent-Length: 99\r\n\r\nshort")) == [] and list(warc.parsed(b"")) == []


def test_http_bodies():
    import gzip

    body = gzip.compress(b"hello")
    chunks = b"".join(b"%x\r\n%s\r\n" % (len(body[k : k + 4]), body[k : k + 4]) for k in range(0, len(body), 4)) + b"0\r\n\r\n"
    _, headers, payload = warc.split_response(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\nX: a\r\n b\r\n\r\n" + chunks)
    assert payload == b"hello" and ("X", "a b") in headers
    assert warc.split_response(b"plain") == ("", [], b"plain")


def test_warc_keeps_every_header(spark, tmp_path):
    http = b"HTTP/1.1 302 Found\r\nSet-Cookie: a=1\r\nLocation: http://b/\r\nX-Robots-Tag: noindex\r\nSet-Cookie: b=2\r\nContent-Type: text/plain\r\n\r\nhello"
    fields = ["WARC-Type: response", "WARC-Record-ID: <urn:x>", "WARC-IP-Address: 1.2.3.4", "WARC-Concurrent-To: <urn:y>", "WARC-Concurrent-To: <urn:z>", "WARC-Truncated: time", "WARC-Identified-Payload-Type: text/html", f"Content-Length: {len(http)}"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc").write_bytes("\r\n".join(["WARC/1.1", *fields, "", ""]).encode() + http + b"\r\n\r\n")
    records = warc.read(spark, str(tmp_path / "in"))
    want = [tuple(f.split(": ", 1)) for f in fields[2:-1]]
    (row,) = records.collect()
    assert [tuple(h) for h in row.headers] == want
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "a.warc.gz").write_bytes(b"".join(bytes(r.member) for r in warc.packed(records).collect()))
    assert warc.read(spark, str(tmp_path / "out")).collect() == [row]
    about, conversion = sorted(warc.derive(records).collect(), key=lambda r: r.warc_type, reverse=True)
    assert [tuple(h) for h in about.headers] == [tuple(h) for h in conversion.headers] == want[:-1]
    lines = bytes(about.block).decode().split("\r\n")
    assert [x for x in lines if x.startswith("source-header-")] == ["source-header-set-cookie: a=1", "source-header-location: http://b/", "source-header-x-robots-tag: noindex", "source-header-set-cookie: b=2", "source-header-content-type: text/plain"]
    assert [x for x in lines if x.startswith("source-field-")] == [f"source-field-{n.lower()}: {v}" for n, v in want]
