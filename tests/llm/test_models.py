"""Operators that learn: edge cases, gradients and held-out accuracy."""

import os
import random

import numpy as np
from cases import SCHEMA, documents, frame, prose

from gleaner.llm import html_extraction, language_id, quality
from gleaner.llm.queries_models import op2_language_id, op9_quality

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_blocks():
    page = "<title>no</title><body><nav class=menu><a href=x>Home</a></nav><p>A <b>b</b>&amp;c<br>d<p>e &lt;f&gt; &am<script>x<p></script><style>y</style><!-- <p>z --><ul><li>1<li>2</ul><div>t"
    found = html_extraction.blocks(page)
    assert [t for _, t, _ in found] == ["Home", "A b&c d", "e <f> &am", "1", "2", "t"]
    assert found[0][2] == 4 and found[0][0].marks[0] == "nav"
    assert html_extraction.blocks("") == [] and html_extraction.blocks("<<<>") != None  # noqa: E711
    assert html_extraction.blocks("a" * 300_000)[0][1] == "a" * 300_000
    assert html_extraction.blocks("<p " * 20_000) == []


def test_raw_elements_that_do_not_close():
    texts = lambda page: [t for _, t, _ in html_extraction.blocks(page)]
    assert texts("<p>a <svg viewBox='0 0'/> b<p>c <svg><text>no</text></svg> d") == ["a b", "c d"]
    assert texts("<p>a <math/> b <math><mi>x</mi><mo>=</mo><mn>1</mn></math> c") == ["a b x=1 c"]
    for name in ("object", "canvas", "audio", "video", "noscript", "svg", "template"):
        assert texts(f"<p>a <{name} id=x> b<p>c") == ["a b", "c"], name
        assert texts(f"<p>a <{name} id=x>no</{name}> b<p>c") == ["a b", "c"], name
    for name in ("script", "style", "textarea", "title"):
        assert texts(f"<p>a <{name}> b<p>c") == ["a"], name
    assert texts("<svg>" * 20_000 + "x") == ["x"]


def test_gradients_of_the_recurrent_network():
    r = np.random.default_rng(1)
    net = html_extraction.BiLstm(2)
    net.w = {k: v.astype(float) for k, v in net.w.items()}
    x, mask = r.normal(size=(5, 2, html_extraction.DIMS)), np.ones((5, 2))
    mask[3:, 1] = 0
    y = (r.random((5, 2)) < 0.5) * mask

    def loss():
        p = net.chances(x, mask)
        return float((-(y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum())

    grads = net.gradients(x, mask, y)
    for k, w in net.w.items():
        at = tuple(r.integers(s) for s in w.shape)
        w[at] += 1e-3
        up = loss()
        w[at] -= 2e-3
        slope = (up - loss()) / 2e-3
        w[at] += 1e-3
        assert abs(slope - grads[k][at]) < 2e-3 + 0.05 * abs(slope), k


def test_main_text_of_generated_pages():
    net, r, right, total = html_extraction.trained(), random.Random(4242), 0, 0
    for _ in range(60):
        page, main = html_extraction._generated(r)
        found = html_extraction.blocks(page)
        chance = net.chances(*html_extraction._padded([html_extraction.vectors(found)]))[:, 0] if found else []
        right += sum((c >= 0.5) == (t in main) for c, (_, t, _) in zip(chance, found))
        total += len(found)
    assert right / total > 0.96


def test_extract(spark):
    body = "".join(f"<p>{prose(k, 30)}</p>" for k in range(5))
    page = f"<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/>News</a></li></ul></nav><article><h1>{prose(9, 6)}</h1>{body}</article><footer>&copy; x</footer></body></html>"
    pages = spark.createDataFrame([(1, "u", page, 0), (1, "u", page, 0), (2, None, None, 0), (None, "v", "", 0), (3, "w", "<script>x</script>", 0)], "page_id long, url string, html string, text int")
    got = html_extraction.extract(pages).collect()
    want = "\n".join([prose(9, 6), *(prose(k, 30) for k in range(5))])
    assert [r.text for r in got if r.page_id == 1] == [want] * 2
    assert all(r.text == "" and r.n_chars == 0 for r in got if r.page_id != 1) and len(got) == 5
    assert html_extraction.extract(pages.limit(0)).count() == 0


def test_gradients_of_attention():
    r = np.random.default_rng(3)
    net = quality.GatedAttention(1)
    x, own, y = r.normal(size=(9, quality.DIMS)), np.array([0, 4, 5, 9]), np.array([1.0, 0.0, 1.0])
    loss = lambda: float(-(y * np.log(p := net.scores(x, own)) + (1 - y) * np.log(1 - p)).mean())
    grads = net.gradients(x, own, y)
    for k, w in net.w.items():
        at = tuple(r.integers(s) for s in w.shape)
        w[at] += 1e-5
        up = loss()
        w[at] -= 2e-5
        slope = (up - loss()) / 2e-5
        w[at] += 1e-5
        assert abs(slope - grads[k][at]) < 1e-6 + 1e-3 * abs(slope), k


def test_passages_follow_texts():
    texts = ["", "a b\nc", "\n\n", "w " * 100, "x"]
    data = [t.encode() for t in texts]
    x, own = quality.passages(np.frombuffer(b"".join(data) + bytes(512), np.uint8), np.cumsum([0, *map(len, data)]))
    assert np.diff(own).tolist() == [1, 2, 1, 3, 1] and not x[own[0]].any() and not x[own[2]].any()
    assert quality.passages(np.zeros(512, np.uint8), np.array([0, 0]))[1].tolist() == [0, 1]


def test_quality_scores_every_row(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 30)] + [(1, None, 0), (None, 1, 0), (2, 0, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.learn(docs, labels)).collect()
    assert len(got) == len(documents()) and all(0 <= r.score <= 1 for r in got)
    none = quality.learn(docs, labels.limit(0))
    assert quality.score(docs, none).count() == len(documents())
    assert quality.score(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_quality_on_held_out_rows(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    got = [r for r in op9_quality(spark, FOLDER).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in got) >= 0.85 * len(got) > 0


def test_languages_on_held_out_rows(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = [r for r in op2_language_id(spark, FOLDER).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) >= 0.95 * len(got) > 0


def test_languages_of_awkward_texts(spark):
    docs = frame(spark)
    model = language_id.learn(docs)
    got = language_id.identify(docs, model).collect()
    assert len(got) == len(documents())
    for r in got:
        letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "en") == letter and (letter or (r.lang_pred, r.score) == ("und", 0.0)) and 0 <= r.score <= 1
    empty = spark.createDataFrame([], SCHEMA)
    assert language_id.identify(docs, language_id.learn(empty)).where("lang_pred <> 'und'").count() == 0
    assert language_id.identify(empty, model).count() == 0


def test_rare_languages_are_classes(spark, monkeypatch):
    monkeypatch.setattr(language_id, "TRAIN_ROWS", 40)
    rows = [(k, prose(k, 20), "en", "s", 1, "", "", 0) for k in range(300)] + [(1000 + k, f"{k} слово предложение язык", "ru", "s", 1, "", "", 0) for k in range(3)]
    assert language_id.learn(frame(spark, rows)).languages == ["en", "ru"]
