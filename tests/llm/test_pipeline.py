"""The stages of the pipeline, each on its own input."""

import os
import random

import corpus_pipeline
from cases import components, frame, prose, removed

from gleaner.llm.decontamination import _item_words, align, counts_as_copy, leaks

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, FOLDER)
        assert out.columns == columns
        before, rows = {r.doc_id: r.text for r in docs.collect()}, out.collect()
        after = {r.doc_id: r.text for r in rows}
        assert len(after) == len(rows) and set(after) <= set(before)
        if name == "near duplicates":
            assert set(after) == {k for k, (_, c) in components(list(before.items())).items() if k == c}
        if name == "repeated strings":
            want = removed(list(before.items()))
            assert set(after) == set(before)
            assert all(want[k][1] or after[k] == before[k] for k in after)
            assert all(len(after[k].encode()) <= want[k][0] - want[k][1] for k in after)
        if name == "decontamination":
            dirty = {r.doc_id for r in leaks(docs, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
            assert set(after) == set(before) - dirty
        seen[name] = len(rows)
        docs = spark.createDataFrame(rows, docs.schema)
    assert seen["quality"] >= 0.7 * len(before)
    mix = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    total = mix.agg({"taken": "sum"}).head()[0]
    words = sum(len((r.text or "").split()) for r in docs.collect())
    assert abs(total - 1.5 * words) <= 0.01 * words + 30


def test_decontamination_against_all_alignments(spark, tmp_path):
    """Every item aligned with every whole document; copies have up to a quarter of their words replaced, dropped or added."""
    r, texts, items = random.Random(5), {}, {k: prose(1100 + k, 12 + 7 * k) for k in range(10)}
    items |= {20 + k: prose(1200 + k, 5 + k) for k in range(8)}
    for number, (k, share) in enumerate((k, share) for k in items for share in (0, 0.1, 0.25)):
        words = items[k].split()
        for at in sorted(r.sample(range(len(words)), int(share * len(words))), reverse=True):
            words[at : at + 1] = r.choice([["other"], [], [words[at], "more"]])
        texts[number] = f"{prose(1300 + number, 25)} {' '.join(words)} {prose(1400 + number, 25)}"
    texts |= {500 + k: prose(1500 + k, 80) for k in range(10)}
    texts |= {600 + k: f"{prose(1600 + k, 20)} {' '.join(items[k].split()[: 6 + k])}" for k in range(10)}
    docs = frame(spark, [(k, t, "en", "s", 1, "", "", 0) for k, t in texts.items()])
    spark.createDataFrame([*items.items()], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = set()
    for d, text in texts.items():
        whole = _item_words(text)
        for k, item in items.items():
            w = _item_words(item)
            score, same, _, _ = align(w, whole)
            if score and counts_as_copy(score, same, len(w)):
                want.add((d, k))
    got = {(x.doc_id, x.item_id) for x in leaks(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect()}
    assert len(want) > 40 and got == want, (got - want, want - got)
    left = {x.doc_id for x in corpus_pipeline.clean(spark, docs, str(tmp_path)).collect()}
    assert left == set(texts) - {d for d, _ in want}
