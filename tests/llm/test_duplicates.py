"""Near duplicates, repeated strings and benchmark copies against plain versions."""

import random
import zlib

import numpy as np
import pytest
from cases import SCHEMA, components, documents, frame, prose, removed
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.llm.decontamination import align, leaks, without_leaks
from gleaner.llm.minhash import _Index, near_duplicates, one_of_each, similar
from gleaner.llm.shingles import shingle_sets, words
from gleaner.llm.suffix_dedup import remove_repeated, repeated_spans


def batch(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data) + bytes(512), np.uint8), np.cumsum([0, *map(len, data)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abAB \t\n\x0b\x1c\u00a0é.", max_size=40), min_size=1, max_size=6))
def test_words_are_those_of_the_pattern(texts):
    import re

    hashes, begin, end, first = words(*batch(texts))
    seen: dict[str, int] = {}
    at = 0
    for k, t in enumerate(texts):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        found = re.findall(r"[^\x20\x09-\x0D]+", low)
        assert first[k + 1] - first[k] == len(found)
        for w in found:
            assert seen.setdefault(w, int(hashes[at])) == int(hashes[at])
            at += 1
    assert len(set(seen.values())) == len(seen)


def test_long_words_and_short_texts():
    long = "x" * 200_000
    a, b, c = shingle_sets(*batch([long + " a", long + " b", ""]))
    assert len(a) == len(b) == 1 and a[0] != b[0] and len(c) == 0


def test_similarity_bound():
    x = np.arange(4, dtype=np.uint64)
    assert similar(x, x[:3]) and not similar(x, x[:2]) and not similar(x[:0], x[:0])


def test_near_duplicates(spark):
    got = near_duplicates(frame(spark)).collect()
    want = components(documents())
    assert len(got) == len(documents())
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
        assert r.kept == (r.doc_id == r.component_id)


def test_components_that_a_pivot_does_not_see(spark):
    """A chain: each text is near the next, the first and the last are far apart; and a star of many near copies."""
    base = prose(9, 200).split()
    chain = [(k, " ".join(base[8 * k : 8 * k + 120])) for k in range(9)]
    star = [(100 + k, " ".join([*base[:50], f"new{k}", *base[51:]])) for k in range(60)]
    rows = [(k, t, "en", "s", 1, "", "", 0) for k, t in chain + star]
    want = components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows)).collect()} == want


def test_index_finds_the_links_of_a_block():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, 40)) for _ in range(30)]
    index = _Index([(k, k % 3, s) for k, s in enumerate(sets)])
    for k, s in enumerate(sets):
        want = [j for j, t in enumerate(sets) if j % 3 != k % 3 and similar(s.astype(np.uint64), t.astype(np.uint64))]
        assert index.links(k, k % 3, s).tolist() == want
    assert index.links(99, 9, np.array([1000])).tolist() == []


def test_links_far_from_every_pivot(spark):
    """Copies of one text with so many edits that most are far from it and each other; some are near in pairs."""
    base, r, rows = prose(8, 150).split(), random.Random(6), [(0, prose(8, 150))]
    for k in range(1, 50):
        words = list(base)
        for at in r.sample(range(150), r.choice([2, 5, 7, 9])):
            words[at] = f"new{k}x{at}"
        rows.append((2 * k, " ".join(words)))
        words[r.randrange(150)] = "other"
        rows.append((2 * k + 1, " ".join(words)))
    rows = [(k, t, "en", "s", 1, "", "", 0) for k, t in rows]
    want = components(rows)
    assert len({c for _, c in want.values()}) > 5
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows)).collect()} == want


def test_one_of_each_keeps_columns(spark):
    docs = frame(spark)
    kept = one_of_each(docs)
    ids = [r.doc_id for r in kept.collect()]
    want = {k for k, (_, c) in components(documents()).items() if k == c}
    assert kept.columns == docs.columns and len(ids) == len(set(ids)) and set(ids) == want


def test_repeated_spans(spark):
    want = removed(documents())
    got = repeated_spans(frame(spark)).collect()
    assert len(got) == len(documents())
    for r in got:
        assert tuple(r)[1:] == want[r.doc_id], r.doc_id


def test_repeats_of_short_periods_and_many_contexts(spark):
    line = prose(3, 12)[:60]
    texts = ["ab" * 300, "a" * 250, "b" + "a" * 180, line * 5, *(f"{prose(200 + k, 12)} {line} {prose(300 + k, 12)}" for k in range(40)), *(prose(200 + k, 12) + " " + line + " " + prose(400, 30) for k in range(5))]
    rows = [(k, t, "en", "s", 1, "", "", 0) for k, t in enumerate(texts)]
    assert {r.doc_id: tuple(r)[1:] for r in repeated_spans(frame(spark, rows)).collect()} == removed(rows)


def test_remove_repeated_changes_only_texts(spark):
    docs = frame(spark)
    out = remove_repeated(docs)
    assert out.columns == docs.columns and out.count() == len(documents())
    want = removed(documents())
    for r in out.collect():
        if r.text is not None and want[r.doc_id][0]:
            assert len(r.text.encode()) <= want[r.doc_id][0] - want[r.doc_id][1] and (r.n_chars == len(r.text))
            if "é" not in r.text:
                assert len(r.text.encode()) == want[r.doc_id][0] - want[r.doc_id][1]
    assert [r.text for r in out.where("doc_id = 31").collect()] == [None]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    assert near_duplicates(none).count() == repeated_spans(none).count() == one_of_each(none).count() == remove_repeated(none).count() == 0
    assert leaks(none, bench).count() == 0 and leaks(frame(spark), bench.limit(0)).count() == 0


@pytest.mark.parametrize(("item", "passage", "score"), [("abcd", "xxabcdxx", 8), ("abcd", "abxcd", 7), ("abcd", "abd", 5), ("abcd", "axcd", 5), ("abcd", "", 0), ("a", "b", 0)])
def test_alignment(item, passage, score):
    to = lambda s: np.array([ord(c) for c in s], np.uint64)
    assert align(to(item), to(passage))[0] == score


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc", max_size=8), st.text(alphabet="abc", max_size=10))
def test_alignment_is_the_textbook_one(item, passage):
    h = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i, x in enumerate(item, 1):
        for j, y in enumerate(passage, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    to = lambda s: np.array([ord(c) for c in s], np.uint64)
    assert align(to(item), to(passage))[0] == max(map(max, h))


def test_leaks_in_edited_copies(spark):
    items = {k: prose(500 + k, 40) for k in range(5)}
    edited = items[1].split()
    edited[5], edited[20] = "other", "another"
    del edited[30]
    texts = {1: f"{prose(1, 50)} {items[0]} {prose(2, 50)}", 2: prose(3, 30) + " " + " ".join(edited), 3: prose(4, 200), 4: items[2].upper() + ", " + items[3], 5: None, 6: "", 7: " ".join(items[4].split()[:8]) + " " + prose(8, 60)}
    rows = [(k, t, "en", "s", 1, "", "", 0) for k, t in texts.items()] + [(None, items[4], None, None, None, None, None, None)]
    bench = spark.createDataFrame([*items.items(), (None, "x y z"), (9, None), (10, ""), (0, items[0])], "item_id long, text string")
    docs = frame(spark, rows)
    got = leaks(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in got) == [(0, 4), (1, 0), (2, 1), (4, 2), (4, 3)]
    by = {(r.doc_id, r.item_id): r for r in got}
    whole = by[1, 0]
    assert whole.score == 1 and texts[1].encode()[whole.begin_byte : whole.end_byte].decode().rstrip(".") == items[0].rstrip(".")
    assert 0.7 < by[2, 1].score < 1
    left = without_leaks(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [3, 5, 6, 7]
    assert docs.where(F.col("doc_id").isNull()).count() == 1


def test_texts_that_share_an_id(spark):
    """Null-id texts A and B with a copy each, a third null-id text of its own, two texts under id 7, and a near copy within it."""
    a, b, c, d, e = (prose(700 + k, 60) for k in range(5))
    near = d.split()
    near = " ".join([*near[:30], "changed", *near[31:]])
    pairs = [(None, a), (None, b), (None, c), (5, a), (9, b), (7, d), (7, near), (7, e), (8, e), (None, c)]
    docs = frame(spark, [(k, t, "en", "s", 1, "", "", 0) for k, t in pairs])
    got = [(r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(None, None, True)] * 4 + [(5, None, False), (9, None, False), (7, 7, True), (7, 7, False), (7, 7, True), (8, 7, False)]))
    left = [(r.doc_id, r.text) for r in one_of_each(docs).collect()]
    assert len(left) == 5 and {(None, a), (None, b), (None, c), (7, e)} < set(left) and len({(7, d), (7, near)} & set(left)) == 1
    kept = without_leaks(docs, spark.createDataFrame([(1, a), (2, e)], "item_id long, text string")).collect()
    assert sorted(r.text for r in kept) == sorted([b, c, b, d, near, c])


def test_texts_whose_short_checksums_collide(spark):
    """Two null-id texts with equal lower 17 bits of their CRC: one repeats a passage, the other is clean."""
    short = lambda t: zlib.crc32(t.encode()) & 0x1FFFF
    passage, long = prose(800, 60), prose(801, 160)
    repeats = {short(t): t for t in (f"{passage} {n} {passage}" for n in range(4000))}
    clean = next(t for t in (f"{long} {n}" for n in range(100_000)) if short(t) in repeats)
    dirty = repeats[short(clean)]
    docs = frame(spark, [(None, t, "en", "s", 1, "", "", 0) for t in (dirty, clean)])
    want = {removed([(1, t)])[1] for t in (dirty, clean)}
    assert {tuple(r)[1:] for r in repeated_spans(docs).collect()} == want and len(want) == 2
    out = {r.text for r in remove_repeated(docs).collect()}
    assert clean in out and len(out) == 2 and min(map(len, out)) < len(dirty) - 100


def test_leaks_of_short_items_and_unspaced_scripts(spark):
    chinese = "植物通过光合作用将二氧化碳和水转化为葡萄糖"
    items = {k: prose(900 + k, n).replace(".", "") for k, n in ((4, 4), (8, 8), (10, 10), (3, 3))} | {20: chinese, 21: "Überall – “größer”… straße; über naïve Öfen früh"}
    edit = lambda k, *at: " ".join("changed" if n in at else w for n, w in enumerate(items[k].split()))
    texts = {1: edit(4, 1), 2: edit(8, 4), 3: edit(10, 2, 5, 8), 4: edit(3, 2), 5: "今天我们学习：" + chinese + "，这是老师说的话", 6: "x Überall größer straße über naïve Öfen früh y", 7: "今天天气很好，我们去公园散步吧", 8: edit(8, 1, 3, 5), 9: " ".join(items[8].split()[:6])}
    texts = {k: f"{prose(950 + k, 20)} {t} {prose(970 + k, 20)}" for k, t in texts.items()}
    docs = frame(spark, [(k, t, "en", "s", 1, "", "", 0) for k, t in texts.items()])
    bench = spark.createDataFrame([*items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in leaks(docs, bench).collect()}
    assert set(got) == {(1, 4), (2, 8), (3, 10), (5, 20), (6, 21), (9, 8)}
    assert got[5, 20].score == got[6, 21].score == 1 and got[2, 8].matched_words == 7
    assert texts[5].encode()[got[5, 20].begin_byte : got[5, 20].end_byte].decode() == chinese
