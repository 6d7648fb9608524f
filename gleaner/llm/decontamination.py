"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A seed is a pair of words of a test item, next to each other or with one word between, that also meet
within one word of each other in a document. Each word replaced, left out or added breaks few pairs: an
alignment that counts as a copy of an item of n words has at least half of n, less one, of them. The
corpus is read once to count how often each pair of an item occurs in it, and half of the pairs that a
copy can spare are given up, the most frequent ones; the others are the item's rare seeds. Where a
document has, within twice the item's length, as many of them as a copy must have, the passage around is
aligned with the whole item word by word. So the search finds every copy that an alignment of all items
with all whole documents would find.

The benchmark is held in blocks of bounded size, and every block meets all documents. The documents
are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import key, mix, numbered_columns, over_texts, place_of, stage, utf8
from gleaner.llm.shingles import loose_words

MATCH, MISMATCH, GAP = 2, -1, -1
#: Least score, as a share of that of a whole copy, and least number of equal words.
LEAST_SCORE, LEAST_WORDS = 0.5, 8
#: Items of fewer words than SHORT need this share of equal words instead, those of fewer than TINY a higher
#: score, and those of at most WHOLE words count whole only: part of these says nothing.
SHORT, SHORT_SHARE, TINY, TINY_SCORE, WHOLE = 14, 0.6, 10, 0.62, 3
#: Items of at most this many bytes meet the documents at once.
BLOCK_BYTES = 16 << 20
#: Scores are counted in steps of _FINE, so that of equal scores the alignment with more equal words is better.
_FINE = 1 << 20

_LEAK = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("matched_words", T.LongType()), T.StructField("begin_byte", T.LongType()), T.StructField("end_byte", T.LongType())])
_TIED = T.StructType([*_LEAK.fields, T.StructField("tie", T.LongType())])


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int, int]:
    """Best local alignment with linear gaps: score, equal words, and first and last passage word (end
    exclusive). Of equal scores the one with most equal words counts, of these the first."""
    m = len(passage)
    gap = GAP * _FINE
    steps = np.arange(m + 1, dtype=np.int64) * -gap
    row, began = np.zeros(m + 1, np.int64), np.arange(m + 1)
    best, at, since = 0, 0, 0
    for word in item:
        here = np.zeros(m + 1, np.int64)
        diagonal = row[:-1] + np.where(passage == word, MATCH * _FINE + 1, MISMATCH * _FINE)
        up = row[1:] + gap
        here[1:] = np.maximum(np.maximum(diagonal, up), 0)
        start = np.arange(m + 1)
        start[1:] = np.where(here[1:] == 0, start[1:], np.where(diagonal >= up, began[:-1], began[1:]))
        raised = np.maximum.accumulate(here + steps)
        origin = np.maximum.accumulate(np.where(here + steps == raised, np.arange(m + 1), 0))
        row, began = raised - steps, start[origin]
        k = int(row.argmax())
        if row[k] > best:
            best, at, since = int(row[k]), k, int(began[k])
    score = round(best / _FINE)
    return score, best - score * _FINE, since, at


def _least_score(length: int) -> float:
    """The share of a whole copy's score that an item of some length needs."""
    return 1.0 if length <= WHOLE else TINY_SCORE if length < TINY else LEAST_SCORE


def counts_as_copy(score: int, same: int, length: int) -> bool:
    """Whether an alignment with an item of some length is a copy of it."""
    least = min(length, LEAST_WORDS) if length >= SHORT or length <= WHOLE else min(LEAST_WORDS, math.ceil(SHORT_SHARE * length))
    return score >= MATCH * length * _least_score(length) and same >= least


def hits_of_copy(length: int) -> int:
    """How many pairs every copy of an item of some length has at least; an item of one word is its own seed.

    With m equal words and e errors the score is 2 m - e, at least 2 s n. Two equal words that follow
    each other in the alignment make a hit unless two errors or more lie between, which happens at most
    e / 2 times; so there are at least m - 1 - e / 2 >= s n - 1 hits."""
    return 1 if length <= 2 else length - 1 if length <= WHOLE else max(1, math.ceil(_least_score(length) * length - 1 - 1e-9))


def _item_words(text: str | None) -> np.ndarray:
    data = (text or "").encode()
    return loose_words(np.frombuffer(data + bytes(512), np.uint8), np.array([0, len(data)]))[0]


def _pairs(words: np.ndarray) -> list[np.ndarray]:
    """Hashes of all words with the next one, and with the one after that."""
    return [mix(words[:-k], words[k:]) if len(words) > k else np.zeros(0, np.uint64) for k in (1, 2)]


def _own_pairs(item: np.ndarray) -> np.ndarray:
    """The different seeds of an item, sorted."""
    return np.unique(np.concatenate(_pairs(item))) if len(item) > 1 else mix(item, item)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Items with at least one word, some MB at a time, in the order of their ids."""
    block, size = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        found = _item_words(text)
        if len(found):
            block.append((item, found))
            size += len(text)
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _hits(hashes: np.ndarray, first: np.ndarray, keys: np.ndarray, single: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where the pairs of some texts (and words, if an item has only one) are among sorted keys: first word and number of the key."""
    places, numbers = [], []
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for k, pairs in enumerate([*_pairs(hashes), *([mix(hashes, hashes)] if single else [])], 1):
        at = np.searchsorted(keys, pairs)
        at[at == len(keys)] = 0
        hit = np.flatnonzero(keys[at] == pairs)
        if k < 3:
            hit = hit[text[hit] == text[hit + k]]
        places.append(hit)
        numbers.append(at[hit])
    return np.concatenate(places), np.concatenate(numbers)


def _frequencies(source: DataFrame, keys: np.ndarray, single: bool) -> np.ndarray:
    """How often each of some sorted pairs occurs in the documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(keys), np.int64)
        for batch in batches:
            hashes, _, _, first = loose_words(*utf8(batch.column(1)))
            found += np.bincount(_hits(hashes, first, keys, single)[1], minlength=len(keys))
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], names=["pair", "n"])

    table = source.mapInArrow(over_texts(count, 1), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(keys), np.int64)
    out[table["pair"].to_numpy()] = table["n"].to_numpy()
    return out


class _Seeds:
    """The rare seeds of a block of items: sorted keys, the items of each, and how many hits an item needs."""

    def __init__(self, items: list[np.ndarray], source: DataFrame):
        own = [_own_pairs(i) for i in items]
        every = np.unique(np.concatenate(own))
        self.single = any(len(i) == 1 for i in items)
        often = _frequencies(source, every, self.single)
        self.lengths = np.array([len(i) for i in items])
        self.need = np.array([hits_of_copy(len(i)) for i in items])
        kept = []
        for k, pairs in enumerate(own):
            spared = int(self.need[k] // 2)  # a spared pair may be hit more than once, so its hits go from the need as often
            repeated = np.sort(np.bincount(np.searchsorted(pairs, np.concatenate(_pairs(items[k]))), minlength=len(pairs)))[::-1] if len(items[k]) > 1 else np.ones(1)
            while spared and repeated[:spared].sum() * 2 > self.need[k]:
                spared -= 1
            n = often[np.searchsorted(every, pairs)]
            kept.append(np.sort(pairs[np.lexsort((pairs, n))][: len(pairs) - spared]))
            self.need[k] -= int(repeated[:spared].sum())
        self.need = np.maximum(self.need, 1)
        rows = np.concatenate(kept)
        order = np.argsort(rows, kind="stable")
        self.owner = np.repeat(np.arange(len(items)), [len(x) for x in kept])[order]
        self.keys, self.first = np.unique(rows[order], return_index=True)
        self.last = np.r_[self.first[1:], len(rows)]

    def passages(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Text, item, first and last word (end exclusive) of the passages to be aligned, in order."""
        place, number = _hits(hashes, first, self.keys, self.single)
        n = self.last[number] - self.first[number]
        item = self.owner[np.repeat(self.first[number] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())] if len(number) else number
        place = np.repeat(place, n)
        text = np.searchsorted(first, place, "right") - 1
        order = np.lexsort((place, item, text))
        place, item, text = place[order], item[order], text[order]
        last = np.arange(len(place)) + self.need[item] - 1
        ok = last < len(place)
        last = np.minimum(last, len(place) - 1)
        span = 2 * self.lengths[item]
        ok = np.flatnonzero(ok & (text[last] == text) & (item[last] == item) & (place[last] - place < span))
        spans = zip(text[ok].tolist(), item[ok].tolist(), np.maximum(place[last[ok]] + 2 - span[ok], first[text[ok]]).tolist(), np.minimum(place[ok] + span[ok], first[text[ok] + 1]).tolist())
        now = next(spans, None)
        for t, i, a, b in spans:
            if (t, i) == now[:2] and a <= now[3]:
                now = t, i, min(a, now[2]), max(b, now[3])
            else:
                yield now
                now = t, i, a, b
        if now:
            yield now


def _leaks(docs: DataFrame, benchmark: DataFrame, doc_column: str) -> DataFrame:
    """The rows of leaks, each with the hash of its document's text."""
    source = docs.select(F.col(doc_column).cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    results = []
    for block in _blocks(benchmark):
        seeds = _Seeds([w for _, w in block], source)

        def find(batches: Iterator[pa.RecordBatch], block=block, seeds=seeds) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, ends = utf8(batch.column(1))
                hashes, begin, end, first = loose_words(data, ends)
                best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
                for text, number, x, y in seeds.passages(hashes, first):
                    score, same, since, upto = align(block[number][1], hashes[x:y])
                    if (score, same) > best.get((text, number), (0, 0))[:2]:
                        best[text, number] = score, same, x + since, x + upto
                rows = []
                for (text, number), (score, same, since, upto) in best.items():
                    item, length = block[number][0], len(block[number][1])
                    if counts_as_copy(score, same, length):
                        rows.append((batch.column(0)[text].as_py(), item, score / (MATCH * length), same, int(begin[since] - ends[text]), int(end[upto - 1] - ends[text]), batch.column(2)[text].as_py()))
                cols = list(zip(*rows)) if rows else [()] * 7
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=_TIED.names)

        results.append(source.mapInArrow(over_texts(find, 1), _TIED))
    if not results:
        return docs.sparkSession.createDataFrame([], _TIED)
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, doc_column: str = "doc_id") -> DataFrame:
    """Copies of test items in docs (doc_id, text, ...); benchmark has item_id and text.

    Result, one row for each document and item that it holds: doc_id, item_id, score (of the best
    alignment, 1 for a whole copy), matched_words (equal words of that alignment), begin_byte and end_byte of
    the aligned passage in the UTF-8 text. Words are runs of letters and digits, A to Z as a to z; in scripts
    without spaces each character is a word. Documents and items without
    a word, and items without an id, give no row. A null doc_id is kept as null. A repeated row of docs
    gives repeated results, a repeated item counts once. Empty in, empty out.
    """
    return _leaks(docs, benchmark, doc_column).drop("tie")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a test item; different texts with one doc_id, null or not, are judged each on its own."""
    found = stage(_leaks(docs, benchmark, "doc_id").select(key(F.col("doc_id")).alias("leak"), F.col("tie").alias("with")).distinct())
    rows = numbered_columns(docs, list(range(len(docs.columns))))
    same = (key(F.col(place_of(docs, "doc_id"))) == F.col("leak")) & (F.xxhash64(place_of(docs, "text")) == F.col("with"))
    return rows.join(found, same, "left_anti").toDF(*docs.columns)
