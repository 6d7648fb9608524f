"""Language identification by sparse multinomial logistic regression.

Features are character n-grams (1 to 3 characters of the small text, everything but letters as one
space), hashed, weighed by tf-idf and brought to length 1. Weights are learnt by
follow-the-regularised-leader with both an absolute and a square penalty, which leaves most of them
zero. A temperature, fitted on rows that did not teach, makes the scores probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import key, over_texts, stage, wider

DIMS, LONGEST = 1 << 14, 3
#: The weights come from so many documents, those whose ids hash lowest, and from as many of each language, so that
#: none is left out; each fifth of these fits the temperature.
TRAIN_ROWS, OF_EACH = 2500, 50
EPOCHS, ALPHA, BETA, L1, L2, SEED = 3, 0.5, 1.0, 0.02, 0.01, 3
UNKNOWN = "und"
_FACTORS = np.array([2654435761, 40503 * 65537, 97 * 16777619], np.uint64)


def held_out() -> Column:
    """Rows that never teach: crc32 of doc_id as text leaves 2 when divided by 4. A null doc_id is none of them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        table = np.zeros(0x110000, bool)
        table[[c for c in range(0x110000) if chr(c).isalpha()]] = True
        _LETTER.append(table)
    return _LETTER[0]


def counts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of each whole text and how often it has them; none where it has no letter."""
    for text in texts:
        points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
        letter = _letters()[points]
        if not letter.any():
            yield np.zeros(0, np.int64), np.zeros(0)
            continue
        points = np.where(letter, points, 32)
        points = points[np.r_[True, letter[1:] | letter[:-1]]]
        points = np.r_[np.uint32(32), points, np.uint32(32)].astype(np.uint64)
        found, h = [], np.zeros(len(points), np.uint64)
        for n in range(1, LONGEST + 1):
            h = (h[: len(points) - n + 1] * _FACTORS[0] + points[n - 1 :] * _FACTORS[1]) & np.uint64(0xFFFFFFFF)
            found.append(((h * _FACTORS[2] + np.uint64(n)) >> np.uint64(7)).astype(np.int64) & (DIMS - 1))
        found = np.bincount(np.concatenate(found), minlength=DIMS)
        at = np.flatnonzero(found)
        yield at, found[at].astype(float)


class Ftrl:
    """Weights for each language and feature, learnt one document at a time."""

    def __init__(self, languages: list[str], idf: np.ndarray):
        self.languages, self.idf, self.temperature = languages, idf, 1.0
        self.z, self.n = np.zeros((DIMS + 1, len(languages))), np.zeros((DIMS + 1, len(languages)))
        self.weights = np.zeros_like(self.z)

    def vector(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (1 + np.log(n)) * self.idf[at]
        return np.r_[at, DIMS], np.r_[x / (np.sqrt((x**2).sum()) or 1), 0.1]

    def _lazy(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    @staticmethod
    def softmax(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> "Ftrl":
        r, ready = np.random.default_rng(SEED), [(*self.vector(a, n), y) for a, n, y in rows]
        teach, check = [v for k, v in enumerate(ready) if k % 5 or len(ready) < 10], [v for k, v in enumerate(ready) if k % 5 == 0]
        for _ in range(EPOCHS):
            for k in r.permutation(len(teach)):
                at, x, y = teach[k]
                w = self._lazy(at)
                error = self.softmax(x @ w)
                error[y] -= 1
                g = x[:, None] * error
                n = self.n[at]
                self.z[at] += g - (np.sqrt(n + g**2) - np.sqrt(n)) / ALPHA * w
                self.n[at] = n + g**2
        self.weights = self._lazy(np.arange(DIMS + 1))
        scores, right = np.array([x @ self.weights[at] for at, x, _ in check]), np.array([y for *_, y in check])
        loss = lambda t: -np.log(np.maximum(self.softmax(scores / t)[np.arange(len(right)), right], 1e-12)).mean()
        self.temperature = min((float(t) for t in np.geomspace(0.05, 10, 60)), key=loss)
        return self

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, chances = [], []
        for at, n in counts(texts):
            if not len(at) or not self.languages:
                names.append(UNKNOWN)
                chances.append(0.0)
                continue
            at, x = self.vector(at, n)
            p = self.softmax(x @ self.weights[at] / self.temperature)
            names.append(self.languages[int(p.argmax())])
            chances.append(float(p.max()))
        return names, chances


def learn(docs: DataFrame) -> Ftrl:
    """A model of the languages in docs (doc_id, text, lang). Document frequencies come from all rows that
    are not held out and have a text and a lang; weights from a bounded sample of them that has rows of
    every language."""
    taught = docs.where("text is not null and lang is not null and doc_id is not null").where(~held_out()).select(key(F.col("doc_id")).alias("doc"), "text", "lang", F.xxhash64("text").alias("tie"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, found = 0, np.zeros(DIMS, np.int64)
        for batch in batches:
            for at, _ in counts(batch.column(0).to_pylist()):
                found[at] += 1
                total += 1
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some]), pa.array(np.r_[total, found[some]])], names=["feature", "n"])

    known = {r["feature"]: r["n"] for r in taught.select("text").mapInArrow(over_texts(frequencies, 0), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    total, df = known.pop(-1, 0), np.zeros(DIMS)
    for k, n in known.items():
        df[k] = n
    each = taught.where(F.col("text").rlike("\\p{L}")).select("doc", "tie", "lang").distinct()
    order = F.xxhash64("doc"), "doc", "tie"
    some = each.orderBy(*order, "lang").limit(TRAIN_ROWS)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    of_each = each.withColumn("k", place).where(F.col("k") <= OF_EACH).drop("k")
    chosen = stage(some.union(of_each.select(*some.columns)).distinct(), clear=False)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(counts(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([a.astype(np.int32).tobytes() for a, _ in found], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in found], pa.binary())], names=["doc", "lang", "at", "n"])

    rows = taught.join(F.broadcast(chosen), ["doc", "tie", "lang"]).select("doc", "text", "lang").distinct().mapInArrow(over_texts(features, 1), "doc long, lang string, at binary, n binary").collect()
    rows = sorted((r["doc"], r["lang"], bytes(r["at"]), bytes(r["n"])) for r in rows if len(r["at"]))
    languages = sorted({r[1] for r in rows})
    model = Ftrl(languages, np.log((1 + total) / (1 + df)) + 1)
    return model.fit([(np.frombuffer(a, np.int32).astype(np.int64), np.frombuffer(n, np.int32).astype(float), languages.index(lang)) for _, lang, a, n in rows]) if rows else model


def identify(docs: DataFrame, model: Ftrl) -> DataFrame:
    """docs with lang_pred and score (0 to 1). A text that is null or has no letter is 'und' with score 0.
    All columns but text only pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, chances = model.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(chances, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    kept = docs.select(*[c for c in docs.columns if c.lower() not in ("lang_pred", "score")])
    return kept.mapInArrow(over_texts(run, kept.columns.index("text")), wider(kept, lang_pred="string", score="double"))
