"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages and only the bag has a label. A passage is a line, or 40 words of a
longer one. It is encoded from its letters, marks and words by one hidden layer; gated attention,
softmax(w * (tanh(V h) * sigmoid(U h))), weighs the passages of a document, and a logistic output
scores the weighted sum. Encoder, attention and output learn together from document labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import key, over_texts, stage, utf8, wider
from gleaner.llm.shingles import words

#: The model learns from at most so many labelled documents, those whose ids hash lowest, and of these from as
#: many as have so many bytes of text together.
TRAIN_ROWS, TRAIN_BYTES = 4000, 64 << 20
PASSAGE_WORDS, HIDDEN, GATE, EPOCHS, BATCH, SEED = 40, 24, 12, 12, 64, 5
THRESHOLD = 0.3
_BUCKETS = 32

#: Kinds of bytes: 0 control, 1 space, 2 small, 3 capital, 4 digit, 5 stop, 6 bar and bracket, 7 exclamation, 8 other sign, 9 beyond ASCII.
_KINDS = 10
_KIND = np.zeros(256, np.int64)
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 9 if _b > 127 else 1 if _c in " \t\n" else 2 if _c.islower() else 3 if _c.isupper() else 4 if _c.isdigit() else 5 if _c in ".,;:'\"?-" else 6 if _c in "|<>[]{}()/\\" else 7 if _c == "!" else 8 if _b > 32 else 0
DIMS = _KINDS + 7 + _BUCKETS


def held_out() -> Column:
    """Rows that never teach: crc32 of doc_id as text divides by 5. A null doc_id is none of them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def passages(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage of a batch, and the first passage of each text (one more at
    the end). A text without words is one passage of zeros."""
    hashes, begin, end, first = words(data, ends)
    if not len(hashes):
        return np.zeros((len(ends) - 1, DIMS), np.float32), np.arange(len(ends))
    size = int(ends[-1])
    lines = np.cumsum(data[:size] == 10)
    new = np.zeros(len(hashes), bool)
    new[0] = True
    new[1:] = lines[begin[1:]] != lines[begin[:-1]]
    new[first[:-1][first[:-1] < first[1:]]] = True
    at = np.arange(len(hashes))
    new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % PASSAGE_WORDS == 0
    starts = np.flatnonzero(new)
    number, n = np.cumsum(new) - 1, len(starts)
    counts = np.diff(np.r_[starts, len(hashes)])
    x = np.zeros((n, DIMS))
    low, high = begin[starts], end[np.r_[starts[1:], len(hashes)] - 1]
    cover = np.zeros(size + 1, np.int32)
    cover[low] += 1
    of_byte = np.cumsum(cover[:-1]) - 1
    of_byte[: low[0]] = 0
    kinds = np.bincount(of_byte * _KINDS + _KIND[data[:size]], minlength=n * _KINDS).reshape(n, _KINDS)
    x[:, :_KINDS] = kinds / (high - low + 1)[:, None]
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & ~new[1:]
    skip = np.zeros(len(hashes))
    skip[2:] = (hashes[2:] == hashes[:-2]) & (number[2:] == number[:-2])
    long = end - begin
    marks = _KIND[data[end - 1]]
    sums = [np.add.reduceat(v, starts) for v in (same, skip, long, (long > 12).astype(float), (marks >= 6) & (marks <= 8))]
    x[:, _KINDS : _KINDS + 7] = np.stack([sums[0] / counts, sums[1] / counts, np.minimum(sums[2] / counts, 30) / 10, sums[3] / counts, sums[4] / counts, np.log1p(counts) / 4, np.ones(n)], axis=1)
    x[:, _KINDS + 7 :] = np.bincount(number * _BUCKETS + (hashes % np.uint64(_BUCKETS)).astype(np.int64), minlength=n * _BUCKETS).reshape(n, _BUCKETS) / counts[:, None]
    # texts without words get their passage of zeros
    own = np.searchsorted(starts, first)
    empty = np.flatnonzero(first[:-1] == first[1:])
    if len(empty):
        x = np.insert(x, own[empty], 0, axis=0)
        own = own + np.searchsorted(empty, np.arange(len(own)), "left")
    return x.astype(np.float32), own


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class GatedAttention:
    """The network; bags are rows x with the first row of each bag in own."""

    def __init__(self, seed: int):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(DIMS), np.ones(DIMS)
        shapes = {"e": (DIMS, HIDDEN), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "w": (GATE,), "o": (HIDDEN,)}
        self.w = {k: r.normal(size=s) / s[0] ** 0.5 for k, s in shapes.items()} | {"f": np.zeros(HIDDEN), "p": np.zeros(1)}

    def forward(self, x, own):
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ self.w["e"] + self.w["f"])
        t, s = np.tanh(h @ self.w["v"]), _sigmoid(h @ self.w["u"])
        a = (t * s) @ self.w["w"]
        bag = np.repeat(np.arange(len(own) - 1), np.diff(own))
        a = np.exp(a - np.maximum.reduceat(a, own[:-1])[bag])
        a /= np.add.reduceat(a, own[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, own[:-1], axis=0)
        return x, h, t, s, a, z, bag, _sigmoid(z @ self.w["o"] + self.w["p"])

    def scores(self, x, own) -> np.ndarray:
        return self.forward(x, own)[-1]

    def gradients(self, x, own, y) -> dict[str, np.ndarray]:
        x, h, t, s, a, z, bag, out = self.forward(x, own)
        error = (out - y) / len(y)
        dz = error[:, None] * self.w["o"]
        da = (h * dz[bag]).sum(1)
        da = a * (da - np.add.reduceat(a * da, own[:-1])[bag])
        g = da[:, None] * self.w["w"]
        dt, ds = g * s * (1 - t**2), g * t * s * (1 - s)
        dh = (a[:, None] * dz[bag] + dt @ self.w["v"].T + ds @ self.w["u"].T) * (1 - h**2)
        return {"e": x.T @ dh, "f": dh.sum(0), "v": h.T @ dt, "u": h.T @ ds, "w": (t * s).T @ da, "o": z.T @ error, "p": np.array([error.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray) -> "GatedAttention":
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 1e-3
        r, step = np.random.default_rng(SEED), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        for epoch in range(EPOCHS):
            order = r.permutation(len(bags))
            for b in range(0, len(order), BATCH):
                chosen = order[b : b + BATCH]
                own = np.cumsum([0, *(len(bags[k]) for k in chosen)])
                step += 1
                for k, g in self.gradients(np.concatenate([bags[i] for i in chosen]), own, y[chosen]).items():
                    g = g + 1e-4 * self.w[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g**2
                    self.w[k] = self.w[k] - 0.02 * (1 - epoch / EPOCHS) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return self


def learn(docs: DataFrame, labels: DataFrame) -> GatedAttention:
    """The network, learnt from labels (doc_id, quality) of documents that are not held out. Of several
    labels of one document the highest counts, null ones do not. A text that rows repeat teaches once. Without
    any label it scores all alike."""
    marked = labels.where("quality is not null and doc_id is not null").where(~held_out())
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.max(F.col("quality").cast("int")).alias("y"))
    chosen = stage(marked.orderBy(F.xxhash64("doc"), "doc").limit(TRAIN_ROWS))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own = passages(*utf8(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[a:b].tobytes() for a, b in zip(own[:-1], own[1:])], pa.binary())], names=["doc", "y", "x"])

    texts = docs.select(key(F.col("doc_id")).alias("doc"), "text", F.xxhash64("text").alias("tie")).join(F.broadcast(chosen), "doc")
    order = Window.orderBy(F.xxhash64("doc"), "doc", "tie")
    each = texts.groupBy("doc", "tie").agg(F.max("y").alias("y"), F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size"))
    each = each.orderBy(F.xxhash64("doc"), "doc", "tie").limit(TRAIN_ROWS).withColumn("upto", F.sum("size").over(order)).where(F.col("upto") <= TRAIN_BYTES)
    taught = texts.join(F.broadcast(stage(each.select("doc", "tie"), clear=False)), ["doc", "tie"]).select("doc", "y", "text")
    rows = sorted({(r["doc"], bytes(r["x"]), r["y"]) for r in taught.dropDuplicates().mapInArrow(over_texts(features, 2), "doc long, y int, x binary").collect()})
    net = GatedAttention(SEED)
    if rows:
        net.fit([np.frombuffer(x, np.float32).reshape(-1, DIMS) for _, x, _ in rows], np.array([y for *_, y in rows], float))
    return net


def score(docs: DataFrame, net: GatedAttention, name: str = "score") -> DataFrame:
    """docs with a column (replaced where there is one of that name), 0 to 1: the likelihood of a good document. Every text, empty and null
    ones too, has a score; all columns but text only pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = net.scores(*passages(*utf8(batch.column("text")))) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, name])

    kept = docs.select(*[c for c in docs.columns if c.lower() != name])
    return kept.mapInArrow(over_texts(run, kept.columns.index("text")), wider(kept, **{name: "double"}))
