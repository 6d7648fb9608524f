"""Near duplicates by min-max hashing.

Each permutation of the shingles gives two values of a signature, the least and the greatest hash, so
half as many hashes are evaluated as with the minimum alone. The two are negatively related, which
lowers the variance of the estimate and leaves it unbiased. The signature is cut into bands; the
minimum and the maximum of one permutation fall into different bands.

A pair with a similarity of 0.75 agrees in a band of 5 values with a chance of 0.237, and in none of
the 48 bands with one of 2e-6.

Texts with equal shingle sets form a class first; classes, not documents, are the nodes of the graph, so
ids play no part in it. One text stands for a class from there on. In a bucket every class is compared
with one pivot, whole set against whole set, never all with all. Where a bucket then holds several
components, classes go that can't be linked across: those with less than 75 in 100 of their shingles in
other components. Of the rest, those outside their bucket's largest component are queries. Buckets that
share classes form a neighbourhood, and the queries of a neighbourhood meet its classes in blocks of
bounded size, by an index of the queries' shingles; only links come out of that. So no link is lost, no
bucket is capped, and the work is the same at every size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import NULL_ID, SIMILAR_PERCENT, components, freed, is_empty, key, mix, numbered_columns, over_texts, place_of, sliced, stage, utf8
from gleaner.llm.shingles import shingle_sets

PERMUTATIONS, ROWS, BANDS = 120, 5, 48
#: Shingles of queries, and of the classes that they meet, in one block.
BLOCK = 500_000
_CHUNK, _AT_ONCE = 4096, 24


def _constants(salt: int) -> np.ndarray:
    return (mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64), np.full(PERMUTATIONS, salt, np.uint64)) >> np.uint64(32)).astype(np.uint32)


_A, _X = _constants(7)[:, None] | np.uint32(1), _constants(11)[:, None]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima under all permutations, then maxima. A permutation multiplies the upper half of a shingle's hash."""
    least, most = np.full(PERMUTATIONS, 2**32 - 1, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    for s in range(0, len(shingles), _CHUNK):
        part = (shingles[s : s + _CHUNK] >> np.uint64(32)).astype(np.uint32)
        for k in range(0, PERMUTATIONS, _AT_ONCE):
            few = slice(k, k + _AT_ONCE)
            h = part ^ _X[few]
            h *= _A[few]
            np.minimum(least[few], h.min(axis=1), out=least[few])
            np.maximum(most[few], h.max(axis=1), out=most[few])
    return np.concatenate([least, most])


def bands(values: np.ndarray) -> np.ndarray:
    """A key for each band of each signature; band k holds the values k, k + BANDS, k + 2 * BANDS and so on."""
    rows = values.astype(np.uint64).reshape(-1, ROWS, BANDS)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(rows), BANDS))
    for k in range(ROWS):
        out = mix(out, rows[:, k])
    return out


_SIGNED = "doc long, tie long, doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = shingle_sets(*utf8(batch.column(1)))
        sizes = np.array([len(s) for s in sets], np.int64)
        some = [s for s in sets if len(s)]
        digests, keys = np.zeros((2, len(sets)), np.uint64), np.zeros((0, BANDS), np.uint64)
        if some:
            every, starts = np.concatenate(some), np.cumsum([0, *(len(s) for s in some[:-1])])
            for k in (0, 1):
                digests[k, sizes > 0] = np.add.reduceat(mix(every, np.full(len(every), 3 + 2 * k, np.uint64)), starts)
            keys = bands(np.stack([signature(s) for s in some]))
        offsets = np.r_[0, np.cumsum((sizes > 0) * BANDS)].astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), batch.column(3), pa.array(sizes), pa.array(digests[0].view(np.int64)), pa.array(digests[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))],
            names=["doc", "tie", "doc_id", "n_shingles", "d1", "d2", "bands"],
        )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        data, ends = utf8(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([pack.compress(data[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])], pa.binary())], names=["of", "tie", "packed"])


def similar(x: np.ndarray, y: np.ndarray, percent: int = SIMILAR_PERCENT) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum()) if len(y) else 0
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    last, pivot_set = None, np.zeros(0, np.uint64)

    def sets(packed: list[bytes]) -> list[np.ndarray]:
        texts = [unpack.decompress(x) for x in packed]
        return shingle_sets(np.frombuffer(b"".join(texts) + bytes(512), np.uint8), np.cumsum([0, *map(len, texts)]))

    for batch in sliced(batches):
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        mine, keep = sets(batch.column("packed_a").to_pylist()), []
        for k, packed in enumerate(batch.column("packed_b")):
            if b[k] != last:  # rows come sorted by pivot, so a set is made once
                last, pivot_set = b[k], sets([packed.as_py()])[0]
            if similar(mine[k], pivot_set):
                keep.append(k)
        yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64())], names=["a", "b"])


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    of_a, of_b = texts.withColumnsRenamed({"doc": "a", "packed": "packed_a"}), texts.withColumnsRenamed({"doc": "b", "packed": "packed_b"})
    rows = pairs.distinct().join(of_a, "a").join(of_b, "b").select("a", "b", "packed_a", "packed_b").sortWithinPartitions("b")
    return stage(rows.mapInArrow(_confirmed, "a long, b long"))


def _open(rest: DataFrame) -> DataFrame:
    """The rows (bucket, doc, n, component) of buckets with several components, with the largest one as main."""
    parts = rest.groupBy("bucket", "component").agg(F.count("*").alias("k"))
    several = parts.groupBy("bucket").agg(F.count("*").alias("c"), F.max(F.struct("k", "component"))["component"].alias("main"))
    return stage(rest.join(several.where("c > 1").select("bucket", "main"), "bucket"))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in sliced(batches, "packed"):
        texts = [unpack.decompress(x) for x in batch.column("packed").to_pylist()]
        sets = shingle_sets(np.frombuffer(b"".join(texts) + bytes(512), np.uint8), np.cumsum([0, *map(len, texts)]))
        offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("component"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))], names=["doc", "component", "shingles"])


def _able(sets: DataFrame) -> DataFrame:
    """The documents of sets that can be linked to another component: at least 75 in 100 of their shingles
    occur in a document of another component. For all others no such link can exist."""
    common = sets.select("component", F.explode("shingles").alias("s")).groupBy("s").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("s")
    hits = sets.select("doc", F.size("shingles").alias("n"), F.explode("shingles").alias("s")).join(stage(common), "s", "left_semi")
    return stage(hits.groupBy("doc").agg(F.count("*").alias("k"), F.first("n").alias("n")).where(f"100 * k >= {SIMILAR_PERCENT} * n").select("doc"))


class _Index:
    """Which queries hold a shingle, for a block of queries."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray]]):
        self.docs, self.components = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
        self.sizes = np.array([len(r[2]) for r in rows], np.int64)
        every, owner = np.concatenate([r[2] for r in rows]), np.repeat(np.arange(len(rows), dtype=np.int32), self.sizes)
        order = np.argsort(every, kind="stable")
        self.owner = owner[order]
        self.keys, self.first = np.unique(every[order], return_index=True)
        self.last = np.r_[self.first[1:], len(every)]

    def links(self, doc: int, component: int, shingles: np.ndarray) -> np.ndarray:
        """The queries of other components that are similar enough to a set.

        A partner lacks at most a quarter of the set, so it holds one of any quarter and one more of its
        shingles: those that the fewest queries hold say whether there can be one."""
        at = np.searchsorted(self.keys, shingles)
        at[at == len(self.keys)] = 0
        at = at[self.keys[at] == shingles]
        n = self.last[at] - self.first[at]
        spare = len(shingles) - -(-SIMILAR_PERCENT * len(shingles) // 100) - (len(shingles) - len(at))
        none = np.zeros(0, np.int64)
        if spare < 0 or not len(at):
            return none
        few = np.argpartition(n, min(spare, len(n) - 1))[: spare + 1]
        if not self._suits(self._owners(at[few], n[few]), doc, component, len(shingles)).any():
            return none
        both = np.bincount(self._owners(at, n), minlength=len(self.docs))
        good = (both > 0) & ((100 + SIMILAR_PERCENT) * both >= SIMILAR_PERCENT * (self.sizes + len(shingles)))
        return np.flatnonzero(good & (self.components != component) & (self.docs != doc))

    def _owners(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The queries that hold some shingles, once for each."""
        return self.owner[np.repeat(self.first[at] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]

    def _suits(self, q: np.ndarray, doc: int, component: int, size: int) -> np.ndarray:
        """Whether queries may be partners of a set, by component and size."""
        sizes = self.sizes[q]
        return (self.components[q] != component) & (self.docs[q] != doc) & (100 * np.minimum(sizes, size) >= SIMILAR_PERCENT * np.maximum(sizes, size))


def _met(key: tuple, queries: pa.Table, sets: pa.Table) -> pa.Table:
    """Links of a block of queries to a block of sets, one for a query and a component."""
    found: dict[tuple[int, int], tuple[int, int]] = {}
    if len(queries) and len(sets):
        index = _Index([(d, c, np.asarray(x.values)) for d, c, x in zip(queries["doc"].to_pylist(), queries["component"].to_pylist(), queries["shingles"])])
        for doc, component, shingles in zip(sets["doc"].to_pylist(), sets["component"].to_pylist(), sets["shingles"]):
            for q in index.links(doc, component, np.asarray(shingles.values)):
                found.setdefault((int(q), component), (int(index.docs[q]), doc))
    a, b = zip(*found.values()) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _neighbourhoods(rest: DataFrame) -> DataFrame:
    """(doc, around) for the classes of rest (bucket, doc, ...): the same around for all that buckets connect."""
    least = rest.groupBy("bucket").agg(F.min("doc").alias("b"))
    found = components(rest.join(least, "bucket").select(F.col("doc").alias("a"), "b"))
    return found.select(F.col("id").alias("doc"), F.col("component").alias("around"))


def _found(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of queries to sets of other components, one for a query, a component and a block.

    rest has bucket, doc, component and main. Queries and sets of a neighbourhood are dealt to blocks of
    about BLOCK shingles by a hash, and each block of queries meets each block of sets; small neighbourhoods
    share a block. Every block is a task's work and nothing passes through the driver."""
    asks = rest.groupBy("doc").agg(F.max((F.col("component") != F.col("main")).cast("int")).alias("asks"))
    near = sets.join(_neighbourhoods(rest), "doc").join(asks, "doc").withColumn("size", F.size("shingles").cast("long"))
    near = stage(near)
    sums = near.groupBy("around").agg(F.sum(F.col("asks") * F.col("size")).alias("q"), F.sum("size").alias("s")).where("q > 0")
    parts = lambda c: F.ceil(F.col(c) / F.lit(BLOCK)).cast("long")
    sums = sums.select("around", parts("q").alias("nq"), parts("s").alias("ns"), "s")
    small = sums.where("ns = 1").agg(F.sum("s")).head()[0] or 0
    shared = F.pmod(F.xxhash64("around"), F.lit(-(-small // BLOCK) or 1))
    plan = stage(sums.select("around", "nq", "ns", F.when(F.col("ns") == 1, shared).otherwise(F.col("around")).alias("block"), (F.col("ns") == 1).alias("small")), clear=False)
    near = near.join(plan, "around")
    dealt = lambda n: F.pmod(F.xxhash64("doc"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    queries = near.where("asks = 1").select("small", "block", dealt("nq").alias("k"), every("ns").alias("j"), "doc", "component", "shingles")
    others = near.select("small", "block", every("nq").alias("k"), dealt("ns").alias("j"), "doc", "component", "shingles")
    others = others.toDF(*others.columns)  # columns of its own, not those of queries
    by = ["small", "block", "k", "j"]
    return stage(queries.groupBy(*by).cogroup(others.groupBy(*by)).applyInArrow(_met, "a long, b long"))


def _marked(docs: DataFrame) -> DataFrame:
    """Rows (doc, tie, doc_id, n_shingles, first, kept) of docs: key and text hash of a row and of the first
    document of its component, by doc_id and then by hash."""
    source = docs.select(key(F.col("doc_id")).alias("doc"), "text", F.xxhash64("text").alias("tie"), F.col("doc_id").cast("long").alias("doc_id"))
    signed = stage(source.mapInArrow(over_texts(_signatures, 1), _SIGNED))
    some = signed.where("n_shingles > 0")
    classes = some.groupBy("d1", "d2").agg(F.min(F.struct("doc", "tie")).alias("first"), F.first("n_shingles").alias("n"))
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()))
    chosen = some.join(classes.select("d1", "d2", F.col("first.doc").alias("doc"), F.col("first.tie").alias("tie"), "n", "node"), ["d1", "d2", "doc", "tie"])
    members = chosen.select(F.explode("bands").alias("bucket"), F.col("node").alias("doc"), "n").distinct()
    shared = stage(members.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket"))
    members = stage(members.join(shared, "bucket", "left_semi"))
    ids = members.select(F.col("doc").alias("node")).distinct()
    ids = stage(classes.join(ids, "node", "left_semi").select(F.col("first.doc").alias("of"), F.col("first.tie").alias("tie"), F.col("node").alias("doc")))
    texts = source.select("doc", "text", "tie").mapInArrow(over_texts(_packed, 1), "of long, tie long, packed binary")
    texts = stage(texts.join(ids.hint("merge"), ["of", "tie"]).select("doc", "packed").dropDuplicates(["doc"]))
    fits = f"100 * least(n, pn) >= {SIMILAR_PERCENT} * greatest(n, pn)"
    pivots = stage(members.groupBy("bucket").agg(F.min(F.struct("doc", "n")).alias("p")).select("bucket", F.col("p.doc").alias("pivot"), F.col("p.n").alias("pn")))
    rest = members.join(pivots, "bucket").where("doc <> pivot")
    links = _links(rest.where(fits).select(F.col("doc").alias("a"), F.col("pivot").alias("b")), texts)
    joined = components(links)
    rest = rest.select("bucket", "doc").join(joined.withColumnRenamed("id", "doc"), "doc", "left").select("bucket", "doc", F.coalesce("component", "doc").alias("component"))
    rest = _open(stage(rest))
    freed(shared, members, ids, pivots)
    if not is_empty(rest):
        ask = rest.select("doc", "component").distinct()
        sets = stage(texts.join(ask, "doc").select("doc", "component", "packed").mapInArrow(_sets, "doc long, component long, shingles array<long>"))
        rest = _open(stage(rest.drop("main").join(_able(sets), "doc", "left_semi")))
        if not is_empty(rest):
            joined = components(stage(joined.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")).union(_found(rest, sets))))
        freed(sets)
    freed(texts, links)
    tops = joined.join(classes.select(F.col("node").alias("id"), "first"), "id").groupBy("component").agg(F.min("first").alias("top"))
    tops = joined.join(tops, "component").select(F.col("id").alias("node"), "top")
    of_class = stage(classes.join(tops, "node", "left").select("d1", "d2", F.coalesce("top", "first").alias("first")))
    out = signed.select("doc", "tie", "doc_id", "n_shingles", "d1", "d2").join(of_class, ["d1", "d2"], "left")
    own = F.struct("doc", "tie")
    first = F.when(F.col("n_shingles") > 0, F.col("first")).otherwise(own)
    return out.select("doc", "tie", "doc_id", "n_shingles", first.alias("first"), (first == own).alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Near-duplicate components of docs (doc_id, text, ...).

    A text's set holds its distinct shingles of five words, the whole text where it has fewer words.
    Two documents are linked if their sets have a similarity of 0.75 or more. Result: doc_id,
    n_shingles, component_id (the smallest doc_id reachable, itself included), kept for every row. Null,
    empty and blank texts have an empty set and are linked with nothing. Rows with one doc_id and one text
    are one document, different texts with one doc_id are different documents, also where the doc_id is
    null; a null comes before all others. kept marks the first document of a component: that with doc_id =
    component_id, and of several the one with the smallest hash of its text. Further columns are ignored.
    Empty in, empty out.
    """
    component = F.when(F.col("first.doc") != NULL_ID, F.col("first.doc"))
    return _marked(docs).select("doc_id", "n_shingles", component.alias("component_id"), "kept")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that near_duplicates keeps, all columns as they were; of rows with one doc_id and one
    text one stays, that with the smallest hash of its simple columns."""
    marks = stage(_marked(docs).where("kept").select("doc", "tie"))
    names = [f"_in{k}" for k in range(len(docs.columns))]
    out = numbered_columns(docs, list(range(len(names))))
    out = out.withColumn("of", key(F.col(place_of(docs, "doc_id")))).withColumn("with", F.xxhash64(place_of(docs, "text")))
    out = out.join(marks.distinct(), (F.col("of") == F.col("doc")) & (F.col("with") == F.col("tie")), "left_semi")
    if not is_empty(marks.groupBy("doc", "tie").count().where("count > 1").limit(1)):
        simple = [n for n, field in zip(names, docs.schema.fields) if "map<" not in field.dataType.simpleString()]
        out = out.groupBy("of", "with").agg(F.min_by(F.struct(*names), F.xxhash64(*simple)).alias("row")).select("row.*")
    return out.select(*names).toDF(*docs.columns)
