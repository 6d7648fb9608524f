"""Removal of repeated byte strings by bucket-pointer refinement of sampled suffixes.

A bucket holds the suffixes that begin with the same string; its identifier is a hash of that string,
so that buckets of all tasks agree without a global sort. Identifiers are refined by identifiers of
later offsets, and every refined identifier is used again by the next step: the bucket of the first 16
bytes at p comes from the buckets of 8 bytes at p and p + 8, that of 32 from those of 16 at p and
p + 16, then 64, and 100 bytes from 64 at p and p + 36.

Suffixes are sampled by content. Of the 69 strings of 32 bytes in a window of 100 bytes, the one with
the least identifier is the window's anchor; equal windows have equal anchors at equal places. So the
windows fall into runs with one anchor each, about one run for 33 bytes. Three levels narrow down:

  0  runs, in buckets of the anchor's 32 bytes;
  1  pieces of at most 8 windows, in buckets of the 93 bytes they have in common;
  2  single windows, in buckets of all their 100 bytes.

On each level a unit that is alone in its bucket is new text. Units whose whole strings are equal are
copies of the first of them. Only firsts of different strings in one bucket go to the next level. No
group is ever gathered: buckets are counted by partial sums and joined back with one row for a bucket,
a join that adaptive execution may split where one bucket holds many rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import freed, key, mix, numbered_columns, over_texts, place_of, stage, utf8

#: Length of a repeated string, and of the anchors in it.
WINDOW, GRAM = 100, 32
_GRAMS = WINDOW - GRAM + 1
_PIECE = 8
#: Positions that are hashed at once, so that the arrays stay in the processor's cache.
_BLOCK = 16384
_LOW = np.uint64((1 << 24) - 1)
#: A place is first window << 14 | windows << 7 | bytes before the anchor: it sorts by position.
_LO, _N = 14, 7

#: tie is a 64-bit hash of the text, which tells different texts with one doc_id apart.
_UNIT = "core long, whole long, doc long, tie long, place long"
_TEXT = "doc long, tie long, doc_id long, n_bytes long, packed binary"


class _Grams:
    """Bucket identifiers at given positions of a byte array that has 512 spare bytes at its end."""

    def __init__(self, data: np.ndarray):
        self.eight = np.ndarray((len(data) - 7,), "<u8", data.data, 0, (1,))

    def of16(self, p):
        return mix(self.eight[p], self.eight[p + 8])

    def of32(self, p):
        return mix(self.of16(p), self.of16(p + 16))

    def of64(self, p):
        return mix(self.of32(p), self.of32(p + 32))

    def of93(self, p):
        return mix(self.of64(p), self.of64(p + 29))

    def window(self, p):
        return mix(self.of64(p), self.of64(p + WINDOW - 64))

    def other(self, p):
        """A second identifier of a window, made of other buckets."""
        return mix(mix(self.of32(p + WINDOW - 32), self.of16(p)), mix(self.of32(p + 42), self.of32(p + 11)))


def _runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window and anchor of each run of the texts."""
    size, found = int(ends[-1]), []
    for s in range(0, size, _BLOCK):
        n = min(_BLOCK, size - s)
        i, j = np.searchsorted(ends, s, "right") - 1, np.searchsorted(ends, s + n, "left")
        a, b = np.clip(ends[i:j] - s, 0, n), np.clip(ends[i + 1 : j + 1] - (WINDOW - 1) - s, 0, n)
        edge = np.zeros(n + 1, np.int32)
        some = b > a
        if not some.any():
            continue
        np.add.at(edge, a[some], 1)
        np.add.at(edge, b[some], -1)
        p = np.flatnonzero(np.cumsum(edge[:-1]))
        span = n + _GRAMS - 1
        eight = np.ndarray((span + GRAM - 8,), "<u8", data.data, s, (1,))
        two = mix(eight[:-8], eight[8:])
        least = (mix(two[:-16], two[16:])[:span] & ~_LOW) | np.arange(span, dtype=np.uint64)
        step = 1
        while step * 2 <= _GRAMS:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        least = np.minimum(least[:n], least[_GRAMS - step :][:n])
        anchor = (least[p] & _LOW).astype(np.int64)
        first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1)])
        found.append((p[first] + s, p[np.r_[first[1:] - 1, len(p) - 1]] + s, anchor[first] + s))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    lo, hi, x = (np.concatenate(c) for c in zip(*found))
    doc = np.searchsorted(ends, lo, "right")
    first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (lo[1:] != hi[:-1] + 1) | (doc[1:] != doc[:-1])])
    return lo[first], hi[np.r_[first[1:] - 1, len(hi) - 1]], x[first]


def _whole(g: _Grams, lo, hi, x):
    """What identifies all bytes of some windows in a row and their places before the anchor."""
    return mix(mix(g.window(lo), g.window(hi)), ((hi - lo) * 256 + (x - lo)).astype(np.uint64))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _batch(core, whole, doc, tie, place) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_signed(core), _signed(whole), pa.array(doc), pa.array(tie), pa.array(place)], names=["core", "whole", "doc", "tie", "place"])


def _level0(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, ends = utf8(batch.column(1))
        lo, hi, x = _runs(data, ends)
        if not len(lo):
            continue
        g = _Grams(data)
        at = np.searchsorted(ends, lo, "right") - 1
        place = (lo - ends[at]) << _LO | (hi - lo + 1) << _N | (x - lo)
        yield _batch(g.of32(x), _whole(g, lo, hi, x), np.asarray(batch.column(0))[at], np.asarray(batch.column(2))[at], place)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts on their way to a join, at a third of their size."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        data, ends = utf8(batch.column(1))
        pairs = list(zip(ends[:-1].tolist(), ends[1:].tolist()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), batch.column(3), pa.array([b - a for a, b in pairs], pa.int64()), pa.array([pack.compress(data[a:b].tobytes()) for a, b in pairs], pa.binary())],
            names=["doc", "tie", "doc_id", "n_bytes", "packed"],
        )


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Number and bytes, with spare ones, of each text."""
    unpack = zstandard.ZstdDecompressor()
    for k, packed in enumerate(batch.column("packed").to_pylist()):
        text = unpack.decompress(packed) if packed else b""
        yield k, np.frombuffer(text + bytes(512), np.uint8)


def _joined(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch's texts in one array, with spare ones, and where each begins."""
    unpack = zstandard.ZstdDecompressor()
    texts = [unpack.decompress(packed) for packed in batch.column("packed").to_pylist()]
    return np.frombuffer(b"".join(texts) + bytes(512), np.uint8), np.cumsum([0, *map(len, texts)])[:-1]


def _numbered(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0 for each of the first length, 1 for the next, ...; and the count within each."""
    each = np.repeat(np.arange(len(lengths)), lengths)
    return each, np.arange(len(each)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _finer(level: int):
    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            data, begins = _joined(batch)
            places = batch.column("places")
            text = np.repeat(np.arange(len(batch)), np.diff(np.asarray(places.offsets)))
            place = np.asarray(places.flatten())
            for s in range(0, len(place), _BLOCK):
                some = place[s : s + _BLOCK]
                lo, n, before = (some >> _LO) + begins[text[s : s + _BLOCK]], some >> _N & 127, some & 127
                x, g = lo + before, _Grams(data)
                if level == 1:
                    first = (before - n + 1) // _PIECE
                    each, part = _numbered(before // _PIECE - first + 1)
                    part += first[each]
                    x = x[each]
                    a = np.maximum(lo[each], x - part * _PIECE - (_PIECE - 1))
                    b = np.minimum((lo + n - 1)[each], x - part * _PIECE)
                    core, whole = mix(g.of93(x - part * _PIECE), part.astype(np.uint64)), _whole(g, a, b, x)
                else:
                    each, step = _numbered(n)
                    a = b = lo[each] + step
                    x = x[each]
                    core, whole = g.window(a), g.other(a)
                number = text[s : s + _BLOCK][each]
                at = (a - begins[number]) << _LO | (b - a + 1) << _N | (x - a)
                yield _batch(core, whole, np.asarray(batch.column("doc"))[number], np.asarray(batch.column("tie"))[number], at)

    return units


def _resolve(units: DataFrame, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """Units that repeat an earlier one, and units that must be refined (none on the last level)."""
    repeated = stage(units.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"))
    units = stage(units.join(repeated, "core", "left_semi"))
    freed(repeated)
    firsts = stage(units.groupBy("core", "whole").agg(F.min(F.struct("doc", "tie", "place")).alias("first")))
    copies = stage(units.join(firsts, ["core", "whole"]).where(F.struct("doc", "tie", "place") > F.col("first")).select("doc", "tie", "place"))
    freed(units)
    if last:
        freed(firsts)
        return copies, None
    several = firsts.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
    finer = stage(firsts.join(several, "core", "left_semi").select("first.doc", "first.tie", "first.place"))
    freed(firsts)
    return copies, finer


def _by_text(places: DataFrame) -> DataFrame:
    return places.groupBy("doc", "tie").agg(F.collect_list("place").alias("places"))


def _removed(batch: pa.RecordBatch, k: int, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal removed runs of one text."""
    places = batch.column("places")[k]
    if not places.is_valid:
        none = np.zeros(0, np.int64)
        return none, none
    place = np.asarray(places.values)
    lo = place >> _LO
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate((lo + (place >> _N & 127) - 1 + WINDOW)[order])
    first = np.flatnonzero(np.r_[True, lo[1:] > end[:-1]])
    return lo[first], end[np.r_[first[1:] - 1, len(lo) - 1]]


def _kept(data: np.ndarray, n: int, begins, ends) -> bytes:
    return b"".join(data[a:b].tobytes() for a, b in zip([0, *ends.tolist()], [*begins.tolist(), n]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, rows = batch.column("n_bytes").to_pylist(), []
        for k, data in _unpacked(batch):
            a, b = _removed(batch, k, data)
            rows.append((int((b - a).sum()), len(a), hashlib.sha256(_kept(data, sizes[k], a, b)).hexdigest()))
        removed, spans, sha = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, rows = batch.column("n_bytes").to_pylist(), []
        for k, data in _unpacked(batch):
            a, b = _removed(batch, k, data)
            rows.append(_kept(data, sizes[k], a, b).decode("utf-8", "ignore"))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tie"), pa.array(rows, pa.string())], names=["doc", "tie", "text"])


def _spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The packed texts of docs, and the places of repeated windows by text."""
    source = docs.select(key(F.col("doc_id")).alias("doc"), "text", F.xxhash64("text").alias("tie"), F.col("doc_id").cast("long").alias("doc_id"))
    packed = source.mapInArrow(over_texts(_packed, 1), _TEXT)
    copies, refine = _resolve(source.select("doc", "text", "tie").mapInArrow(over_texts(_level0, 1), _UNIT), False)
    found = [copies]
    for level in (1, 2):
        finer = packed.join(_by_text(refine), ["doc", "tie"]).select("doc", "tie", "packed", "places").mapInArrow(over_texts(_finer(level), "packed"), _UNIT)
        copies, refine = _resolve(finer, level == 2)
        found.append(copies)
    return packed, _by_text(found[0].union(found[1]).union(found[2]))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """What removal of repeated strings leaves of each text of docs (doc_id, text, ...).

    A byte goes if a string of 100 bytes that covers it also starts earlier: in a document with a
    smaller doc_id, or earlier in the same document. Strings are judged on the input. Result: doc_id,
    n_bytes, n_removed, n_spans, kept_sha256 for every row. Null and empty texts have 0 bytes. A null
    doc_id comes before all others. Rows with one doc_id and one text count as one document and get
    the same result; of different texts with one doc_id, that with the smaller 64-bit hash comes first.
    Further columns are ignored. An empty table gives an empty result.
    """
    packed, places = _spans(docs)
    return packed.join(places, ["doc", "tie"], "left").mapInArrow(over_texts(_digests, "packed"), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeated(docs: DataFrame) -> DataFrame:
    """docs with repeated strings taken out of text, with all other columns as they were.

    As repeated_spans; of a character that a span cuts, the rest goes too. n_chars, where there is such
    a column, gets the new length. A text that repeats others in whole becomes empty; its row stays.
    A null text stays null.
    """
    packed, places = _spans(docs)
    changed = packed.join(places, ["doc", "tie"]).mapInArrow(over_texts(_texts, "packed"), "doc long, tie long, text string").dropDuplicates(["doc", "tie"])
    rows = numbered_columns(docs, list(range(len(docs.columns))))
    old = F.col(place_of(docs, "text"))
    out = rows.join(changed, (key(F.col(place_of(docs, "doc_id"))) == F.col("doc")) & (F.xxhash64(old) == F.col("tie")), "left")
    text = F.coalesce(F.col("text"), old)
    new = {"text": text, "n_chars": F.char_length(text)}
    return out.select(*[new[c.lower()].cast(docs.schema[k].dataType).alias(f"_in{k}") if c.lower() in new else f"_in{k}" for k, c in enumerate(docs.columns)]).toDF(*docs.columns)
