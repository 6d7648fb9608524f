"""WARC derivatives: metadata and plain-text conversion records from responses.

A record is a row: warc_type, record_id, refers_to, target_uri, date, content_type, block_digest,
payload_digest, block (bytes), headers (all further named fields of the record in order, a name and a
value each; Content-Length follows from block). Records are read from and
written to files of the format, whole records in gzip members of their own.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import over_texts
from gleaner.llm.html_extraction import blocks

_NAMES = ("warc_type", "record_id", "refers_to", "target_uri", "date", "content_type", "block_digest", "payload_digest")
RECORD = T.StructType([*(T.StructField(n, T.StringType()) for n in _NAMES), T.StructField("block", T.BinaryType()), T.StructField("headers", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])))])
_FIELDS = {"warc-type": "warc_type", "warc-record-id": "record_id", "warc-refers-to": "refers_to", "warc-target-uri": "target_uri", "warc-date": "date", "content-type": "content_type", "warc-block-digest": "block_digest", "warc-payload-digest": "payload_digest"}
_HEADERS = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type", "block_digest": "WARC-Block-Digest", "payload_digest": "WARC-Payload-Digest"}
#: Fields that hold for a source record's own block only, so that no derived record has them.
_OWN_FIELDS = ("warc-identified-payload-type", "warc-segment-number", "warc-segment-origin-id", "warc-segment-total-length")
_ARROW = pa.schema([*((n, pa.string()) for n in _NAMES), ("block", pa.binary()), ("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])))])


_LINE_END = re.compile(r"[\r\n]+")
_CHARSET = re.compile(rb"<meta[^>]{0,1000}?charset\s*=\s*[\"']?\s*([\w-]+)|<\?xml[^>]{0,1000}?encoding\s*=\s*[\"']([\w-]+)", re.I)
#: Bytes of a file that are unpacked at once, and bytes of records that leave the reader at once.
_STEP, _OUT = 1 << 16, 8 << 20


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """An identifier that follows from what the record is made of, so that reruns give the same."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(parts))}>"


def split_response(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response; a block without headers is all payload."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/"):
        return "", [], block
    status, *lines = head.decode("iso-8859-1").split("\r\n")
    headers: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in " \t" and headers:
            headers[-1] = headers[-1][0], f"{headers[-1][1]} {line.strip()}"
        elif ":" in line:
            name, _, value = line.partition(":")
            headers.append((name.strip(), value.strip()))
    known = {n.lower(): v.lower() for n, v in headers}
    if "chunked" in known.get("transfer-encoding", ""):
        payload = _dechunked(payload)
    if known.get("content-encoding") in ("gzip", "x-gzip", "deflate"):
        try:
            payload = zlib.decompressobj(47).decompress(payload)
        except zlib.error:
            pass
    return status, headers, payload


def _dechunked(data: bytes) -> bytes:
    out, at = [], 0
    while found := re.compile(rb"([0-9a-fA-F]+)[^\r\n]*\r?\n").match(data, at):
        size = int(found[1], 16)
        if not size:
            return b"".join(out)
        out.append(data[found.end() : found.end() + size])
        at = found.end() + size
        at += 2 if data[at : at + 2] == b"\r\n" else 0
    return b"".join(out) or data


def plain_text(payload: bytes, content_type: str) -> str:
    """The visible text, one block in a line; of other content than HTML the text itself, of binary content nothing.

    The characters are read by the charset that the header names, else by the first one that the payload itself
    declares, else as UTF-8."""
    charset = re.search(r"charset=[\"']?([\w-]+)", content_type, re.I)
    declared = None if charset else _CHARSET.search(payload)
    name = charset[1] if charset else (declared[1] or declared[2]).decode() if declared else "utf-8"
    try:
        text = payload.decode(name, "replace")
    except (LookupError, ValueError):
        text = payload.decode("utf-8", "replace")
    kind = content_type.lower()
    if "html" in kind or "xml" in kind or not kind:
        return "\n".join(t for _, t, _ in blocks(text))
    return text if kind.startswith("text/") or "json" in kind else ""


def _derived(r: dict) -> Iterator[dict]:
    block = r["block"] or b""
    status, headers, payload = split_response(block)
    known = {n.lower(): v for n, v in headers}
    source, uri = r["record_id"] or "", r["target_uri"] or ""
    lines = [("source-record-id", source), ("source-status", status), ("source-block-digest", r["block_digest"] or digest(block)), ("source-payload-digest", digest(payload))]
    lines += [(f"source-field-{h['name'].lower()}", h["value"]) for h in r["headers"] or []]
    lines += [(f"source-header-{n.lower()}", v) for n, v in headers]
    text = plain_text(payload, known.get("content-type", "")).encode("utf-8", "replace")
    conversion = record_id("conversion", source, uri, digest(payload))
    lines.append(("conversion-record-id", conversion))
    about = "".join(f"{n}: {_LINE_END.sub(' ', v or '')}\r\n" for n, v in lines).encode("utf-8", "replace")
    same = {"refers_to": r["record_id"], "target_uri": r["target_uri"], "date": r["date"], "headers": [h for h in r["headers"] or [] if h["name"].lower() not in _OWN_FIELDS]}
    yield same | {"warc_type": "metadata", "record_id": record_id("metadata", source, uri, digest(payload)), "content_type": "application/warc-fields", "block_digest": digest(about), "payload_digest": None, "block": about}
    yield same | {"warc_type": "conversion", "record_id": conversion, "content_type": "text/plain; charset=utf-8", "block_digest": digest(text), "payload_digest": digest(payload), "block": text}


def derive(records: DataFrame, keep: str | None = None) -> DataFrame:
    """Two records for each response of records: metadata, then conversion to plain text.

    Both refer to the response; the metadata names the conversion, the response's status and digests,
    all further fields of its record (source-field-) and all its HTTP headers (source-header-), repeated
    ones in order. Both carry the record's further fields in headers, without those of its own block. payload_digest of a conversion is that of the response's payload. Identifiers follow
    from the source. A response with a null or empty block gives an empty conversion; a repeated one
    gives repeated rows. Records of other types give nothing. keep names a column to carry along.
    """
    schema = T.StructType([*([records.schema[keep]] if keep else []), *RECORD.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            carried, rows = [], []
            for k, r in enumerate(batch.select(_ARROW.names).to_pylist()):
                for d in _derived(r):
                    rows.append(d)
                    carried.append(k)
            out = pa.RecordBatch.from_pylist(rows, schema=_ARROW)
            if keep:
                own = batch.column(batch.schema.names.index(keep)).take(pa.array(carried, pa.int64()))
                out = pa.RecordBatch.from_arrays([own, *out.columns], names=[keep, *_ARROW.names])
            yield out

    chosen = records.where("warc_type = 'response'").select(*([keep] if keep else []), *RECORD.names)
    return chosen.mapInArrow(over_texts(run), schema)


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """pages (page_id, url, html) as response records with page_id; a null html is an empty payload.

    pages does not say when a page was fetched: all records carry the given date."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body), F.lit("\r\n\r\n"))
    h = F.md5(F.concat_ws(" ", F.col("page_id").cast("string"), "url").cast("binary"))
    urn = F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))
    none = F.lit(None).cast("string")
    return pages.select("page_id", F.lit("response").alias("warc_type"), urn.alias("record_id"), none.alias("refers_to"), F.col("url").cast("string").alias("target_uri"), F.lit(date).alias("date"), F.lit("application/http; msgtype=response").alias("content_type"), none.alias("block_digest"), none.alias("payload_digest"), F.concat(head.cast("binary"), body).alias("block"), F.array().cast(RECORD["headers"].dataType).alias("headers"))


def written(r: dict) -> bytes:
    """One record as a gzip member."""
    lines = [f"{_HEADERS[n]}: {r[n]}" for n in _NAMES if r[n] is not None]
    lines += [f"{h['name']}: {h['value'] or ''}" for h in r["headers"] or []]
    block = r["block"] or b""
    raw = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    return gzip.compress(raw, 6, mtime=0)


def _unpacked(data: memoryview) -> Iterator[bytes]:
    """The bytes of a file, a step at a time, out of gzip members or as they are; up to the first damaged one."""
    at, size = 0, len(data)
    if bytes(data[:2]) != b"\x1f\x8b":
        while at < size:
            yield bytes(data[at : at + _STEP])
            at += _STEP
        return
    while at < size:
        member = zlib.decompressobj(31)
        while not member.eof and at < size:
            part = data[at : at + _STEP]
            at += len(part)
            try:
                while part and not member.eof:
                    yield member.decompress(part, _STEP * 16)
                    part = member.unconsumed_tail
            except zlib.error:
                return
        if not member.eof:
            yield member.flush()
        at -= len(member.unused_data)
        while at < size and data[at] == 0:  # padding between members
            at += 1


class _Stream:
    """Bytes that come in steps: holds what was read ahead and not yet taken."""

    def __init__(self, steps: Iterator[bytes]):
        self.steps, self.held = steps, bytearray()

    def more(self) -> bool:
        step = next(self.steps, None)
        self.held += step or b""
        return step is not None

    def upto(self, mark: bytes) -> bytes | None:
        """What comes before a mark, which is skipped; None, and nothing is held, if there is none."""
        seen = 0
        while (at := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                return None
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def skip_to(self, mark: bytes) -> bool:
        """Drop what comes before a mark."""
        while (at := self.held.find(mark)) < 0:
            del self.held[: max(0, len(self.held) - len(mark) + 1)]
            if not self.more():
                return False
        del self.held[:at]
        return True

    def take(self, size: int) -> bytes | None:
        """So many bytes; None if fewer follow."""
        while len(self.held) < size:
            if not self.more():
                return None
        out = bytes(self.held[:size])
        del self.held[:size]
        return out


def parsed(data: bytes | memoryview) -> Iterator[dict]:
    """The records of a file, packed or not, one at a time. A file that breaks off, or a damaged member in it,
    gives the records before that. Of the unpacked file no more than a record and a step are held."""
    stream = _Stream(_unpacked(memoryview(data)))
    while stream.skip_to(b"WARC/"):
        head = stream.upto(b"\r\n\r\n")
        if head is None:
            return
        fields: list[tuple[str, str]] = []
        for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
            if line[:1] in (" ", "\t") and fields:
                fields[-1] = fields[-1][0], f"{fields[-1][1]} {line.strip()}"
            elif ":" in line:
                name, _, value = line.partition(":")
                fields.append((name.strip(), value.strip()))
        record, size = dict.fromkeys(_ARROW.names) | {"headers": []}, 0
        for name, value in fields:
            column = _FIELDS.get(name.lower())
            if name.lower() == "content-length" and value.isdigit():
                size = int(value)
            elif column and record[column] is None:
                record[column] = value
            else:
                record["headers"].append({"name": name, "value": value})
        block = stream.take(size)
        if block is None:
            return
        yield record | {"block": block}


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of the files at path. A file is read by one task, which holds it as it is packed (files of
    up to 2 GB, the limit of Spark's binary files) and its records some MB at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for r in parsed(memoryview(data.as_buffer())):
                    rows.append(r)
                    size += len(r["block"])
                    if len(rows) == 256 or size >= _OUT:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def packed(records: DataFrame) -> DataFrame:
    """Each record as the bytes of a gzip member; members joined in any order are a file of the format."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([written(r) for r in batch.to_pylist()], pa.binary())], names=["member"])

    return records.select(*RECORD.names).mapInArrow(over_texts(run), "member binary")
