"""WARC records, and the derivatives of responses.

A response becomes two linked records: metadata (the fields of the source: its HTTP headers,
status, digests, title, language) and a plain-text conversion. Both refer to the response by
WARC-Refers-To and keep its target address, date and payload digest; the metadata
record is also linked with the conversion by WARC-Concurrent-To. Record ids are derived from
the response's id, so reruns agree. Digests are SHA-1 in base 32, as is the custom of the format.

Null addresses give records without WARC-Target-URI; null pages an empty payload, whose
conversion is empty; ids may be null or repeat (their records then share ids only if
address and page are the same). Each row is handled by itself: nothing is shuffled, and copies or ties make no
difference. A page of any length is handled whole, in linear time whatever it leaves unclosed; batches are
cut by bytes. Other columns are not read, so their names cannot clash. An empty table gives no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, split_uri
from .markup import declared, html_text, title

#: Pages come without a date of capture; records of them bear this one unless a column is named.
DATE = "2024-01-01T00:00:00Z"
FILE_BYTES = 64 << 20
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of addresses
RECORD = "page_id {id}, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, payload_digest string, headers string, block binary"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _named(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, '|'.join(map(repr, parts)))}>"


def header_text(fields: list[tuple[str, str | None]]) -> str:
    return "WARC/1.1\r\n" + "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in fields if v is not None)


def _record(page, kind: str, name: str, uri: str | None, date: str, content: str, block: bytes, payload: str | None, more: list[tuple[str, str | None]], refers: str | None = None) -> tuple:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", refers), *more]
    fields += [("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", payload), ("Content-Type", content), ("Content-Length", str(len(block)))]
    return (page, kind, name, refers, uri, date, content, digest(block), payload, header_text(fields), block)


def _batch(rows: list[tuple], like: pa.DataType) -> pa.RecordBatch:
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [like, *[pa.string()] * 9, pa.binary()]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names)


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date_col: str | None = None) -> DataFrame:
    """The pages as response records."""
    kind = pages.schema[id_col].dataType.simpleString()
    date = F.col(date_col).cast("string") if date_col else F.lit(DATE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in by_bytes(whole, "html")):
            rows = []
            for page, uri, body, when in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (body or "").encode()
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n"
                sha = digest(payload)
                rows.append(_record(page, "response", _named(page, uri, sha), uri, when or DATE, "application/http; msgtype=response", http + payload, sha, []))
            yield _batch(rows, batch.schema.field(0).type)

    cut = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), date.alias("date"))
    return cut.mapInArrow(run, RECORD.format(id=kind))


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body of an HTTP response; without a blank line all is body."""
    head, blank, body = block.partition(b"\r\n\r\n")
    if not blank or not head.startswith(b"HTTP/"):
        return "", [], block
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    return status, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)], body


def derivatives(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response; other records are passed over."""
    kind = records.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in by_bytes(whole, "block")):
            rows = []
            for page, name, uri, date, payload, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                status, headers, body = split_http(raw or b"")
                page_html = body.decode("utf-8", "replace")
                text = html_text(page_html)
                meta, conv = _named(name, "metadata"), _named(name, "conversion")
                payload = payload or digest(body)
                fields = [("source-status", status), *((f"source-header-{k.lower()}", v) for k, v in headers), ("source-payload-digest", payload), ("source-block-digest", digest(raw or b""))]
                fields += [("title", title(page_html)), ("language-declared", declared(page_html)), ("conversion-record", conv), ("conversion-characters", str(len(text)))]
                block = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in fields).encode()
                links = [("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date)]
                rows.append(_record(page, "metadata", meta, uri, date, "application/warc-fields", block, payload, [("WARC-Concurrent-To", conv), *links], name))
                rows.append(_record(page, "conversion", conv, uri, date, "text/plain; charset=utf-8", text.encode(), digest(text.encode()), [("WARC-Source-Payload-Digest", payload), *links], name))
            yield _batch(rows, batch.schema.field(0).type)

    only = records.where("record_type = 'response'").select("page_id", "record_id", "target_uri", "date", "payload_digest", "block")
    return only.mapInArrow(run, RECORD.format(id=kind))


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Write records as files of gzip members into a shared folder; returns the manifest (file, records), which alone says what counts."""
    target = f"{folder}/warc"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = split_uri(target)
        fs.create_dir(place, recursive=True)
        out = None
        name, n = "", 0
        for batch in batches:
            for head, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None:
                    name, n = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{place}/{name}", compression=None)
                out.write(gzip.compress(head.encode() + b"\r\n" + block + b"\r\n\r\n", 6, mtime=0))
                n += 1
                if out.tell() >= FILE_BYTES:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"file": [name], "records": [n]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [n]})

    records.select("headers", "block").mapInArrow(run, "file string, records long").write.parquet(f"{folder}/manifest")
    return records.sparkSession.read.parquet(f"{folder}/manifest")


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields with lower-case names, block) of each record of a file, gzip or plain."""
    data = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:])}
        n = int(fields["content-length"])
        yield fields, data[stop + 4 : stop + 4 + n]
        at = stop + 4 + n + 4


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """record_type, record_id, refers_to, target_uri, date, content_type, block_digest, payload_digest, block of the files that the manifest names."""
    names = ["warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date", "content-type", "warc-block-digest", "warc-payload-digest"]
    schema = "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, payload_digest string, block binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                rows = [(*(f.get(k) for k in names), b) for f, b in parse_warc(raw.as_py())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary() if k == len(names) else pa.string()) for k, c in enumerate(zip(*rows, strict=True))], [x.split()[0] for x in schema.split(", ")])

    files = spark.read.format("binaryFile").load(f"{folder}/warc").withColumn("file", F.element_at(F.split("path", "/"), -1))
    return files.join(spark.read.parquet(f"{folder}/manifest"), "file", "left_semi").select("content").mapInArrow(run, schema)
