"""Operator 10: WARC derivative builder.

Every response (a stored page) gives three linked records: the *response* itself, a *metadata* record with the facts read
off its page (title, language, charset, outgoing links) and a *conversion* record with its plain text.  The derived records
name the response in WARC-Refers-To, repeat its target URI and date, and keep the source's header block and digests as
fields of the metadata record, so each can be traced and checked without the others.  Record ids are name-based (from the
page's id, address and digest), so a rebuilt derivative has the same ids.  Where the pages come with the header block, record
id or payload digest of their own response record, these are kept as they are; pages without a header block get a minimal
made-up one (status 200, type, length).  ``serialize`` writes a record as WARC/1.1 bytes and ``parse`` reads them back;
``write_files`` stores gzip members, those of a batch of records together, as rows of a parquet table.

Defined results: a null page is an empty block with the digest of nothing; a null address gives no target URI; the date is
that of the column ``fetched`` if there is one, else the fixed ``EPOCH``; repeated rows give records with equal ids; pages
without a body give an empty conversion; long pages are converted whole; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
EPOCH = "1970-01-01T00:00:00Z"
TYPES = {"response": "application/http;msgtype=response", "metadata": "application/warc-fields", "conversion": "text/plain;charset=utf-8"}

_DROP = re.compile(r"<!--.*?-->|<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>|<!DOCTYPE[^>]*>", re.I | re.S)
_OPEN_DROP = re.compile(r"<!--.*|<(?:script|style|noscript|template)\b[^>]*>.*", re.I | re.S)
_BLOCK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|blockquote|pre|title|head|body|hr)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^>]*>")
_TITLE = re.compile(r"<title[^>]*>(.*?)</title\s*>", re.I | re.S)
_LANG = re.compile(r"<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_CHARSET = re.compile(r"<meta\b[^>]*\bcharset\s*=\s*[\"']?([A-Za-z0-9_-]+)", re.I)
_LINK = re.compile(r"<a\b[^>]*\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def plain_text(page: str) -> str:
    """Text of a page: no scripts, styles or comments, one line per block, entities resolved, blanks joined."""
    page = _OPEN_DROP.sub(" ", _DROP.sub(" ", page))
    head = re.search(r"<head\b.*?</head\s*>", page, re.I | re.S)
    if head:
        page = page[:head.start()] + page[head.end():]
    text = html.unescape(_TAG.sub("", _BLOCK.sub("\n", page)))
    return "\n".join(line for line in (" ".join(x.split()) for x in text.split("\n")) if line)


def one_line(value: str) -> str:
    return " ".join(value.split())


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def header_block(headers: str) -> bytes:
    """The lines of a header block, none empty, each ended by CR LF, and the empty line after them."""
    return "".join(f"{x}\r\n" for x in headers.splitlines() if x.strip()).encode() + b"\r\n"


def derive(page_id: str, url: str | None, page: str, date: str, headers: str | None = None, source_id: str | None = None,
           payload_digest: str | None = None) -> list[dict]:
    """The response and its derivatives, as dictionaries of header fields with a block of bytes.  ``headers`` (status line and
    header lines), ``source_id`` and ``payload_digest`` are those of the stored response, where known; blank counts as unknown."""
    body = page.encode()
    given = headers is not None and headers.strip()
    http = header_block(headers if given else f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(body)}")
    target = one_line(url) if url is not None else None
    own = one_line(source_id or "") or record_id("response", page_id, target or "", digest(body))
    response = {"type": "response", "id": own, "refers_to": None, "date": date,
                "target": target, "block": http + body, "payload_digest": one_line(payload_digest or "") or digest(body)}
    title, lang, charset = _TITLE.search(page), _LANG.search(page), _CHARSET.search(page)
    fields = [("title", one_line(html.unescape(title[1])) if title else None), ("languages-declared", lang[1] if lang else None),
              ("charset-declared", charset[1].lower() if charset else None), ("source-block-digest", digest(response["block"])),
              ("source-payload-digest", response["payload_digest"]),
              *(("source-header", one_line(x)) for x in http.decode().split("\r\n") if x),
              *(("outlink", one_line(html.unescape(a or b or c))) for a, b, c in _LINK.findall(_DROP.sub(" ", page)))]
    out = [response]
    for kind, block in (("metadata", "".join(f"{k}: {v}\r\n" for k, v in fields if v).encode()), ("conversion", plain_text(page).encode())):
        out.append({"type": kind, "id": record_id(kind, response["id"]), "refers_to": response["id"], "date": date, "target": target,
                    "block": block, "payload_digest": None})
    return out


def serialize(record: dict) -> bytes:
    """A record in WARC/1.1 form."""
    block = record["block"]
    head = [("WARC-Type", record["type"]), ("WARC-Record-ID", record["id"]), ("WARC-Date", record["date"]), ("WARC-Target-URI", record["target"]),
            ("WARC-Refers-To", record["refers_to"]), ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", record["payload_digest"]),
            ("Content-Type", TYPES[record["type"]]), ("Content-Length", str(len(block)))]
    return "".join([f"{VERSION}\r\n", *(f"{k}: {v}\r\n" for k, v in head if v is not None), "\r\n"]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a WARC stream."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        first, *lines = raw[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(line.split(": ", 1) for line in lines)
        size = int(head["Content-Length"])
        yield head, raw[end + 4:end + 4 + size]
        at = end + 4 + size + 4


RECORD = ("page_id bigint, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
          "content_length bigint, block_digest string, payload_digest string, record_bytes bigint")


def derivatives(pages: DataFrame, with_block: bool = False, headers: str | None = None, source_id: str | None = None,
                payload_digest: str | None = None) -> DataFrame:
    """Three rows per page; with ``with_block`` also the block and the record's WARC bytes.  ``headers``, ``source_id`` and
    ``payload_digest`` name string columns with the header block, record id and payload digest of the stored responses."""
    date = F.date_format("fetched", "yyyy-MM-dd'T'HH:mm:ss'Z'") if "fetched" in pages.columns else F.lit(None).cast("string")
    chosen = pages.select(F.col("page_id").cast("bigint"), "url", F.col("html"), F.coalesce(date, F.lit(EPOCH)).alias("date"),
                          *[(F.col(c) if c else F.lit(None)).cast("string").alias(f"source_{k}")
                            for k, c in enumerate((headers, source_id, payload_digest))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows: list[list] = [[] for _ in range(13)]
                for page_id, url, page, when, *source in zip(*(c.slice(lo, 256).to_pylist() for c in batch.columns)):
                    for r in derive("" if page_id is None else str(page_id), url, page or "", when, *source):
                        raw = serialize(r)
                        values = (page_id, r["type"], r["id"], r["refers_to"], r["target"], r["date"], TYPES[r["type"]], len(r["block"]),
                                  digest(r["block"]), r["payload_digest"], len(raw), r["block"], raw)
                        for column, v in zip(rows, values):
                            column.append(v)
                kinds = [pa.int64(), *[pa.string()] * 6, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
                names = [x.split()[0] for x in RECORD.split(", ")] + ["block", "warc"]
                n = 13 if with_block else 11
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows[:n], kinds)], names=names[:n])

    return chosen.mapInArrow(run, RECORD + (", block binary, warc binary" if with_block else ""))


def write_files(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the records as gzip members to rows of parquet part files under ``folder`` (one row per task: part, data)
    and returns that table; concatenated members are a valid .warc.gz file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            data = b"".join(gzip.compress(x, mtime=0) for x in batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([data], pa.binary())], names=["part", "number", "data"])

    derivatives(pages, with_block=True).select("warc").mapInArrow(run, "part int, number int, data binary").write.parquet(folder)
    return pages.sparkSession.read.parquet(folder)
