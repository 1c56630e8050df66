"""WARC files, and their derivatives: linked metadata and plain-text conversion records.

A response gives two records. ``metadata`` holds JSON with the response's WARC headers, its HTTP headers, the page's
title, description, canonical address and links (made absolute). ``conversion`` holds the page's plain text. Both carry
``WARC-Refers-To`` (the response's record id), its target address and date, and their own block digest; the response's
block and payload digests are kept as ``WARC-Source-Block-Digest`` and ``WARC-Source-Payload-Digest``. Record ids are
UUIDs made from the response's id and the kind, so that a rerun gives the same ids.

Files are written by Spark's text writer: a record ends with two line ends, and those are the writer's separator, so
files of any Hadoop file system are complete or absent, whatever tasks are lost.

Cases: a null html is an empty payload and gives empty text and no links; a null url gives records without a target
address; a payload that isn't UTF-8 is decoded with replacements; HTML without end tags, or with comments and scripts
left open, is taken up to the end; a page of any length is read whole, in time that is in proportion to it, whatever is
left open in it; a null page_id counts as an id of its own; rows that repeat give records that repeat, with the same record
ids; an empty table gives none; other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import json
import re
import uuid
import zlib
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches

VERSION = "WARC/1.1"
#: Pages carry no date; responses made from them have this one unless told otherwise.
NO_DATE = "1970-01-01T00:00:00Z"
RECORD = "record_id string, record_type string, target_uri string, warc_date string, warc_headers string, http_headers string, payload binary"
HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b.*?(?:</\1\s*>|\Z)", re.I | re.S)
BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|nav|aside|main|blockquote|pre|hr|dd|dt|dl|form|title|head|body|html)\b[^>]*>", re.I)
TAG = re.compile(r"<[!/?a-zA-Z][^>]*>")
BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")
LINES = re.compile(r" ?\n[ \n]*")
TITLE = re.compile(r"<title[^>]*>(.*?)(?:</title|\Z)", re.I | re.S)
META = re.compile(r"<meta\b[^>]*>", re.I)
LINK = re.compile(r"<(a|link|img|iframe|area)\b([^>]*)>", re.I)
#: Starts at a name's first letter and gives none back, so that a long run of letters is read once.
ATTRIBUTE = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]++)""")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def shown(page: str) -> tuple[str, str]:
    """What isn't hidden, up to the last > and after it.

    In the first part, each tag that begins ends, so patterns read it once; in the second there is none.
    """
    text = HIDDEN.sub(" ", page)
    at = text.rfind(">") + 1
    return text[:at], text[at:]


def plain_text(page: str) -> str:
    """The page's text: blocks on lines of their own, white space within a line as one space."""
    tagged, rest = (x.replace("\n", " ") for x in shown(page))
    text = BLANKS.sub(" ", TAG.sub(lambda m: "\n" if BREAK.match(m[0]) else "", tagged) + rest)
    if "&" in text:
        text = BLANKS.sub(" ", entities.unescape(text))
    return LINES.sub("\n", text).strip()


def attributes(tag: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(tag)}


def page_facts(page: str, url: str | None) -> dict:
    """Title, metas, canonical address and links of a page."""
    tagged, rest = shown(page)
    title = TITLE.search(tagged)
    if title and title.end() == len(tagged) and not title[0].lower().endswith("</title"):
        title = TITLE.search(tagged[title.start() :] + rest)
    metas = [a for a in map(attributes, META.findall(tagged)) if a]
    base, links, canonical = url or "", [], None
    for tag, rest in LINK.findall(tagged):
        a = attributes(rest)
        to = a.get("href") or a.get("src")
        if to:
            try:
                to = urljoin(base, to)
            except ValueError:
                pass
            if a.get("rel", "").lower() == "canonical":
                canonical = to
            links.append({"path": tag.upper(), "url": to})
    named = {k: a["content"] for a in metas if "content" in a for k in [a.get("name") or a.get("property") or a.get("http-equiv")] if k}
    return {"title": " ".join(entities.unescape(title[1]).split()) if title else None, "metas": named, "canonical": canonical, "links": links}


def header_lines(headers: list[tuple[str, str | None]]) -> str:
    return "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)


def response(rid: str, url: str | None, date: str, http_headers: str, payload: bytes) -> tuple:
    """A row of RECORD."""
    block = http_headers.encode() + b"\r\n" + payload
    headers = header_lines([("WARC-Type", "response"), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", url), ("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(payload)), ("Content-Length", str(len(block)))])
    return rid, "response", url, date, headers, http_headers, payload


def responses(pages: DataFrame, date: str = NO_DATE) -> DataFrame:
    """Responses (page_id and the columns of RECORD) from pages (page_id, url, html)."""

    def make(batches):
        for batch in batches:
            rows = []
            for i, url, page in zip(*(batch.column(c).to_pylist() for c in range(2)), batch.column(2)):
                payload = (page.as_py() or "").encode()
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
                rows.append(response(record_id("response", str(i), url or ""), url, date, http, payload))
            cols = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.binary() if k == 6 else pa.string()) for k, c in enumerate(cols))], ["page_id", *(x.split()[0] for x in RECORD.split(", "))])

    return in_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")).mapInArrow(make, f"page_id long, {RECORD}")


def fields(headers: str) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in headers.split("\r\n") if ": " in x)


def charset(http_headers: str) -> str:
    m = re.search(r"charset=[\"']?([\w.:-]+)", http_headers, re.I)
    try:
        return b"".decode(m[1]) or m[1] if m else "utf-8"
    except LookupError:
        return "utf-8"


def derive(rid: str, url: str | None, date: str, warc_headers: str, http_headers: str, payload: bytes) -> list[tuple]:
    """The metadata and the conversion record of a response: (type, id, headers, block, facts)."""
    page = payload.decode(charset(http_headers), "replace")
    source = fields(warc_headers)
    facts = page_facts(page, url)
    envelope = {"WARC-Header-Metadata": source, "HTTP-Response-Metadata": {"Status-Line": http_headers.split("\r\n", 1)[0], "Headers": fields(http_headers)}, "HTML-Metadata": facts}
    out = []
    for kind, block, mime in (("metadata", json.dumps({"Envelope": envelope}, ensure_ascii=False, sort_keys=True).encode(), "application/json"), ("conversion", plain_text(page).encode(), "text/plain; charset=utf-8")):
        own = record_id(kind, rid)
        headers = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", rid), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Source-Block-Digest", source.get("WARC-Block-Digest")), ("WARC-Source-Payload-Digest", source.get("WARC-Payload-Digest")), ("Content-Type", mime), ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
        out.append((kind, own, header_lines(headers), block, len(facts["links"])))
    return out


def derivatives(records: DataFrame, id_col: str | None = None) -> DataFrame:
    """Metadata and conversion records of the responses among records (RECORD, and maybe a long id_col, which is kept).

    (id, record_type, record_id, refers_to, target_uri, warc_date, headers, block, block_digest, source_payload_digest, n_links)
    """

    def make(batches):
        for batch in batches:
            rows = []
            for key, rid, url, date, headers, http, payload in zip(*(batch.column(c).to_pylist() for c in range(6)), batch.column(6)):
                source = fields(headers).get("WARC-Payload-Digest")
                for kind, own, said, block, n in derive(rid, url, date, headers, http or "", payload.as_py() or b""):
                    rows.append((key, kind, own, rid, url, date, said, block, digest(block), source, n))
            cols = list(zip(*rows)) if rows else [()] * 11
            types = [pa.int64(), *[pa.string()] * 6, pa.binary(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    schema = "id long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, headers string, block binary, block_digest string, source_payload_digest string, n_links long"
    names = [x.split()[0] for x in schema.split(", ")]
    key = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    wanted = records.filter("record_type = 'response'").select(key.alias("id"), "record_id", "target_uri", "warc_date", "warc_headers", "http_headers", "payload")
    return in_batches(wanted).mapInArrow(make, schema)


def write_warc(records: DataFrame, path: str) -> None:
    """Write records (headers string, block binary) as WARC files into the folder path."""
    value = F.concat(F.lit(f"{VERSION}\r\n").cast("binary"), F.col("headers").cast("binary"), F.lit("\r\n").cast("binary"), F.col("block"))
    records.select(value.cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def parse_warc(data: bytes):
    """(record type, id, target, date, headers, HTTP headers, payload) of each record; takes members of gzip, too."""
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            parts.append(member.decompress(data) + member.flush())
            data = member.unused_data
        data = b"".join(parts)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        headers = data[data.index(b"\r\n", at) + 2 : end + 2].decode("utf-8", "replace")
        f = {k.lower(): v for k, v in fields(headers).items()}
        block = data[end + 4 : end + 4 + int(f["content-length"])]
        at = end + 4 + len(block)
        http, payload = "", block
        if f.get("content-type", "").startswith("application/http"):
            head, _, payload = block.partition(b"\r\n\r\n")
            http = head.decode("utf-8", "replace") + "\r\n"
        yield f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"), f.get("warc-date"), headers, http, payload


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records (RECORD) of the WARC files, plain or gzipped, that path names; a file is read by one task."""

    def scan(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = list(parse_warc(content.as_py()))
                cols = list(zip(*rows)) if rows else [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 6 else pa.string()) for k, c in enumerate(cols)], [x.split()[0] for x in RECORD.split(", ")])

    return in_batches(spark.read.format("binaryFile").load(path).select("content")).mapInArrow(scan, RECORD)


def query(spark, sf_dir: str) -> DataFrame:
    made = derivatives(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")), "page_id")
    return made.select(F.col("id").alias("page_id"), "record_type", "record_id", "refers_to", "target_uri", "warc_date", "block_digest", "source_payload_digest", F.length("block").cast("long").alias("content_length"), "n_links")
