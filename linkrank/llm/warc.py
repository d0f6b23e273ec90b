"""WARC derivatives: responses become linked metadata and conversion records (operator 4).

For each response record, ``derive`` makes a metadata record (JSON: the source's WARC headers, HTTP status and headers,
title and links) and, of HTML and plain text, a conversion record (plain text). Both name the response in
WARC-Refers-To and keep its target URI, date and payload digest. Chunked transfer and gzip or deflate encodings are
undone; of other encodings and other content there is a metadata record only. A header that occurs several times keeps
all its values, as a list. Record ids follow from content, so a repeated run gives the same records.

Edge cases: null html is an empty payload and gives an empty text; a null url leaves the target header out; what isn't
a whole response record (malformed, cut off, of another type, or with a wrong digest) gives one row with an error and
no record; a file that is cut off or malformed gives its whole records and one row with an error; repeated rows each
give their records, and as ids follow from content there are no ties; texts of any length are read whole; an empty table
gives an empty result; key columns keep their values, and a key of the name of a derived column is an error.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from contextlib import suppress

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import P, text_batches

#: WARC-Date of responses made from tables that have none.
DATE = "1970-01-01T00:00:00Z"

DERIVED = "record_type string, record_id string, refers_to string, target_uri string, warc_date string, source_payload_digest string, block_digest string, content_length long, record binary, error string"

#: Bytes that a gzip member is fed at once, and about the most bytes of records in a batch.
GZIP_STEP, READ_BYTES = 16 << 10, 8 << 20

#: Most bytes that a compressed body may become.
DECODED_BYTES = 1 << 29

#: Content that has a plain text.
READABLE = ("text/html", "application/xhtml+xml", "text/plain")

# Elements whose content is no text, and elements that end a line.
HIDDEN = ("script", "style", "noscript", "template", "head")
BLOCKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())

_SKIP = re.compile(r"<!--.*?(?:-->|\Z)|<(" + "|".join(HIDDEN) + r")\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)\b[^<>]*>|<[!?/][^<>]*>")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_LINK = re.compile(r"<(a|link|area|img|iframe|script|source)\b[^<>]*?\b(href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+))", re.I)
_SPACES = re.compile(r"[^\S\n]+")


class Malformed(ValueError):
    pass


def sha1(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def build(headers: list[tuple[str, str]], block: bytes) -> bytes:
    clean = lambda x: re.sub(r"[\r\n]+", " ", x)  # noqa: E731  a header is one line
    head = "".join(f"{k}: {clean(v)}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in raw.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and out:  # a continued line
            out[-1] = out[-1][0], f"{out[-1][1]} {line.strip()}"
        elif ":" in line:
            k, v = line.split(":", 1)
            out.append((k.strip(), v.strip()))
    return out


def parse(raw: bytes, start: int = 0) -> tuple[list[tuple[str, str]], bytes, int]:
    """Headers and block of the record at ``start``, and where the next begins."""
    end = raw.find(b"\r\n\r\n", start)
    first = raw.find(b"\r\n", start)
    if not raw.startswith(b"WARC/1.", start) or end < 0:
        raise Malformed("no WARC header")
    headers = _headers(raw[first + 2 : end])
    length = get(headers, "Content-Length")
    if length is None or not length.isdigit():
        raise Malformed("no content length")
    stop = end + 4 + int(length)
    if stop > len(raw):
        raise Malformed("record cut off")
    return headers, raw[end + 4 : stop], stop + 4


def get(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def members(raw: bytes) -> Iterator[bytes]:
    """What the gzip members of a file hold. Each member is fed in steps, so that what follows it is not copied for each."""
    view, at = memoryview(raw), 0
    while at < len(raw):
        member, out = zlib.decompressobj(31), []
        try:
            while not member.eof:
                if at >= len(raw):
                    raise Malformed("a gzip member cut off")
                step = view[at : at + GZIP_STEP]
                out.append(member.decompress(step))
                at += len(step)
        except zlib.error as e:
            raise Malformed(f"bad gzip member: {e}") from e
        at -= len(member.unused_data)
        yield b"".join(out)


def split_records(raw: bytes) -> Iterator[bytes]:
    """The records of a file, plain or in gzip members."""
    for part in members(raw) if raw[:2] == b"\x1f\x8b" else (raw,):
        at = 0
        while at < len(part):
            _, _, after = parse(part, at)
            yield part[at:after]
            at = after


def unchunked(body: bytes) -> bytes:
    """A body in chunked transfer, put together."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size):
            raise Malformed("bad chunk")
        n = int(size, 16)
        if not n:
            return b"".join(out)
        if end + 2 + n > len(body):
            raise Malformed("chunk cut off")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def decoded(body: bytes, encoding: str) -> bytes | None:
    """A body without its content encodings; None if one isn't known or doesn't fit, or if over DECODED_BYTES come out."""
    for name in reversed([x.strip().lower() for x in encoding.split(",") if x.strip()]):
        if name == "identity":
            continue
        if name not in ("gzip", "x-gzip", "deflate"):
            return None
        for bits in (31,) if "gzip" in name else (15, -15):  # deflate is sent with and without a header
            try:
                stream = zlib.decompressobj(bits)
                made = stream.decompress(body, DECODED_BYTES)
            except zlib.error:
                continue
            if stream.eof:
                body = made
                break
        else:
            return None
    return body


def mapping(headers: list[tuple[str, str]]) -> dict[str, str | list[str]]:
    """Headers by name; one that occurs several times (in any case) has the list of its values."""
    values: dict[str, list[str]] = {}
    names: dict[str, str] = {}
    for k, v in headers:
        values.setdefault(names.setdefault(k.lower(), k), []).append(v)
    return {k: v[0] if len(v) == 1 else v for k, v in values.items()}


def response(url: str | None, body: bytes, date: str = DATE) -> bytes:
    """A response record with an HTML payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n"
    digest = sha1(body)
    target = [("WARC-Target-URI", url)] if url else []
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", url or "", digest)), ("WARC-Date", date), *target]
    return build([*headers, ("WARC-Payload-Digest", digest), ("WARC-Block-Digest", sha1(http + body)), ("Content-Type", "application/http; msgtype=response")], http + body)


def plain_text(page: str) -> str:
    """The text of HTML: hidden content goes, block elements end lines, white space collapses."""
    page = _SKIP.sub(" ", page)
    page = _TAG.sub(lambda m: "\n" if m[1] and m[1].lower() in BLOCKS else "", page)
    page = _SPACES.sub(" ", html.unescape(page) if "&" in page else page)
    return "\n".join(x for line in page.split("\n") if (x := line.strip()))


def page_facts(page: str) -> dict:
    title = _TITLE.search(page)
    links = [{"path": f"{m[0].upper()}@/{m[1].lower()}", "url": html.unescape(m[2] or m[3] or m[4])} for m in _LINK.findall(page)]
    return {"Head": {"Title": " ".join(html.unescape(title[1]).split()) if title else None}, "Links": links}


def derivatives(raw: bytes) -> list[tuple]:
    """Rows of DERIVED for one response record."""
    headers, block, _ = parse(raw)
    if get(headers, "WARC-Type") != "response":
        raise Malformed("not a response")
    source, target, date = get(headers, "WARC-Record-ID"), get(headers, "WARC-Target-URI"), get(headers, "WARC-Date")
    if not source:
        raise Malformed("no record id")
    cut = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or cut < 0:
        raise Malformed("no HTTP response")
    status, _, rest = block[:cut].partition(b"\r\n")
    version, code, reason = (status.decode("latin-1").split(" ", 2) + ["", ""])[:3]
    http = _headers(rest)
    payload = sent = block[cut + 4 :]
    if "chunked" in (get(http, "Transfer-Encoding") or "").lower():
        with suppress(Malformed):  # many archives store the body put together under the old header
            payload = unchunked(sent)
    digest = sha1(payload)
    for name, found in (("WARC-Payload-Digest", (digest, sha1(sent))), ("WARC-Block-Digest", (sha1(block),))):
        given = get(headers, name)
        if given and given.startswith("sha1:") and given not in found:
            raise Malformed(f"wrong {name}")
    content = (get(http, "Content-Type") or "text/html").lower()
    body = decoded(payload, get(http, "Content-Encoding") or "")
    page, text = "", None
    if body is not None and content.split(";")[0].strip() in READABLE:
        charset = re.search(r"charset=[\"']?([\w-]+)", content)
        try:
            page = body.decode(charset[1] if charset else "utf-8", "replace")
        except (LookupError, ValueError):  # not known, or not for such bytes
            page = body.decode("utf-8", "replace")
        text = page if content.startswith("text/plain") else plain_text(page)
    facts = {"HTML-Metadata": page_facts(page)} if text is not None and not content.startswith("text/plain") else {}
    envelope = {
        "Envelope": {
            "Format": "WARC", "WARC-Header-Metadata": mapping(headers), "Block-Digest": get(headers, "WARC-Block-Digest"),
            "Payload-Metadata": {"HTTP-Response-Metadata": {
                "Response-Message": {"Version": version, "Status": code, "Reason": reason}, "Headers": mapping(http), "Headers-Length": cut + 4,
                "Entity-Length": len(payload), "Entity-Digest": digest, **facts}},
        }
    }
    made = [("metadata", "application/json", json.dumps(envelope, ensure_ascii=False).encode("utf-8", "replace"))]
    if text is not None:
        made.append(("conversion", "text/plain", text.encode("utf-8", "replace")))
    out = []
    for kind, content, body in made:
        own, block_digest = record_id(kind, source, digest), sha1(body)
        linked = [("WARC-Target-URI", target)] if target else []
        lines = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date or DATE), *linked, ("WARC-Refers-To", source), ("WARC-Source-Payload-Digest", digest), ("WARC-Block-Digest", block_digest), ("Content-Type", content)]
        out.append((kind, own, source, target, date, digest, block_digest, len(body), build(lines, body), None))
    return out


def _derive(records: pd.Series) -> pd.Series:
    out = []
    for raw in records:
        try:
            out.append(derivatives(raw or b""))
        except Malformed as e:
            out.append([(None,) * 9 + (str(e),)])
    return pd.Series(out, dtype=object)


def _respond(url: pd.Series, page: pd.Series) -> pd.Series:
    return pd.Series([response(u, (p or "").encode("utf-8", "replace")) for u, p in zip(url, page)], dtype=object)


def responses(url: str | Column, page: str | Column) -> Column:
    """Response records of pages given as columns."""
    return F.pandas_udf(_respond, "binary")(url, page)


def derive(rows: DataFrame, record: str | Column, *keys: str) -> DataFrame:
    """``keys`` and the columns of DERIVED: two rows for each response in ``record``, or one with an error."""
    kind = "array<struct<" + ", ".join(":".join(x.split()) for x in DERIVED.split(",")) + ">>"
    if clash := {x.split()[0] for x in DERIVED.split(", ")} & set(keys):
        raise ValueError(f"keys have names of derived columns: {', '.join(sorted(clash))}")
    made = F.pandas_udf(_derive, kind)(record)
    return rows.select(*keys, F.explode(made).alias(f"{P}d")).select(*keys, f"{P}d.*")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """path, record and error of files that Spark can read: a row for each whole record, and one with an error and no
    record where a file can't be read on. One file (under 2 GB) is one task's work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content")):
                held, size = [], 0
                try:
                    for record in split_records(raw.as_py() or b""):
                        held.append((name, record, None))
                        size += len(record)
                        if size > READ_BYTES:
                            yield _rows(held)
                            held, size = [], 0
                except Malformed as e:
                    held.append((name, None, str(e)))
                yield _rows(held)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, record binary, error string")


def _rows(held: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, k in enumerate(kinds)], ["path", "record", "error"])


def gzip_member(record: bytes) -> bytes:
    """A record as a gzip member; members put together are a WARC file."""
    return gzip.compress(record, mtime=0)


def page_derivatives(pages: DataFrame) -> DataFrame:
    """Derivatives of a table of page_id, url and html, without the records' bytes but with their SHA-256."""
    text_batches(pages.sparkSession)
    out = derive(pages, responses("url", "html"), "page_id")
    return out.select(*(c for c in out.columns if c != "record"), F.sha2("record", 256).alias("record_sha256"))
