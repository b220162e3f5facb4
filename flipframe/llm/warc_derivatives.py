"""Web archives: metadata and plain-text conversion records derived from responses.

Every ``response`` record yields a ``metadata`` record (application/warc-fields: status, source
headers, title, language, out-links) and, when its payload is HTML or plain text, a
``conversion`` record (text/plain).  Each source header line is one ``source-header`` field of the
metadata record.  Both name their source: WARC-Refers-To holds the response's record id, the target
URI and date are the response's, and the source's own header lines and payload digest travel along
unchanged.  Record ids are derived from the source id and the type, so a rerun gives the same archive.

Rows that are no ``response``, or have no record id, derive nothing.  A null or empty block is a
response without HTTP headers or payload: it gives a metadata record only.  Repeated responses
derive repeated records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flipframe.llm.common import ready
from flipframe.llm.host_suffixes import blocks

#: Capture date that ``page_responses`` writes for tables that hold none.
CAPTURED = "2024-01-01T00:00:00Z"

RESPONSE_COLUMNS = ("page_id", "warc_type", "record_id", "target_uri", "warc_date", "headers", "block")

DERIVED_COLUMNS = [
    T.StructField(n, T.StringType())
    for n in ("warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "source_headers", "source_digest", "block_digest")
] + [T.StructField("content_length", T.LongType()), T.StructField("block", T.StringType())]

_NAME = re.compile(r"[A-Za-z][A-Za-z0-9:-]*")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'])(href|lang)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", re.I)
_END = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("title", "script", "style")}


def digest(data: bytes) -> str:
    """Labelled SHA-1 in base 32, as WARC digests are written."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source}#{kind}')}>"


def page_responses(pages: DataFrame, captured: str = CAPTURED) -> DataFrame:
    """The pages as response records, in Spark expressions only: an HTTP message per page, an id
    from the hash of the row and the source's WARC header lines."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    h = F.sha2(F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("")), url, body).cast("binary"), 256)
    ident = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body,
    )
    return pages.select(
        "page_id", F.lit("response").alias("warc_type"), ident.alias("record_id"), url.alias("target_uri"),
        F.lit(captured).alias("warc_date"), F.lit("Content-Type: application/http; msgtype=response").alias("headers"),
        http.cast("binary").alias("block"),
    )


def split_http(block: bytes) -> tuple[str, list[str], bytes]:
    """Status code, header lines and payload of an HTTP response message."""
    head, sep, payload = block.partition(b"\r\n\r\n")
    if not head.startswith(b"HTTP/"):
        return "", [], b""
    lines = head.decode("utf-8", "replace").split("\r\n")
    status = (lines[0].split(" ") + [""])[1]
    if any(re.match(r"transfer-encoding:.*chunked", x, re.I) for x in lines[1:]):
        payload = _dechunked(payload)
    return status, [x for x in lines[1:] if x], payload if sep else b""


def _dechunked(data: bytes) -> bytes:
    """The payload of a chunked body; a body that doesn't begin with a chunk size stays as it is, and
    a broken size later on ends it there."""
    out, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        size = data[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,16}", size):
            return b"".join(out) if out else data
        n = int(size, 16)
        if n == 0:
            break
        out.append(data[end + 2 : end + 2 + n])
        at = end + 4 + n
    return b"".join(out)


def _tag_end(text: str, at: int, last: dict[str, int]) -> int:
    """Place of the ">" that ends a tag whose attributes begin at ``at``, or -1.  A value in quotes may hold
    ">"; a quote that never closes is a plain character.  ``last`` has the last place of each quote, so no
    search runs to the end of the text twice."""
    while (gt := text.find(">", at)) >= 0:
        eq = text.find("=", at, gt)
        if eq < 0:
            return gt
        at = eq + 1
        while at < gt and text[at].isspace():
            at += 1
        if text[at] in last and at < last[text[at]]:
            at = text.find(text[at], at + 1) + 1
    return -1


def page_facts(text: str) -> tuple[str | None, str | None, list[str]]:
    """Title, language and link targets of a page in one pass; comments, scripts and styles hold none."""
    title, lang, links, at = None, None, [], 0
    endless: set[str] = set()
    last = {q: text.rfind(q) for q in "\"'"}
    while (lt := text.find("<", at)) >= 0:
        if text.startswith("<!--", lt):
            end = text.find("-->", lt + 4)
            if end < 0:
                break
            at = end + 3
            continue
        m = _NAME.match(text, lt + 1)
        if not m:
            at = lt + 1
            continue
        gt = _tag_end(text, m.end(), last)
        if gt < 0:
            break  # no tag ends after this place
        name, at = m.group().lower(), gt + 1
        if name in ("a", "html"):
            found: dict[str, str] = {}
            for k, v in _ATTRIBUTE.findall(text[m.end() : gt]):
                found.setdefault(k.lower(), html.unescape(v[1:-1] if v[0] in "\"'" else v))
            if name == "a" and "href" in found:
                links.append(_one_line(found["href"]))
            if name == "html" and lang is None and re.match(r"[A-Za-z-]+", found.get("lang", "")):
                lang = re.match(r"[A-Za-z-]+", found["lang"])[0].lower()
        elif name in _END and name not in endless:
            end = _END[name].search(text, at)
            if end is None:
                if name != "title":
                    break
                endless.add(name)  # no later title ends either
                continue
            if name == "title" and title is None:
                title = _one_line(html.unescape(text[at : end.start()]))
            at = end.end()
    return title, lang, links


def _field(lines: list[str], name: str) -> str:
    return next((x.split(":", 1)[1].strip() for x in lines if x.lower().startswith(name + ":")), "")


def _one_line(text: str) -> str:
    return " ".join(text.split())


def derive_one(ident: str, uri: str, date: str, headers: str, block: bytes) -> Iterator[dict]:
    """The derived records of one response."""
    status, lines, payload = split_http(block)
    source = {"refers_to": ident, "target_uri": uri, "warc_date": date, "source_digest": digest(payload)}
    kept = [x for x in headers.split("\r\n") if x] + lines
    source["source_headers"] = "\r\n".join(kept)
    kind = _field(lines, "content-type").split(";")[0].strip().lower()
    charset = re.search(r"charset=[\"']?([\w-]+)", _field(lines, "content-type"), re.I)
    try:
        text = payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        text = payload.decode("utf-8", "replace")
    fields = [("http-status", status), ("http-content-type", kind), ("payload-length", str(len(payload)))]
    plain = None
    if kind in ("text/html", "application/xhtml+xml"):
        title, lang, links = page_facts(text)
        fields += [("title", title)] if title is not None else []
        fields += [("language", lang)] if lang else []
        fields += [("outlink", x) for x in links]
        plain = "\n".join(t for _, t in blocks(text))
    elif kind == "text/plain":
        plain = text
    fields += [("source-header", re.sub(r"\r\n|\r|\n", "\r\n ", x)) for x in kept]  # a stray line end is folded
    made = [("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields))]
    if payload and plain is not None:
        made.append(("conversion", "text/plain; charset=utf-8", plain))
    for what, content, body in made:
        raw = body.encode("utf-8", "replace")
        yield source | {
            "warc_type": what, "record_id": record_id(ident, what), "content_type": content,
            "block_digest": digest(raw), "content_length": len(raw), "block": raw.decode("utf-8"),
        }


def derivatives(responses: DataFrame) -> DataFrame:
    """Derived records, with their blocks, of a table of RESPONSE_COLUMNS; ``page_id`` keeps its type."""
    ready(responses.sparkSession)
    spec = T.StructType([T.StructField("page_id", responses.schema["page_id"].dataType), *DERIVED_COLUMNS])
    src = responses.where((F.col("warc_type") == "response") & F.col("record_id").isNotNull()).select(*RESPONSE_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(spec)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(at, 256).to_pylist():
                    made = derive_one(r["record_id"], r["target_uri"] or "", r["warc_date"] or "", r["headers"] or "", bytes(r["block"] or b""))
                    out += [d | {"page_id": r["page_id"]} for d in made]
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return src.mapInArrow(run, spec)


def record_bytes(derived: DataFrame, column: str = "record") -> DataFrame:
    """Add each derived record as WARC 1.1 bytes: its header lines, an empty line, block, two line ends.

    A line end inside a value is percent-encoded in a URI and a blank elsewhere, so no value makes
    a header line of its own.
    """

    def line(name: str, c: str):
        v = F.col(c).cast("string")
        v = F.replace(F.replace(v, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")) if c == "target_uri" else F.translate(v, "\r\n", "  ")
        return F.concat(F.lit(f"{name}: "), v, F.lit("\r\n"))

    return derived.withColumn(
        column,
        F.concat(
            F.lit("WARC/1.1\r\n"), line("WARC-Type", "warc_type"), line("WARC-Record-ID", "record_id"), line("WARC-Refers-To", "refers_to"),
            line("WARC-Target-URI", "target_uri"), line("WARC-Date", "warc_date"), line("WARC-Refers-To-Date", "warc_date"),
            line("WARC-Source-Payload-Digest", "source_digest"), line("WARC-Block-Digest", "block_digest"),
            line("Content-Type", "content_type"), line("Content-Length", "content_length"), F.lit("\r\n"), F.col("block"), F.lit("\r\n\r\n"),
        ).cast("binary"),
    )
