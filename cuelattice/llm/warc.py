"""WARC derivatives: from response records to linked metadata and plain-text conversion records."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.llm import html_text
from cuelattice.llm.common import small_batches

VERSION = "WARC/1.0"
# How the version lines of 1.0 and 1.1 begin, and go on.
MARK = b"WARC/1."
STARTS = (b"0\r\n", b"1\r\n")
RECORD = "record_id string, record_type string, target_uri string, warc_date string, refers_to string, content_type string, content_length long, block_digest string, headers map<string,string>, block binary"
# Content types whose payload is text.
TEXT_TYPES = ("text/html", "application/xhtml+xml", "text/plain", "text/xml", "application/xml")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def parse_record(raw: bytes) -> dict | None:
    """One record without its version line: named fields and block; None where it is no record.

    ``whole`` is false if fewer bytes are there than Content-Length says. Field names are kept in lower case.
    """
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap:
        return None
    headers: dict[str, str] = {}
    last = ""
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            headers[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            headers[last] = value.strip()
    if "warc-type" not in headers:
        return None
    try:
        length = int(headers.get("content-length", ""))
    except ValueError:
        return None
    return {"headers": headers, "block": rest[:length], "whole": len(rest) >= length}


def serialise(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v)
    return f"{VERSION}\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def split_http(block: bytes) -> tuple[int | None, dict[str, str], bytes]:
    """Status, header fields (lower case) and payload of an HTTP response; without a status line all is payload."""
    if not block.startswith(b"HTTP/"):
        return None, {}, block
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        head, _, body = block.partition(b"\n\n")
    lines = head.decode("iso-8859-1").replace("\r\n", "\n").split("\n")
    words = lines[0].split(None, 2)
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k.strip()}
    return (int(words[1]) if len(words) > 1 and words[1].isdigit() else None), fields, body


def decoded(fields: dict[str, str], body: bytes) -> bytes | None:
    """The payload without transfer and content encodings; None where an encoding isn't known or the bytes are no such.

    What a cut-off compressed body still holds is given.
    """
    if "chunked" in fields.get("transfer-encoding", "").lower():
        parts, at = [], 0
        while True:
            end = body.find(b"\r\n", at)
            size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
            if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
                if not parts:
                    return None
                break
            if not int(size, 16):
                break
            parts.append(body[end + 2 : end + 2 + int(size, 16)])
            at = end + 4 + int(size, 16)
        body = b"".join(parts)
    for name in reversed([x.strip().lower() for x in fields.get("content-encoding", "").split(",") if x.strip()]):
        if name in ("identity", "none"):
            continue
        if name not in ("gzip", "x-gzip", "deflate"):
            return None
        for bits in (31,) if "gzip" in name else (15, -15):
            try:
                unpacked = zlib.decompressobj(bits).decompress(body)
                break
            except zlib.error:
                continue
        else:
            return None
        body = unpacked
    return body


def is_text(kind: str, payload: bytes) -> bool:
    """By content type; without one, what holds no zero byte."""
    kind = kind.split(";")[0].strip().lower()
    return kind in TEXT_TYPES if kind else b"\0" not in payload


def page_text(payload: bytes, content_type: str) -> str:
    """All visible text of a page, a block a line; other text as it is."""
    kind, _, more = content_type.partition(";")
    charset = next((x.split("=", 1)[1].strip("\"' ") for x in more.split(";") if x.strip().lower().startswith("charset=")), "utf-8")
    try:
        text = payload.decode(charset, "replace")
    except LookupError:
        text = payload.decode("utf-8", "replace")
    if kind.strip().lower() == "text/plain":
        return text
    return "\n".join(b.text for b in html_text.blocks_of(text))


def derive(record_id: str, uri: str, date: str, block: bytes) -> list[tuple]:
    """The metadata record and, for a text payload, the conversion record of one response.

    Both refer to the response, carry its target and date, and have ids that follow from its id, so that a second run
    gives the same records. The metadata record holds the source's HTTP status and header fields, digests and lengths.
    Digests of the source are of the bytes as they were sent; text is made from the payload without its encodings.
    """
    status, fields, sent = split_http(block)
    payload = decoded(fields, sent)
    kind = fields.get("content-type", "")
    named = lambda what: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record_id}#{what}')}>"
    converted = bool(payload) and is_text(kind, payload)
    lines = {
        "http-status": "" if status is None else str(status),
        "source-block-digest": digest(block),
        "source-payload-digest": digest(sent),
        "source-payload-length": str(len(sent)),
        "conversion-record": named("conversion") if converted else "",
        "source-headers": json.dumps(fields, sort_keys=True, ensure_ascii=False),
    }
    about = "".join(f"{k}: {v}\r\n" for k, v in lines.items() if v).encode()

    def row(what: str, content_type: str, data: bytes, more: dict[str, str]) -> tuple:
        # A record's own payload is its block here; the source's digest goes under a name of its own.
        headers = {"WARC-Payload-Digest": digest(data), "WARC-Source-Payload-Digest": digest(sent), **more}
        return named(what), what, uri, date, record_id, content_type, len(data), digest(data), headers, data

    out = [row("metadata", "application/warc-fields", about, {})]
    if converted:
        out.append(row("conversion", "text/plain", page_text(payload, kind).encode("utf-8", "replace"), {"WARC-Source-Content-Type": kind}))
    return out


def derivatives(responses: DataFrame) -> DataFrame:
    """Responses (``record_id, target_uri, warc_date, block``) to rows of derived records.

    Null blocks count as empty: they have a metadata record only. Rows without a record id have no place to refer to
    and are left out; repeated rows give repeated records.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["record_id", "record_type", "target_uri", "warc_date", "refers_to", "content_type", "content_length", "block_digest", "headers", "block"]
        for pdf in batches:
            for lo in range(0, len(pdf), 200):
                p = pdf.iloc[lo : lo + 200]
                rows = [x for i, u, d, b in zip(p["record_id"], p["target_uri"], p["warc_date"], p["block"], strict=True) for x in derive(i, u, d, bytes(b))]
                yield pd.DataFrame(rows, columns=names)

    src = responses.where("record_id is not null").select("record_id", F.coalesce("target_uri", F.lit("")).alias("target_uri"), F.coalesce("warc_date", F.lit("")).alias("warc_date"), F.coalesce("block", F.lit(b"")).alias("block"))
    small_batches(responses.sparkSession)
    return src.mapInPandas(run, RECORD)


def _join(pieces: list[bytes], ended: bool) -> tuple[list[dict], list[bytes]]:
    """Records told from pieces of one file, parted at ``MARK``, and the pieces that wait for more of their record."""
    out: list[dict] = []
    at = 0
    while at < len(pieces):
        if pieces[at][:3] not in STARTS:
            at += 1
            continue
        to, raw, record = at + 1, pieces[at][3:], None
        while (record := parse_record(raw)) is None or not record["whole"]:
            if to == len(pieces) or (record is None and b"\r\n\r\n" in raw):
                break
            raw += MARK + pieces[to]
            to += 1
        if to == len(pieces) and not ended and (record is None or not record["whole"]):
            return out, pieces[at:]
        rest = raw.partition(b"\r\n\r\n")[2][len(record["block"]) :].strip(b"\r\n") if record else b""
        if to > at + 1 and (record is None or not record["whole"] or rest):
            # The length does not end at a record's end: the record was cut off, and others follow.
            to, record, rest = at + 1, parse_record(pieces[at][3:]), b""
        if rest:
            raise ValueError(f"{len(rest)} bytes between records after {record['headers'].get('warc-record-id')}")
        out += [record] if record else []
        at = to
    return out, []


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC/1.0 and 1.1 files (plain, or gzip by record) as ``record_type, record_id, target_uri, warc_date, block, whole``.

    Spark splits plain files at the beginning of version lines; the pieces of a file meet in order in one task, where
    those of a record that holds such a line are joined by its Content-Length. A record that was cut off has ``whole``
    false; bytes that belong to no record are an error.
    """
    raw = spark.read.option("lineSep", MARK.decode()).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("raw")
    )
    raw = raw.repartition("file").sortWithinPartitions("file", "start", "at")

    def rows(got: list[dict]) -> pd.DataFrame:
        h = [r["headers"] for r in got]
        return pd.DataFrame({
            "record_type": [x.get("warc-type") for x in h], "record_id": [x.get("warc-record-id") for x in h], "target_uri": [x.get("warc-target-uri") for x in h],
            "warc_date": [x.get("warc-date") for x in h], "refers_to": [x.get("warc-refers-to") for x in h], "block": [r["block"] for r in got], "whole": [r["whole"] for r in got],
        }, dtype=object)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, kept = None, []
        for pdf in batches:
            for name, part in pdf.groupby("file", sort=False):
                if name != file:
                    yield rows(_join(kept, True)[0])
                    file, kept = name, []
                got, kept = _join(kept + [bytes(x) for x in part["raw"]], False)
                yield rows(got)
        yield rows(_join(kept, True)[0])

    return raw.mapInPandas(parse, "record_type string, record_id string, target_uri string, warc_date string, refers_to string, block binary, whole boolean")


def write_warc(records: DataFrame, path: str) -> None:
    """Derived records as WARC text files below ``path``, one for each partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                headers = [("WARC-Type", r.record_type), ("WARC-Record-ID", r.record_id), ("WARC-Date", r.warc_date), ("WARC-Target-URI", r.target_uri), ("WARC-Refers-To", r.refers_to), ("Content-Type", r.content_type), ("WARC-Block-Digest", r.block_digest), *dict(r.headers).items()]
                # The line feed that ends a record is the one that Spark puts after each row.
                out.append(serialise(headers, bytes(r.block)).decode("utf-8").removesuffix("\n"))
            yield pd.DataFrame({"value": out})

    records.mapInPandas(run, "value string").write.option("lineSep", "\n").text(path)


def responses_of_pages(pages: DataFrame) -> DataFrame:
    """Pages (``page_id, url, html``) as response records, with an HTTP head before the page."""
    body = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 7919, F.lit(31536000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return pages.select(
        F.format_string("<urn:page:%d>", "page_id").alias("record_id"), F.col("url").alias("target_uri"), stamp.alias("warc_date"),
        F.concat(head, body).cast("binary").alias("block"), "page_id",
    )
